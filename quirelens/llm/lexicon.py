"""BPE encoding over a minimal acyclic transducer of frequent words, and decoding.

Words (the matches of the byte-level splitting pattern) are counted over all documents.
The most frequent ones are compiled into an acyclic automaton whose equal suffixes are
one state: each step to a next byte adds a number, and the sum over a word is the place
of its token ids.  The automaton is a file of flat arrays that all workers of an executor
map into memory; every word of a text walks it at once, one array operation for each
byte of the longest.  A word that the automaton refuses is merged by the tokenizer's
own model, so ids never depend on which words were compiled.
"""

from __future__ import annotations

import json
import re
import uuid
from array import array
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelens.llm import arrays, bpe
from quirelens.llm.rows import shared_file, written

#: Words that are compiled at most; the rest is merged when met.
WORDS = 1 << 18
#: A word is worth a place when it is seen this often.
SEEN = 2
#: Bytes of text handled at a time.
STEP = 1 << 19
#: Merged words that a worker remembers, and the longest of them in bytes.
MERGED, MERGED_BYTES = 50_000, 64
_FIRST_SLOT = 256


# -- the automaton ---------------------------------------------------------------


def minimal_states(words: Sequence[bytes]) -> list[tuple[bool, bytes, tuple[int, ...]]]:
    """States (accepting, bytes, next states) of the least automaton of the sorted words.

    A state is closed as soon as no later word can pass it, and then shared with an equal
    one; so next states come before their users and the start state is the last.
    """
    known: dict[tuple, int] = {}
    states: list[tuple[bool, bytes, tuple[int, ...]]] = []
    path: list[tuple[list[bool], bytearray, list[int]]] = [([False], bytearray(), [])]

    def close(depth: int) -> None:
        while len(path) > depth + 1:
            accepting, labels, following = path.pop()
            key = (accepting[0], bytes(labels), tuple(following))
            at = known.get(key)
            if at is None:
                at = known[key] = len(states)
                states.append(key)
            path[-1][2].append(at)

    before = b""
    for word in words:
        same = 0
        for a, b in zip(before, word):
            if a != b:
                break
            same += 1
        close(same)
        for b in word[same:]:
            path[-1][1].append(b)
            path.append(([False], bytearray(), []))
        path[-1][0][0] = True
        before = word
    close(0)
    accepting, labels, following = path[0]
    states.append((accepting[0], bytes(labels), tuple(following)))
    return states


def _bases(states: Sequence[tuple[bool, bytes, tuple[int, ...]]]) -> tuple[list[int], int]:
    """Where each state's row of steps lies in one common table without overlap."""
    used = bytearray(b"\1" * _FIRST_SLOT) + bytearray(4096)
    base = [0] * len(states)
    wide = narrow = top = _FIRST_SLOT
    for s in sorted(range(len(states)), key=lambda s: -len(states[s][1])):
        labels = states[s][1]
        if not labels:
            continue
        if len(used) < top + 1024:
            used += bytearray(len(used))
        at, tries = used.find(0, narrow if len(labels) == 1 else wide), 0
        while any(used[at + b - labels[0]] for b in labels):
            at = used.find(0, at + 1)
            tries += 1
        base[s] = at - labels[0]
        for b in labels:
            used[base[s] + b] = 1
        top = max(top, base[s] + labels[-1])
        if len(labels) == 1:
            narrow = at
        elif tries > 32:  # dense up to here: later rows with one step fill the holes
            wide = at
    return base, len(used) + 256


def compiled(words: Sequence[bytes], ids: Sequence[Sequence[int]]) -> bytes:
    """The file of the transducer: sorted distinct words and the token ids of each."""
    states = minimal_states(words)
    base, size = _bases(states)
    below = [0] * len(states)  # words that a state accepts
    table = np.full((size, 3), -1, np.int32)  # owner, next state, number to add
    for s, (accepting, labels, following) in enumerate(states):
        n = int(accepting)
        for b, t in zip(labels, following):
            table[base[s] + b] = s, t, n
            n += below[t]
        below[s] = n
    lengths = np.array([len(x) for x in ids], np.int64)
    parts = {
        "base": np.array(base, np.int32),
        "accepting": np.array([s[0] for s in states], np.uint8),
        "table": table,
        "start": np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64),
        "ids": np.array([i for x in ids for i in x], np.uint32),
    }
    head, at = {}, 0
    for name, part in parts.items():
        head[name] = (part.dtype.str, part.shape, at)
        at += -(-part.nbytes // 8) * 8
    front = json.dumps(head).encode()
    front += b" " * (-(len(front) + 8) % 8)
    blob = bytearray(len(front).to_bytes(8, "little") + front)
    for part in parts.values():
        blob += part.tobytes() + b"\0" * (-part.nbytes % 8)
    return bytes(blob)


class Transducer:
    """The compiled words; ``data`` is a mapped file, or bytes."""

    def __init__(self, data):
        raw = np.frombuffer(data, np.uint8) if isinstance(data, bytes) else data
        front = 8 + int.from_bytes(bytes(raw[:8]), "little")
        for name, (kind, shape, at) in json.loads(bytes(raw[8:front])).items():
            count = int(np.prod(shape))
            size = count * np.dtype(kind).itemsize
            setattr(self, name, raw[front + at : front + at + size].view(kind).reshape(shape))
        self.root = len(self.base) - 1

    def numbers(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Number of each word data[start:end] in the sorted lexicon, or -1.

        Of short words, each different one walks once: up to seven bytes and the length
        fit into one number, so equal numbers are equal words.
        """
        if not len(self.ids):
            return np.full(len(start), -1, np.int64)
        size = end - start
        short = np.flatnonzero(size < 8)
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        eight = np.lib.stride_tricks.as_strided(padded.view(np.uint8), (len(data) + 1, 8), (1, 1))
        key = np.ascontiguousarray(eight[start[short]]).view("<u8").ravel()
        key &= (np.uint64(1) << (8 * size[short]).astype(np.uint64)) - np.uint64(1)
        key |= size[short].astype(np.uint64) << np.uint64(56)
        _, one, back = np.unique(key, return_index=True, return_inverse=True)
        long = np.flatnonzero(size >= 8)
        walked = np.concatenate([short[one], long])
        found = self._walk(data, start[walked], end[walked])
        out = np.empty(len(start), np.int64)
        out[short] = found[: len(one)][back]
        out[long] = found[len(one) :]
        return out

    def _walk(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = np.full(len(start), -1, np.int64)
        alive = np.flatnonzero(end > start)
        at, stop = start[alive], end[alive]
        state = np.full(len(alive), self.root, np.int32)
        total = np.zeros(len(alive), np.int64)
        while len(alive):
            step = self.table[self.base[state] + data[at]]
            known = step[:, 0] == state
            at = at + 1
            done = known & (at == stop)
            total += step[:, 2]
            last = step[done, 1]
            good = self.accepting[last] != 0
            out[alive[done][good]] = total[done][good]
            go = known & ~done
            alive, at, stop, total, state = alive[go], at[go], stop[go], total[go], step[go, 1]
        return out


# -- encoder and decoder of one worker -------------------------------------------


class Codec:
    """Encoder and decoder of one tokenizer file; built once per worker."""

    def __init__(self, file: str, transducer: Transducer | None = None):
        from tokenizers import Tokenizer

        spec = json.loads(file)
        splitter = spec.get("pre_tokenizer") or {}
        if spec["model"]["type"] != "BPE" or splitter.get("type") != "ByteLevel" or spec.get("normalizer"):
            raise ValueError("only byte-level BPE without a normalizer is supported")
        if splitter.get("add_prefix_space") or not splitter.get("use_regex", True):
            raise ValueError("only the plain byte-level splitting pattern is supported")
        self._special = {}
        for token in spec["added_tokens"]:
            if token["single_word"] or token["lstrip"] or token["rstrip"]:
                raise ValueError("added tokens that take in blanks are not supported")
            self._special[token["content"]] = token["id"]
        longest = sorted(self._special, key=len, reverse=True)
        self._find = re.compile("|".join(map(re.escape, longest))) if longest else None
        self._model = Tokenizer.from_str(file).model
        self._words = transducer
        self._spell = dict(enumerate(bpe.byte_table()))
        byte = {c: b for b, c in self._spell.items()}
        tokens = spec["model"]["vocab"] | self._special
        spelt = [b""] * (max(tokens.values(), default=-1) + 1)
        for token, i in tokens.items():
            plain = all(c in byte for c in token)
            spelt[i] = bytes(byte[c] for c in token) if plain else token.encode()
        self._width = np.array([len(x) for x in spelt] + [0], np.int64)  # unknown ids: no bytes
        self._at = np.cumsum(self._width) - self._width
        self._flat = np.frombuffer(b"".join(spelt), np.uint8)
        self._merged: dict[bytes, bytes] = {}

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word by the tokenizer's model."""
        return [t.id for t in self._model.tokenize(word.decode("latin-1").translate(self._spell))]

    def _unseen(self, word: bytes) -> bytes:
        found = self._merged.get(word)
        if found is None:
            found = array("I", self.merge(word)).tobytes()
            if len(word) <= MERGED_BYTES:
                if len(self._merged) >= MERGED:
                    self._merged.clear()
                self._merged[word] = found
        return found

    def split(self, data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, ...]:
        """Start, end, text number and fixed id (else -1) of each piece of the texts
        data[edges[i]:edges[i+1]]; pieces with a fixed id are added tokens."""
        text = data.tobytes().decode()
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        begins = np.searchsorted(lead, edges)  # in characters
        size = len(lead)
        none = np.zeros(0, np.int64)
        if not size:
            return none, none, none, none
        codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
        first = np.zeros(size + 1, bool)
        first[begins] = True
        inside, fixed = np.zeros(size + 1, bool), {}
        if self._find is not None and self._find.search(text):
            for a, b in zip(begins[:-1].tolist(), begins[1:].tolist()):
                for m in self._find.finditer(text[a:b]):
                    begin, stop = a + m.start(), a + m.end()
                    first[[begin, stop]] = True
                    inside[begin + 1 : stop] = True
                    fixed[begin] = self._special[m.group()]
        start = bpe.piece_starts(codes, first[:-1])
        start = start[~inside[start]]
        known = np.full(len(start), -1, np.int64)
        if fixed:
            known[np.searchsorted(start, list(fixed))] = list(fixed.values())
        owner = np.searchsorted(begins, start, "right") - 1
        place = np.append(lead, len(data))
        return place[start], place[np.append(start[1:], size)], owner, known

    def encode(self, data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts, one after the other, and the number of ids of each text."""
        start, end, owner, fixed = self.split(data, edges)
        words = self._words
        number = words.numbers(data, start, end) if words is not None else np.full(len(start), -1, np.int64)
        number[fixed >= 0] = -1
        seen = number >= 0
        raw = data.tobytes()
        other = np.flatnonzero(~seen)
        found = [
            int(f).to_bytes(4, "little") if f >= 0 else self._unseen(raw[a:b])
            for f, a, b in zip(fixed[other].tolist(), start[other].tolist(), end[other].tolist())
        ]
        length = np.zeros(len(start), np.int64)
        length[other] = [len(x) // 4 for x in found]
        ids = np.empty(0, np.uint32)
        if words is not None and seen.any():
            begin = words.start[number[seen]]
            length[seen] = words.start[number[seen] + 1] - begin
            ids = np.empty(int(length.sum()), np.uint32)
            listed = np.repeat(seen, length)
            ids[listed] = arrays.gathered(words.ids, begin, length[seen])
            ids[~listed] = np.frombuffer(b"".join(found), "<u4")
        elif found:
            ids = np.frombuffer(b"".join(found), "<u4")
        counts = np.bincount(owner, length, len(edges) - 1).astype(np.int64)
        return ids, counts

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[bytes, np.ndarray]:
        """UTF-8 of the texts that the ids stand for, and the number of bytes of each;
        bytes that are no UTF-8 become U+FFFD."""
        known = np.where((ids >= 0) & (ids < len(self._width) - 1), ids, len(self._width) - 1)
        width = self._width[known]
        data = arrays.gathered(self._flat, self._at[known], width)
        edge = np.concatenate([[0], np.cumsum(width)])[np.concatenate([[0], np.cumsum(sizes)])]
        raw = data.tobytes()
        whole = not (data[edge[:-1][edge[:-1] < len(data)]] & 0xC0 == 0x80).any()
        if whole:
            try:
                raw.decode()
            except UnicodeDecodeError:
                whole = False
        if whole:
            return raw, np.diff(edge)
        texts = [raw[a:b].decode("utf-8", "replace").encode() for a, b in zip(edge[:-1], edge[1:])]
        return b"".join(texts), np.array([len(t) for t in texts], np.int64)


@lru_cache(maxsize=2)
def _codec(name: str, file: str) -> Codec:
    return Codec(file, Transducer(np.memmap(SparkFiles.get(name), np.uint8, "r")))


# -- Spark -----------------------------------------------------------------------


def word_counts(docs: DataFrame) -> DataFrame:
    """``(word, n)`` over all texts: how often each match of the splitting pattern occurs."""
    matches = F.regexp_extract_all("text", F.lit(bpe.BYTE_LEVEL), F.lit(0))
    return docs.select(F.explode(matches).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def frequent(counts: DataFrame, most: int = WORDS, seen: int = SEEN) -> list[bytes]:
    """The most frequent words, at most ``most`` of them, sorted.

    A histogram of the counts gives the least count with which all words of that count
    fit; ties at the edge stay out together, so the list does not depend on any order.
    """
    kept = written(counts.where(F.col("n") >= seen))
    sizes = kept.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).limit(most)
    least, total = None, 0
    for r in sizes.collect():
        total += r.words
        if total > most:
            break
        least = r.n
    if least is None:
        return []
    words = kept.where(F.col("n") >= least).select("word").toArrow()["word"].to_pylist()
    return sorted(w.encode() for w in words)


class WordPieces:
    """Column functions of one tokenizer file and a compiled lexicon.

    Null text encodes like empty text, to no ids; null ids decode to the empty text.  Ids
    are those of the tokenizers library with its added tokens found in the text, whatever
    ``words`` holds.  Words compiled and the file are bounded (``WORDS``); texts are not:
    a step is ``STEP`` bytes, or one text.
    """

    def __init__(self, spark: SparkSession, path: str, words: Sequence[bytes] = ()):
        with open(path, encoding="utf-8") as f:
            file = f.read()
        own = Codec(file)
        words = sorted(set(words) - {b""})
        self.name = f"lexicon-{uuid.uuid4().hex}"
        blob = compiled(words, [own.merge(w) for w in words])
        # through the shared folder to every executor, which maps its own copy
        spark.sparkContext.addFile(shared_file(spark, self.name, blob))
        self._file = spark.sparkContext.broadcast(file)

    @classmethod
    def fitted(cls, docs: DataFrame, path: str, most: int = WORDS) -> WordPieces:
        """With the frequent words of all texts of ``docs`` compiled."""
        return cls(docs.sparkSession, path, frequent(word_counts(docs), most))

    def _function(self, kind: str, work):
        name, file = self.name, self._file

        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            own = _codec(name, file.value)
            for batch in batches:
                for part in arrays.steps(batch, STEP):
                    yield work(own, part)

        return F.arrow_udf(run, kind)

    def encode(self, text: Column) -> Column:
        """array<int> of token ids."""
        return self._function("array<int>", _ids)(text)

    def decode(self, ids: Column) -> Column:
        """Text of the ids."""
        return self._function("string", _texts)(ids)

    def round_trip(self, text: Column) -> Column:
        """struct<ids array<int>, decoded string>, the text made from the ids alone."""

        def work(own: Codec, texts: pa.Array) -> pa.Array:
            ids = _ids(own, texts)
            return pa.StructArray.from_arrays([ids, _texts(own, ids)], names=["ids", "decoded"])

        return self._function("ids array<int>, decoded string", work)(text)


    def packed(self, text: Column) -> Column:
        """struct<n_tokens long, ids binary, decoded string>: ids as unsigned 32-bit integers,
        little-endian, and the text made from them."""

        def work(own: Codec, texts: pa.Array) -> pa.Array:
            ids = _ids(own, texts)
            size = ids.value_lengths().cast(pa.int64())
            edge = np.concatenate([[0], np.cumsum(4 * size.to_numpy())]).astype(np.int32)
            flat = np.ascontiguousarray(ids.values.to_numpy().astype("<i4"))
            raw = pa.Array.from_buffers(
                pa.binary(), len(ids), [None, pa.py_buffer(edge), pa.py_buffer(flat)]
            )
            return pa.StructArray.from_arrays([size, raw, _texts(own, ids)], names=["n_tokens", "ids", "decoded"])

        return self._function("n_tokens long, ids binary, decoded string", work)(text)


def _ids(own: Codec, texts: pa.Array) -> pa.Array:
    ids, sizes = own.encode(*arrays.flat(texts))
    edge = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(edge), pa.array(ids.view(np.int32)))


def _texts(own: Codec, lists: pa.Array) -> pa.Array:
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
    raw, width = own.decode(flat, sizes)
    edge = np.concatenate([[0], np.cumsum(width)]).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(lists), [None, pa.py_buffer(edge), pa.py_buffer(raw)])


def encoded(docs: DataFrame, pieces: WordPieces) -> DataFrame:
    """``docs`` with ``ids`` and ``decoded``; columns of ``docs`` with these names are replaced."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("ids", "decoded")]
    return docs.select(*rest, pieces.round_trip(F.col("text")).alias("_pair")).select(
        *rest, F.col("_pair.ids").alias("ids"), F.col("_pair.decoded").alias("decoded")
    )


def digests(docs: DataFrame, pieces: WordPieces) -> DataFrame:
    """One row per document: n_tokens, ids_sha256, decoded_sha256; other columns are dropped.

    Null and empty text give no tokens and the digest of no bytes.  Rows are handled one
    by one, so repeated rows and null ids stay as they are.
    """
    return docs.select("doc_id", pieces.packed(F.col("text")).alias("_packed")).select(
        "doc_id",
        F.col("_packed.n_tokens").alias("n_tokens"),
        F.sha2("_packed.ids", 256).alias("ids_sha256"),
        F.sha2(F.col("_packed.decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
