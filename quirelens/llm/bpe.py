"""Byte-level BPE: texts to token ids with offsets, and ids back to bytes and text.

The vocabulary is a rank file (base64 token, blank, rank).  The tokenizers library
does the merges; rank files merge any two neighbours whose concatenation has a rank,
so every such split becomes a merge.  A batch is cut into pieces by array operations,
each different piece of it is merged once, and ids are gathered from there.
"""

from __future__ import annotations

import base64
import codecs
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelens.llm import arrays

#: Bytes of merged pieces that a worker keeps before it starts afresh, as it counts them.
CACHE = 16 << 20
#: Characters, bytes or ids handled at a time.
BLOCK = 1 << 18
#: Fixed value: the splitting pattern that array operations stand for; others go by regex.
BYTE_LEVEL = (
    r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
)
OTHER, LETTER, NUMBER, SPACE = range(4)


def byte_table() -> list[str]:
    """A printable character for each byte: itself where printable, else from 256 on."""
    keep = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(spare)) for b in range(256)]


def read_ranks(blob: bytes) -> dict[bytes, int]:
    return {base64.b64decode(t): int(r) for t, r in map(bytes.split, blob.splitlines()) if t}


@lru_cache(maxsize=1)
def character_classes() -> np.ndarray:
    import regex

    every = "".join("\0" if 0xD800 <= c < 0xE000 else chr(c) for c in range(0x110000))
    out = np.zeros(0x110000, np.uint8)
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", SPACE)):
        for m in regex.finditer(pattern, every):
            out[m.start() : m.end()] = kind
    return out


@lru_cache(maxsize=1)
def powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64."""
    base = 0x9E3779B97F4A7C15
    inverse = pow(base, -1, 1 << 64)
    out = []
    for b in (base, inverse):
        factors = np.full(2 << 18, b, np.uint64)
        factors[0] = 1
        out.append(np.cumprod(factors))
    return tuple(out)


def piece_starts(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where the matches of BYTE_LEVEL start; ``first`` marks the first character of a text."""
    n = len(codes)
    kind = character_classes()[codes]
    change = first.copy()
    change[1:] |= kind[1:] != kind[:-1]
    start = np.flatnonzero(change)
    end = np.append(start[1:], n)
    own = kind[start]
    last = np.append(first[start[1:]], True)  # last run of its text
    cut = np.zeros(n + 1, bool)
    cut[start] = True
    gap = (own == SPACE) & ~last
    blank = gap & (codes[end - 1] == 32)
    cut[end[blank]] = False  # the blank belongs to the run after it
    cut[end[gap] - 1] = True
    # contractions: one apostrophe that starts a match, then letters
    before = np.concatenate([[False], blank[:-1]])
    quote = np.flatnonzero((own == OTHER) & (end - start == 1) & (codes[start] == 39) & ~before & ~last)
    quote = quote[own[quote + 1] == LETTER]
    if len(quote):
        at, stop = start[quote], end[quote + 1]
        one = codes[at + 1]
        two = np.where(at + 2 < stop, codes[np.minimum(at + 2, n - 1)], 0)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = np.zeros(len(at), bool)
        for a, b in ("re", "ve", "ll"):
            long |= (one == ord(a)) & (two == ord(b))
        taken = short | long
        width = np.where(short, 2, 3)
        cut[at[taken] + 1] = False
        inside = taken & (at + width < stop)
        cut[at[inside] + width[inside]] = True
    return np.flatnonzero(cut[:n])


def gathered(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The slices ``flat[start:start+length]``, one after the other."""
    end = np.cumsum(length)
    at = np.arange(end[-1] if len(end) else 0, dtype=np.int64)
    return flat[at + np.repeat(start - (end - length), length)]


class Codec:
    """Encoder and decoder of one vocabulary; built once per worker."""

    def __init__(self, blob: bytes, pattern: str):
        import regex
        from tokenizers import models

        table = byte_table()
        ranks = read_ranks(blob)
        spelt = {t: "".join(table[b] for b in t) for t in ranks}
        merges = [
            (spelt[t[:i]], spelt[t[i:]])
            for t in sorted(ranks, key=ranks.get)
            for i in range(1, len(t))
            if t[:i] in ranks and t[i:] in ranks
        ]
        self._split = None if pattern == BYTE_LEVEL else regex.compile(pattern)
        self._model = models.BPE(
            vocab={spelt[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True
        )
        self._spell = dict(enumerate(table))
        # back from characters to bytes: the table read the other way
        byte = {c: b for b, c in enumerate(table)}
        self._bytes = {r: bytes(byte[c] for c in spelt[t]) for t, r in ranks.items()}
        most = max(ranks.values(), default=-1) + 1
        self._width = np.array([len(self._bytes.get(r, b"")) for r in range(most)], np.int64)
        self._at = np.cumsum(self._width) - self._width
        self._flat = np.frombuffer(b"".join(self._bytes.get(r, b"") for r in range(most)), np.uint8)
        self._pieces: dict[str, bytes] = {}
        self._kept = 0

    def _ids(self, piece: str) -> bytes:
        found = self._pieces.get(piece)
        if found is None:
            spelling = piece.encode().decode("latin-1").translate(self._spell)
            found = np.array([t.id for t in self._model.tokenize(spelling)], "<u4").tobytes()
            size = 200 + 4 * len(piece) + len(found)
            if self._kept + size > CACHE:
                self._pieces.clear()
                self._kept = 0
            if size <= CACHE:
                self._pieces[piece] = found
                self._kept += size
        return found

    def _block(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts, one after the other, and how many each has."""
        joined = "".join(texts)
        if not joined:
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        sizes = np.array([len(t) for t in texts])
        begins = np.cumsum(sizes) - sizes
        codes = np.frombuffer(joined.encode("utf-32-le"), "<u4")
        first = np.zeros(len(codes), bool)
        first[begins[sizes > 0]] = True
        if self._split is None:
            start = piece_starts(codes, first)
        else:
            start = np.concatenate(
                [[m.start() + b for m in self._split.finditer(t)] for t, b in zip(texts, begins)]
            ).astype(np.int64)
        end = np.append(start[1:], len(codes))
        power, inverse = powers()
        if len(codes) < len(power):
            sums = np.zeros(len(codes) + 1, np.uint64)
            np.cumsum((codes + np.uint64(1)) * power[: len(codes)], out=sums[1:])
            key = (sums[end] - sums[start]) * inverse[start]
        else:  # one text without a place to cut it
            key = np.arange(len(start))
        _, at, back = np.unique(key, return_index=True, return_inverse=True)
        found = [self._ids(joined[a:b]) for a, b in zip(start[at].tolist(), end[at].tolist())]
        length = np.array([len(x) // 4 for x in found], np.int64)
        ids = gathered(
            np.frombuffer(b"".join(found), "<u4"), (np.cumsum(length) - length)[back], length[back]
        )
        total = np.concatenate([[0], np.cumsum(length[back])])
        edges = np.searchsorted(start, np.append(begins, len(codes)))
        return ids, np.diff(total[edges])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of whole texts, one after the other, and the number of ids of each text."""
        ids, sizes, waiting, held = [], [], [], 0

        def flush():
            nonlocal waiting, held
            if waiting:
                got, each = self._block([p for _, p in waiting])
                ids.append(got)
                np.add.at(counts, [i for i, _ in waiting], each)
                waiting, held = [], 0

        counts = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            for part in parts(text or ""):
                if held + len(part) > BLOCK:
                    flush()
                waiting.append((i, part))
                held += len(part)
        flush()
        return (np.concatenate(ids) if ids else np.zeros(0, np.uint32)), counts

    def starts(self, text: str) -> np.ndarray:
        """Character offset of each token; tokens that begin in one character share its offset."""
        ids, _ = self.encode([text])
        width = self._width[ids]
        raw = np.frombuffer(text.encode(), np.uint8)
        # a byte that is no continuation starts a character
        character = np.cumsum((raw & 0xC0) != 0x80) - 1
        return character[np.cumsum(width) - width].astype(np.int32) if len(ids) else np.zeros(0, np.int32)

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all ids, one after the other, and the number of bytes of each id."""
        data, widths = [self._flat[:0]], [self._width[:0]]
        for i in range(0, len(ids), BLOCK // 4):
            own = ids[i : i + BLOCK // 4]
            width = self._width[own]
            data.append(gathered(self._flat, self._at[own], width))
            widths.append(width.astype(np.int32))
        return np.concatenate(data), np.concatenate(widths)

    def token_texts(self, ids: np.ndarray) -> list[str]:
        """Text that each token completes: a character split over tokens goes to the last."""
        decoder = codecs.getincrementaldecoder("utf-8")("replace")
        texts = [decoder.decode(self._bytes[i]) for i in ids.tolist()]
        if texts:
            texts[-1] += decoder.decode(b"", final=True)
        return texts


def parts(text: str) -> list[str]:
    """The text cut into blocks before white space that follows something else.

    No match of BYTE_LEVEL crosses such a place and none looks back over it.
    """
    out = []
    at = 0
    while len(text) - at > BLOCK:
        cut = text.rfind(" ", at + 1, at + BLOCK)
        while cut > at and text[cut - 1].isspace():
            cut = text.rfind(" ", at + 1, cut)
        if cut <= at:
            cut = text.find(" ", at + BLOCK)
            while cut > 0 and text[cut - 1].isspace():
                cut = text.find(" ", cut + 1)
            if cut < 0:
                break
        out.append(text[at:cut])
        at = cut
    return [*out, text[at:]]


@lru_cache(maxsize=2)
def codec(blob: bytes, pattern: str) -> Codec:
    return Codec(blob, pattern)


class BytePairs:
    """Column functions of one vocabulary file.

    ``path`` is read on the driver and broadcast: a vocabulary file has a fixed size.
    Null text encodes like empty text, to no ids; null ids decode to no bytes.
    """

    def __init__(self, spark: SparkSession, path: str, pattern: str = BYTE_LEVEL):
        with open(path, "rb") as f:
            self._blob = spark.sparkContext.broadcast(f.read())
        self._pattern = pattern

    def _function(self, kind: str, work):
        blob, pattern = self._blob, self._pattern

        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            own = codec(blob.value, pattern)
            for batch in batches:
                for part in arrays.steps(batch, BLOCK):
                    yield work(own, part)

        return F.arrow_udf(run, kind)

    def encode(self, text: Column) -> Column:
        """array<int> of token ids."""
        return self._function("array<int>", _encoded)(text)

    def round_trip(self, text: Column) -> Column:
        """struct<ids array<int>, decoded binary, same boolean>: ids, the bytes made from the
        ids alone, and whether these are the text's bytes."""

        def work(own: Codec, texts: pa.Array) -> pa.Array:
            ids = _encoded(own, texts)
            decoded = _decoded(own, ids)
            want = texts.fill_null("").cast(pa.binary())
            return pa.StructArray.from_arrays(
                [ids, decoded, pc.equal(decoded, want)], names=["ids", "decoded", "same"]
            )

        return self._function("ids array<int>, decoded binary, same boolean", work)(text)

    def packed(self, text: Column) -> Column:
        """struct<n_tokens long, ids binary, decoded binary>: ids as unsigned 32-bit integers,
        little-endian, and the bytes made from them."""

        def work(own: Codec, texts: pa.Array) -> pa.Array:
            ids = _encoded(own, texts)
            return pa.StructArray.from_arrays(
                [ids.value_lengths().cast(pa.int64()), _little_endian(ids), _decoded(own, ids)],
                names=["n_tokens", "ids", "decoded"],
            )

        return self._function("n_tokens long, ids binary, decoded binary", work)(text)

    def starts(self, text: Column) -> Column:
        """array<int>: where in the text, in characters, each token starts."""

        def work(own: Codec, texts: pa.Array) -> pa.Array:
            found = [own.starts(t or "") for t in texts.to_pylist()]
            flat = np.concatenate([np.zeros(0, np.int32), *found])
            return pa.ListArray.from_arrays(_edges([len(x) for x in found]), pa.array(flat))

        return self._function("array<int>", work)(text)

    def decode_bytes(self, ids: Column) -> Column:
        """binary: the bytes that the ids stand for."""
        return self._function("binary", _decoded)(ids)

    def decode(self, ids: Column) -> Column:
        """Text of the ids; bytes that are no UTF-8 become U+FFFD."""

        def work(own: Codec, lists: pa.Array) -> pa.Array:
            return pa.array([b.decode("utf-8", "replace") for b in _decoded(own, lists).to_pylist()], pa.string())

        return self._function("string", work)(ids)

    def token_texts(self, ids: Column) -> Column:
        """array<string>: the text of each token, split characters with their last token."""

        def work(own: Codec, lists: pa.Array) -> pa.Array:
            flat, sizes = _flat(lists)
            edge = np.cumsum([0, *sizes])
            found = [own.token_texts(flat[a:b]) for a, b in zip(edge[:-1], edge[1:])]
            return pa.array(found, pa.list_(pa.string()))

        return self._function("array<string>", work)(ids)


def _edges(sizes) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), pa.int32())


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All ids and the number per row; a null row has none."""
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return lists.flatten().to_numpy(zero_copy_only=False), sizes


def _decoded(own: Codec, lists: pa.Array) -> pa.Array:
    flat, sizes = _flat(lists)
    data, width = own.decode(flat)
    total = np.concatenate([[0], np.cumsum(width)])
    edge = total[np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(edge), pa.py_buffer(data)])


def _encoded(own: Codec, texts: pa.Array) -> pa.Array:
    ids, sizes = own.encode(texts.to_pylist())
    return pa.ListArray.from_arrays(_edges(sizes), pa.array(ids.view(np.int32)))


def _little_endian(lists: pa.Array) -> pa.Array:
    flat, sizes = _flat(lists)
    edge = (4 * np.concatenate([[0], np.cumsum(sizes)])).astype(np.int32)
    data = np.ascontiguousarray(flat.astype("<i4"))
    return pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(edge), pa.py_buffer(data)])


def little_endian(ids: Column) -> Column:
    """binary: the ids as unsigned 32-bit integers, little-endian."""

    def packed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for part in arrays.steps(batch, BLOCK):
                yield _little_endian(part)

    return F.arrow_udf(packed, "binary")(ids)


def round_trip(docs: DataFrame, pairs: BytePairs) -> DataFrame:
    """``docs`` with ``ids`` and ``decoded``, the text made from the ids alone."""
    return docs.withColumn("ids", pairs.encode(F.col("text"))).withColumn(
        "decoded", pairs.decode(F.col("ids"))
    )


def digests(docs: DataFrame, pairs: BytePairs) -> DataFrame:
    """One row per document: n_tokens, ids_sha256, decoded_sha256.

    Null and empty text give no tokens and the digest of no bytes.  Rows are handled
    one by one, so repeated rows and null ids stay as they are; other columns are dropped.
    """
    return docs.select("doc_id", pairs.packed(F.col("text")).alias("_packed")).select(
        "doc_id",
        F.col("_packed.n_tokens").alias("n_tokens"),
        F.sha2("_packed.ids", 256).alias("ids_sha256"),
        F.sha2("_packed.decoded", 256).alias("decoded_sha256"),
    )
