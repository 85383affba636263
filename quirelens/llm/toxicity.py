"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A word is a run of letters, lower-cased.  Its input is an embedding of the word, if
fitting has seen it often enough, beside the mean embedding of its hashed character
trigrams and prefixes.  The network reads overlapping windows of words; a text scores as its worst
window.  It is trained in numpy: a text's loss is that of the window it scores by.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelens.llm.arrays import gathered, mixed, span_hashes, steps
from quirelens.llm.langid import _is_letter
from quirelens.llm.rows import bounded_sample

#: Words in a window and between the starts of two windows.
WINDOW, STRIDE = 24, 6
WORD, CHAR, HIDDEN = 12, 12, 8
TRIGRAMS = 8192
#: Prefixes of so many letters go with the trigrams: stems that take unseen endings.
PREFIXES = (4, 5)
#: Words with an embedding of their own: the most frequent ones in this many texts or more.
VOCABULARY, LEAST_TEXTS = 20_000, 3
#: Labelled rows and the length of texts that the network is fitted on.
FIT_ROWS, FIT_CHARS = 4_000, 20_000
FIT_GROUP = 200
EPOCHS, TEXTS_PER_STEP = 4, 64
#: A small sample is passed more often, until there were this many steps.
LEAST_STEPS = 150
#: Characters and windows handled at a time, and windows that blocks of a text share.
BLOCK, WINDOWS, SHARED = 1 << 19, 2048, 8


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text number and hash of each word; character features of all words and their edges."""
    letter = _is_letter()
    lowered = [t.lower() for t in texts]
    codes = np.frombuffer((" ".join(lowered) + " ").encode("utf-32-le", "surrogatepass"), "<u4")
    inside = letter[codes]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    start = np.flatnonzero(first)
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    end = np.flatnonzero(last) + 1
    begins = np.cumsum([0] + [len(t) + 1 for t in lowered[:-1]])
    text = np.searchsorted(begins, start, "right") - 1
    flat = np.where(inside, codes, 0).astype(np.uint64)
    flat = np.concatenate([[np.uint64(0)], flat, [np.uint64(0)]])
    trigram = mixed((flat[:-2] << np.uint64(42)) | (flat[1:-1] << np.uint64(21)) | flat[2:])
    # trigram i is around character i; a word of n letters has n
    key = span_hashes(flat[1:-1], start, end)
    length = end - start
    edge = np.concatenate([[0], np.cumsum(length + len(PREFIXES))])
    feature = np.empty(edge[-1], np.uint64)
    inner = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    feature[np.repeat(edge[:-1], length) + inner] = trigram[np.repeat(start, length) + inner]
    for j, n in enumerate(PREFIXES):
        prefix = span_hashes(flat[1:-1], start, np.minimum(end, start + n))
        feature[edge[1:] - len(PREFIXES) + j] = mixed(prefix + np.uint64(n))
    return text, key, (feature % np.uint64(TRIGRAMS)).astype(np.int64), edge


def _summed(n: int, index: np.ndarray, values: np.ndarray) -> np.ndarray:
    """(n, columns) sums of the rows of ``values`` by index."""
    return np.column_stack([np.bincount(index, v, n) for v in values.T]).astype(np.float32)


def _sigmoid(x):
    return 0.5 * (np.tanh(0.5 * x) + 1)


@dataclass
class Network:
    keys: np.ndarray  # sorted word hashes with an embedding
    p: dict[str, np.ndarray] = field(default_factory=dict)
    constant: float | None = None

    @classmethod
    def start(cls, keys: np.ndarray, seed: int = 5) -> Network:
        rng = np.random.default_rng(seed)
        d, h = WORD + CHAR, HIDDEN
        make = lambda *s, scale: rng.normal(0, scale, s).astype(np.float32)
        p = {"word": make(len(keys) + 1, WORD, scale=0.05), "char": make(TRIGRAMS, CHAR, scale=0.05)}
        for way in "fb":
            p[f"wx{way}"] = make(d, 3 * h, scale=d**-0.5)
            p[f"wh{way}"] = make(h, 3 * h, scale=h**-0.5)
            p[f"b{way}"] = np.zeros(3 * h, np.float32)
        p["attend"] = make(2 * h, scale=h**-0.5)
        p["out"] = make(2 * h, scale=h**-0.5)
        p["bias"] = np.full(1, -1, np.float32)
        return cls(keys, p)

    def word_rows(self, key: np.ndarray) -> np.ndarray:
        """Row of each word's embedding; the last row stands for all unknown words."""
        if not len(self.keys):
            return np.zeros(len(key), np.int64)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, at, len(self.keys))

    def inputs(self, rows: np.ndarray, trigrams: np.ndarray, edge: np.ndarray) -> np.ndarray:
        """(words, WORD + CHAR) input of each word."""
        sums = np.add.reduceat(self.p["char"][trigrams], edge[:-1], 0) if len(rows) else np.zeros((0, CHAR))
        return np.column_stack([self.p["word"][rows], sums / np.diff(edge)[:, None]]).astype(np.float32)

    def forward(self, x: np.ndarray, index: np.ndarray, keep: bool = False):
        """Logit of each window; ``index`` (windows, WINDOW) points into ``x``, -1 for none."""
        p, h = self.p, HIDDEN
        n, steps = index.shape
        real = index >= 0
        states = np.zeros((n, steps, 2 * h), np.float32)
        memory = {}
        for way, order in (("f", range(steps)), ("b", range(steps - 1, -1, -1))):
            gates = x @ p[f"wx{way}"] + p[f"b{way}"]
            gates = np.concatenate([gates, np.zeros((1, 3 * h), np.float32)])
            wh = p[f"wh{way}"]
            state = np.zeros((n, h), np.float32)
            for t in order:
                g = gates[index[:, t]]
                u = state @ wh
                zr = _sigmoid(g[:, : 2 * h] + u[:, : 2 * h])
                z, r = zr[:, :h], zr[:, h:]
                new = np.tanh(g[:, 2 * h :] + r * u[:, 2 * h :])
                m = real[:, t, None]
                after = np.where(m, new + z * (state - new), state)
                if keep:
                    memory[way, t] = (state, z, r, new, u[:, 2 * h :])
                state = after
                states[:, t, slice(0, h) if way == "f" else slice(h, 2 * h)] = state
        a = np.where(real, states @ p["attend"], -np.inf)
        a = np.exp(a - a.max(1, keepdims=True))
        a /= a.sum(1, keepdims=True)
        pooled = np.einsum("nt,nth->nh", a, states)
        logit = pooled @ p["out"] + p["bias"][0]
        return (logit, (states, a, pooled, memory, real)) if keep else logit

    def full(self, x: np.ndarray, index: np.ndarray) -> np.ndarray:
        """Logits like ``forward``, of windows without a gap: in place, no masks."""
        p, h = self.p, HIDDEN
        n, steps = index.shape
        # windows lie side by side, so every gate is one stretch of memory
        states = np.empty((steps, 2 * h, n), np.float32)
        columns = np.ascontiguousarray(index.T)
        for way, order in (("f", range(steps)), ("b", range(steps - 1, -1, -1))):
            gates = np.ascontiguousarray((x @ p[f"wx{way}"] + p[f"b{way}"]).T)
            wh = np.ascontiguousarray(p[f"wh{way}"].T)
            # the sigmoid of v is half of 1 + tanh(v / 2)
            gates[: 2 * h] *= 0.5
            wh[: 2 * h] *= 0.5
            part = slice(0, h) if way == "f" else slice(h, 2 * h)
            state = np.zeros((h, n), np.float32)
            for t in order:
                g = gates.take(columns[t], 1)
                u = wh @ state
                zr, new = g[: 2 * h], g[2 * h :]
                zr += u[: 2 * h]
                np.tanh(zr, out=zr)
                zr += 1
                zr *= 0.5
                u = u[2 * h :]
                u *= zr[h:]
                new += u
                np.tanh(new, out=new)
                state -= new
                state *= zr[:h]
                state += new
                states[t, part] = state
        a = (p["attend"] @ states.swapaxes(0, 1).reshape(2 * h, -1)).reshape(steps, n)
        a = np.exp(a - a.max(0))
        a /= a.sum(0)
        states *= a[:, None]
        return p["out"] @ states.sum(0) + p["bias"][0]

    def logits(self, x: np.ndarray, index: np.ndarray) -> np.ndarray:
        """Logit of each window, some at a time; windows with a gap are few."""
        out = np.empty(len(index), np.float32)
        whole = index[:, -1] >= 0
        for rows, work in ((np.flatnonzero(whole), self.full), (np.flatnonzero(~whole), self.forward)):
            for i in range(0, len(rows), WINDOWS):
                out[rows[i : i + WINDOWS]] = work(x, index[rows[i : i + WINDOWS]])
        return out

    def backward(self, x, index, rest, error):
        """Gradients of the sum of error * logit: of the parameters, and of ``x``."""
        p, h = self.p, HIDDEN
        states, a, pooled, memory, real = rest
        grad = {"out": error @ pooled, "bias": np.array([error.sum()], np.float32)}
        dpool = error[:, None] * p["out"]
        da = np.einsum("nh,nth->nt", dpool, states)
        ds = a * (da - (a * da).sum(1, keepdims=True))
        grad["attend"] = np.einsum("nt,nth->h", ds, states)
        dstates = a[:, :, None] * dpool[:, None] + ds[:, :, None] * p["attend"]
        dx = np.zeros_like(x)
        steps = index.shape[1]
        for way, order in (("f", range(steps - 1, -1, -1)), ("b", range(steps))):
            part = slice(0, h) if way == "f" else slice(h, 2 * h)
            wh = p[f"wh{way}"]
            dwh, parts = np.zeros_like(wh), []
            d = np.zeros((len(index), h), np.float32)
            for t in order:
                state, z, r, new, un = memory[way, t]
                d = d + dstates[:, t, part]
                m = real[:, t, None]
                own = np.where(m, d, 0)
                dn = own * (1 - z) * (1 - new * new)
                dz = own * (state - new) * z * (1 - z)
                dr = dn * un * r * (1 - r)
                dg = np.concatenate([dz, dr, dn], 1)
                du = np.concatenate([dz, dr, dn * r], 1)
                dwh += state.T @ du
                parts.append((index[m[:, 0], t], dg[m[:, 0]]))
                d = np.where(m, own * z + du @ wh.T, d)
            dgates = _summed(len(x), *(np.concatenate(v) for v in zip(*parts)))
            grad[f"wh{way}"] = dwh
            grad[f"wx{way}"] = x.T @ dgates
            grad[f"b{way}"] = dgates.sum(0)
            dx += dgates @ p[f"wx{way}"].T
        return grad, dx


def windows(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text of each window and its (windows, WINDOW) word numbers, -1 past the end.

    Texts follow each other in the numbering; windows start every STRIDE words and the
    last one reaches the end of its text; a text without words has none.
    """
    n = np.where(count > 0, 1 + np.maximum(0, -(-(count - WINDOW) // STRIDE)), 0)
    text = np.repeat(np.arange(len(count)), n)
    step = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    at = step[:, None] * STRIDE + np.arange(WINDOW)
    base = np.cumsum(count) - count
    return text, np.where(at < count[text][:, None], at + base[text][:, None], -1)


def _worst(network: Network, x: np.ndarray, word: np.ndarray, count: np.ndarray):
    """Per text the largest logit and the window it comes from; -inf without words."""
    text, index = windows(count)
    index = np.where(index >= 0, np.append(word, -1)[index], -1)
    logit = network.logits(x, index)
    best = np.full(len(count), -np.inf)
    np.maximum.at(best, text, logit)
    order = np.lexsort((-logit, text))
    at = np.searchsorted(text[order], np.arange(len(count)))
    # meaningless for a text without words, which has no window
    which = np.append(order, 0)[np.minimum(at, len(order))]
    return best, which, index


def usable_text(text: Column, chars: int = FIT_CHARS) -> Column:
    """Whether the network can be fitted on a text: it has a letter and is not too long."""
    return (F.length(text) <= chars) & text.rlike(r"\p{L}")


def fit(labelled: DataFrame, rows: int = FIT_ROWS, chars: int = FIT_CHARS, seed: int = 5) -> Network:
    """Network of ``labelled(text, toxic)``, on at most ``rows`` rows of both labels alike.

    Texts of more than ``chars`` characters, and rows without text or label, take no part
    in fitting; so the driver gets a bounded sample.  With one label only the network is
    a constant.
    """
    usable = labelled.select("text", F.col("toxic").cast("int").alias("toxic")).where(
        F.col("toxic").isin(0, 1) & usable_text(F.col("text"), chars)
    )
    got = bounded_sample(usable, "toxic", rows).toArrow().to_pylist()
    got = sorted((r["text"], r["toxic"]) for r in got)
    label = np.array([t for _, t in got], np.float32)
    if not len(got) or label.min() == label.max():
        return Network(np.zeros(0, np.uint64), constant=float(label[0]) if len(got) else 0.0)
    # in groups of texts, so that the driver holds the sample's words, not its features
    seen_char, bad_char = np.zeros((2, TRIGRAMS))
    parts: list[tuple[np.ndarray, ...]] = []
    for i in range(0, len(got), FIT_GROUP):
        of = label[i : i + FIT_GROUP]
        text, key, trigrams, edge = words([t for t, _ in got[i : i + FIT_GROUP]])
        own, place = np.unique(key, return_index=True)
        size = np.diff(edge)[place]
        parts.append((text + i, key, own, size, gathered(trigrams, edge[:-1][place], size).astype(np.uint16)))
        pairs = np.unique(trigrams * len(of) + np.repeat(text, np.diff(edge)))
        seen_char += np.bincount(pairs // len(of), minlength=TRIGRAMS)
        bad_char += np.bincount(pairs // len(of), of[pairs % len(of)], TRIGRAMS)
    text, key, own, size, features = (np.concatenate(x) for x in zip(*parts))
    parts.clear()
    count = np.bincount(text, minlength=len(got))
    # words of the sample are handled as distinct ones
    distinct, place = np.unique(own, return_index=True)
    tri = gathered(features, (np.cumsum(size) - size)[place], size[place]).astype(np.int64)
    tri_edge = np.concatenate([[0], np.cumsum(size[place])])
    back = np.searchsorted(distinct, key)
    pairs = np.unique(back.astype(np.int64) * len(got) + text)
    seen = np.bincount(pairs // len(got), minlength=len(distinct))
    bad = np.bincount(pairs // len(got), label[pairs % len(got)], len(distinct))
    often = np.flatnonzero(seen >= LEAST_TEXTS)
    often = np.sort(often[np.argsort(-seen[often], kind="stable")[:VOCABULARY]])
    network = Network.start(distinct[often], seed)
    # a word starts out along one axis by how much more often toxic texts have it, and so
    # does a character feature
    odds = lambda bad, all_, n: np.log((bad + 0.5) / (all_ - bad + 0.5) * (n - label.sum() + 1) / (label.sum() + 1))
    network.p["word"][:-1, 0] = np.clip(odds(bad, seen, len(got))[often], -3, 3) / 3
    seen, bad = seen_char, bad_char
    network.p["char"][:, 0] = np.clip(odds(bad, seen, len(got)), -3, 3) / 3
    row = network.word_rows(distinct)
    rng = np.random.default_rng(seed)
    first = np.cumsum(count) - count
    moment: dict[str, list[np.ndarray]] = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in network.p.items()}
    step, parts = 0, -(-len(got) // TEXTS_PER_STEP)
    epochs = max(EPOCHS, -(-LEAST_STEPS // parts))
    for epoch in range(epochs):
        for texts in np.array_split(rng.permutation(len(got)), parts):
            step += 1
            word = np.concatenate([back[first[t] : first[t] + count[t]] for t in texts])
            used, local = np.unique(word, return_inverse=True)
            n = np.diff(tri_edge)[used]
            at = np.repeat(tri_edge[used] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            e = np.concatenate([[0], np.cumsum(n)])
            x = network.inputs(row[used], tri[at], e)
            _, which, index = _worst(network, x, local, count[texts])
            index = index[which]
            logit, rest = network.forward(x, index, keep=True)
            error = ((_sigmoid(logit) - label[texts]) / len(texts)).astype(np.float32)
            grad, dx = network.backward(x, index, rest, error)
            grad["word"] = _summed(len(network.p["word"]), row[used], dx[:, :WORD])
            hit = np.flatnonzero(dx.any(1))
            own = np.repeat(np.isin(np.arange(len(used)), hit), n)
            spread = np.repeat(dx[hit, WORD:] / n[hit, None], n[hit], 0)
            grad["char"] = _summed(TRIGRAMS, tri[at][own], spread)
            rate = 0.01 if epoch < epochs // 2 else 0.003
            for k, g in grad.items():
                m, v = moment[k]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                network.p[k] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return network


def scores(network: Network, texts: list[str | None]) -> np.ndarray:
    """Score of each whole text; 0 for texts without a word."""
    if network.constant is not None:
        letter = _is_letter()
        some = [letter[np.frombuffer((t or "").encode("utf-32-le", "surrogatepass"), "<u4")].any() for t in texts]
        return np.where(some, network.constant, 0.0)
    out = np.zeros(len(texts))
    waiting: list[tuple[int, str]] = []
    held = 0

    def flush():
        text, key, trigrams, edge = words([t for _, t in waiting])
        count = np.bincount(text, minlength=len(waiting))
        _, place, back = np.unique(key, return_index=True, return_inverse=True)
        size = np.diff(edge)[place]
        own = np.repeat(edge[:-1][place] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        x = network.inputs(network.word_rows(key[place]), trigrams[own], np.concatenate([[0], np.cumsum(size)]))
        best, _, _ = _worst(network, x, back, count)
        got = np.where(np.isfinite(best), _sigmoid(np.where(np.isfinite(best), best, 0)), 0.0)
        np.maximum.at(out, [i for i, _ in waiting], got)

    for i, text in enumerate(texts):
        for part in _parts((text or "").lower()):
            if held + len(part) > BLOCK and waiting:
                flush()
                waiting, held = [], 0
            waiting.append((i, part))
            held += len(part)
    if waiting:
        flush()
    return out


def _parts(text: str) -> list[str]:
    """Blocks of a long lower-case text whose windows together are those of the text.

    A block starts at a word whose number is a multiple of STRIDE and, unless it is the
    last, ends with the last word of a whole window; the next one shares some windows.
    """
    if len(text) <= BLOCK:
        return [text]
    letter = _is_letter()
    out, at, size = [], 0, BLOCK
    while at + size < len(text):
        inside = letter[np.frombuffer(text[at : at + size].encode("utf-32-le", "surrogatepass"), "<u4")]
        edge = np.flatnonzero(np.diff(np.concatenate([[False], inside]).astype(np.int8)))
        start, end = edge[::2], edge[1::2]  # a word that the block cuts has no end
        full = (len(end) - WINDOW) // STRIDE
        if full <= SHARED:  # words of no end: a longer block
            size *= 2
            continue
        out.append(text[at : at + int(end[WINDOW + full * STRIDE - 1])])
        at, size = at + int(start[(full - SHARED) * STRIDE]), BLOCK
    return [*out, text[at:]]


def detect(docs: DataFrame, network: Network, threshold: float = 0.3) -> DataFrame:
    """``docs`` with toxicity (0 to 1) and is_toxic (toxicity >= threshold).

    Null and empty texts, and texts without a letter, score 0.  Rows are scored one by one,
    repeated ones and ones without an id too, and a text of any length whole, by the same
    windows whatever blocks it is read in.  Columns of ``docs`` with the new names are
    replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def work(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for texts in steps(batch, 4 * BLOCK):
                yield pa.array(scores(shared.value, texts.to_pylist()), pa.float64())

    scored = F.arrow_udf(work, "double")
    return docs.withColumn("toxicity", scored(F.col("text"))).withColumn(
        "is_toxic", F.col("toxicity") >= threshold
    )
