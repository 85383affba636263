"""Array routines on UTF-8 text inside tasks: words, rolling hashes, packed slices."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at a time; a longer text is a slice of its own.
SLICE = 1 << 21
_BASE = 0x9E3779B97F4A7C15
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for b in (_BASE, pow(_BASE, -1, 1 << 64)):
        factors = np.full(n, b, np.uint64)
        factors[0] = 1
        out.append(np.cumprod(factors))
    return out[0], out[1]


def span_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit polynomial hash of values[start:end] for each span, with its length."""
    n = max(SLICE, len(values)) + 1
    power, inverse = _powers(n)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * power[: len(values)], out=sums[1:])
    return mixed((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))


def rolled(values: np.ndarray, n: int, base: int = _BASE) -> np.ndarray:
    """Hash of each run of ``n`` consecutive values, by doubling."""
    size = max(0, len(values) - n + 1)
    done, out = 0, np.zeros(size, np.uint64)
    part, width = values.astype(np.uint64), 1
    left = n
    while left:
        if left & 1:
            out = out * np.uint64(pow(base, width, 1 << 64)) + part[done : done + size]
            done += width
        left >>= 1
        if left:
            part = part[:-width] * np.uint64(pow(base, width, 1 << 64)) + part[width:]
            width *= 2
    return mixed(out)


def sliding_min(values: np.ndarray, n: int) -> np.ndarray:
    """Minimum of each run of ``n`` consecutive values."""
    width = 1
    while 2 * width <= n:
        values = np.minimum(values[:-width], values[width:])
        width *= 2
    if width < n:
        values = np.minimum(values[: len(values) - (n - width)], values[n - width :])
    return values


def gathered(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The slices ``flat[start:start+length]``, one after the other."""
    end = np.cumsum(length)
    at = np.arange(end[-1] if len(end) else 0, dtype=np.int64)
    at += np.repeat(start - (end - length), length)
    return flat[at]


def steps(values: pa.Array, size: int) -> Iterator[pa.Array]:
    """Consecutive slices of texts or lists with ``size`` bytes or items each, or one row."""
    if pa.types.is_list(values.type):
        each = values.value_lengths()
    else:
        each = pc.binary_length(values)
    edge = np.cumsum(each.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(values):
        before = edge[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(edge, before + size, "right")))
        yield values.slice(at, stop - at)
        at = stop


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the texts, one after the other, and their edges; null counts as empty."""
    texts = texts.fill_null("") if pa.types.is_string(texts.type) else texts.fill_null(b"")
    _, edge, data = texts.buffers()
    if edge is None or not len(texts):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    edge = np.frombuffer(edge, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[edge[0] : edge[-1]], edge - edge[0]


def text_slices(rows: pa.Array, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row numbers, bytes, edges) of consecutive texts; null counts as empty."""
    texts = texts.fill_null("") if pa.types.is_string(texts.type) else texts.fill_null(b"")
    number = rows.to_numpy(zero_copy_only=False).astype(np.int64)
    _, edge, data = texts.buffers()
    edge = np.frombuffer(edge, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(edge, edge[at] + SLICE, "right")) - 1)
        stop = min(stop, len(texts))
        yield number[at:stop], data[edge[at] : edge[stop]], edge[at : stop + 1] - edge[at]
        at = stop


def find_words(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each word; texts are data[edges[i]:edges[i+1]]."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~_BLANK[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cut = edges[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    first[cut] |= inside[cut]
    last[cut - 1] |= inside[cut - 1]
    start = np.flatnonzero(first)
    end = np.flatnonzero(last) + 1
    return start, end, np.searchsorted(edges, start, "right") - 1


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z, and nothing else, in lower case."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table[data]
