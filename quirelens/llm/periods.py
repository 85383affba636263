"""Runs of words that repeat with a period, found on a Re-Pair grammar.

Words become numbers and the most frequent pairs of neighbours become new symbols, round
by round, until every stretch is one symbol.  Each new symbol is looked at once: which
runs cross the boundary of its two halves, by common extensions to both sides.  A run of
the text crosses the boundary of the lowest symbol that spans it, so moving these runs to
all places where their symbol was derived, and dropping what lies inside a longer one of
the same period, gives all maximal runs and nothing else.

A run of at least 12 words and two periods holds a sequence of six words that comes back
within the same document, and such sequences cover it whole.  So only the stretches that
they cover take part in the grammar.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelens.llm import arrays

#: Words that a run must have, and at least two periods.
LEAST = 12
#: Bytes of text handled at a time: one grammar; a longer text is handled by itself.
STEP = 1 << 20
RUNS = "n_words long, runs array<struct<start long, length long, period long>>, collapsed string"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_NONE = np.zeros(0, np.int64)


def _stretches(ids: np.ndarray, edges: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places that a repeated sequence of ``least / 2`` words of the same text covers.

    Returns these places, the number of the stretch of each, and how far right the
    sequence at a place reaches together with its next copy in the stretch (past all
    places if it has none).  Sequences meet by a hash of 64 bits; one too many makes a
    stretch longer and nothing else.
    """
    half = max(1, least // 2)
    n = len(ids) - half + 1
    if n <= 0:
        return _NONE, _NONE, _NONE
    text = np.searchsorted(edges, np.arange(len(ids)), "right") - 1
    place = np.flatnonzero(text[:n] == text[half - 1 :])
    key = arrays.rolled(arrays.mixed(ids.astype(np.uint64) + np.uint64(1)), half)[place]
    key = arrays.mixed(key ^ arrays.mixed(text[place].astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    again = np.full(len(ids), -1)
    again[place[order[:-1][same]]] = place[order[1:][same]]
    repeated = np.zeros(len(ids) + 1, np.int64)
    hits = np.unique(np.concatenate([place[order[:-1][same]], place[order[1:][same]]]))
    repeated[hits] += 1
    np.subtract.at(repeated, hits + half, 1)
    covered = np.cumsum(repeated)[:-1] > 0
    at = np.flatnonzero(covered)
    if not len(at):
        return _NONE, _NONE, _NONE
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) > 1) | (text[at][1:] != text[at][:-1])
    stretch = np.cumsum(new) - 1
    index = np.full(len(ids), -1)
    index[at] = np.arange(len(at))
    reach = np.full(len(at), np.iinfo(np.int64).max)
    copy = index[np.maximum(again[at], 0)]
    found = (again[at] >= 0) & (copy >= 0)
    found[found] = stretch[copy[found]] == stretch[found]
    reach[found] = copy[found] + half
    return at, stretch, reach


def grammar(symbols: np.ndarray, stretch: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Re-Pair in rounds: ``(half, length, symbol, place)``.

    ``half`` is the length of each new symbol's left part and ``length`` its own; each
    ``symbol`` (numbered from 0) is derived at ``place``.  A round replaces each pair that
    is more frequent than the pairs it overlaps, ties by a hash, so stretches shrink by
    about a third; a pair of equal symbols is taken at every other place of its row.
    When no pair comes twice, neighbours are paired evenly.
    """
    first = int(symbols.max()) + 1 if len(symbols) else 0
    size = np.ones(len(symbols), np.int64)
    place = np.arange(len(symbols))
    halves, lengths, derived, places = [_NONE], [_NONE], [_NONE], [_NONE]
    count, frequent = first, True
    while len(symbols) > 1:
        pair = stretch[:-1] == stretch[1:]
        if not pair.any():
            break
        at = np.flatnonzero(pair)
        keys, kind, times = np.unique(
            symbols[at] * np.int64(count) + symbols[at + 1], return_inverse=True, return_counts=True
        )
        if frequent:
            rank = np.empty(len(keys), np.int64)
            rank[np.lexsort((arrays.mixed(keys.astype(np.uint64)), times))] = np.arange(len(keys))
            weight = np.full(len(symbols) + 1, -1)
            weight[at + 1] = rank[kind]  # shifted by one: a place before the first
            # rows of one pair at consecutive places, higher than what stands next to them
            begin = np.flatnonzero(weight[1:] != weight[:-1]) + 1
            stop = np.append(begin[1:], len(weight))
            value = weight[begin]
            high = value >= 0
            high &= np.concatenate([[True], value[1:] > value[:-1]])
            high &= np.concatenate([value[:-1] > value[1:], [True]])
            high[high] = times[np.argsort(rank)][value[high]] > 1
            begin, stop = begin[high], stop[high]
            amount = (stop - begin + 1) // 2
            chosen = np.repeat(begin - 2 * (np.cumsum(amount) - amount), amount) + 2 * np.arange(amount.sum()) - 1
            frequent = len(chosen) > 0
        if not frequent:
            before = np.flatnonzero(np.append(True, ~pair))
            chosen = at[(at - before[np.searchsorted(before, at, "right") - 1]) % 2 == 0]
        own = kind[np.searchsorted(at, chosen)]
        used, one, name = np.unique(own, return_index=True, return_inverse=True)
        halves.append(size[chosen[one]])
        lengths.append(size[chosen[one]] + size[chosen[one] + 1])
        derived.append(name + count - first)
        places.append(place[chosen])
        symbols, size = symbols.copy(), size.copy()
        symbols[chosen] = name + count
        size[chosen] += size[chosen + 1]
        count += len(used)
        keep = np.ones(len(symbols), bool)
        keep[chosen + 1] = False
        symbols, size, place, stretch = symbols[keep], size[keep], place[keep], stretch[keep]
    return tuple(np.concatenate(x) for x in (halves, lengths, derived, places))


def _matches(text: list[int]) -> np.ndarray:
    """At each place, how many items from there on equal those from the start."""
    n = len(text)
    out = [0] * n
    left = right = 0
    for i in range(1, n):
        k = 0
        if i < right:
            k = out[i - left]
            if k < right - i:
                out[i] = k
                continue
            k = right - i
        while i + k < n and text[k] == text[i + k]:
            k += 1
        out[i] = k
        if i + k > right:
            left, right = i, i + k
    return np.array(out, np.int64)


def crossing(text: list[int], middle: int, least: int = LEAST) -> list[tuple[int, int, int]]:
    """Runs (start, end, smallest period) of ``text`` that cross the place ``middle``."""
    left, right = text[:middle], text[middle:]
    n, a, b = len(text), middle, len(text) - middle
    forward = _matches([*right, -1, *text])
    backward = _matches([*left[::-1], -1, *text[::-1]])
    # a whole period right of the middle: extend it there, and left from the middle
    q = np.arange(1, b + 1)
    after = np.append(forward[1:b], 0)
    before = backward[a + 1 + b - q]
    found = [(a - before, a + q + after, q)]
    # a whole period left of it
    q = np.arange(1, a + 1)
    before = np.append(backward[1:a], 0)
    after = forward[b + 1 + a - q]
    found.append((a - q - before, a + after, q))
    start, end, q = (np.concatenate(x) for x in zip(*found))
    size = end - start
    good = (size >= 2 * q) & (size >= least) & (start < middle) & (end > middle)
    best: dict[tuple[int, int], int] = {}
    for s, e, p in zip(start[good].tolist(), end[good].tolist(), q[good].tolist()):
        if p < best.get((s, e), n):
            best[s, e] = p
    return [(s, e, p) for (s, e), p in best.items()]


def runs_of(ids: np.ndarray, edges: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and smallest period of all maximal runs of the texts ids[edges[i]:edges[i+1]],
    places counted over all texts, by start, then period."""
    at, stretch, reach = _stretches(ids, edges, least)
    if not len(at):
        return _NONE, _NONE, _NONE
    own = ids[at]
    half, length, symbol, place = grammar(own, stretch)
    # one place of each symbol; inside it some six words and their copy must stand
    some = np.empty(len(half), np.int64)
    some[symbol] = place
    nearest = np.minimum.accumulate(reach[::-1])[::-1]
    able = np.flatnonzero((length >= least) & (nearest[some] <= some + length))
    found, holder = [], []
    for x in able.tolist():
        text = own[some[x] : some[x] + length[x]].tolist()
        new = crossing(text, int(half[x]), least)
        found += new
        holder += [x] * len(new)
    if not found:
        return _NONE, _NONE, _NONE
    start, end, period = np.array(found, np.int64).T
    # to all places where the symbol was derived
    order = np.argsort(symbol, kind="stable")
    begin = np.searchsorted(symbol[order], holder)
    times = np.searchsorted(symbol[order], holder, "right") - begin
    moved = place[order][arrays.gathered(np.arange(len(order)), begin, times)]
    start, end = np.repeat(start, times) + moved, np.repeat(end, times) + moved
    period = np.repeat(period, times)
    # of one period in one stretch, the longest
    order = np.lexsort((-end, start, period, stretch[start]))
    start, end, period = start[order], end[order], period[order]
    group = np.cumsum(
        np.append(True, (period[1:] != period[:-1]) | (stretch[start][1:] != stretch[start][:-1]))
    )
    far = np.maximum.accumulate(end + group * (len(at) + 1))
    longest = np.append(True, (end + group * (len(at) + 1))[1:] > far[:-1])
    start, end, period = start[longest], end[longest], period[longest]
    # of one place, the smallest period
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    single = np.append(True, (start[1:] != start[:-1]) | (end[1:] != end[:-1]))
    start, end, period = at[start[single]], at[end[single] - 1] + 1, period[single]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def described(texts: list[list[bytes]], least: int = LEAST) -> Iterator[dict]:
    """For each list of words: number of words, runs, and the words that are left."""
    numbers: defaultdict[bytes, int] = defaultdict()
    numbers.default_factory = numbers.__len__
    edges = np.cumsum([0, *map(len, texts)])
    ids = np.fromiter((numbers[w] for words in texts for w in words), np.int64, int(edges[-1]))
    start, end, period = runs_of(ids, edges, least)
    first = np.searchsorted(start, edges)
    for i, words in enumerate(texts):
        own = slice(first[i], first[i + 1])
        s, e, p = start[own] - edges[i], end[own] - edges[i], period[own]
        kept = words
        if len(s):
            change = np.zeros(len(words) + 1, np.int64)
            np.add.at(change, s + p, 1)
            np.subtract.at(change, e, 1)
            gone = np.cumsum(change)[:-1] > 0
            kept = [w for w, g in zip(words, gone.tolist()) if not g]
        runs = [{"start": a, "length": b - a, "period": c} for a, b, c in zip(s.tolist(), e.tolist(), p.tolist())]
        yield {"n_words": len(words), "runs": runs, "collapsed": b" ".join(kept).decode()}


def periodic_runs(
    docs: DataFrame,
    least: int = LEAST,
    rewrite: Callable[[str | None, list[bytes]], list[bytes]] | None = None,
) -> DataFrame:
    """``docs`` with ``n_words``, ``runs`` and ``collapsed`` instead of ``text``.

    A run is a stretch of at least ``least`` words and two periods whose words one period
    apart are equal, which no neighbouring word continues; its period is the smallest
    such distance.  ``collapsed`` holds the words that no run contains after its first
    period, joined by single blanks.  Null and empty texts have no words, no runs and an
    empty ``collapsed``.  Rows are handled one by one, so repeated rows and null ids stay
    as they are; columns of ``docs`` with the new names are replaced.  ``rewrite`` may
    change the words of a document first, given its id as text.
    """

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        kind = pa.struct([("n_words", pa.int64()), ("runs", pa.list_(_RUN)), ("collapsed", pa.string())])
        for ids, texts in batches:
            at = 0
            for part in arrays.steps(texts, STEP):
                words = [(t or "").encode().split() for t in part.to_pylist()]
                if rewrite is not None:
                    own = ids.slice(at, len(part)).to_pylist()
                    words = [rewrite(i, w) for i, w in zip(own, words)]
                at += len(part)
                yield pa.array(list(described(words, least)), kind)

    new = ("text", "n_words", "runs", "collapsed")
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in new]
    found = F.arrow_udf(run, RUNS)(F.col("doc_id").cast("string"), F.col("text"))
    return docs.select(*rest, found.alias("_runs")).select(*rest, "_runs.*")


def longest(runs: Column) -> Column:
    """The longest run; of equally long ones the first, then the one of smallest period."""
    best = F.array_max(F.transform(runs, lambda r: F.struct(r["length"], -r["start"], -r["period"])))
    return F.when(F.size(runs) > 0, F.struct(
        (-best["col2"]).alias("start"), best["length"].alias("length"), (-best["col3"]).alias("period")
    ))


def listed(runs: Column) -> Column:
    """All runs as lines ``start,length,period``."""
    lines = F.transform(runs, lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), "")
