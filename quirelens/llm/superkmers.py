"""Exact search for repeated fixed-length windows by super-k-mers.

A window is ``length`` consecutive symbols of one document.  Its minimiser is the least
hash of the ``seed``-symbol runs in it, so equal windows have equal minimisers and
consecutive windows mostly share theirs.  Each run of windows with one minimiser is
packed once, as the bytes it spans, and sent to the bucket of the minimiser; there the
windows are sorted and every copy of an earlier one is reported.

Equal packed strings are collapsed before the shuffle and again in the bucket: what a
thousand copies share is sent once per slice of text and sorted once, so one passage in
a third of all documents fills no bucket.  What each document has around such a passage
differs but has the passage's minimisers.  So minimisers with many distinct strings are
found first, and their windows are sent one by one to the bucket of the whole window.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelens.llm import arrays

#: Bytes of text per bucket; a bucket holds about four times that, packed.
BUCKET_BYTES = 8 << 20
#: A bucket is worked off in so many parts, so that arrays stay small.
PARTS = 8
#: A minimiser with so many distinct strings is hot: its windows are dealt one by one.
HOT_STRINGS = 20_000
#: Strings are counted in one document of so many.
SAMPLE = 64
PACKED = "bucket int, kind int, blob binary"
ADDRESSED = "dest int, blob binary"


@dataclass(frozen=True)
class Windows:
    """What a window is, and which earlier copy counts."""

    length: int
    seed: int
    #: (bytes, edges) -> start, end, text number and 64-bit value of each symbol
    symbols: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, ...]]
    #: (value, first window, windows, order) of distinct packed strings -> class of each window
    classes: Callable[..., np.ndarray]
    #: an earlier copy must stand in an earlier document
    across: bool
    #: minimisers are counted first and strings packed only where another document
    #: shares theirs; pays where packing repeats the text several times
    counted: bool = False


def runs(shape: Windows, value: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, ...]:
    """First window, number of windows and minimiser of each run with one minimiser."""
    n = len(value) - shape.length + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64)
    least = arrays.sliding_min(arrays.rolled(value, shape.seed), shape.length - shape.seed + 1)
    inside = text[:n] == text[shape.length - 1 :]
    change = np.ones(n, bool)
    change[1:] = (least[1:] != least[:-1]) | (text[1:n] != text[: n - 1]) | (inside[1:] != inside[:-1])
    first = np.flatnonzero(change)
    count = np.diff(np.append(first, n))
    keep = inside[first]
    return first[keep], count[keep], least[first[keep]]


def copies(key: np.ndarray, row: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For equal keys: index of the earliest by (row, at), for each; and that order."""
    order = np.lexsort((at, row, key))
    new = np.ones(len(key), bool)
    new[1:] = key[order][1:] != key[order][:-1]
    first = np.empty(len(key), np.int64)
    first[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    return first, order


def _planes(a: np.ndarray, kind: str) -> bytes:
    """Bytes of the numbers, all first bytes before all second ones: packs better."""
    a = np.ascontiguousarray(a, kind)
    return a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()


def _numbers(raw: memoryview, n: int, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, n).T).view(kind)[:, 0]


def _blob(part, row, at, size, content: bytes) -> bytes:
    body = _planes(part, "u1") + _planes(row, "<i8") + _planes(at, "<i4") + _planes(size, "<i4")
    body += content
    return len(row).to_bytes(8, "little") + zstandard.ZstdCompressor(level=3).compress(body)


def _unpacked(blob: bytes) -> tuple[np.ndarray, ...]:
    n = int.from_bytes(blob[:8], "little")
    raw = memoryview(zstandard.ZstdDecompressor().decompress(blob[8:]))
    o, a, b, c = n, 9 * n, 13 * n, 17 * n
    return (
        _numbers(raw[:o], n, "u1"),
        _numbers(raw[o:a], n, "<i8"),
        _numbers(raw[a:b], n, "<i4"),
        _numbers(raw[b:c], n, "<i4"),
        np.frombuffer(raw[c:], np.uint8),
    )


def hot_minimisers(rows: DataFrame, shape: Windows) -> np.ndarray:
    """Minimisers of very many distinct strings, from a share of the documents.

    Which ones are found decides where windows meet, never what is found.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, edges in arrays.text_slices(batch["_row"], batch["text"]):
                _, _, text, value = shape.symbols(data, edges)
                first, count, least = runs(shape, value, text)
                key = arrays.span_hashes(value, first, first + count + shape.length - 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(least.view(np.int64)), pa.array(key.view(np.int64))], names=["least", "key"]
                )

    found = (
        rows.where(F.pmod(F.xxhash64("_row"), F.lit(SAMPLE)) == 0)
        .select("_row", "text")
        .mapInArrow(work, "least long, key long")
        .distinct()
        .groupBy("least")
        .count()
        .where(F.col("count") >= HOT_STRINGS / SAMPLE)
        .collect()
    )
    return np.array([r.least for r in found], np.int64).view(np.uint64)


def seeds(shape: Windows, buckets: int, hot: np.ndarray) -> Callable:
    """mapInArrow function: by bucket, 32 bits of each run's minimiser and where it is.

    Runs of hot minimisers are shared without being counted.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, data, edges in arrays.text_slices(batch["_row"], batch["text"]):
                _, _, text, value = shape.symbols(data, edges)
                first, _, least = runs(shape, value, text)
                own = text[first]
                place = np.arange(len(first)) - np.searchsorted(own, own)
                counted = ~np.isin(least, hot)
                own, place, least = own[counted], place[counted], least[counted]
                least = arrays.mixed(least)
                bucket = (least % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                bucket, row, place = bucket[order], number[own][order], place[order]
                least = (least >> np.uint64(32))[order]
                begins = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else []
                stops = [*begins[1:], len(bucket)]
                blobs = [
                    (b - a).item().to_bytes(8, "little") + zstandard.ZstdCompressor(level=3).compress(
                        _planes(row[a:b], "<i8") + _planes(place[a:b], "<i4") + _planes(least[a:b], "<u4")
                    )
                    for a, b in zip(begins, map(np.int64, stops))
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket[begins] if len(bucket) else [], pa.int32()), pa.array(blobs, pa.binary())],
                    names=["bucket", "blob"],
                )

    return work


def shared_seeds(group: pa.Table, buckets: int) -> pa.Table:
    """Of a bucket, the runs whose minimiser stands in two documents or more."""
    rows, places, least = [], [], []
    for blob in group["blob"].to_pylist():
        n = int.from_bytes(blob[:8], "little")
        raw = memoryview(zstandard.ZstdDecompressor().decompress(blob[8:]))
        rows.append(_numbers(raw[: 8 * n], n, "<i8"))
        places.append(_numbers(raw[8 * n : 12 * n], n, "<i4"))
        least.append(_numbers(raw[12 * n :], n, "<u4"))
    row, place, key = (np.concatenate(x) for x in (rows, places, least))
    order = np.lexsort((row, key))
    row, place, key = row[order], place[order], key[order]
    begin = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    last = np.append(begin[1:], len(key)) - 1
    many = np.repeat(row[begin] != row[last], last - begin + 1)
    row, place = row[many], place[many]
    order = np.lexsort((place, row))
    row, place = row[order], place[order]
    return addressed(row, place, buckets)


def addressed(row: np.ndarray, value: np.ndarray, buckets: int) -> pa.Table:
    """Numbers by row, packed into one blob per group of rows they go to."""
    dest = (arrays.mixed(row.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(dest, kind="stable")
    dest, row, value = dest[order], row[order], value[order]
    begin = np.flatnonzero(np.append(True, dest[1:] != dest[:-1])) if len(dest) else np.zeros(0, np.int64)
    blobs = [
        (int(b) - int(a)).to_bytes(8, "little")
        + zstandard.ZstdCompressor(level=1).compress(_planes(row[a:b], "<i8") + _planes(value[a:b], "<i4"))
        for a, b in zip(begin, [*begin[1:], len(dest)])
    ]
    return pa.table({"dest": pa.array(dest[begin], pa.int32()), "blob": pa.array(blobs, pa.binary())})


def collected(group: pa.Table) -> pa.Table:
    """applyInArrow function of a group of rows: ``(_row, numbers)``, all of a row together."""
    rows, values = [], []
    for blob in group["blob"].to_pylist():
        n = int.from_bytes(blob[:8], "little")
        raw = memoryview(zstandard.ZstdDecompressor().decompress(blob[8:]))
        rows.append(_numbers(raw[: 8 * n], n, "<i8"))
        values.append(_numbers(raw[8 * n :], n, "<i4"))
    row, value = np.concatenate(rows), np.concatenate(values)
    order = np.argsort(row, kind="stable")
    row, value = row[order], value[order].astype("<i4")
    begin = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    lists = [value[a:b].tobytes() for a, b in zip(begin, [*begin[1:], len(row)])]
    return pa.table({"_row": pa.array(row[begin], pa.int64()), "numbers": pa.array(lists, pa.binary())})


def _chosen(batch: pa.RecordBatch, number: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Of runs in texts ``own``, which are listed in the batch's ``runs`` for their row."""
    lists = dict(zip(batch["_row"].to_pylist(), batch["runs"].to_pylist()))
    base = np.searchsorted(own, np.arange(len(number)))
    out = np.zeros(len(own), bool)
    for i, row in enumerate(number.tolist()):
        out[base[i] + np.frombuffer(lists[row] or b"", "<i4")] = True
    return out


def pack(shape: Windows, buckets: int, hot: np.ndarray) -> Callable:
    """mapInArrow function: packed strings by bucket (kind 0), known copies (kind 1)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, data, edges in arrays.text_slices(batch["_row"], batch["text"]):
                out: list[tuple[int, int, bytes]] = []
                start, end, text, value = shape.symbols(data, edges)
                first, count, least = runs(shape, value, text)
                single = np.isin(least, hot)
                if shape.counted:
                    chosen = _chosen(batch, number, text[first]) | single
                    first, count, least, single = first[chosen], count[chosen], least[chosen], single[chosen]
                if not len(first):
                    continue
                # a run of a hot minimiser becomes runs of one window each
                times = np.where(single, count, 1)
                which = np.repeat(np.arange(len(first)), times)
                first = first[which] + np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
                count, least, single = np.where(single, 1, count)[which], least[which], single[which]
                row = number[text[first]]
                base = np.searchsorted(text, np.arange(len(number)))
                at = first - base[text[first]]
                key = arrays.span_hashes(value, first, first + count + shape.length - 1)
                origin, _ = copies(key, row, at)
                known = row > row[origin] if shape.across else origin != np.arange(len(key))
                deal = np.where(single, key, least)
                bucket = (arrays.mixed(deal) % np.uint64(PARTS * buckets)).astype(np.int64)
                own = arrays.mixed(row.astype(np.uint64)) % np.uint64(buckets)
                own = own.astype(np.int64) * PARTS
                _split(out, 1, own[known], row[known], at[known], count[known], None)
                keep = np.flatnonzero(~known)
                span = (start[first[keep]], end[first[keep] + count[keep] + shape.length - 2])
                _split(out, 0, bucket[keep], row[keep], at[keep], span[1] - span[0], (data, span[0]))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([x[0] for x in out], pa.int32()),
                        pa.array([x[1] for x in out], pa.int32()),
                        pa.array([x[2] for x in out], pa.binary()),
                    ],
                    names=["bucket", "kind", "blob"],
                )

    return work


def _split(out, kind, bucket, row, at, size, content) -> None:
    order = np.argsort(bucket, kind="stable")
    bucket, row, at, size = bucket[order], row[order], at[order], size[order]
    bucket, part = np.divmod(bucket, PARTS)
    begins = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else []
    if content is not None:
        data, start = content
        flat = arrays.gathered(data, start[order], size)
        edge = np.concatenate([[0], np.cumsum(size)])
    for a, b in zip(begins, [*begins[1:], len(bucket)]):
        body = flat[edge[a] : edge[b]].tobytes() if content is not None else b""
        out.append((int(bucket[a]), kind, _blob(part[a:b], row[a:b], at[a:b], size[a:b], body)))


def resolve(shape: Windows, buckets: int) -> Callable:
    """applyInArrow function of a bucket: spans of symbols that repeat earlier windows."""

    def work(group: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        packed = []
        for kind, blob in zip(group["kind"].to_pylist(), group["blob"].to_pylist()):
            part, row, at, size, content = _unpacked(blob)
            if kind:
                found.append((row, at, size))
            else:
                packed.append((part, row, at, size, content))
        if packed:
            part, row, at, size, data = (np.concatenate(x) for x in zip(*packed))
            packed.clear()
            begin = np.cumsum(size, dtype=np.int64) - size
            for k in range(PARTS):
                own = np.flatnonzero(part == k)
                if len(own):
                    content = arrays.gathered(data, begin[own], size[own].astype(np.int64))
                    found += _part(shape, row[own], at[own], size[own], content)
        return _spans(found, shape.length, buckets)

    return work


def _part(shape, row, at, size, data):
    """Spans of repeated windows among the packed strings of one part of a bucket."""
    edges = np.concatenate([[0], np.cumsum(size.astype(np.int64))])
    _, _, text, value = shape.symbols(data, edges)
    first = np.searchsorted(text, np.arange(len(row) + 1))
    key = arrays.span_hashes(value, first[:-1], first[1:])
    count = np.diff(first) - shape.length + 1
    origin, _ = copies(key, row, at)
    known = row > row[origin] if shape.across else origin != np.arange(len(row))
    spans = [(row[known], at[known], count[known])]
    return spans + _repeats(shape, row, at, value, first, count, origin)


def _repeats(shape, row, at, value, first, count, origin):
    """Spans among the distinct packed strings of a bucket."""
    own = np.flatnonzero(origin == np.arange(len(row)))
    if not len(own):
        return []
    # a minimiser that stands only once among the distinct strings: nothing to share
    width = count[own] + shape.length - 1
    inner = np.cumsum(width) - width
    seeds = np.append(
        arrays.rolled(arrays.gathered(value, first[own], width), shape.seed), np.uint64(2**64 - 1)
    )
    size = width - shape.seed + 1
    ranges = np.column_stack([inner, inner + size]).ravel()
    least = np.minimum.reduceat(seeds, ranges)[::2]
    times = np.add.reduceat(
        arrays.gathered(seeds, inner, size) == np.repeat(least, size), np.cumsum(size) - size
    )
    _, back = np.unique(least, return_inverse=True)
    own = own[np.bincount(back, times)[back] > 1]
    if not len(own):
        return []
    width = count[own] + shape.length - 1
    window = arrays.gathered(np.arange(len(value)), first[own], count[own])
    which = np.repeat(np.arange(len(own)), count[own])
    label = shape.classes(value, first[own], width, window)
    place = at[own][which] + window - first[own][which]
    order = np.lexsort((place, row[own][which], label))
    new = np.ones(len(order), bool)
    new[1:] = label[order][1:] != label[order][:-1]
    earliest = row[own][which][order][np.flatnonzero(new)][np.cumsum(new) - 1]
    later = np.zeros(len(order), bool)
    later[order] = row[own][which][order] > earliest if shape.across else ~new
    # as runs of consecutive windows of one string
    hit = np.flatnonzero(later)
    if not len(hit):
        return []
    new = np.ones(len(hit), bool)
    new[1:] = (hit[1:] != hit[:-1] + 1) | (which[hit][1:] != which[hit][:-1])
    begin = hit[new]
    amount = np.diff(np.append(np.flatnonzero(new), len(hit)))
    spans = [(row[own][which[begin]], place[begin], amount)]
    if shape.across:  # a string that stands again in the same document has the same spans
        same = np.flatnonzero((origin != np.arange(len(row))) & (row == row[origin]))
        to = np.full(len(row), -1)
        to[own] = np.arange(len(own))
        for i in same[to[origin[same]] >= 0]:
            mine = which[begin] == to[origin[i]]
            offset = window[begin[mine]] - first[origin[i]]
            spans.append((np.full(mine.sum(), row[i]), at[i] + offset, amount[mine]))
    return spans


def _spans(found, length: int, buckets: int) -> pa.Table:
    """Spans [first symbol, last symbol + 1) by document, joined where they touch."""
    row, at, count = (
        (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
    )
    order = np.lexsort((at, row))
    row, at, stop = row[order].astype(np.int64), at[order].astype(np.int64), (at + count + length - 1)[order]
    begins = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else []
    rows, spans = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a, b in zip(begins, [*begins[1:], len(row)]):
        own = joined(at[a:b], stop[a:b]).ravel()
        rows.append(np.full(len(own), row[a]))
        spans.append(own)
    return addressed(np.concatenate(rows), np.concatenate(spans), buckets)


def joined(start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """(n, 2) maximal runs that the sorted spans cover."""
    reach = np.maximum.accumulate(stop)
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > reach[:-1]
    last = np.append(np.flatnonzero(new)[1:] - 1, len(start) - 1)
    return np.column_stack([start[new], reach[last]])


def removed_spans(numbers: bytes | None) -> np.ndarray:
    """Spans of one document from all its buckets, joined."""
    if not numbers:
        return np.zeros((0, 2), np.int64)
    pairs = np.frombuffer(numbers, "<i4").reshape(-1, 2).astype(np.int64)
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    return joined(pairs[:, 0], pairs[:, 1])


def repeated(rows: DataFrame, shape: Windows) -> DataFrame:
    """``(_row, spans)`` for the rows of ``rows(_row, text)`` that repeat earlier windows."""
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-size // BUCKET_BYTES))
    hot = hot_minimisers(rows, shape)
    if shape.counted:
        shared = (
            rows.select("_row", "text")
            .mapInArrow(seeds(shape, buckets, hot), "bucket int, blob binary")
            .groupBy("bucket")
            .applyInArrow(lambda group: shared_seeds(group, buckets), ADDRESSED)
            .groupBy("dest")
            .applyInArrow(collected, "_row long, numbers binary")
            .withColumnRenamed("numbers", "runs")
        )
        # all columns, as in with_spans: the shuffle of the texts is the same and made once
        wanted = rows.join(shared, "_row", "left" if len(hot) else "inner")
    else:
        wanted = rows.select("_row", "text")
    return (
        wanted.mapInArrow(pack(shape, buckets, hot), PACKED)
        .groupBy("bucket")
        .applyInArrow(resolve(shape, buckets), ADDRESSED)
        .groupBy("dest")
        .applyInArrow(collected, "_row long, numbers binary")
        .withColumnRenamed("numbers", "spans")
    )


def with_spans(rows: DataFrame, shape: Windows) -> DataFrame:
    """``rows`` with ``spans``, null where nothing repeats."""
    return rows.join(repeated(rows, shape), "_row", "left")


def cut(kind: str, work: Callable) -> Callable[[Column, Column], Column]:
    """Column function of text and spans from ``work(text, spans)``, one dict per row."""
    fields = [f.split()[0] for f in kind.split(", ")]

    def run(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = [
            work((t.as_py() or "").encode(), removed_spans(s.as_py()))
            for t, s in zip(texts, spans)
        ]
        return pa.StructArray.from_arrays(
            [pa.array([r[i] for r in out], _arrow(k)) for i, k in enumerate(kind.split(", "))], names=fields
        )

    return F.arrow_udf(run, kind)


def _arrow(field: str) -> pa.DataType:
    return {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}[field.split()[1]]
