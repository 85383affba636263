"""Near-duplicate documents: minima of many universal hashes, banding, exact verification."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelens.llm import arrays
from quirelens.llm.components import components
from quirelens.llm.rows import keyed, light, own_tables, written

#: Words in a shingle.
SHINGLE = 5
#: Bands and minima per band: a pair of similarity 0.75 shares no band once in 200,000.
BANDS, ROWS = 32, 4
#: Links have 100 * intersection >= THRESHOLD * union.
THRESHOLD = 75


@lru_cache(maxsize=1)
def family(n: int = BANDS * ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and shifts of ``n`` multiply-add-shift hashes; fixed by the seed."""
    rng = np.random.default_rng(7)
    a = rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2)
    return a, b


def shingle_sets(data: np.ndarray, edges: np.ndarray, size: int = SHINGLE):
    """Distinct shingle hashes of each text, sorted, one text after the other; their edges.

    Words are what stands between blanks, A-Z lower-cased; a text with fewer words than
    a shingle has is one shingle, a text without words has none.
    """
    data = arrays.lower(data)
    start, end, text = arrays.find_words(data, edges)
    word = arrays.span_hashes(data, start, end)
    n = len(edges) - 1
    words = np.bincount(text, minlength=n)
    first = np.concatenate([[0], np.cumsum(words)])
    long = arrays.rolled(word, size)
    of = text[: len(long)]
    inside = of == text[len(text) - len(long) :]
    few = np.flatnonzero((words > 0) & (words < size))
    short = arrays.span_hashes(word, first[few], first[few + 1]) ^ words[few].astype(np.uint64)
    key = np.concatenate([long[inside], short])
    owner = np.concatenate([of[inside], few])
    order = np.lexsort((key, owner))
    key, owner = key[order], owner[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
    key, owner = key[new], owner[new]
    return key, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))])


def minima(key: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """(texts, BANDS * ROWS) least hashes of non-empty sets."""
    a, b = family()
    out = np.zeros((len(edges) - 1, len(a)), np.uint32)
    full = np.flatnonzero(np.diff(edges))
    begins = edges[:-1][full]
    for j in range(len(a)):
        h = ((key * a[j] + b[j]) >> np.uint64(32)).astype(np.uint32)
        out[full, j] = np.minimum.reduceat(h, begins) if len(full) else 0
    return out


#: Share of equal minima below which a pair is not verified: for a similarity of 0.75 it
#: lies six standard deviations down, a pair in five hundred million.
ESTIMATE = 0.5
#: Members of a bucket that are compared in one group; a larger bucket is compared in
#: pairs of blocks, so none is cut.
BLOCK = 2048
SIGNED = "_row long, n long, set_a long, set_b long, signature binary, prints binary"


def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size, identity, minima and 16-bit prints of each text's shingle set."""
    for batch in batches:
        for number, data, edges in arrays.text_slices(batch["_row"], batch["text"]):
            key, edge = shingle_sets(data, edges)
            n = np.diff(edge)
            sums = [np.concatenate([[np.uint64(0)], np.cumsum(k)]) for k in (key, arrays.mixed(key ^ np.uint64(0x5851F42D4C957F2D)))]
            a, b = ((s[edge[1:]] - s[edge[:-1]]).view(np.int64) for s in sums)
            minimum = minima(key, edge)
            prints = [
                np.unique(key[i:j] >> np.uint64(48)).astype("<u2").tobytes()
                for i, j in zip(edge[:-1], edge[1:])
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(number), pa.array(n), pa.array(a), pa.array(b),
                    pa.array([m.astype("<u4").tobytes() for m in minimum], pa.binary()),
                    pa.array(prints, pa.binary()),
                ],
                names=["_row", "n", "set_a", "set_b", "signature", "prints"],
            )


def may_be_linked(n, m, left: bytes, right: bytes, signature_left, signature_right) -> bool:
    """False only where sizes, minima or prints rule a link out.

    Prints of equal shingles are equal, so the prints that both sets have, plus what a
    set loses by prints that coincide, bound the intersection from above.
    """
    if 100 * min(n, m) < THRESHOLD * max(n, m):
        return False
    a, b = np.frombuffer(signature_left, "<u4"), np.frombuffer(signature_right, "<u4")
    if (a == b).mean() < ESTIMATE:
        return False
    x, y = np.frombuffer(left, "<u2"), np.frombuffer(right, "<u2")
    common = len(np.intersect1d(x, y, assume_unique=True)) + min(n - len(x), m - len(y))
    common = min(common, n, m)
    return 100 * common >= THRESHOLD * (n + m - common)


def _screen(*columns: pa.Array) -> pa.Array:
    return pa.array([may_be_linked(*x) for x in zip(*(c.to_pylist() for c in columns))], pa.bool_())


def compare_block(group: pa.Table) -> pa.Table:
    """Pairs of one block of one bucket that may be linked and are in two components."""
    i, j = group["i"][0].as_py(), group["j"][0].as_py()
    band = group["band"][0].as_py()
    sig = np.frombuffer(b"".join(group["signature"].to_pylist()), "<u4").reshape(-1, BANDS * ROWS)
    row, comp, n, block = (group[c].to_numpy() for c in ("_row", "component", "n", "block"))
    prints, raw = group["prints"].to_pylist(), group["signature"].to_pylist()
    bands = sig.reshape(len(sig), BANDS, ROWS)
    left = np.flatnonzero(block == i)
    out: list[tuple[int, int]] = []
    for x in left:
        other = (comp != comp[x]) & (block == j)
        if i == j:
            other &= row > row[x]
        y = np.flatnonzero(other)
        y = y[(sig[y] == sig[x]).sum(1) >= ESTIMATE * sig.shape[1]]
        # a pair is looked at in the first band that it shares
        shared = (bands[y] == bands[x]).all(2)
        y = y[shared.argmax(1) == band]
        out += [
            (int(row[x]), int(row[k]))
            for k in y
            if may_be_linked(n[x], n[k], prints[x], prints[k], raw[x], raw[k])
        ]
    return pa.table({"a": pa.array([p[0] for p in out], pa.int64()), "b": pa.array([p[1] for p in out], pa.int64())})


def _linked(left: pa.Array, right: pa.Array) -> pa.Array:
    """Whether the full shingle sets of two texts are similar enough."""
    out = []
    for a, b in zip(left.to_pylist(), right.to_pylist()):
        a, b = a.encode(), b.encode()
        key, edge = shingle_sets(np.frombuffer(a + b, np.uint8), np.array([0, len(a), len(a) + len(b)]))
        n, m = np.diff(edge)
        common = len(np.intersect1d(key[: edge[1]], key[edge[1] :], assume_unique=True))
        out.append(bool(100 * common >= THRESHOLD * (n + m - common)))
    return pa.array(out, pa.bool_())


def near_duplicates(rows: DataFrame) -> DataFrame:
    """``(_row, n_shingles, component)`` of all rows of ``rows(_row, text)``.

    1. Rows with equal shingle sets are one class, stood for by its first row.
    2. In each bucket of a band every member is paired with the first one; what sizes,
       minima and prints do not rule out is verified on the full sets and joined to
       components.
    3. Buckets whose members are all in one component are done, since more links change
       nothing.  In the others members of different components are compared, in blocks.
    """
    with own_tables(rows.sparkSession) as result:
        signed = written(rows.select("_row", "text").mapInArrow(sign, SIGNED))
        some = signed.where("n > 0")
        classes = some.groupBy("n", "set_a", "set_b").agg(F.min("_row").alias("head"))
        member = written(
            some.select("_row", "n", "set_a", "set_b")
            .join(classes, ["n", "set_a", "set_b"])
            .select("_row", "head")
        )
        heads = some.join(light(member.where("_row = head").select("_row")), "_row")
        width = 4 * ROWS
        keys = F.array(
            *[
                F.struct(
                    F.lit(b).alias("band"),
                    F.xxhash64(F.lit(b), F.substring("signature", 1 + b * width, width)).alias("key"),
                )
                for b in range(BANDS)
            ]
        )
        in_band = heads.select("_row", F.inline(keys))
        buckets = (
            in_band.groupBy("band", "key")
            .agg(F.min("_row").alias("first"), F.count("*").alias("size"))
            .where("size > 1")
        )
        bucketed = written(in_band.join(buckets, ["band", "key"]))
        involved = light(written(bucketed.select("_row").distinct()))
        texts = written(rows.select("_row", "text").join(involved, "_row"))
        facts = written(signed.drop("set_a", "set_b").join(involved, "_row"))

        def side(table: DataFrame, name: str, *columns: str) -> DataFrame:
            return table.select(F.col("_row").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in columns])

        def verified(pairs: DataFrame) -> DataFrame:
            whole = pairs.join(side(texts, "a", "text"), "a").join(side(texts, "b", "text"), "b")
            return written(whole.where(F.arrow_udf(_linked, "boolean")("text_a", "text_b")).select("a", "b"))

        what = ("n", "prints", "signature")
        stars = (
            bucketed.where("_row <> first")
            .select(F.col("first").alias("a"), F.col("_row").alias("b"))
            .distinct()
            .join(side(facts, "a", *what), "a")
            .join(side(facts, "b", *what), "b")
            .where(
                F.arrow_udf(_screen, "boolean")(
                    "n_a", "n_b", "prints_a", "prints_b", "signature_a", "signature_b"
                )
            )
            .select("a", "b")
        )
        links = verified(stars)
        found = components(links)
        placed = written(
            bucketed.join(found.withColumnRenamed("node", "_row"), "_row", "left").withColumn(
                "component", F.coalesce("component", "_row")
            )
        )
        open_ = (
            placed.groupBy("band", "key")
            .agg(F.min("component").alias("_x"), F.max("component").alias("_y"))
            .where("_x <> _y")
            .select("band", "key")
        )
        blocks = F.ceil(F.col("size") / BLOCK).cast("int")
        own = F.pmod(F.xxhash64("_row"), F.col("blocks")).cast("int")
        pairs = F.transform(
            F.sequence(F.lit(0), F.col("blocks") - 1),
            lambda k: F.struct(F.least(k, F.col("block")).alias("i"), F.greatest(k, F.col("block")).alias("j")),
        )
        rest = (
            placed.join(open_, ["band", "key"])
            .withColumn("blocks", blocks)
            .withColumn("block", own)
            .select("_row", "band", "key", "component", "block", F.inline(pairs))
            .join(facts.select("_row", *what), "_row")
            .groupBy("band", "key", "i", "j")
            .applyInArrow(compare_block, "a long, b long")
        )
        links = links.union(verified(rest)).union(member.where("_row <> head").select("_row", "head"))
        found = components(links)
        return result(
            signed.select("_row", F.col("n").alias("n_shingles"))
            .join(found.withColumnRenamed("node", "_row"), "_row", "left")
            .select("_row", "n_shingles", F.coalesce("component", "_row").alias("component"))
        )


def component_table(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``, one row per document.

    Documents are linked when 100 times the intersection of their shingle sets is at
    least 75 times the union; ``component_id`` is the least doc_id that links reach.
    Null, empty and blank texts have no shingle and no link.  Rows that share a doc_id,
    or have none, are documents of their own; the first row of a component is kept, and
    rows without an id come last and have a null component_id where they come first.
    """
    rows = keyed(docs)
    members = near_duplicates(rows)
    ids = rows.select("_row", "doc_id")
    first = ids.select(F.col("_row").alias("component"), F.col("doc_id").alias("component_id"))
    return (
        members.join(ids, "_row")
        .join(first, "component")
        .select("doc_id", "n_shingles", "component_id", (F.col("_row") == F.col("component")).alias("kept"))
    )


def first_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, but later members of each group."""
    rows = keyed(docs, whole=True)
    later = light(near_duplicates(rows).where("_row <> component").select("_row"))
    return rows.join(later, "_row", "left_anti").select("_doc.*")


#: The query in SQL: all links by shared shingles, and what they reach.
COMPONENTS_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
),
shingle AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + {SHINGLE - 1}), ' ') AS s
  FROM (SELECT doc_id, w, UNNEST(range(1, greatest(len(w) - {SHINGLE - 2}, 2))) AS i FROM d WHERE len(w) > 0)
),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
both_ AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
  FROM shingle x JOIN shingle y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2
),
link AS (
  SELECT a, b FROM both_ JOIN size m ON m.doc_id = a JOIN size k ON k.doc_id = b
  WHERE 100 * c >= {THRESHOLD} * (m.n + k.n - c)
),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM d
  UNION
  SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b
)
SELECT d.doc_id, coalesce(any_value(size.n), 0) AS n_shingles, min(reach.b) AS component_id, d.doc_id = min(reach.b) AS kept
FROM d JOIN reach ON reach.a = d.doc_id LEFT JOIN size ON size.doc_id = d.doc_id
GROUP BY d.doc_id
"""
