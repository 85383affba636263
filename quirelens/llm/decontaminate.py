"""Benchmark decontamination by size-partitioned MinHash containment search.

Short test items are looked for inside long documents.  Items are partitioned by the
size of their shingle sets; a partition says how many minima an item is known by.  A
document that contains most of an item contains most of the shingles in which the
item's minima lie, however long it is, so its shingles are probed for those and the
share found estimates the containment.  What passes is verified on the exact shingles.
Items of few shingles are known by all of them.  An item of fewer words than a shingle
has is one run of words, and is looked for among the runs of its own length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirelens.llm.rows import keyed, own_tables, words, written
from quirelens.operators.scale import fits_broadcast

SHINGLE = 5
#: Part of an item's distinct shingles that a document must contain.
CONTAINMENT = 0.75
#: Items of up to so many shingles are known by all of them, so none is missed.
WHOLE = 16
#: Upper size of a partition of larger items and the minima an item in it is known by.  At
#: 0.75, fewer than a fifth of them are found less than once in a hundred million items.
PARTITIONS = ((64, 24), (None, 32))


_WORDS = [f"w{j}" for j in range(SHINGLE)]


def _shingled(rows: DataFrame, key: str) -> DataFrame:
    """``(key, w0 ... w4)``: one row for each run of five words."""
    split = rows.select(key, words(F.lower("text")).alias("_w"))
    last = F.greatest(F.size("_w") - (SHINGLE - 1), F.lit(1))
    zipped = F.arrays_zip(*[F.slice("_w", j + 1, last).alias(f"w{j}") for j in range(SHINGLE)])
    # an array without words is sliced to five empty arrays, hence no row
    return split.select(key, F.inline(zipped).alias(*_WORDS))


def _with_size(items: DataFrame) -> DataFrame:
    """``(item, shingle, n)``: distinct shingles of each item and how many it has."""
    one = _shingled(items, "item").select("item", F.concat_ws(" ", *_WORDS).alias("shingle")).distinct()
    return one.join(one.groupBy("item").agg(F.count("*").alias("n")), "item")


def _sketches(sized: DataFrame, containment: float) -> DataFrame:
    """``(h, item, mask, needed)``: shingles that an item is known by, as a mask of bits."""
    place = F.row_number().over(Window.partitionBy("item").orderBy("shingle")) - 1  # up to WHOLE
    whole = sized.where(F.col("n") <= WHOLE).select(
        F.xxhash64("shingle").alias("h"), "item",
        F.call_function("shiftleft", F.lit(1).cast("long"), place.cast("int")).alias("bit"),
        F.ceil(F.col("n") * F.lit(containment) - 1e-9).cast("long").alias("needed"),
    )
    most = PARTITIONS[-1][1]
    known = F.lit(most)
    for upper, minima in reversed(PARTITIONS[:-1]):
        known = F.when(F.col("n") <= upper, minima).otherwise(known)
    hashed = sized.where(F.col("n") > WHOLE).withColumn("h", F.xxhash64("shingle")).groupBy("item").agg(
        F.first("n").alias("n"),
        *[F.min_by("h", F.xxhash64(F.lit(j), "h")).alias(f"m{j}") for j in range(most)],
    )
    minima = F.array(
        *[F.struct(F.lit(j).alias("j"), F.col(f"m{j}").alias("h")) for j in range(most)]
    )
    large = (
        hashed.select("item", known.alias("known"), F.inline(minima))
        .where("j < known")
        .select(
            "h", "item", F.expr("shiftleft(1L, j)").alias("bit"),
            F.greatest(F.floor(F.col("known") / 5), F.lit(1)).alias("needed"),
        )
    )
    return whole.union(large).groupBy("h", "item", "needed").agg(F.bit_or("bit").alias("mask"))


def _short_runs(rows: DataFrame, lengths: list[int]) -> DataFrame:
    """``(_row, run)``: distinct runs of so many words of each row, for each length."""
    split = rows.select("_row", words(F.lower("text")).alias("_w"))

    def of(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size("_w") - (n - 1), F.lit(1)))
        runs = F.arrays_zip(*[F.slice("_w", j + 1, F.size(starts)).alias(f"w{j}") for j in range(n)])
        spelt = F.transform(runs, lambda r: F.concat_ws(" ", *[r[f"w{j}"] for j in range(n)]))
        return F.when(F.size("_w") >= n, F.array_distinct(spelt)).otherwise(F.array().cast("array<string>"))

    return split.select("_row", F.explode(F.concat(*[of(n) for n in lengths])).alias("run"))


def _short_items(rows: DataFrame, items: DataFrame) -> DataFrame:
    """``(_row, item, n_shared, n_item)`` of ``items(item, run, n)``, each one run of words.

    Runs of the lengths that items have are compared as they are; a run in every document
    gives one row for each, and where the items are too many to be broadcast, its
    partition can be split.
    """
    lengths = sorted(r["n"] for r in items.select("n").distinct().collect())  # 1 to 4
    one = F.lit(1).cast("long")
    if not lengths:
        return rows.limit(0).select("_row", F.col("_row").alias("item"), one.alias("n_shared"), one.alias("n_item"))
    wanted = items.select("run", "item")
    wanted = F.broadcast(wanted) if fits_broadcast(wanted, 500_000) else wanted
    return _short_runs(rows, lengths).join(wanted, "run").select(
        "_row", "item", one.alias("n_shared"), one.alias("n_item")
    )


def contained_items(rows: DataFrame, items: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """``(_row, item, n_shared, n_item)`` of ``rows(_row, text)`` and ``items(item, text)``.

    The sketches are broadcast only where they are measured to be small; otherwise both
    sides are shuffled by shingle, where a hot shingle's partition can be split.
    """
    with own_tables(rows.sparkSession) as result:
        split = items.select("item", "text", words(F.lower("text")).alias("_w"))
        short = written(
            split.where(F.size("_w").between(1, SHINGLE - 1)).select(
                "item", F.concat_ws(" ", "_w").alias("run"), F.size("_w").alias("n")
            )
        )
        sized = written(_with_size(split.where(F.size("_w") >= SHINGLE)))
        sketch = written(_sketches(sized, containment))
        small = fits_broadcast(sketch, 500_000)
        probe = F.broadcast(sketch) if small else sketch
        hashed = _shingled(rows, "_row").select("_row", F.xxhash64(F.concat_ws(" ", *_WORDS)).alias("h"))
        candidates = written(
            hashed.join(probe, "h")
            .groupBy("_row", "item")
            .agg(F.bit_or("mask").alias("mask"), F.first("needed").alias("needed"))
            .where(F.bit_count("mask") >= F.col("needed"))
            .select("_row", "item")
        )
        texts = rows.select("_row", "text").join(candidates.select("_row").distinct(), "_row", "left_semi")
        exact = _shingled(texts, "_row").select("_row", F.concat_ws(" ", *_WORDS).alias("shingle")).distinct()
        wanted = F.broadcast(sized) if fits_broadcast(sized, 500_000) else sized
        long = (
            exact.join(wanted, "shingle")
            .join(candidates, ["_row", "item"])
            .groupBy("_row", "item")
            .agg(F.count("*").alias("n_shared"), F.first("n").alias("n_item"))
            .where(F.col("n_shared") >= containment * F.col("n_item"))
        )
        return result(long.union(_short_items(rows, short).select(*long.columns)))


def _items(benchmark: DataFrame) -> DataFrame:
    renamed = benchmark.select(F.col("item_id").alias("doc_id"), "text")
    return keyed(renamed).select(F.col("_row").alias("item"), F.col("doc_id").alias("item_id"), "text")


def leaks(docs: DataFrame, benchmark: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """``(doc_id, item_id, n_shared, n_item)``: items of which a document holds enough.

    Words are what stands between blanks, lower-cased; an item of one to four words is one
    shingle, which every document with these words side by side holds.  Null, empty and
    blank texts hold nothing and are found nowhere.  Rows that share an id, or have none,
    are documents and items of their own.
    """
    rows, items = keyed(docs), _items(benchmark)
    found = contained_items(rows, items.select("item", "text"), containment)
    return (
        found.join(rows.select("_row", "doc_id"), "_row")
        .join(items.select("item", "item_id"), "item")
        .select("doc_id", "item_id", "n_shared", "n_item")
    )


def drop_leaks(docs: DataFrame, benchmark: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """``docs``, with all columns, without the rows that contain a benchmark item."""
    rows, items = keyed(docs, whole=True), _items(benchmark)
    found = contained_items(rows, items.select("item", "text"), containment)
    return rows.join(found.select("_row").distinct(), "_row", "left_anti").select("_doc.*")


LEAKS_SQL = f"""
WITH said AS (
  SELECT 'd' AS kind, doc_id AS id, regexp_extract_all(lower(text), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
  UNION ALL
  SELECT 'i', item_id, regexp_extract_all(lower(text), '[^\\x20\\x09-\\x0D]+') FROM benchmark
),
size AS (SELECT {SHINGLE} AS k UNION SELECT len(w) FROM said WHERE kind = 'i' AND len(w) BETWEEN 1 AND {SHINGLE - 1}),
place AS (SELECT kind, id, w, k, UNNEST(range(1, len(w) - k + 2)) AS i FROM said, size
  WHERE len(w) >= k AND (kind = 'd' OR k = least(len(w), {SHINGLE}))),
shingle AS (
  SELECT DISTINCT kind, id, array_to_string(list_slice(w, i, i + k - 1), ' ') AS s FROM place
),
sized AS (SELECT id, s, count(*) OVER (PARTITION BY id) AS n FROM shingle WHERE kind = 'i')
SELECT d.id AS doc_id, z.id AS item_id, count(*) AS n_shared, max(z.n) AS n_item
FROM shingle d JOIN sized z ON z.s = d.s
WHERE d.kind = 'd'
GROUP BY d.id, z.id
HAVING count(*) >= {CONTAINMENT} * max(z.n)
"""
