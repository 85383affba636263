"""Size checks, skew handling and durable hand-over points shared by the operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# A table is broadcast only when it is known to be below both bounds.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 * 1024 * 1024
# At most this many keys can each hold more than 1/HOT_KEYS of the rows.
HOT_KEYS = 20_000
# Parts that a task's share of the rows is cut into, where a key is split.
SPLITS = 16
# Slices of the tasks in a ranking.
SALTS = 64
# Slots of a key filter for each key, and the most that it has.
FILTER_SHARE = 32
FILTER_SLOTS = 2**18


def fits_broadcast(
    table: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES
) -> bool:
    """Whether the whole table is small; looks at no more than ``max_rows + 1`` rows."""
    width = reduce(
        lambda a, b: a + b,
        [F.coalesce(F.length(F.col(f"`{c}`").cast("string")), F.lit(0)) for c in table.columns],
    )
    n, size = (
        table.limit(max_rows + 1)
        .agg(F.count("*"), F.coalesce(F.sum(width.cast("long")), F.lit(0)))
        .first()
    )
    return n <= max_rows and 4 * size <= max_bytes


def bounded_list(words: DataFrame | Sequence[str] | None, limit: int) -> list[str] | None:
    """A word list as Python strings if it has at most ``limit`` entries, else None."""
    if words is None:
        return []
    if not isinstance(words, DataFrame):
        words = list(words)
        return words if len(words) <= limit else None
    rows = words.select(words.columns[0]).limit(limit + 1).collect()
    return [r[0] for r in rows if r[0] is not None] if len(rows) <= limit else None


def lookup_join(
    rows: DataFrame,
    table: DataFrame,
    key: str,
    how: str,
    spread_by: Sequence[str],
    max_rows: int = BROADCAST_ROWS,
    keys: DataFrame | None = None,
) -> DataFrame:
    """Join many rows to a look-up table on one column, safe for hot keys.

    A table that is measured to be small is broadcast.  Otherwise both sides are
    shuffled; rows of frequent keys are split by ``spread_by`` into as many parts as
    their measured count asks for (``split_factors``), rows without a key likewise, and
    only those keys of the table are repeated, so no key lands in a single task.
    ``keys`` has the keys of all rows, where they can be had without making the rows.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join type {how!r}")
    if fits_broadcast(table, max_rows):
        return rows.join(F.broadcast(table), key, how)
    hot = split_factors(rows if keys is None else keys, key)
    salted = rows.join(F.broadcast(hot), key, "left").withColumn(
        "_salt",
        F.pmod(
            F.xxhash64(*spread_by),
            # rows without a key find no partner; they are only kept apart from each other
            F.when(F.col(key).isNull(), SPLITS * _partitions(rows)).otherwise(F.coalesce("_parts", F.lit(1))),
        ).cast("int"),
    ).drop("_parts")
    copies = table.join(F.broadcast(hot), key, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))
    ).drop("_parts")
    return salted.join(copies, [key, "_salt"], how).drop("_salt")


def _partitions(rows: DataFrame) -> int:
    return int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def split_factors(rows: DataFrame, key: str) -> DataFrame:
    """``(key, _parts)`` of the keys with too many rows for one part of a task.

    A part is one ``SPLITS``-th of what a task gets on average; a key with more rows is
    split into as many parts as it fills, so parts even out over the tasks.  At most
    ``SPLITS`` keys a task, and no more than ``HOT_KEYS``, can be that large, so the table
    is small whatever the rows are.
    """
    counts = durable(rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_rows")))
    total = counts.agg(F.sum("_rows")).first()[0] or 0
    part = max(1, total // min(SPLITS * _partitions(rows), HOT_KEYS))
    return counts.where(F.col("_rows") > part).select(
        key, F.ceil(F.col("_rows") / part).cast("int").alias("_parts")
    )


def key_filter(table: DataFrame, key: str = "form") -> Callable[[Column], Column]:
    """A test that holds for every value of a table's column, and for few others.

    Each value marks the slot that its hash names, of a bounded number, so values that
    cannot be in the table need not be joined to it.  Of a table with more rows than
    slots it lets most pass.
    """
    size = 2**10
    wanted = min(FILTER_SHARE * table.limit(FILTER_SLOTS).count(), FILTER_SLOTS)
    while size < wanted:
        size *= 2

    def slot(value: Column) -> Column:
        return F.pmod(F.xxhash64(value), F.lit(size)).cast("int")

    slots = bytearray(size)
    for r in table.select(slot(F.col(f"`{key}`")).alias("at")).distinct().collect():
        slots[r["at"]] = 1
    marks, marked = F.lit(bytes(slots)), F.lit(b"\x01")
    return lambda value: F.substring(marks, slot(value) + 1, 1) == marked


def row_ids(rows: DataFrame) -> DataFrame:
    """``rows`` with ``_row``, a number of its own for each row that stays the same when a
    task is run again; rows that have one keep it.

    A scan gives the same rows in the same order.  A task behind a shuffle gets the same
    rows in any order, so there they are sorted by a hash of all they hold, in the task;
    rows that are equal may change places.
    """
    if "_row" in rows.columns:
        return rows
    if "Exchange" in rows._jdf.queryExecution().executedPlan().toString():
        rows = rows.sortWithinPartitions(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]))
    return rows.withColumn("_row", F.monotonically_increasing_id())


def dealt_rows(rows: DataFrame) -> DataFrame:
    """Numbered rows dealt by their number, for several look-ups without a further shuffle."""
    return row_ids(rows).repartition("_row")


def row_lookup(
    rows: DataFrame,
    forms: Column,
    table: DataFrame,
    hit: Column | None = None,
    max_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """All rows and columns of ``rows`` with ``hits``: what a table keyed by ``form`` says.

    ``forms`` is an array expression over a row.  ``hits`` collects ``hit`` (a column of
    the joined row, by default the form) for each distinct form of the row that is in
    the table.  Rows are told apart by a number of their own, so repeated rows and rows
    with null keys all come back, on either route.  Forms that cannot be in the table are
    dropped where they arise (``key_filter``).

    A table measured to be small is broadcast, in one pass: a row is exploded into its
    forms where it lies, only the first of these carries the columns, forms without a
    hit are dropped, and the row is put together again without a second read.
    Otherwise rows are written once and forms alone travel to the table, hot ones salted.
    """
    value = F.col("form") if hit is None else hit
    may_hit = key_filter(table)
    numbered = row_ids(rows).select(
        "_row",
        F.struct(*[F.col(f"`{c}`") for c in rows.columns if c != "_row"]).alias("_page"),
        F.array_distinct(
            F.filter(F.coalesce(forms, F.array().cast("array<string>")), lambda f: may_hit(f))
        ).alias("_forms"),
    )
    if fits_broadcast(table, max_rows):
        parts = F.transform(
            F.concat(F.array(F.lit("")), F.col("_forms")),
            lambda f, i: F.struct(
                f.alias("form"), (i == 0).alias("_first"), F.when(i == 0, F.col("_page")).alias("_page")
            ),
        )
        found = (
            (numbered if "_row" in rows.columns else numbered.repartition("_row"))
            .select("_row", F.inline(parts))
            .join(F.broadcast(table.withColumn("_in", F.lit(True))), "form", "left")
            .withColumn("_hit", F.when(F.col("_in") & ~F.col("_first"), value))
            .where(F.col("_first") | F.col("_hit").isNotNull())
            .groupBy("_row")
            .agg(
                F.first("_page", ignorenulls=True).alias("_page"),
                F.collect_list("_hit").alias("hits"),
            )
        )
    else:
        numbered = stage(numbered)
        stream = numbered.select("_row", F.explode("_forms").alias("form"))
        hits = (
            lookup_join(stream, table, "form", "inner", ["_row"], max_rows)
            .groupBy("_row")
            .agg(F.collect_list(value).alias("hits"))
        )
        empty = F.array().cast(hits.schema["hits"].dataType)
        found = numbered.join(hits, "_row", "left").withColumn("hits", F.coalesce("hits", empty))
    return found.select(*(["_row"] if "_row" in rows.columns else []), "_page.*", "hits")


def top_per_group(
    rows: DataFrame, group: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank"
) -> DataFrame:
    """First ``n`` rows of each group under a total order, for groups of any size.

    Each task keeps its own first ``n`` per group before anything is shuffled;
    tasks are bundled into slices that are cut to ``n`` again, so the last ranking
    sees at most ``SALTS * n`` rows per group.  Slices do not affect the result.
    """
    sliced = rows.withColumn("_slice", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    local = Window.partitionBy(*group, "_slice").orderBy(*order)
    whole = Window.partitionBy(*group).orderBy(*order)
    return (
        sliced.withColumn("_local", F.row_number().over(local))
        .where(F.col("_local") <= n)
        .drop("_local", "_slice")
        .withColumn(rank, F.row_number().over(whole))
        .where(F.col(rank) <= n)
    )


def term_table(spark: SparkSession, words: list[str]) -> DataFrame:
    """``(term_index, term)`` of a vocabulary held by the driver (a model parameter bounds it)."""
    index = pa.array(range(len(words)), pa.int32())
    return spark.createDataFrame(
        pa.table({"term_index": index, "term": pa.array(words, pa.string())})
    )


def spread(df: DataFrame, by: Sequence[str] | None = None, num: int | None = None) -> DataFrame:
    """Give heavy per-row work enough tasks.

    Call it on a scan: a table that arrives in fewer partitions than there are
    cores is repartitioned; a large one keeps its scan partitions, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if num is None and df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(num or cores, *(by or []))


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage at a point that is read more than once.

    Uses reliable ``checkpoint()`` in the folder named by ``spark.checkpoint.dir``;
    a local session without that setting gets a scratch folder of its own.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    return df.checkpoint(eager=True)


def stage(df: DataFrame) -> DataFrame:
    """The rows from a Parquet table in the shared folder, read once more by column."""
    spark = df.sparkSession
    path = stage_path(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stage(table: DataFrame) -> None:
    """Delete the files of a table that ``stage`` has written and nothing reads any more."""
    spark = table.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        if "/quirelens-" in path:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def stage_path(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    ensure_checkpoint_dir(spark)
    folder = spark.sparkContext.getCheckpointDir().rstrip("/")
    return f"{folder}/quirelens-{uuid.uuid4().hex}"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="quirelens-checkpoint-")
    sc.setCheckpointDir(configured)
