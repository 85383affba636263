"""Row keys and written hand-over tables shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirelens.operators.scale import BROADCAST_ROWS, fits_broadcast

#: Words are runs of anything but these bytes: space, tab, LF, VT, FF, CR.
SPACE = "\\x20\\x09-\\x0D"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="quirelens-llm-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def shared_file(spark: SparkSession, name: str, data: bytes) -> str:
    """Writes a file of bounded size to the shared folder, whatever store that is in."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(shared_folder(spark), name)
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
    try:
        for at in range(0, len(data), 1 << 22):
            out.write(bytearray(data[at : at + (1 << 22)]))
    finally:
        out.close()
    return path.toString()


#: Paths of the tables that the open ``own_tables`` scopes have written.
_SCOPES: ContextVar[tuple[list[str], ...]] = ContextVar("quirelens_tables", default=())


def written(df: DataFrame) -> DataFrame:
    """The rows of ``df`` from a Parquet table in the shared folder: lineage ends here.

    A lost executor then costs its own tasks only, and later reads are pruned scans.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/quirelens-{uuid.uuid4().hex}"
    for scope in _SCOPES.get()[-1:]:
        scope.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def light(ids: DataFrame) -> DataFrame:
    """Ids to be joined to texts: broadcast if they are measured to be few, so that no text
    is shuffled; otherwise as they are, and both sides are."""
    return F.broadcast(ids) if fits_broadcast(ids, BROADCAST_ROWS) else ids


@contextmanager
def own_tables(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes the tables that are written inside, once the block ends.

    Yields a function that writes the block's result so that it outlives the block.
    """
    outer = _SCOPES.get()
    paths: list[str] = []
    mark = _SCOPES.set((*outer, paths))

    def result(df: DataFrame) -> DataFrame:
        inner = _SCOPES.set(outer)
        try:
            return written(df)
        finally:
            _SCOPES.reset(inner)

    try:
        yield result
    finally:
        _SCOPES.reset(mark)
        for path in paths:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def keyed(docs: DataFrame, whole: bool = False) -> DataFrame:
    """``(_row, doc_id, text)`` where ``_row`` is a unique long in doc_id order.

    ``whole`` adds all columns of ``docs`` as the struct ``_doc``.  Unique ids that are
    never null are used as they are.  Otherwise rows are written once in the order
    doc_id, text (nulls last) and numbered, so repeated rows and rows without an id are
    documents of their own, each later than the ones before it.
    """
    columns = ["doc_id", "text"]
    if whole:
        columns.append(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))
    rows = docs.select(*columns)
    n, ids = rows.agg(F.count("*"), F.count_distinct("doc_id")).first()
    if n == ids and dict(rows.dtypes)["doc_id"] in ("bigint", "int", "smallint", "tinyint"):
        # no id is null here; said once, all joins by _row share one shuffle of the texts
        known = rows.where(F.col("doc_id").isNotNull())
        return known.select(F.col("doc_id").cast("long").alias("_row"), "*")
    order = [F.col("doc_id").asc_nulls_last(), F.col("text").asc_nulls_last()]
    return written(
        rows.orderBy(*order).select(F.monotonically_increasing_id().alias("_row"), "*")
    )


def words(text: Column) -> Column:
    """Array of the words of ``text``; empty without any, or for null."""
    bare = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(bare != "", F.split(bare, f"[{SPACE}]+")).otherwise(F.array().cast("array<string>"))


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(n))


def bounded_sample(rows: DataFrame, label: str, bound: int) -> DataFrame:
    """At most ``bound`` rows in all, spread evenly over the values of ``label``.

    Counts per label come first; a row is then kept by a hash of its content, and what
    a label still has too many of is cut by that hash, so no label meets in one task
    and the sample does not depend on the partitioning.
    """
    # beyond ``bound`` different labels, the most frequent ones
    most = rows.groupBy(label).count().orderBy(F.desc("count"), label).limit(bound)
    counts = [r.asDict() for r in most.collect()]
    if not counts:
        return rows.limit(0)
    share = max(1, bound // len(counts))
    key = F.pmod(F.xxhash64(*[F.col(c) for c in sorted(rows.columns)]), F.lit(1 << 30))
    spark = rows.sparkSession
    limits = spark.createDataFrame(
        [(r[label], min(1 << 30, int((1 << 30) * 1.5 * share / r["count"]) + 1)) for r in counts],
        f"_label {rows.schema[label].dataType.simpleString()}, _below long",
    )
    taken = (
        rows.withColumn("_key", key)
        .join(F.broadcast(limits), rows[label] == F.col("_label"))
        .where(F.col("_key") < F.col("_below"))
    )
    window = Window.partitionBy(label).orderBy("_key", *sorted(rows.columns))
    return (
        taken.withColumn("_n", F.row_number().over(window))
        .where(F.col("_n") <= share)
        .select(*rows.columns)
    )


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, bound: int) -> DataFrame:
    """``(text, label)`` of at most ``bound`` usable documents, evenly over the labels.

    ``labels(doc_id, label)`` has one row per id.  Ids and a hash of the text alone meet
    the labels; the texts of those drawn, a bounded number, are read in a second scan that
    the drawn ids are broadcast to.  So no text is shuffled, whatever the size.  Equal
    texts of one id count once.
    """
    mark = F.xxhash64("text").alias("_mark")
    narrow = docs.where(usable).select("doc_id", mark).distinct()
    drawn = written(bounded_sample(narrow.join(labels.select("doc_id", label), "doc_id"), label, bound))
    return (
        docs.where(usable)
        .select("doc_id", "text", mark)
        .join(F.broadcast(drawn), ["doc_id", "_mark"])
        .dropDuplicates(["doc_id", "_mark"])
        .select("text", label)
    )
