"""Sources.  Schemas are explicit: no inference pass over the data."""

from __future__ import annotations

from functools import reduce
from itertools import islice

from pyspark.ml.clustering import DistributedLDAModel, LDAModel, LocalLDAModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelens.functions.ids import BUCKET, page_bucket, volume_path
from quirelens.operators.joins import only_volumes
from quirelens.operators.scale import spread

STAGE_SCHEMA = "text string, volid string, seq string"
# Names of files that one scan is cut down to.
LISTED = 10_000
CATALOGUE = ("htid", "title", "author", "rights_date_used", "access", "rights")


def read_pages(
    spark: SparkSession,
    path: str,
    fmt: str = "parquet",
    ids: DataFrame | None = None,
    num_partitions: int | None = None,
    index: DataFrame | None = None,
) -> DataFrame:
    """Pages ``(volid, seq, text)``, of the listed volumes if ``ids`` is given.

    ``fmt``: ``parquet``, ``store`` (``writers.write_pages``; of its folders, only those
    that can hold a listed volume are read), ``csv`` (a headerless stage file) or
    ``text`` (one file per page, named ``<volid>/<seq>.txt``).  A file scan skips files of length 0;
    ``index(volid, seq)`` brings such pages back as empty ones, which matters for
    stitching.
    """
    if fmt == "parquet":
        pages = spark.read.parquet(path).select("volid", "seq", "text")
    elif fmt == "store":
        stored = spark.read.parquet(path)
        (bucket,) = [c for c in stored.columns if c.startswith(BUCKET)]
        if ids is not None:
            own = page_bucket(F.col("volid"), int(bucket.removeprefix(BUCKET))).alias("b")
            # no more buckets than the store has folders
            wanted = [r["b"] for r in ids.where("volid is not null").select(own).distinct().collect()]
            stored = stored.where(F.col(bucket).isin(wanted))
        pages = stored.select("volid", "seq", "text")
    elif fmt == "csv":
        pages = read_stage_csv(spark, path)
    elif fmt == "text":
        raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(
            F.col("value").alias("text"), F.split(F.col("_metadata.file_path"), "/").alias("_p")
        )
        pages = raw.select(
            F.url_decode(F.try_element_at("_p", F.lit(-2))).alias("volid"),
            F.regexp_replace(F.try_element_at("_p", F.lit(-1)), r"\.[^.]*$", "").alias("seq"),
            "text",
        )
    else:
        raise ValueError(f"unknown page format {fmt!r}")
    if num_partitions is None:
        pages = spread(pages)
    else:
        pages = pages.repartition(num_partitions, "volid", "seq")
    if index is not None:
        pages = index.join(pages, ["volid", "seq"], "left").select(
            "volid", "seq", F.coalesce("text", F.lit("")).alias("text")
        )
    return only_volumes(pages, ids) if ids is not None else pages


def read_stage_csv(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Headerless page CSV: text, volume id, seq.

    Stage texts hold no line breaks, so files stay splittable; ``multiline`` reads
    texts that do.
    """
    return (
        spark.read.schema(STAGE_SCHEMA)
        .option("multiLine", multiline)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
        .select("volid", "seq", "text")
    )


def read_patterns(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``name <tab> regex`` lines in file order: good ones, and lines of another shape.

    ``(line, name, pattern)`` and ``(line, value)``.  The file is read as one
    row: it is a short hand-written list, and its order matters.
    """
    lines = spark.read.text(path, wholetext=True).select(
        F.posexplode(F.split(F.regexp_replace("value", "\r?\n\\z", ""), "\r?\n")).alias("line", "value")
    )
    parts = lines.withColumn("_p", F.split("value", "\t"))
    good = parts.where(F.size("_p") == 2).select(
        "line", F.col("_p")[0].alias("name"), F.col("_p")[1].alias("pattern")
    )
    return good, parts.where(F.size("_p") != 2).select("line", "value")


def read_word_list(spark: SparkSession, path: str, column: str = "word") -> DataFrame:
    """First CSV column."""
    return spark.read.csv(path).select(F.col("_c0").alias(column)).where(F.col(column).isNotNull())


def read_phrase_list(spark: SparkSession, path: str) -> DataFrame:
    """Phrase report as ``(rank, phrase)``: by falling count, then by phrase."""
    rows = spark.read.schema("noun_phrase string, count long").csv(path)
    return rows.select(
        F.struct((-F.col("count")).alias("n"), F.col("noun_phrase").alias("p")).alias("rank"),
        F.col("noun_phrase").alias("phrase"),
    )


def read_exclusions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("volid string, seq string").csv(path)


def catalogue_columns(raw: DataFrame, typed: bool = False) -> DataFrame:
    """The six catalogue columns; ``typed`` turns the year into an integer or null."""
    cols = raw.select(*CATALOGUE)
    if typed:
        cols = cols.withColumn("rights_date_used", F.col("rights_date_used").try_cast("int"))
    return cols


def read_catalogue(spark: SparkSession, path: str, typed: bool = False) -> DataFrame:
    return catalogue_columns(spark.read.csv(path, sep="\t", header=True), typed)


def read_result(spark: SparkSession, path: str) -> DataFrame:
    """Model output with its ids named ``htid`` and ``seq``, without tokens."""
    raw = spark.read.parquet(path)
    names = {"_c1": "htid", "_c2": "seq", "volid": "htid"}
    return raw.withColumnsRenamed({k: v for k, v in names.items() if k in raw.columns}).drop("tokens")


def read_ids(spark: SparkSession, path: str, num_partitions: int | None = None) -> DataFrame:
    """One volume id per line."""
    ids = spark.read.text(path).select(F.trim("value").alias("volid")).where(F.col("volid") != "")
    return ids.repartition(num_partitions) if num_partitions else ids


def read_mets(
    spark: SparkSession, root: str, ids: DataFrame | None = None, batch: int = LISTED
) -> DataFrame:
    """``(path, xml)`` of the metadata files below a tree root, paths relative to it.

    With ``ids(volid)`` only files with the name of a listed volume are opened: names are
    taken from the id table ``batch`` at a time and cut the list of files before it is
    dealt out to tasks.  The list itself is made once.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.mets.xml")
        .load(root)
    )

    def texts(chosen: DataFrame) -> DataFrame:
        return chosen.select(
            F.regexp_extract("path", r"([^/]+/pairtree_root/.*)$", 1).alias("path"),
            F.decode("content", "UTF-8").alias("xml"),
        )

    if ids is None:
        return texts(files)
    name = F.try_element_at(F.split(volume_path(F.col("volid")), "/"), F.lit(-1))
    names = ids.select(name.alias("name")).where("name is not null").distinct()
    rows, parts = iter(r["name"] for r in names.toLocalIterator()), []
    while wanted := list(islice(rows, batch)):
        parts.append(texts(files.where(F.col("_metadata.file_name").isin(wanted))))
    return reduce(DataFrame.union, parts) if parts else texts(files).limit(0)


def load_model(path: str, distributed: bool = False) -> tuple[CountVectorizerModel, LDAModel]:
    """Vocabulary and topic model saved below one folder."""
    kind = DistributedLDAModel if distributed else LocalLDAModel
    return CountVectorizerModel.load(f"{path}/vocab"), kind.load(f"{path}/topicmodel")
