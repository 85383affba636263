"""From raw documents to encoded training text: five stages, each on what the last one kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelens.llm import decontaminate, langid, lines, minhash
from quirelens.llm.queries import byte_pairs, table
from quirelens.llm.rows import remainder, written

#: Rows of an Arrow batch.  The JVM and the Python worker both keep room for a batch of texts
#: in each task, outside the heap, also while later stages run.
BATCH_ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    """No batch of the session's Python stages has more than ``BATCH_ROWS`` rows from now on."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(setting)) <= BATCH_ROWS:
        spark.conf.set(setting, str(BATCH_ROWS))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those too far from every learned language.

    The model is fitted on rows of the stage's own input; ``lang`` becomes the language
    that was found, for labelled and unlabelled rows alike.
    """
    small_batches(spark)
    model = langid.fit(docs.where(F.coalesce(remainder(F.col("doc_id"), 5), F.lit(1)) != 0))
    found = langid.identify(docs.drop("lang"), model).where("not lang_rejected")
    return found.withColumnRenamed("lang_pred", "lang").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later copies of repeated runs of lines; a document of nothing else goes."""
    return lines.drop_repeated_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each group of near duplicates."""
    return minhash.first_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain three quarters or more of a benchmark item."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the token ids and their number; ``decoded_ok`` tells that they give the text back.

    Null and empty texts get no ids.  Rows are handled one by one, repeated ones too, and
    a text of any length whole.  Columns of ``docs`` with the new names are replaced.
    """
    small_batches(spark)
    new = ("ids", "n_tokens", "decoded_ok")
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in new]
    coded = docs.select(*rest, byte_pairs(spark).round_trip(F.col("text")).alias("_coded"))
    return coded.select(
        *rest,
        F.size("_coded.ids").cast("long").alias("n_tokens"),
        F.col("_coded.ids").alias("ids"),
        F.col("_coded.same").alias("decoded_ok"),
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("byte-level BPE", encoding),
]

#: A nearest-centroid model cannot be stated in SQL; tests compare each stage by brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
