"""Sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.clustering import LDAModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelens.functions.ids import BUCKET, page_bucket


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Headerless CSV, comma, UTF-8; blanks and tabs at the ends of a text are kept."""
    (
        df.write.mode(mode)
        .option("header", False)
        .option("sep", ",")
        .option("encoding", "UTF-8")
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def write_header(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The column names, comma-joined, as a one-line text beside the data."""
    names = F.concat_ws(",", *[F.lit(c) for c in df.columns])
    df.sparkSession.range(1).select(names.alias("value")).coalesce(1).write.mode(mode).text(path)


def write_result(result: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Topic distribution per page as Parquet, without text and features."""
    result.drop("text", "features").write.mode(mode).parquet(path)


def save_model(
    path: str, vocabulary: CountVectorizerModel | None = None, model: LDAModel | None = None
) -> None:
    if vocabulary is not None:
        vocabulary.write().overwrite().save(f"{path}/vocab")
    if model is not None:
        model.write().overwrite().save(f"{path}/topicmodel")


def write_sweep(sweep: DataFrame, path: str, mode: str = "errorifexists") -> None:
    sweep.coalesce(1).write.mode(mode).option("header", True).csv(path)


def write_per_topic(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One folder per topic, each written by one task per topic (bounded slices)."""
    rows.repartition("topic").sortWithinPartitions("topic", "slice", "rank").write.mode(
        mode
    ).partitionBy("topic").option("header", True).csv(path)


def write_quarantine(bad: DataFrame, path: str, mode: str = "errorifexists") -> bool:
    """Error report, only when there is something to report."""
    if bad.isEmpty():
        return False
    bad.write.mode(mode).parquet(path)
    return True


def write_stage(df: DataFrame, path: str, mode: str = "errorifexists", partition_by: Sequence[str] = ()) -> None:
    """Parquet between stages: keeps empty texts, nulls and types apart."""
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def write_pages(pages: DataFrame, path: str, buckets: int = 256, mode: str = "errorifexists") -> None:
    """Pages as a store that an id list prunes: a folder per hash bucket of the volume.

    Tasks get ranges of (bucket, volume, seq), so a bucket has few files, a volume lies
    together in order, and a volume with a third of all pages is written by many tasks.
    """
    folder = f"{BUCKET}{buckets}"
    order = [folder, "volid", "seq"]
    (
        pages.withColumn(folder, page_bucket(F.col("volid"), buckets))
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .write.mode(mode)
        .partitionBy(folder)
        .parquet(path)
    )
