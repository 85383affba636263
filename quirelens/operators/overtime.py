"""Topic weight per year, and the extreme pages of each topic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirelens.operators.joins import attach_catalogue, attach_labels
from quirelens.operators.scale import BROADCAST_ROWS, durable, lookup_join, top_per_group

SENTINEL_YEAR = "9999"


def explode_topics(pages: DataFrame, weights: str = "weights", keep: tuple[str, ...] = ("htid", "seq")) -> DataFrame:
    """One row per page and topic."""
    return pages.select(*keep, F.posexplode(weights).alias("topic", "weight"))


def year_of(text: Column) -> Column:
    """Year as integer; null for text that is no number."""
    return text.try_cast("int")


def topic_weight_by_year(
    pages: DataFrame, catalogue: DataFrame, max_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """``(year, topic, sum_weight)``.

    Weights are summed per volume and topic before the catalogue is joined: the
    join then sees k rows per volume, however many pages the volume has.
    """
    per_volume = (
        explode_topics(pages, keep=("htid",))
        .groupBy("htid", "topic")
        .agg(F.sum("weight").alias("weight"))
    )
    dated = catalogue.select("htid", year_of(F.col("rights_date_used")).alias("year"))
    return (
        attach_catalogue(per_volume, dated, ("htid", "topic"), max_rows)
        .groupBy("year", "topic")
        .agg(F.sum("weight").alias("sum_weight"))
    )


def total_weight_by_year(by_topic: DataFrame) -> DataFrame:
    return by_topic.groupBy("year").agg(F.sum("sum_weight").alias("total_weight"))


def attach_year_total(by_topic: DataFrame) -> DataFrame:
    """Year totals beside the topic sums; the null year gets none.

    A window over the k rows of a year: same result as joining the totals back,
    without computing the sums twice.
    """
    total = F.sum("sum_weight").over(Window.partitionBy("year"))
    return by_topic.withColumn("total_weight", F.when(F.col("year").isNotNull(), total))


def normalised_weight(joined: DataFrame) -> DataFrame:
    return joined.select(
        "year", "topic", F.try_divide("sum_weight", "total_weight").alias("norm_weight")
    )


def topics_by_year(by_topic: DataFrame, labels: DataFrame) -> DataFrame:
    return attach_labels(normalised_weight(attach_year_total(by_topic)), labels).orderBy(
        "year", "topic"
    ).select("year", "topic", "norm_weight", "topic_terms")


def year_histogram(
    pages: DataFrame, catalogue: DataFrame, max_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Pages per year text, latest first; pages are counted per volume before the join."""
    per_volume = pages.groupBy("htid").agg(F.count("*").alias("n"))
    dated = catalogue.select("htid", "rights_date_used")
    return (
        attach_catalogue(per_volume, dated, ("htid",), max_rows)
        .groupBy("rights_date_used")
        .agg(F.sum("n").alias("count"))
        .orderBy(F.desc("rights_date_used"))
    )


def sentinel_years(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("rights_date_used") == SENTINEL_YEAR)


def wide_topics(pages: DataFrame, k: int, weights: str = "weights") -> DataFrame:
    """Columns ``t0..t{k-1}`` in one projection."""
    rest = [c for c in pages.columns if c != weights]
    return pages.select(
        *rest, *[F.get(weights, F.lit(i)).alias(f"t{i}") for i in range(k)]
    )


def representative_pages(
    pages: DataFrame,
    catalogue: DataFrame,
    top: int = 1000,
    bottom: int = 100,
) -> DataFrame:
    """Per topic the ``top`` highest and ``bottom`` lowest pages, with metadata.

    A page can be in both slices.  Both ends come from one scan: each weight goes up for
    both ends with its sign turned for one of them, and one ranking cuts both, first
    inside each slice of tasks.  The chosen pages, at most ``k * (top + bottom)``, then
    cut the catalogue down to their volumes.
    """
    long = explode_topics(pages)
    ends = long.select(
        "*",
        F.inline(
            F.array(
                F.struct(F.lit("top").alias("slice"), (-F.col("weight")).alias("_order"), F.lit(top).alias("_most")),
                F.struct(F.lit("bottom").alias("slice"), F.col("weight").alias("_order"), F.lit(bottom).alias("_most")),
            )
        ),
    )
    # a weight that is null is the lowest of all at either end
    order = [F.when(F.col("slice") == "top", F.col("weight").isNull()).otherwise(F.col("weight").isNotNull()), "_order", "htid", "seq"]
    ranked = top_per_group(ends, ["topic", "slice"], order, max(top, bottom))
    chosen = durable(ranked.where(F.col("rank") <= F.col("_most")).drop("_order", "_most"))
    details = lookup_join(
        catalogue.select("htid", "rights_date_used", "title", "author", "access", "rights"),
        chosen.select("htid").distinct(), "htid", "left_semi", ["htid"],
    )
    return lookup_join(chosen, details, "htid", "left", ["topic", "slice", "rank"]).select(
        "topic", "slice", "rank", "htid", "seq", "weight",
        "rights_date_used", "title", "author", "access", "rights",
    )
