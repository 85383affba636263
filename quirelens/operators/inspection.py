"""Describing topics and the tables behind a topic browser."""

from __future__ import annotations

import uuid

from pyspark.ml.clustering import LDAModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirelens.functions import arrays as ax
from quirelens.operators.scale import ensure_checkpoint_dir, lookup_join, term_table, top_per_group


def top_terms(topic_terms: DataFrame, n: int = 20) -> DataFrame:
    """``(topic, term, weight)`` -> the ``n`` heaviest terms per topic, ranked."""
    return top_per_group(topic_terms, ["topic"], [F.desc("weight"), "term"], n)


def describe_ranked(ranked: DataFrame) -> DataFrame:
    """``topic, topic_terms, terms_and_weights, sum_of_weights`` from ranked terms.

    A group is one topic's top terms, n rows.
    """
    grouped = ranked.groupBy("topic").agg(
        F.sort_array(F.collect_list(F.struct("rank", "term", "weight"))).alias("_t")
    )
    return _describe(
        grouped.select(
            "topic",
            F.transform("_t", lambda t: t["term"]).alias("_terms"),
            F.transform("_t", lambda t: t["weight"]).alias("_weights"),
        )
    )


def describe_topics(model: LDAModel, vocabulary: list[str], n: int = 20) -> DataFrame:
    """The same for a fitted model."""
    topics = model.describeTopics(int(n))
    return _describe(
        topics.select(
            "topic",
            ax.index_terms(F.col("termIndices"), vocabulary).alias("_terms"),
            F.col("termWeights").alias("_weights"),
        )
        if len(vocabulary) <= 5_000
        else _lookup_terms(topics, vocabulary)
    )


def _lookup_terms(topics: DataFrame, vocabulary: list[str]) -> DataFrame:
    """Index -> word by join, for vocabularies too long for a literal."""
    words = term_table(topics.sparkSession, vocabulary)
    rows = topics.select(
        "topic", F.posexplode(F.arrays_zip("termIndices", "termWeights")).alias("_i", "_e")
    ).select("topic", "_i", F.col("_e.termIndices").alias("term_index"), F.col("_e.termWeights").alias("w"))
    return (
        rows.join(words, "term_index")
        .groupBy("topic")
        .agg(F.sort_array(F.collect_list(F.struct("_i", "term", "w"))).alias("_t"))
        .select(
            "topic",
            F.transform("_t", lambda t: t["term"]).alias("_terms"),
            F.transform("_t", lambda t: t["w"]).alias("_weights"),
        )
    )


def _describe(topics: DataFrame) -> DataFrame:
    return topics.select(
        "topic",
        F.concat_ws(", ", "_terms").alias("topic_terms"),
        F.concat_ws(", ", ax.format_terms(F.col("_terms"), F.col("_weights"))).alias(
            "terms_and_weights"
        ),
        ax.sum_weights(F.col("_weights")).alias("sum_of_weights"),
    )


def topic_labels(described: DataFrame) -> DataFrame:
    return described.select("topic", "topic_terms")


def topic_term_table(model: LDAModel) -> DataFrame:
    """``(topic, term_index, weight)`` of a fitted model: saved, then read as a table."""
    spark = SparkSession.active()
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/quirelens-{uuid.uuid4().hex}"
    (model.toLocal() if model.isDistributed() else model).save(path)
    return saved_topic_terms(spark, path)


def saved_topic_terms(spark: SparkSession, path: str) -> DataFrame:
    """``(topic, term_index, weight)`` over the whole vocabulary of a saved local model.

    The matrix is a row of the model's Parquet files; its numbers are exploded where they
    are read and never pass through the driver.  Weights of a topic sum to 1.
    """
    matrix = spark.read.parquet(f"{path}/data").select(F.unwrap_udt("topicsMatrix").alias("m"))
    flat = matrix.select(
        F.col("m.numRows").alias("terms"), F.col("m.numCols").alias("topics"),
        F.col("m.isTransposed").alias("by_term"), F.posexplode("m.values").alias("at", "value"),
    )
    across, down = F.floor(F.col("at") / F.col("terms")), F.col("at") % F.col("terms")
    long = flat.select(
        F.when(F.col("by_term"), F.col("at") % F.col("topics")).otherwise(across).cast("int").alias("topic"),
        F.when(F.col("by_term"), F.floor(F.col("at") / F.col("topics"))).otherwise(down).cast("int").alias("term_index"),
        "value",
    )
    total = long.groupBy("topic").agg(F.sum("value").alias("total"))
    return lookup_join(long, total, "topic", "inner", ["term_index"]).select(
        "topic", "term_index", (F.col("value") / F.col("total")).alias("weight")
    )


def saved_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """``(term_index, term)`` of a saved vocabulary, read from its files."""
    return spark.read.parquet(f"{path}/data").select(F.posexplode("vocabulary").alias("term_index", "term"))


def page_topic_table(result: DataFrame, vector: str = "topicDistribution") -> DataFrame:
    """``(volid, seq, topic, weight)``."""
    return result.select(
        "volid", "seq", F.posexplode(ax.topic_array(F.col(vector))).alias("topic", "weight")
    )


def topic_prevalence(page_topics: DataFrame, lengths: DataFrame) -> DataFrame:
    """Share of each topic: page weight times page length, over the total.

    ``page_topics(volid, seq, weights)``; the page join is on unique keys.
    """
    weighted = page_topics.join(lengths, ["volid", "seq"]).select(
        "doc_length", F.posexplode("weights").alias("topic", "weight")
    )
    mass = weighted.groupBy("topic").agg(
        F.sum(F.col("weight") * F.col("doc_length")).alias("mass")
    )
    # one row per topic
    total = F.sum("mass").over(Window.partitionBy(F.lit(1)))
    return mass.select("topic", F.try_divide("mass", total).alias("share"))


def term_relevance(
    topic_terms: DataFrame, frequency: DataFrame, lam: float = 0.6
) -> DataFrame:
    """``lam * log p(w|t) + (1 - lam) * log(p(w|t) / p(w))`` (Sievert & Shirley 2014).

    ``topic_terms(topic, term, weight)`` with weights summing to 1 per topic;
    ``frequency(term, n)``.
    """
    corpus = frequency.agg(F.sum("n"))
    shares = frequency.select("term", F.try_divide("n", corpus.scalar()).alias("share"))
    p = F.col("weight")
    positive = (F.col("weight") > 0) & (F.col("share") > 0)
    return topic_terms.join(shares, "term").where(positive).select(
        "topic", "term",
        (F.lit(lam) * F.log(p) + F.lit(1 - lam) * F.log(p / F.col("share"))).alias("relevance"),
    )


def topic_distance(topic_terms: DataFrame) -> DataFrame:
    """Jensen-Shannon divergence for each pair of topics, ``topic_a < topic_b``.

    Works on the model, k topics by V terms.  A term's k weights form one array;
    each topic meets the later ones inside that array and the sums are combined
    map-side, so only k * k / 2 partial sums per task are shuffled.
    """
    by_term = topic_terms.groupBy("term").agg(
        F.sort_array(F.collect_list(F.struct("topic", "weight"))).alias("_w")
    )
    left = by_term.select(F.posexplode("_w").alias("_i", "_a"), "_w")
    pairs = left.select(
        "_a", F.explode(F.slice("_w", F.col("_i") + 2, F.size("_w"))).alias("_b")
    ).select(
        F.col("_a.topic").alias("topic_a"), F.col("_b.topic").alias("topic_b"),
        F.col("_a.weight").alias("p"), F.col("_b.weight").alias("q"),
    )
    m = (F.col("p") + F.col("q")) / 2

    def part(x):
        return F.when(x > 0, x * F.log(x / m)).otherwise(F.lit(0.0))

    return pairs.groupBy("topic_a", "topic_b").agg(
        (F.sum(part(F.col("p")) + part(F.col("q"))) / 2).alias("divergence")
    )
