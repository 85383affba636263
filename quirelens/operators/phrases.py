"""Mining multi-word phrases and writing them as single tokens."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelens.functions import text as tx
from quirelens.operators.scale import BROADCAST_ROWS, durable, row_lookup

# Up to this many phrases are written into the plan; longer lists are joined.
LITERAL_PHRASES = 100
_PLAIN = r"^\p{L}+(?: \p{L}+)+$"
# Words of a phrase that serve as its join key.
KEY_WORDS = 3


def phrase_counts(phrases: DataFrame, more_than: int = 10) -> DataFrame:
    """Frequency of each phrase, ignoring case, most frequent first."""
    return (
        phrases.groupBy(F.lower("phrase").alias("noun_phrase"))
        .agg(F.count("*").alias("count"))
        .where(F.col("count") > more_than)
        .orderBy(F.desc("count"), "noun_phrase")
    )


def ranked_phrases(counted: DataFrame) -> DataFrame:
    """``(rank, phrase)``: fusion order is by falling frequency, then by phrase.

    The rank is a sortable key, not a position, so no global numbering is needed.
    """
    return counted.select(
        F.struct((-F.col("count")).alias("n"), F.col("noun_phrase").alias("p")).alias("rank"),
        F.col("noun_phrase").alias("phrase"),
    )


def fuse_phrases(
    pages: DataFrame,
    phrases: DataFrame | Sequence[str],
    literal_phrases: int = LITERAL_PHRASES,
    max_broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Write each listed phrase as one word, in list order.

    ``phrases`` is a sequence, or a DataFrame ``(rank, phrase)``.  For a long
    list, a page's candidates come from an equi-join of its word n-grams with the
    phrases (the first ``KEY_WORDS`` words of longer ones): a phrase of plain words
    can only match where neighbouring letter runs are exactly its words.
    Candidates are then applied in rank order, so the result is the same as
    applying the whole list.
    """
    if not isinstance(phrases, DataFrame):
        phrases = list(phrases)
        if len(phrases) <= literal_phrases:
            return _fuse_literal(pages, phrases)
        phrases = pages.sparkSession.createDataFrame(
            list(enumerate(phrases)), "rank long, phrase string"
        )
    phrases = durable(phrases.select("rank", "phrase"))
    head = phrases.orderBy("rank").limit(literal_phrases + 1).collect()
    if len(head) <= literal_phrases:
        return _fuse_literal(pages, [r["phrase"] for r in head])

    multi = phrases.where(F.contains("phrase", F.lit(" ")))
    # A phrase matches only where its first run of letters is a whole run of the text, one
    # without letters where its first run of digits is, another one where its first
    # character stands.
    odd = multi.where(~F.col("phrase").rlike(_PLAIN)).withColumn(
        "_key", F.regexp_extract("phrase", r"\p{L}+", 0)
    )
    lettered = odd.where(F.col("_key") != "")
    digits, other = F.regexp_extract("phrase", r"\p{N}+", 0), F.substring("phrase", 1, 1)
    bare = odd.where(F.col("_key") == "").withColumn("_key", F.when(digits != "", digits).otherwise(other))
    plain = multi.where(F.col("phrase").rlike(_PLAIN)).withColumn(
        "_words", F.least(F.size(F.split("phrase", " ")), F.lit(KEY_WORDS))
    )
    keyed = plain.select(
        F.array_join(F.slice(F.split("phrase", " "), 1, F.col("_words")), " ").alias("form"),
        "rank", "phrase",
    ).union(lettered.union(bare).select(F.col("_key").alias("form"), "rank", "phrase"))
    # 2 .. KEY_WORDS, whichever occur; 1 for phrases with other characters in them, and 0
    # for those without a letter
    lengths = sorted(
        {r["_words"] for r in plain.select("_words").distinct().collect()}
        | ({1} if not lettered.isEmpty() else set())
        | ({0} if not bare.isEmpty() else set())
    )
    joined = row_lookup(
        pages, _ngrams(lengths), keyed, F.struct("rank", "phrase"), max_broadcast_rows
    )
    ordered = F.transform(F.sort_array(F.array_distinct("hits")), lambda h: h["phrase"])
    return joined.withColumn(
        "text",
        F.when(F.size("hits") > 0, tx.fuse_phrases(F.col("text"), ordered)).otherwise(F.col("text")),
    ).select(*pages.columns)


def _ngrams(lengths: Sequence[int]) -> Column:
    """Runs of n neighbouring words of ``text``, joined by single blanks, for each n; for
    n = 0 runs of digits and single characters that are neither."""
    text = F.coalesce("text", F.lit(""))
    found = [
        F.regexp_extract_all(text, F.lit(r"\p{N}+|[^\p{L}\p{N}]"), F.lit(0)) if n == 0
        else F.regexp_extract_all(
            text, F.lit(rf"(?<!\p{{L}})(?=(\p{{L}}++(?: \p{{L}}++){{{n - 1}}}))\p{{L}}++"), F.lit(1)
        )
        for n in lengths
    ]
    return F.concat(*found) if found else F.array().cast("array<string>")


def _fuse_literal(pages: DataFrame, phrases: Sequence[str]) -> DataFrame:
    if not phrases:
        return pages
    listed = F.array(*[F.lit(p) for p in phrases])
    return pages.withColumn("text", tx.fuse_phrases(F.col("text"), listed))


def list_order(phrases: DataFrame, order: Sequence[str]) -> DataFrame:
    """``(rank, phrase)`` for a phrase table with its own ordering columns."""
    return phrases.select(F.struct(*order).alias("rank"), "phrase")
