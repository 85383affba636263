"""From tab-joined page text to cleaned page text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelens.functions import text as tx
from quirelens.operators.phrases import fuse_phrases
from quirelens.operators.scale import bounded_list, dealt_rows
from quirelens.operators.tokens import LITERAL_WORDS, SENTENCE_BREAK, lemmatise, mark_words

# Fixed value: always treated as a stop word (pronoun marker of older lemmatisers).
PRONOUN_MARK = "-pron-"


def stop_list(words: DataFrame | Sequence[str] | None) -> list[str] | None:
    """Stop words in lower case, with the pronoun marker; None if they are too many for a plan."""
    listed = bounded_list(words, LITERAL_WORDS)
    return None if listed is None else sorted({w.lower() for w in listed} | {PRONOUN_MARK})


def stop_table(pages: DataFrame, words: DataFrame | Sequence[str]) -> DataFrame:
    """Stop words of any number as a table, with the pronoun marker."""
    spark = pages.sparkSession
    if not isinstance(words, DataFrame):
        words = spark.createDataFrame([(w,) for w in words], "word string")
    own = words.select(F.lower(F.col(f"`{words.columns[0]}`")).alias("word"))
    return own.union(spark.createDataFrame([(PRONOUN_MARK,)], "word string")).distinct()


def page_tokens(
    pages: DataFrame, patterns: Sequence[tuple[str, str]] = ()
) -> DataFrame:
    """All columns but ``text``, and ``tokens``: rewritten sentences as word and
    punctuation tokens, with a tab token between sentences."""

    def one(sentence):
        return F.concat(
            tx.words_and_marks(tx.rewrite_patterns(sentence, patterns)),
            F.array(F.lit(SENTENCE_BREAK)),
        )

    text = F.coalesce(F.col("text"), F.lit(""))
    return pages.withColumn(
        "tokens", F.flatten(F.transform(F.split(text, SENTENCE_BREAK), one))
    ).drop("text")


def preprocess_pages(
    pages: DataFrame,
    stop_words: DataFrame | Sequence[str] | None = None,
    patterns: Sequence[tuple[str, str]] = (),
    phrases: DataFrame | Sequence[str] | None = None,
    lemmas: DataFrame | None = None,
    **options,
) -> DataFrame:
    """Rewrite, lemmatise, drop stop and blacklisted words per sentence; then fuse
    phrases, keep words and years, keep tokens longer than two characters."""
    stops = stop_list(stop_words)
    dealt = dealt_rows(pages) if lemmas is not None or stops is None else pages
    tokens = page_tokens(dealt, patterns)
    if lemmas is not None:
        tokens = lemmatise(tokens, lemmas, **options)
    else:
        tokens = tokens.withColumn("tokens", F.transform("tokens", F.lower))
    if stops is None:
        tokens = mark_words(tokens, stop_table(pages, stop_words), **options)
    kept = tx.drop_blacklisted(tx.drop_words(F.col("tokens"), stops or []))
    text = F.regexp_replace(F.array_join(kept, " "), " ?\t ?", SENTENCE_BREAK)
    rewritten = tokens.withColumn("text", text).drop("tokens")
    if phrases is not None:
        rewritten = fuse_phrases(rewritten, phrases, **options)
    final = F.array_join(tx.min_token_length(tx.extract_tokens(F.col("text"))), " ")
    return rewritten.withColumn("text", final).select(*pages.columns)
