"""Token streams: look-ups against word tables, frequencies, outliers."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelens.functions import text as tx
from quirelens.operators.scale import (
    BROADCAST_ROWS, bounded_list, fits_broadcast, key_filter, lookup_join, row_ids, stage,
)

# Up to this many words are written into the plan as an IN set.
LITERAL_WORDS = 2_000
SENTENCE_BREAK = "\t"
_PLACED = "array<struct<pos:int,_word:string>>"


def lemma_table(lemmas: DataFrame) -> DataFrame:
    """One lower-case lemma per lower-case form."""
    return lemmas.groupBy(F.lower("form").alias("form")).agg(
        F.lower(F.min("lemma")).alias("lemma")
    )


def map_tokens(
    pages: DataFrame,
    tokens: str,
    table: DataFrame,
    outcome: Column,
    missed: Callable[[Column, Column], Column] | None,
    lower: bool = False,
    max_broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Every token of a page replaced by ``outcome``, or dropped where that is null.

    ``table`` is keyed by ``form``, one row each; ``outcome`` is an expression over its
    columns (null without an entry) and ``hit``, ``form`` and ``token``; ``missed`` is what
    it comes to without an entry, from the token and its form (None where nearly all
    have one, so that all are looked up).  ``lower`` looks
    tokens up by their lower-case form.  All rows and columns stay, in a time that grows
    with the tokens whatever a page holds; a null list of tokens becomes an empty one.

    Tokens that cannot be in the table (``key_filter``) stay in their page.  With a table
    measured to be small, pages are dealt by row and the other tokens exploded; a token finds
    its entry in the broadcast table and a page is put together in the task that holds
    all of it.  Otherwise a page is written once and sent as posting lists (each distinct
    one of these tokens with its positions) to the table, hot forms salted.
    """
    numbered = row_ids(pages)
    rest = [F.col(f"`{c}`") for c in pages.columns if c not in (tokens, "_row")]
    listed = F.coalesce(F.col(f"`{tokens}`"), F.array().cast("array<string>"))
    may_hit = key_filter(table) if missed is not None else lambda value: F.lit(True)

    def form_of(token: Column) -> Column:
        return F.lower(token) if lower else token

    def sought(pages: DataFrame, *columns) -> DataFrame:
        """``_others``: the words of the tokens that cannot be in the table, null in the
        places of the rest; ``_sought``: those tokens with their places."""
        if missed is None:
            every = F.transform(listed, lambda t, i: F.struct(i.alias("pos"), t.alias("token")))
            none = F.array().cast("array<string>")
            return pages.select("_row", *columns, none.alias("_others"), every.alias("_sought"))
        return pages.select("_row", *columns, listed.alias("_tokens"), F.transform(listed, form_of).alias("_forms")).select(
            "_row", *columns,
            F.transform("_forms", lambda f, i: F.when(~may_hit(f), missed(F.get("_tokens", i), f))).alias("_others"),
            F.array_compact(F.transform(
                "_forms", lambda f, i: F.when(may_hit(f), F.struct(i.alias("pos"), F.get("_tokens", i).alias("token")))
            )).alias("_sought"),
        )

    form = form_of(F.col("token"))
    table = table.withColumn("hit", F.lit(True))
    hit = F.coalesce("hit", F.lit(False)).alias("hit")
    if fits_broadcast(table.drop("hit"), max_broadcast_rows):
        # the first row of a page carries its columns, the others a token each
        first = F.array(F.struct(F.lit(-1).alias("pos"), F.lit(None).cast("string").alias("token")))
        page = F.when(F.col("pos") < 0, F.struct(*rest, "_others"))
        dealt = numbered if "_row" in pages.columns else numbered.repartition("_row")
        joined = (
            sought(dealt, *rest)
            .select("_row", *rest, "_others", F.inline(F.concat(first, "_sought")))
            .select("_row", "pos", "token", page.alias("_page"))
            .withColumn("form", form)
            .join(F.broadcast(table), "form", "left")
            .withColumn("hit", hit)
            .withColumn("_word", F.when(F.col("pos") >= 0, outcome))
            .where(F.col("_page").isNotNull() | F.col("_word").isNotNull())
        )
        words = F.collect_list(F.when(F.col("_word").isNotNull(), F.struct("pos", "_word")))
        found = joined.groupBy("_row").agg(F.first("_page", ignorenulls=True).alias("_page"), words.alias("_hits"))
        found = found.select("_row", "_page.*", "_hits")
    else:
        numbered = stage(numbered)
        # pages travel whole, so that their tokens are grouped where they lie; the keys are
        # counted on the pages, without the lists
        posting = (
            sought(numbered.select("_row", F.col(f"`{tokens}`")).repartition("_row"))
            .select("_row", F.inline("_sought"))
            .groupBy("_row", "token")
            .agg(F.collect_list("pos").alias("_at"))
            .withColumn("form", form)
        )
        keys = numbered.select(
            F.explode(F.array_distinct(F.filter(listed, lambda t: may_hit(form_of(t))))).alias("token")
        ).select(form.alias("form"))
        joined = (
            lookup_join(posting, table, "form", "left", ["_row"], max_broadcast_rows, keys)
            .withColumn("hit", hit)
            .withColumn("_word", outcome)
            .where(F.col("_word").isNotNull())
            .groupBy("_row")
            .agg(F.collect_list(F.struct("_at", "_word")).alias("_lists"))
        )
        places = F.flatten(F.transform("_lists", lambda x: F.transform(
            x["_at"], lambda p: F.struct(p.alias("pos"), x["_word"].alias("_word")))))
        words = joined.select("_row", places.alias("_hits"))
        found = sought(numbered, *rest).drop("_sought").join(words, "_row", "left")
    known = F.array_compact(F.transform("_others", lambda w, i: F.when(w.isNotNull(), F.struct(i.alias("pos"), w.alias("_word")))))
    words = F.sort_array(F.concat(known, F.coalesce("_hits", F.array().cast(_PLACED))))
    return found.withColumn(tokens, F.transform(words, lambda w: w["_word"])).select(
        *[F.col(f"`{c}`") for c in pages.columns]
    )


def lemmatise(
    pages: DataFrame,
    lemmas: DataFrame,
    tokens: str = "tokens",
    max_broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Lower-case lemma per token; a form without an entry is only lower-cased.

    A short table becomes a map inside the projection, which only its forms are looked up in.
    """
    table = lemma_table(lemmas).where("form is not null")
    short = min(LITERAL_WORDS, max_broadcast_rows)
    rows = table.limit(short + 1).collect()
    if 0 < len(rows) <= short:
        forms = [r["form"] for r in rows]
        entries = F.map_from_arrays(F.lit(forms), F.array(*[F.lit(r["lemma"]).cast("string") for r in rows]))

        def one(form: Column) -> Column:
            return F.coalesce(F.when(form.isin(forms), F.element_at(entries, form)), form)

        listed = F.transform(F.coalesce(f"`{tokens}`", F.array().cast("array<string>")), F.lower)
        return pages.withColumn(tokens, F.array_compact(F.transform(listed, one)))
    return map_tokens(
        pages, tokens, table, F.coalesce("lemma", "form"), lambda token, form: form,
        True, max_broadcast_rows,
    )


def mark_words(
    pages: DataFrame,
    words: DataFrame,
    tokens: str = "tokens",
    mark: str | None = None,
    keep_listed: bool = False,
    lower: bool = False,
    max_broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Listed tokens dropped (or replaced by ``mark``), or only they kept.

    ``words`` has one column of words of any number.  All rows and columns stay.
    """
    form = F.col(f"`{words.columns[0]}`")
    listed = words.select((F.lower(form) if lower else form).alias("form")).where("form is not null").distinct()
    if mark is not None:
        outcome = F.when(F.col("hit"), F.lit(mark)).otherwise(F.col("token"))
    else:
        outcome = F.when(F.col("hit") if keep_listed else ~F.col("hit"), F.col("token"))

    # few tokens are on a list of words to drop, most on one of words to keep
    missed = None if keep_listed and mark is None else lambda token, form: token
    return map_tokens(pages, tokens, listed, outcome, missed, lower, max_broadcast_rows)


def remove_words(
    pages: DataFrame,
    words: DataFrame | Sequence[str],
    kept: DataFrame | None = None,
    literal_words: int = LITERAL_WORDS,
    max_broadcast_rows: int = BROADCAST_ROWS,
    in_place: bool = False,
) -> DataFrame:
    """Drop listed words from ``text`` and join the rest with single blanks.

    A short list becomes an IN set inside the projection.  Of a longer one only the
    distinct words of each page meet the list, or the list of all other words
    (``kept``) where that is the one that can be broadcast.  ``in_place`` has the list that
    can be broadcast decide on the words of a text where it lies, in Python, so that no page
    is taken apart and grouped again.  Every route returns all
    rows, with all columns, in which a null text becomes an empty one.
    """
    short = bounded_list(words, literal_words)
    if short is not None:
        return pages.withColumn("text", tx.remove_tokens_text(F.col("text"), short))
    if not isinstance(words, DataFrame):
        words = pages.sparkSession.createDataFrame([(w,) for w in words], "word string")
    by_kept = kept is not None and fits_broadcast(kept, max_broadcast_rows)
    if in_place and by_kept:
        return keep_words(pages, kept)
    if in_place and fits_broadcast(words, max_broadcast_rows):
        return pages.withColumn("text", _filtered_text(words, False)(F.col("text")))
    split = pages.withColumn("_tokens", tx.whitespace_tokens(F.col("text"))).drop("text")
    rest = mark_words(
        split, kept if by_kept else words, "_tokens", keep_listed=by_kept,
        max_broadcast_rows=max_broadcast_rows,
    )
    return rest.withColumn("text", F.array_join("_tokens", " ")).select(*pages.columns)


def keep_words(pages: DataFrame, kept: DataFrame) -> DataFrame:
    """``text`` without the words that are not in a list that can be broadcast, in place."""
    return pages.withColumn("text", _filtered_text(kept, True)(F.col("text")))


def _filtered_text(words: DataFrame, keep: bool) -> Callable[[Column], Column]:
    """A function of a text: its words that are in the list (``keep``) or are not."""
    listed = words.select(F.col(f"`{words.columns[0]}`").alias("word")).where("word is not null").toArrow()
    shared = words.sparkSession.sparkContext.broadcast(listed["word"].combine_chunks())

    def filtered(texts: pa.Array) -> pa.Array:
        return filtered_texts(texts, shared.value, keep)

    return F.arrow_udf(filtered, "string")


def filtered_texts(texts: pa.Array, words: pa.Array, keep: bool) -> pa.Array:
    """Texts without their unlisted words (``keep``) or their listed ones, joined by single
    blanks; a null text becomes an empty one."""
    split = pc.ascii_split_whitespace(texts)
    tokens = split.flatten()
    stays = pc.is_in(tokens, value_set=words.cast(tokens.type)).to_numpy(zero_copy_only=False)
    # white space at the ends leaves empty words
    stays = (stays == keep) & (pc.binary_length(tokens).to_numpy(zero_copy_only=False) > 0)
    before = np.concatenate([[0], np.cumsum(stays)])
    ends = split.offsets.to_numpy() - split.offsets[0].as_py()
    lists = pa.ListArray.from_arrays(pa.array(before[ends], pa.int32()), tokens.filter(pa.array(stays)))
    return pc.binary_join(lists, " ")


def page_frequency(pages: DataFrame, tokens: str = "tokens") -> DataFrame:
    """Number of pages that contain each token."""
    return (
        pages.select(F.explode(F.array_distinct(tokens)).alias("token"))
        .groupBy("token")
        .agg(F.count("*").alias("num_pages"))
    )


def outlier_tokens(frequency: DataFrame, min_pages: int, max_pages: int) -> DataFrame:
    """Tokens outside ``min_pages..max_pages`` (both ends stay in the text)."""
    return frequency.where(
        (F.col("num_pages") < min_pages) | (F.col("num_pages") > max_pages)
    )


def term_frequency(pages: DataFrame, vocabulary: DataFrame, tokens: str = "tokens") -> DataFrame:
    """Corpus count of each vocabulary term (0 when absent)."""
    counts = (
        pages.select(F.explode(tokens).alias("term"))
        .groupBy("term")
        .agg(F.count("*").alias("n"))
    )
    return vocabulary.join(counts, "term", "left").withColumn(
        "n", F.coalesce("n", F.lit(0).cast("long"))
    )


def document_lengths(pages: DataFrame, tokens: str = "tokens") -> DataFrame:
    return pages.select("volid", "seq", F.size(tokens).alias("doc_length"))


def bag_of_words(
    pages: DataFrame, tokens: str = "tokens", keys: Sequence[str] = ("volid", "seq")
) -> DataFrame:
    """``(keys, term, n)``."""
    return (
        pages.select(*keys, F.explode(tokens).alias("term"))
        .groupBy(*keys, "term")
        .agg(F.count("*").alias("n"))
    )
