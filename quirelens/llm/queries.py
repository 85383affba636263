"""The corpus operators as queries on the given tables, with SQL where it can state them."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelens.llm import (
    bpe, decontaminate, fim, hnsw, langid, lexicon, lines, lm, minhash, periods, substrings, suffixes,
    toxicity,
)
from quirelens.llm.rows import labelled_sample, remainder, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def byte_pairs(spark: SparkSession) -> bpe.BytePairs:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.BytePairs(spark, path, public_tokenizers.PATTERN)


@query
def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), byte_pairs(spark))


@query
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(remainder(F.col("doc_id"), 5) != 0))
    return langid.identify(docs.select("doc_id", "text"), model).select(
        "doc_id",
        (remainder(F.col("doc_id"), 5) == 0).alias("held_out"),
        "lang_pred",
        F.col("lang_score").alias("score"),
        F.col("lang_rejected").alias("rejected"),
    )


@query
def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffixes.remove_repeated_bytes(table(spark, sf_dir, "documents"))
    return cut.select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


ORACLES["op6_suffix_dedup"] = suffixes.REMOVED_SQL


@query
def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substrings.remove_repeated_words(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLES["op9_substring_dedup"] = substrings.REMOVED_SQL


@query
def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.component_table(table(spark, sf_dir, "documents"))


ORACLES["op7_minhash_dedup"] = minhash.COMPONENTS_SQL


@query
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = lines.line_report(table(spark, sf_dir, "documents"))
    return report.select(
        "doc_id", "n_lines", "n_removed", "n_runs", F.sha2("kept", 256).alias("kept_sha256")
    )


ORACLES["op3_line_dedup"] = lines.REPORT_SQL


@query
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLES["op5_decontamination"] = decontaminate.LEAKS_SQL


@query
def op1_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = hnsw.usable(table(spark, sf_dir, "embeddings"))
    return hnsw.nearest(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def labels(spark: SparkSession, sf_dir: str, column: str) -> DataFrame:
    """One label per document: the larger, where a document has several."""
    found = table(spark, sf_dir, "labels").select("doc_id", column)
    return found.groupBy("doc_id").agg(F.max(column).alias(column))


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    usable = (remainder(F.col("doc_id"), 4) != 2) & toxicity.usable_text(F.col("text"))
    marks = labels(spark, sf_dir, "toxic").where("toxic in (0, 1)")
    learned = labelled_sample(docs, marks, "toxic", usable, toxicity.FIT_ROWS)
    found = toxicity.detect(docs, toxicity.fit(learned))
    return found.select(
        "doc_id",
        (remainder(F.col("doc_id"), 4) == 2).alias("held_out"),
        F.col("toxicity").alias("score"),
        F.col("is_toxic").cast("int").alias("predicted"),
    )


@query
def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    good = labels(spark, sf_dir, "quality").where("quality = 1").select("doc_id", F.lit(True).alias("is_target"))
    # the same plan at every size: beyond a small table the labels cannot be broadcast
    marked = docs.join(good.hint("merge"), "doc_id", "left").withColumn("is_target", F.coalesce("is_target", F.lit(False)))
    return lm.score(docs, lm.fit(marked), fitted=True).select(
        "doc_id", "n_tokens", "target_loss", "background_loss", F.col("lm_score").alias("score")
    )


@query
def op11_lexicon_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = lexicon.WordPieces.fitted(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return lexicon.digests(docs, pieces)


@query
def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = written(fim.store(table(spark, sf_dir, "documents").select("doc_id", "text")))
    made = fim.transform(kept, *fim.drawn(F.col("doc_id"), F.col("n")))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        fim.digests(F.col("output"), F.col("form")).alias("_sha"),
    ).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "_sha.*")


ORACLES["op12_fill_in_middle"] = fim.DRAWN_SQL


def planted_period(doc_id: str | None, words: list[bytes]) -> list[bytes]:
    """One document in ten, by its id, goes on from some word with a period."""
    h = zlib.crc32((doc_id or "").encode())
    n, g = len(words), h // 10
    if h % 10 or not n or doc_id is None:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


@query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = periods.periodic_runs(docs, rewrite=planted_period)
    best = periods.longest(F.col("runs"))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.floor(1000 * best["length"] / best["period"]).alias("exponent_milli"),
        F.sha2(periods.listed(F.col("runs")).cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
