"""Tokens, word lists, phrases and cleaned pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirelens.functions import text as tx
from quirelens.operators import cleaning as cl, phrases as ph, tokens as tk
from quirelens.plans import jobs
from registry import query
from registry.inputs import (
    DOCS, LEMMAS, PHRASES, REWRITES, STOP_SQL, STOP_WORDS, WORD, clean_token_sql, documents,
    fuse_sql, lemmas, phrase_sql, phrases, table,
)

TOKENS = f"tok AS (SELECT volid, seq, regexp_extract_all(text, '{WORD}') AS tokens FROM docs)"
SPLIT = "list_filter(string_split_regex({t}, '\\s+'), lambda x: x <> '')"
WORDS = f"ws AS (SELECT volid, seq, {SPLIT.format(t='text')} AS tokens FROM docs)"


def rewrite_sql(text: str) -> str:
    for name, pattern in REWRITES:
        text = "regexp_replace({}, '{}', '{}', 'g')".format(text, pattern, name.replace("\\", "\\\\"))
    return text


@query("whitespace_tokens", f"""WITH {DOCS}, {WORDS}
    SELECT volid, seq, CAST(len(tokens) AS INTEGER) AS n, array_to_string(tokens, '|') AS tokens FROM ws""")
def whitespace_tokens(spark, sf):
    return documents(spark, sf).select("volid", "seq", tx.whitespace_tokens(F.col("text")).alias("t")).select(
        "volid", "seq", F.size("t").alias("n"), F.array_join("t", "|").alias("tokens"))


@query("tokenise", f"""WITH {DOCS}
    SELECT volid, seq, CAST(len(string_split(text, ' ')) AS INTEGER) AS n,
           array_to_string(string_split(text, ' '), '|') AS tokens FROM docs WHERE text IS NOT NULL""")
def tokenise(spark, sf):
    from quirelens.operators import topics as tp

    return tp.tokenised(documents(spark, sf)).select(
        "volid", "seq", F.size("tokens").alias("n"), F.array_join("tokens", "|").alias("tokens"))


@query("non_null_pages", f"""WITH {DOCS}, d AS (SELECT volid, seq, regexp_extract(text, '(?s)^(.{{200}}).*$', 1) AS t FROM docs)
    SELECT volid, seq FROM d WHERE t <> ''""")
def non_null_pages(spark, sf):
    """Pages of fewer than 200 characters lose their text first."""
    from quirelens.operators import topics as tp

    holed = documents(spark, sf).withColumn("text", F.when(F.length("text") >= 200, F.col("text")))
    return tp.tokenised(holed).select("volid", "seq")


@query("tokenised_nonempty", f"""WITH {DOCS}, d AS (SELECT volid, seq,
        CASE WHEN seq % 3 = 0 THEN '' ELSE text END AS text FROM docs)
    SELECT volid, seq, CAST(len(string_split(text, ' ')) AS INTEGER) AS n FROM d WHERE text <> ''""")
def tokenised_nonempty(spark, sf):
    """Every third page is empty, as pages are that lose all their words."""
    from quirelens.operators import topics as tp

    holed = documents(spark, sf).withColumn("text", F.when(F.col("seq") % 3 == 0, "").otherwise(F.col("text")))
    return tp.tokenised(holed).select("volid", "seq", F.size("tokens").alias("n"))


@query("words_and_marks", f"""WITH {DOCS}, {TOKENS}
    SELECT volid, seq, array_to_string(tokens, ' ') AS text FROM tok""")
def words_and_marks(spark, sf):
    return documents(spark, sf).select(
        "volid", "seq", F.array_join(tx.words_and_marks(F.col("text")), " ").alias("text"))


YEARED = "text || ' (' || CAST(1790 + seq % 260 AS VARCHAR) || ')'"


@query("extract_tokens", f"""WITH {DOCS}, e AS (SELECT volid, seq, {clean_token_sql(YEARED)} AS t FROM docs)
    SELECT volid, seq, array_to_string(t, ' ') AS tokens,
           array_to_string(list_filter(t, lambda x: length(x) > 2), ' ') AS long_tokens FROM e""")
def extract_tokens(spark, sf):
    """A year is added to each page: the tables hold none."""
    yeared = F.concat("text", F.lit(" ("), (1790 + F.col("seq") % 260).cast("string"), F.lit(")"))
    return documents(spark, sf).select("volid", "seq", tx.extract_tokens(yeared).alias("t")).select(
        "volid", "seq", F.array_join("t", " ").alias("tokens"),
        F.array_join(tx.min_token_length(F.col("t")), " ").alias("long_tokens"))


@query("drop_blacklisted", f"""WITH {DOCS}, m AS (SELECT volid, seq,
      {SPLIT.format(t="replace(replace(text, 'ou', '__'), 'sch', 'º')")} AS t FROM docs)
    SELECT volid, seq, array_to_string(list_filter(t, lambda x: NOT contains(x, '__') AND NOT contains(x, 'º')), ' ') AS text FROM m""")
def drop_blacklisted(spark, sf):
    marked = F.replace(F.replace("text", F.lit("ou"), F.lit("__")), F.lit("sch"), F.lit("º"))
    return documents(spark, sf).select(
        "volid", "seq",
        F.array_join(tx.drop_blacklisted(tx.whitespace_tokens(marked)), " ").alias("text"))


@query("rewrite_patterns", f"WITH {DOCS} SELECT volid, seq, {rewrite_sql('text')} AS text FROM docs")
def rewrite_patterns(spark, sf):
    return documents(spark, sf).withColumn("text", tx.rewrite_patterns(F.col("text"), REWRITES))


LEMMATISED = """lt AS (SELECT volid, seq, unnest(tokens) AS t, unnest(range(0, len(tokens))) AS pos FROM {src}),
lj AS (SELECT volid, seq, list(coalesce(lemma, lower(t)) ORDER BY pos) AS tokens
       FROM lt LEFT JOIN lem ON lower(t) = form GROUP BY volid, seq)"""


@query("lemmatise", f"""WITH {DOCS}, {TOKENS}, {LEMMAS}, {LEMMATISED.format(src='tok')}
    SELECT volid, seq, array_to_string(tokens, ' ') AS text FROM lj""")
def lemmatise(spark, sf):
    tokens = cl.page_tokens(documents(spark, sf)).withColumn(
        "tokens", F.filter("tokens", lambda t: t != cl.SENTENCE_BREAK))
    return tk.lemmatise(tokens, lemmas(spark, sf)).select("volid", "seq", F.array_join("tokens", " ").alias("text"))


@query("lemmatise_shuffled", f"""WITH {DOCS}, {TOKENS}, {LEMMAS}, {LEMMATISED.format(src='tok')}
    SELECT volid, seq, array_to_string(tokens, ' ') AS text FROM lj""")
def lemmatise_shuffled(spark, sf):
    """The route for lemma tables too large to be broadcast."""
    tokens = cl.page_tokens(documents(spark, sf)).withColumn(
        "tokens", F.filter("tokens", lambda t: t != cl.SENTENCE_BREAK))
    return tk.lemmatise(tokens, lemmas(spark, sf), max_broadcast_rows=0).select(
        "volid", "seq", F.array_join("tokens", " ").alias("text"))


@query("candidate_phrases", f"""WITH {DOCS}, {TOKENS}
    SELECT volid, seq, array_to_string({phrase_sql('tok', 'tokens')}, '|') AS phrases FROM tok""")
def candidate_phrases(spark, sf):
    return cl.page_tokens(documents(spark, sf)).select(
        "volid", "seq",
        F.array_join(tx.candidate_phrases(F.col("tokens"), [*STOP_WORDS, cl.PRONOUN_MARK]), "|").alias("phrases"))


@query("noun_phrase_report", f"""WITH {DOCS}, {TOKENS}, {LEMMAS}, {LEMMATISED.format(src='tok')},
    p AS (SELECT lower(unnest({phrase_sql('lj', 'tokens')})) AS noun_phrase FROM lj)
    SELECT noun_phrase, count(*) AS count FROM p GROUP BY noun_phrase HAVING count(*) > 10""")
def noun_phrase_report(spark, sf):
    return jobs.noun_phrase_report(documents(spark, sf), STOP_WORDS, lemmas(spark, sf))


@query("phrase_counts", f"""WITH {PHRASES}
    SELECT phrase AS noun_phrase, n AS count FROM phr WHERE n > 0""")
def phrase_counts(spark, sf):
    from registry.inputs import benchmark_pages

    return jobs.noun_phrase_report(benchmark_pages(spark, sf), STOP_WORDS, more_than=0)


@query("fuse_phrases", f"""WITH {DOCS}, {TOKENS}, {PHRASES},
    low AS (SELECT volid, seq, lower(array_to_string(tokens, ' ')) AS text FROM tok)
    SELECT volid, seq, {fuse_sql('text')} AS text FROM low, plist""")
def fuse_phrases(spark, sf):
    flat = documents(spark, sf).withColumn(
        "text", F.lower(F.array_join(tx.words_and_marks(F.col("text")), " ")))
    return ph.fuse_phrases(flat, phrases(spark, sf)).select("volid", "seq", "text")


@query("fuse_phrases_shuffled", f"""WITH {DOCS}, {TOKENS}, {PHRASES},
    low AS (SELECT volid, seq, lower(array_to_string(tokens, ' ')) AS text FROM tok)
    SELECT volid, seq, {fuse_sql('text')} AS text FROM low, plist""")
def fuse_phrases_shuffled(spark, sf):
    """The route for phrase lists too long to be written into the plan or broadcast."""
    flat = documents(spark, sf).withColumn(
        "text", F.lower(F.array_join(tx.words_and_marks(F.col("text")), " ")))
    return ph.fuse_phrases(
        flat, phrases(spark, sf), literal_phrases=0, max_broadcast_rows=0
    ).select("volid", "seq", "text")


# Sentences are separated by a tab; a rewritten page keeps that tab.
TABBED = """tab AS (SELECT volid, seq, replace(text, '. ', '.' || chr(9)) AS text FROM docs)"""
CLEANED = rf"""sen AS (SELECT volid, seq, unnest(string_split(text, chr(9))) AS s,
                unnest(range(0, len(string_split(text, chr(9))))) AS si FROM tab),
rw AS (SELECT volid, seq, si, regexp_extract_all({rewrite_sql('s')}, '{WORD}') AS toks FROM sen),
wd AS (SELECT volid, seq, si, unnest(toks) AS t, unnest(range(0, len(toks))) AS pos FROM rw),
lw AS (SELECT volid, seq, si, pos, coalesce(lemma, lower(t)) AS w FROM wd LEFT JOIN lem ON lower(t) = form),
kept AS (SELECT volid, seq, si, string_agg(w, ' ' ORDER BY pos) AS s FROM lw
         WHERE w NOT IN ({STOP_SQL}) AND NOT contains(w, '__') AND NOT contains(w, 'º') GROUP BY volid, seq, si),
joined AS (SELECT volid, seq, string_agg(s, ' ' || chr(9) || ' ' ORDER BY si) AS text FROM kept GROUP BY volid, seq),
whole AS (SELECT docs.volid, docs.seq, coalesce(joined.text, '') AS text FROM docs
          LEFT JOIN joined ON docs.volid = joined.volid AND docs.seq = joined.seq),
fused AS (SELECT volid, seq, {fuse_sql('text')} AS text FROM whole, plist),
cleaned AS (SELECT volid, seq, array_to_string(list_filter({clean_token_sql('text')}, lambda x: length(x) > 2), ' ') AS text
            FROM fused)"""


def tabbed(spark, sf):
    return documents(spark, sf).withColumn("text", F.replace("text", F.lit(". "), F.lit(".\t")))


@query("clean_pages", f"WITH {DOCS}, {LEMMAS}, {PHRASES}, {TABBED}, {CLEANED} SELECT volid, seq, text FROM cleaned")
def clean_pages(spark, sf):
    return jobs.clean_pages(
        tabbed(spark, sf), STOP_WORDS, REWRITES, phrases(spark, sf), lemmas(spark, sf)
    ).select("volid", "seq", "text")


@query("clean_pages_shuffled", f"WITH {DOCS}, {LEMMAS}, {PHRASES}, {TABBED}, {CLEANED} SELECT volid, seq, text FROM cleaned")
def clean_pages_shuffled(spark, sf):
    """As clean_pages, with nothing broadcast."""
    return jobs.clean_pages(
        tabbed(spark, sf), STOP_WORDS, REWRITES, phrases(spark, sf), lemmas(spark, sf), max_broadcast_rows=0
    ).select("volid", "seq", "text")


FREQ = "freq AS (SELECT token, count(*) AS num_pages FROM (SELECT unnest(list_distinct(tokens)) AS token FROM ws) GROUP BY token)"
OUT = "outl AS (SELECT token, num_pages FROM freq WHERE num_pages < 3 OR num_pages > 60)"


@query("page_frequency", f"WITH {DOCS}, {WORDS}, {FREQ} SELECT token, num_pages FROM freq")
def page_frequency(spark, sf):
    return tk.page_frequency(
        documents(spark, sf).select(tx.whitespace_tokens(F.col("text")).alias("tokens")))


@query("outlier_report", f"WITH {DOCS}, {WORDS}, {FREQ}, {OUT} SELECT token, num_pages FROM outl")
def outlier_report(spark, sf):
    return jobs.outlier_report(documents(spark, sf), 3, 60)


REMOVED = """wt AS (SELECT volid, seq, unnest(tokens) AS t, unnest(range(0, len(tokens))) AS pos FROM ws),
rest AS (SELECT volid, seq, string_agg(t, ' ' ORDER BY pos) AS text FROM wt
         WHERE t NOT IN (SELECT token FROM {words}) GROUP BY volid, seq),
fin AS (SELECT docs.volid, docs.seq, coalesce(rest.text, '') AS text FROM docs
        LEFT JOIN rest ON docs.volid = rest.volid AND docs.seq = rest.seq)"""


@query("remove_outliers", f"WITH {DOCS}, {WORDS}, {FREQ}, {OUT}, {REMOVED.format(words='outl')} SELECT volid, seq, text FROM fin")
def remove_outliers(spark, sf):
    return jobs.remove_outliers(documents(spark, sf), 3, 60).select("volid", "seq", "text")


LISTED = "listed AS (SELECT DISTINCT unnest(string_split_regex(text, '\\s+')) AS token FROM benchmark)"


def _listed(spark, sf):
    return table(spark, sf, "benchmark").select(F.explode(F.split("text", r"\s+")).alias("token")).distinct()


@query("remove_words", f"WITH {DOCS}, {WORDS}, {LISTED}, {REMOVED.format(words='listed')} SELECT volid, seq, text FROM fin")
def remove_words(spark, sf):
    return tk.remove_words(documents(spark, sf), _listed(spark, sf)).select("volid", "seq", "text")


@query("remove_words_joined", f"WITH {DOCS}, {WORDS}, {LISTED}, {REMOVED.format(words='listed')} SELECT volid, seq, text FROM fin")
def remove_words_joined(spark, sf):
    """The route for lists too long to be written into the plan or broadcast."""
    return tk.remove_words(
        documents(spark, sf), _listed(spark, sf), literal_words=0, max_broadcast_rows=0
    ).select("volid", "seq", "text")


VOC = "voc AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '\\p{L}+')) AS term FROM benchmark)"


@query("term_frequency", f"""WITH {DOCS}, {WORDS}, {VOC},
    c AS (SELECT t AS term, count(*) AS n FROM (SELECT unnest(tokens) AS t FROM ws) GROUP BY t)
    SELECT voc.term, coalesce(n, 0) AS n FROM voc LEFT JOIN c ON voc.term = c.term""")
def term_frequency(spark, sf):
    vocabulary = table(spark, sf, "benchmark").select(
        F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("term")).distinct()
    return tk.term_frequency(
        documents(spark, sf).select(tx.whitespace_tokens(F.col("text")).alias("tokens")), vocabulary)


@query("document_lengths", f"WITH {DOCS}, {WORDS} SELECT volid, seq, CAST(len(tokens) AS INTEGER) AS doc_length FROM ws")
def document_lengths(spark, sf):
    return tk.document_lengths(
        documents(spark, sf).withColumn("tokens", tx.whitespace_tokens(F.col("text"))))


BAG = "bag AS (SELECT volid, seq, term, count(*) AS n FROM (SELECT volid, seq, unnest(tokens) AS term FROM ws) GROUP BY volid, seq, term)"


@query("bag_of_words", f"WITH {DOCS}, {WORDS}, {BAG} SELECT volid, seq, term, n FROM bag")
def bag_of_words(spark, sf):
    return tk.bag_of_words(documents(spark, sf).withColumn("tokens", tx.whitespace_tokens(F.col("text"))))
