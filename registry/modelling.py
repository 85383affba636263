"""Vocabulary, LDA, topic inspection and coherence."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirelens.functions import arrays as ax, text as tx
from quirelens.operators import coherence as co, inspection as ins, tokens as tk, topics as tp
from quirelens.operators.scale import durable, stage
from quirelens.plans import jobs
from registry import query
from registry.cleaning import BAG, WORDS
from registry.inputs import (
    DOCS, STOP_SQL, STOP_WORDS, TERMS, TOPICS, WORD, clean_token_sql, documents, table, topic_pages,
    topic_terms,
)
from registry.overtime import r6



def tokens(spark, sf):
    return documents(spark, sf).select(
        "volid", "seq", tx.whitespace_tokens(F.col("text")).alias("tokens"))


def features(spark, sf):
    pages = tokens(spark, sf)
    vocabulary = tp.fit_vocabulary(pages)
    return vocabulary, tp.vectorise(vocabulary, pages)


VOCABULARY = """vo AS (SELECT t AS term, count(*) AS n FROM (SELECT unnest(tokens) AS t FROM ws)
    GROUP BY t ORDER BY count(*) DESC, t LIMIT 262144)"""


@query("fit_vocabulary", f"WITH {DOCS}, {WORDS}, {VOCABULARY} SELECT term, n FROM vo")
def fit_vocabulary(spark, sf):
    """Terms of the vocabulary (its size limit is part of the feature) with their corpus count."""
    pages = tokens(spark, sf)
    words = tp.vocabulary_table(spark, tp.fit_vocabulary(pages)).select("term")
    return tk.term_frequency(pages, words).select("term", "n")


@query("vectorise", f"""WITH {DOCS}, {WORDS}, {BAG}, {VOCABULARY}
    SELECT volid, seq, bag.term, bag.n FROM bag JOIN vo ON bag.term = vo.term""")
def vectorise(spark, sf):
    vocabulary, vectors = features(spark, sf)
    words = tp.vocabulary_table(spark, vocabulary)
    return tp.vector_terms(vectors).join(words, "term_index").select("volid", "seq", "term", "n")


def cleaned_pages(spark, sf):
    """Documents after cleaning and outlier removal, the input of the topic model.

    Not written: ``topic_features`` reads them once.
    """
    return without_outliers(written_pages(spark, sf))


def written_pages(spark, sf):
    return stage(jobs.clean_pages(documents(spark, sf), STOP_WORDS))


def without_outliers(clean):
    return jobs.remove_outliers(clean, 5, 10**9, in_place=True)


def excluded(spark, sf):
    return table(spark, sf, "labels").where("toxic = 1").join(
        table(spark, sf, "documents").select("doc_id", "source"), "doc_id"
    ).select(F.col("source").alias("volid"), F.col("doc_id").cast("int").alias("seq"))


def model(spark, sf, k=10, **options):
    clean = written_pages(spark, sf)
    return jobs.topic_model(without_outliers(clean), k, excluded(spark, sf), scratch=[clean], **options)


@query("topic_model")
def topic_model(spark, sf):
    """Topic distribution of every page that is not excluded."""
    return model(spark, sf).result.select("volid", "seq", ax.topic_array(F.col("topicDistribution")).alias("weights"))


@query("topic_model_minibatch")
def topic_model_minibatch(spark, sf):
    return model(spark, sf, minibatch=True).result.select(
        "volid", "seq", ax.topic_array(F.col("topicDistribution"), narrow=True).alias("weights"))


@query("minibatch_score")
def minibatch_score(spark, sf):
    """Log perplexity of the second model, and the bound it comes from."""
    fitted = model(spark, sf, minibatch=True)
    return spark.createDataFrame(
        [(tp.model_info(fitted.model)["topics"], fitted.log_likelihood, fitted.log_perplexity)],
        "k int, log_likelihood double, log_perplexity double")


@query("model_coherence")
def model_coherence(spark, sf):
    """Coherence of the fitted model's topics by their twenty heaviest terms."""
    return jobs.model_coherence(model(spark, sf), 20)


@query("describe_topics")
def describe_topics(spark, sf):
    fitted = model(spark, sf)
    return ins.describe_topics(fitted.model, fitted.vocabulary.vocabulary, 20)


@query("topic_scores")
def topic_scores(spark, sf):
    fitted = model(spark, sf)
    info = tp.model_info(fitted.model)
    return spark.createDataFrame(
        [(info["topics"], info["vocabulary_size"], fitted.log_likelihood, fitted.log_perplexity)],
        "k int, vocabulary_size int, log_likelihood double, log_perplexity double")


@query("sweep_k")
def sweep_k(spark, sf):
    clean = written_pages(spark, sf)
    _, vectors = jobs.topic_features(without_outliers(clean), excluded(spark, sf), scratch=[clean])
    return tp.sweep_k(vectors, seed=tp.SEED)


# The pages that the topic model is fitted on, as in cleaned_pages.
MODELLED = f"""lowered AS (SELECT volid, seq, array_to_string(list_filter(list_transform(
    regexp_extract_all(text, '{WORD}'), lambda x: lower(x)),
    lambda x: x NOT IN ({STOP_SQL}) AND NOT contains(x, '__') AND NOT contains(x, 'º')), ' ') AS t FROM docs),
clean AS (SELECT volid, seq, list_filter({clean_token_sql('t')}, lambda x: length(x) > 2) AS t FROM lowered),
often AS (SELECT token FROM (SELECT unnest(list_distinct(t)) AS token FROM clean) GROUP BY token HAVING count(*) >= 5),
modelled AS (SELECT volid, seq, term FROM (SELECT volid, seq, unnest(t) AS term FROM clean)
  WHERE term IN (SELECT token FROM often) AND seq NOT IN (SELECT doc_id FROM labels WHERE toxic = 1))"""


def tables(spark, sf):
    """A small model will do here: what the tables say of it does not depend on its fit."""
    return jobs.topic_tables(model(spark, sf, k=5, maxIter=3))


@query("topic_term_table")
def topic_term_table(spark, sf):
    return tables(spark, sf)["topic_terms"]


@query("topic_term_sums", f"""WITH {DOCS}, {MODELLED}, v AS (SELECT count(DISTINCT term) AS terms FROM modelled)
    SELECT CAST(topic AS INTEGER) AS topic, terms, 1.0::DOUBLE AS total FROM v, (SELECT unnest(range(5)) AS topic)""")
def topic_term_sums(spark, sf):
    """A topic has a weight for every term of the vocabulary, and they sum to 1."""
    return topic_term_table(spark, sf).groupBy("topic").agg(
        F.count_distinct("term_index").alias("terms"), F.round(F.sum("weight"), 6).alias("total"))


@query("page_topic_sums", f"""WITH {DOCS}, {MODELLED}
    SELECT DISTINCT volid, seq, CAST(5 AS BIGINT) AS topics, 1.0::DOUBLE AS total FROM modelled""")
def page_topic_sums(spark, sf):
    """Every page that keeps a word has a weight for each topic, and they sum to 1."""
    long = tables(spark, sf)["page_topics"]
    return long.groupBy("volid", "seq").agg(F.count("*").alias("topics"), F.round(F.sum("weight"), 6).alias("total"))


@query("model_lengths", f"""WITH {DOCS}, {MODELLED}
    SELECT volid, seq, CAST(count(*) AS INTEGER) AS doc_length FROM modelled GROUP BY volid, seq""")
def model_lengths(spark, sf):
    return tables(spark, sf)["lengths"]


@query("model_vocabulary", f"""WITH {DOCS}, {MODELLED}, c AS (SELECT term, count(*) AS n FROM modelled GROUP BY term)
    SELECT CAST(row_number() OVER (ORDER BY n DESC, term) - 1 AS INTEGER) AS term_index, term FROM c""")
def model_vocabulary(spark, sf):
    return tables(spark, sf)["vocabulary"]


@query("model_term_frequency", f"""WITH {DOCS}, {MODELLED} SELECT term, count(*) AS n FROM modelled GROUP BY term""")
def model_term_frequency(spark, sf):
    return tables(spark, sf)["frequency"].select("term", "n")


LEN = "dl AS (SELECT CAST(doc_id AS INTEGER) AS seq, CAST(len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS INTEGER) AS doc_length FROM documents)"


@query("topic_prevalence", f"""WITH {TOPICS}, {LEN},
    m AS (SELECT topic, sum(weight * doc_length) AS mass FROM long JOIN dl ON long.seq = dl.seq GROUP BY topic)
    SELECT topic, round(mass / (SELECT sum(mass) FROM m), 6) AS share FROM m""")
def topic_prevalence(spark, sf):
    weights = topic_pages(spark, sf).select(F.lit("d").alias("volid"), "seq", "weights")
    lengths = tk.document_lengths(tokens(spark, sf)).withColumn("volid", F.lit("d"))
    return ins.topic_prevalence(weights, lengths).select("topic", *r6("share"))


FREQ = "fr AS (SELECT 'w' || CAST(doc_id AS VARCHAR) AS term, n_chars AS n FROM documents)"


@query("term_relevance", f"""WITH {TERMS}, {FREQ},
    p AS (SELECT term, n / (SELECT sum(n) FROM fr) AS share FROM fr)
    SELECT topic, tt.term, round(0.6 * ln(weight) + 0.4 * ln(weight / share), 6) AS relevance
    FROM tt JOIN p ON tt.term = p.term WHERE weight > 0 AND share > 0""")
def term_relevance(spark, sf):
    frequency = table(spark, sf, "documents").select(
        F.concat(F.lit("w"), F.col("doc_id").cast("string")).alias("term"), F.col("n_chars").alias("n"))
    return ins.term_relevance(topic_terms(spark, sf), frequency).select("topic", "term", *r6("relevance"))


@query("topic_distance", f"""WITH {TERMS}
    SELECT a.topic AS topic_a, b.topic AS topic_b, round(sum(
      CASE WHEN a.weight > 0 THEN a.weight * ln(a.weight / ((a.weight + b.weight) / 2)) ELSE 0 END
      + CASE WHEN b.weight > 0 THEN b.weight * ln(b.weight / ((a.weight + b.weight) / 2)) ELSE 0 END) / 2, 6) AS divergence
    FROM tt a JOIN tt b ON a.term = b.term AND a.topic < b.topic GROUP BY 1, 2""")
def topic_distance(spark, sf):
    return ins.topic_distance(topic_terms(spark, sf)).select("topic_a", "topic_b", *r6("divergence"))


# Topics for the coherence: the twenty most frequent lower-case words of each language.
CO_TOPICS = """ct AS (
  SELECT topic, term FROM (
    SELECT topic, term, row_number() OVER (PARTITION BY topic ORDER BY count(*) DESC, term) AS r
    FROM (SELECT lang AS topic, unnest(regexp_extract_all(lower(text), '\\p{L}+')) AS term FROM documents)
    GROUP BY topic, term) WHERE r <= 20)"""
CO_PAIRS = f"""{CO_TOPICS},
lw AS (SELECT source AS volid, doc_id AS seq, regexp_extract_all(lower(text), '\\p{{L}}+') AS tokens FROM documents),
win AS (SELECT volid, seq, unnest(range(0, greatest(len(tokens) - 109, 1))) AS st, tokens FROM lw WHERE len(tokens) > 0),
occ AS (SELECT volid, seq, len(tokens) AS l, unnest(tokens) AS term, unnest(range(0, len(tokens))) AS pos FROM lw),
hit AS (SELECT DISTINCT volid, seq, ct.topic, ct.term,
          unnest(range(greatest(pos - 109, 0), least(pos, greatest(l - 110, 0)) + 1)) AS st
        FROM occ JOIN ct ON occ.term = ct.term),
pc0 AS (SELECT a.topic, a.term AS term_a, b.term AS term_b, count(*) AS windows
        FROM hit a JOIN hit b ON a.volid = b.volid AND a.seq = b.seq AND a.st = b.st AND a.topic = b.topic GROUP BY 1, 2, 3),
pc AS (SELECT x.topic, x.term AS term_a, y.term AS term_b, coalesce(windows, 0) AS windows
       FROM ct x JOIN ct y ON x.topic = y.topic
       LEFT JOIN pc0 ON pc0.topic = x.topic AND term_a = x.term AND term_b = y.term)"""
CO_NPMI = f"""{CO_PAIRS},
tot AS (SELECT sum(greatest(len(tokens) - 109, 1)) AS total FROM lw WHERE len(tokens) > 0),
sg AS (SELECT topic, term_a AS t, windows AS w FROM pc WHERE term_a = term_b),
np AS (SELECT pc.topic, term_a, term_b,
         ln((windows / total + 1e-12) / ((a.w / total) * (b.w / total))) / -ln(windows / total + 1e-12) AS npmi
       FROM pc JOIN sg a ON a.topic = pc.topic AND a.t = term_a JOIN sg b ON b.topic = pc.topic AND b.t = term_b, tot)"""


def lower_words(spark, sf):
    return documents(spark, sf).select(
        "volid", "seq", F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)).alias("tokens"))


def coherence_topics(spark, sf):
    words = table(spark, sf, "documents").select(
        F.col("lang").alias("topic"),
        F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("term"))
    counted = words.groupBy("topic", "term").agg(F.count("*").alias("weight"))
    return ins.top_terms(counted, 20).select("topic", "term")


def _pairs(spark, sf):
    pages, bits = lower_words(spark, sf), durable(co.topic_term_bits(coherence_topics(spark, sf)))
    return pages, durable(co.pair_counts(co.window_masks(pages, bits), bits))


@query("coherence_pairs", f"WITH {CO_PAIRS} SELECT topic, term_a, term_b, windows FROM pc")
def coherence_pairs(spark, sf):
    return _pairs(spark, sf)[1]


@query("coherence_npmi", f"WITH {CO_NPMI} SELECT topic, term_a, term_b, round(npmi, 6) AS npmi FROM np")
def coherence_npmi(spark, sf):
    pages, pairs = _pairs(spark, sf)
    return co.npmi(pairs, co.window_count(pages)).select("topic", "term_a", "term_b", *r6("npmi"))


@query("coherence_cv", f"""WITH {CO_NPMI},
    s AS (SELECT topic, term_b, sum(npmi) AS s FROM np GROUP BY 1, 2),
    c AS (SELECT np.topic, term_a, sum(npmi * s) / (sqrt(sum(npmi * npmi)) * sqrt(sum(s * s))) AS c
          FROM np JOIN s ON s.topic = np.topic AND s.term_b = np.term_b GROUP BY 1, 2)
    SELECT topic, round(avg(c), 6) AS coherence FROM c GROUP BY topic""")
def coherence_cv(spark, sf):
    return co.coherence_cv(lower_words(spark, sf), coherence_topics(spark, sf)).select("topic", *r6("coherence"))
