"""How the given tables play the parts of page, catalogue and topic tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelens.operators.scale import ensure_checkpoint_dir, spread

# --- pages ---------------------------------------------------------------


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def conversations(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select(
        F.col("conv_id").cast("string").alias("volid"), F.col("turn").cast("int").alias("seq"), "text"
    )


def documents(spark: SparkSession, sf: str) -> DataFrame:
    raw = table(spark, sf, "documents").select("source", "doc_id", "text")
    return spread(raw).select(
        F.col("source").alias("volid"), F.col("doc_id").cast("int").alias("seq"), "text"
    )


CONV = "conv AS (SELECT CAST(conv_id AS VARCHAR) AS volid, CAST(turn AS INTEGER) AS seq, text FROM conversations)"
DOCS = "docs AS (SELECT source AS volid, CAST(doc_id AS INTEGER) AS seq, text FROM documents)"

# --- stop words, patterns ------------------------------------------------

STOP_WORDS = (
    "the", "and", "of", "to", "in", "a", "is", "that", "it", "was", "for", "on", "as", "with",
    "de", "la", "le", "les", "et", "des", "un", "une", "du", "que", "el", "en", "los", "se",
    "der", "die", "und", "das", "ist", "von", "zu", "mit", "den",
)
STOP_SQL = ", ".join(f"'{w}'" for w in (*STOP_WORDS, "-pron-"))

PATTERNS = (
    ("determiner", r"(?i)\bth(e|at)\b"),
    ("capital_tion", r"\p{Lu}\p{L}*tion\p{L}*"),
    ("joined", r"(?i)en(-|\s)la"),
    ("before_mark", r"(?i)(tion|ment)\p{L}{0,3}[,.]"),
    ("opening", r"[.!?]\s+\p{Lu}"),
)
REWRITES = (
    ("US$ton", r"(?i)tions?[,.]"),
    ("the_end", r"the[.!?]"),
    (r"back\slash", r"und\s+\p{L}+"),
)

# --- catalogue and topic weights ----------------------------------------


def catalogue(spark: SparkSession, sf: str) -> DataFrame:
    """A row for the labelled documents only; some years are 9999 or no number."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    labels = table(spark, sf, "labels")
    return docs.join(labels, "doc_id").select(
        F.col("doc_id").cast("string").alias("htid"),
        F.concat_ws(" ", "lang", "source").alias("title"),
        F.col("source").alias("author"),
        F.when(F.col("toxic") == 1, "9999")
        .when(F.col("quality") == 0, "n.d.")
        .otherwise((1800 + F.col("n_chars") % 200).cast("string"))
        .alias("rights_date_used"),
        F.col("lang").alias("access"),
        F.concat(F.lit("q"), F.col("quality").cast("string")).alias("rights"),
    )


CATALOGUE = """cat AS (
  SELECT CAST(d.doc_id AS VARCHAR) AS htid, d.lang || ' ' || d.source AS title, d.source AS author,
         CASE WHEN l.toxic = 1 THEN '9999' WHEN l.quality = 0 THEN 'n.d.'
              ELSE CAST(1800 + d.n_chars % 200 AS VARCHAR) END AS rights_date_used,
         d.lang AS access, 'q' || CAST(l.quality AS VARCHAR) AS rights
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


def topic_pages(spark: SparkSession, sf: str) -> DataFrame:
    """``(htid, seq, weights)``: absolute embedding values scaled to sum 1, k = 64."""
    vectors = table(spark, sf, "embeddings").select(
        ((F.col("vec_id") * 7) % 300).cast("string").alias("htid"),
        F.col("vec_id").cast("int").alias("seq"),
        F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("v"),
    )
    return vectors.select(
        "htid", "seq",
        F.get(
            F.transform(
                F.array(F.aggregate("v", F.lit(0.0), lambda a, x: a + x)),
                lambda total: F.transform("v", lambda x: x / total),
            ),
            F.lit(0),
        ).alias("weights"),
    )


TOPICS = """tp AS (
  SELECT htid, seq, list_transform(v, lambda x: x / list_sum(v)) AS weights
  FROM (SELECT CAST((vec_id * 7) % 300 AS VARCHAR) AS htid, CAST(vec_id AS INTEGER) AS seq,
               list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE))) AS v
        FROM embeddings)),
long AS (SELECT htid, seq, CAST(unnest(range(0, len(weights))) AS INTEGER) AS topic, unnest(weights) AS weight FROM tp)"""


def topic_terms(spark: SparkSession, sf: str) -> DataFrame:
    """``(topic, term, weight)``: the same values read by column, a topic summing to 1."""
    rows = table(spark, sf, "embeddings").select(
        F.concat(F.lit("w"), F.col("vec_id").cast("string")).alias("term"),
        F.posexplode("embedding").alias("topic", "x"),
    ).withColumn("x", F.abs(F.col("x").cast("double")))
    totals = rows.groupBy("topic").agg(F.sum("x").alias("s"))
    return rows.join(F.broadcast(totals), "topic").select(
        "topic", "term", (F.col("x") / F.col("s")).alias("weight")
    )


TERMS = """tt AS (
  SELECT topic, term, x / sum(x) OVER (PARTITION BY topic) AS weight
  FROM (SELECT 'w' || CAST(vec_id AS VARCHAR) AS term,
               CAST(unnest(range(0, len(embedding))) AS INTEGER) AS topic,
               abs(CAST(unnest(embedding) AS DOUBLE)) AS x
        FROM embeddings))"""

# --- word tables derived from the benchmark texts -----------------------

WORD = r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]+"


def lemmas(spark: SparkSession, sf: str) -> DataFrame:
    """Forms of the benchmark texts that end in s, without it."""
    words = table(spark, sf, "benchmark").select(
        F.explode(F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0))).alias("form")
    )
    return words.where(F.length("form") > 3).where(F.col("form").endswith("s")).select(
        F.lower("form").alias("form"), F.lower(F.expr("left(form, length(form) - 1)")).alias("lemma")
    ).distinct()


LEMMAS = r"""lem AS (
  SELECT DISTINCT lower(form) AS form, lower(left(form, length(form) - 1)) AS lemma
  FROM (SELECT unnest(regexp_extract_all(text, '\p{L}+')) AS form FROM benchmark)
  WHERE length(form) > 3 AND form LIKE '%s')"""


def phrase_sql(source: str, tokens: str) -> str:
    """Candidate phrases of a token list, as a list."""
    return rf"""list_filter(string_split_regex(array_to_string(list_transform({tokens}, lambda t:
      CASE WHEN regexp_full_match(t, '\p{{L}}+') AND lower(t) NOT IN ({STOP_SQL}) THEN t ELSE chr(31) END), ' '),
      ' *\x1f *'), lambda r: contains(r, ' '))"""


def phrases(spark: SparkSession, sf: str) -> DataFrame:
    """Phrase report of the benchmark texts, all counts, in fusion order."""
    from quirelens.operators import phrases as ph
    from quirelens.plans import jobs

    return ph.ranked_phrases(
        jobs.noun_phrase_report(benchmark_pages(spark, sf), STOP_WORDS, more_than=0)
    )


def benchmark_pages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(
        F.lit("b").alias("volid"), F.col("item_id").cast("int").alias("seq"), "text"
    )


PHRASES = rf"""phr AS (
  SELECT phrase, count(*) AS n
  FROM (SELECT lower(unnest({phrase_sql('benchmark', f"regexp_extract_all(text, '{WORD}')")})) AS phrase FROM benchmark)
  GROUP BY phrase),
plist AS (SELECT list(phrase ORDER BY n DESC, phrase) AS ps FROM phr)"""


def fuse_sql(text: str) -> str:
    """Fold of all phrases over blank-separated tokens: with doubled blanks every
    token owns the blanks around it, so whole-token matches are plain replaces."""
    return rf"""trim(replace(list_reduce(list_prepend(' ' || replace({text}, ' ', '  ') || ' ',
      list_filter(ps, lambda p: contains({text}, p))),
      lambda acc, p: replace(acc, ' ' || replace(p, ' ', '  ') || ' ', ' ' || replace(p, ' ', '__') || ' ')), '  ', ' '))"""


def clean_token_sql(text: str) -> str:
    """Words and years.  RE2 knows ASCII word edges only, so every run of word
    characters is bracketed first and the brackets stand for the edges."""
    marked = rf"regexp_replace({text}, '([\p{{L}}\p{{N}}_]+)', chr(1) || '\1' || chr(2), 'g')"
    found = (
        rf"regexp_extract_all({marked}, "
        r"'\x01\p{L}+(?:(?:\x02-\x01|_{1,2})\p{L}+)*\x02|\x01(?:1[89][0-9]{2}|20[01][0-9])\x02')"
    )
    return rf"list_transform({found}, lambda w: replace(replace(w, chr(1), ''), chr(2), ''))"


def new_folder(spark) -> str:
    """A folder of its own below the one that the cluster shares, for files that are read back."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/quirelens-{uuid.uuid4().hex}"
