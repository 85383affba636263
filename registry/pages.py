"""Sources, page text, stitching and keywords."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirelens.functions import text as tx
from quirelens.operators import joins, keywords as kw, pages as pg, quality
from quirelens.plans import jobs
from quirelens.sources import readers, writers
from registry import query
from registry.inputs import (
    CATALOGUE, CONV, DOCS, PATTERNS, catalogue, conversations, documents, new_folder, table,
)

LIST = "'|'"

# Lines, sentences and stitching in SQL.  Stitching is stated as the sequential
# rule itself: a recursive walk over the pages of each volume.
NORMAL = """array_to_string(list_filter(list_transform(string_split({t}, chr(10)),
  lambda x: regexp_replace(x, '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g')), lambda x: x <> ''), chr(10))"""
SENTENCES = r"""list_filter(list_transform(string_split(regexp_replace({t},
  '([.!?][''"’”)\]]*)\s+', '\1' || chr(31), 'g'), chr(31)),
  lambda x: regexp_replace(x, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')), lambda x: x <> '')"""
HYPHEN = r"regexp_replace({t}, '(\p{{L}})-\n(\S+)[ \n]?', '\1\2' || chr(10), 'g')"
FLAT = r"array_to_string(list_transform({s}, lambda x: regexp_replace(x, '[\n\r\t]', ' ', 'g')), chr(9))"


def sentences_sql(source: str) -> str:
    return SENTENCES.replace("{t}", HYPHEN.format(t=NORMAL.replace("{t}", source)))


def stitched_sql(pages: str, sentences: str) -> str:
    """CTEs ``... , stitched(volid, seq, s)`` from a page CTE and its sentence expression."""
    return f"""
sent AS (SELECT volid, seq, {sentences} AS s FROM {pages}),
num AS (SELECT volid, seq, s, len(s) AS n, row_number() OVER (PARTITION BY volid ORDER BY seq) AS i FROM sent),
walk AS (
  SELECT volid, i, n, 0 AS lost FROM num WHERE i = 1
  UNION ALL
  SELECT num.volid, num.i, num.n, CASE WHEN walk.n - walk.lost > 0 AND num.n > 0 THEN 1 ELSE 0 END
  FROM walk JOIN num ON num.volid = walk.volid AND num.i = walk.i + 1),
stitched AS (
  SELECT a.volid, a.seq,
    CASE WHEN nw.lost = 1
         THEN list_concat(a.s[w.lost + 1 : a.n - 1], [a.s[a.n] || ' ' || nx.s[1]])
         ELSE a.s[w.lost + 1 : a.n] END AS s
  FROM num a JOIN walk w ON a.volid = w.volid AND a.i = w.i
  LEFT JOIN num nx ON nx.volid = a.volid AND nx.i = a.i + 1
  LEFT JOIN walk nw ON nw.volid = a.volid AND nw.i = a.i + 1)"""


@query(
    "read_pages",
    f"""WITH {CONV} SELECT volid, seq, text FROM conv
        WHERE volid IN (SELECT CAST(doc_id AS VARCHAR) FROM labels WHERE quality = 1)""",
)
def read_pages(spark, sf):
    """The turns of conversations written as a page store, and the listed volumes read back."""
    ids = table(spark, sf, "labels").where("quality = 1").select(F.col("doc_id").cast("string").alias("volid"))
    path = new_folder(spark)
    writers.write_pages(conversations(spark, sf), path, buckets=16)
    return readers.read_pages(spark, path, "store", ids)


@query("read_pages_csv", f"WITH {DOCS} SELECT volid, CAST(seq AS VARCHAR) AS seq, text FROM docs WHERE text <> ''")
def read_pages_csv(spark, sf):
    """Pages through a headerless stage file and back; their texts hold line breaks."""
    path = new_folder(spark)
    writers.write_csv(documents(spark, sf).select("text", "volid", "seq"), path)
    return readers.read_stage_csv(spark, path, multiline=True).where("text is not null")


@query("read_lists", """SELECT 'word' AS list, concat_ws(' ', l.quality, l.toxic) AS first, '' AS second FROM labels l
    UNION ALL SELECT 'page', CAST(doc_id AS VARCHAR), CAST(toxic AS VARCHAR) FROM labels
    UNION ALL SELECT 'id', 'lib.' || CAST(doc_id AS VARCHAR), '' FROM labels
    UNION ALL SELECT 'phrase', CAST(item_id AS VARCHAR) || ' x', CAST(item_id % 7 AS VARCHAR) FROM benchmark
    UNION ALL SELECT 'pattern', 'k' || CAST(item_id AS VARCHAR), 'a{' || CAST(item_id AS VARCHAR) || '}' FROM benchmark
    UNION ALL SELECT 'refused line', 'k' || CAST(item_id AS VARCHAR), '' FROM benchmark WHERE item_id % 5 = 0""")
def read_lists(spark, sf):
    """Word list, exclusions, ids, phrases and patterns, each through its file."""
    marks, items = table(spark, sf, "labels"), table(spark, sf, "benchmark")
    number = F.col("item_id").cast("string")
    words, pages, ids, phrases, patterns = (new_folder(spark) for _ in range(5))
    writers.write_csv(marks.select(F.concat_ws(" ", "quality", "toxic")), words)
    writers.write_csv(marks.select(F.col("doc_id").cast("string"), F.col("toxic").cast("string")), pages)
    marks.select(F.concat(F.lit("  lib."), F.col("doc_id").cast("string"), F.lit(" "))).write.text(ids)
    writers.write_csv(items.select(F.concat(number, F.lit(" x")), (F.col("item_id") % 7)), phrases)
    name = F.concat(F.lit("k"), number)
    lines = items.select(F.concat_ws("\t", name, F.concat(F.lit("a{"), number, F.lit("}")))).union(
        items.where("item_id % 5 = 0").select(name))
    lines.coalesce(1).write.text(patterns)
    good, bad = readers.read_patterns(spark, patterns)

    def rows(df, kind, first, second=F.lit("")):
        return df.select(F.lit(kind).alias("list"), first.alias("first"), second.alias("second"))

    return (
        rows(readers.read_word_list(spark, words), "word", F.col("word"))
        .union(rows(readers.read_exclusions(spark, pages), "page", F.col("volid"), F.col("seq")))
        .union(rows(readers.read_ids(spark, ids), "id", F.col("volid")))
        .union(rows(readers.read_phrase_list(spark, phrases), "phrase", F.col("phrase"), (-F.col("rank.n")).cast("string")))
        .union(rows(good, "pattern", F.col("name"), F.col("pattern")))
        .union(rows(bad, "refused line", F.col("value")))
    )


@query("write_quarantine", f"""WITH {DOCS} SELECT 'x' || volid AS volid, seq FROM docs WHERE seq % 3 = 0""")
def write_quarantine(spark, sf):
    """An error report is written when there is one, and read back; an empty one is not."""
    bad = documents(spark, sf).where("seq % 3 = 0").select(F.concat(F.lit("x"), "volid").alias("volid"), "seq")
    path, none = new_folder(spark), new_folder(spark)
    written = writers.write_quarantine(bad, path)
    if not written or writers.write_quarantine(bad.limit(0), none):
        raise AssertionError("the report is written exactly if it has rows")
    return spark.read.parquet(path)


@query("write_header", "SELECT 'volid,seq,text' AS value")
def write_header(spark, sf):
    path = new_folder(spark)
    writers.write_header(documents(spark, sf).select("volid", "seq", "text"), path)
    return spark.read.text(path)


@query(
    "read_catalogue",
    f"""WITH {CATALOGUE} SELECT htid, title, author, TRY_CAST(rights_date_used AS INTEGER) AS rights_date_used,
        access, rights FROM cat""",
)
def read_catalogue(spark, sf):
    """The catalogue through its tab-separated file."""
    path = new_folder(spark)
    catalogue(spark, sf).write.option("header", True).option("sep", "\t").csv(path)
    return readers.read_catalogue(spark, path, typed=True)


@query(
    "normalise_lines",
    f"""WITH {DOCS}, raw AS (SELECT volid, seq,
          replace(text, '. ', '.  ' || chr(10) || ' ' || chr(10) || chr(9) || ' ') AS text FROM docs)
        SELECT volid, seq, {NORMAL.replace('{t}', 'text')} AS text FROM raw""",
)
def normalise_lines(spark, sf):
    messy = F.replace("text", F.lit(". "), F.lit(".  \n \n\t "))
    return documents(spark, sf).select("volid", "seq", tx.normalise_lines(messy).alias("text"))


@query(
    "dehyphenate",
    rf"""WITH {DOCS} SELECT volid, seq,
         regexp_replace(text, '([a-z]{{3}})([a-z]{{3}}) ', '\1\2' || chr(10), 'g') AS text FROM docs""",
)
def dehyphenate(spark, sf):
    """Words broken at a line end on purpose must come back whole."""
    broken = F.regexp_replace("text", "([a-z]{3})([a-z]{3}) ", "$1-\n$2 ")
    return documents(spark, sf).select("volid", "seq", tx.dehyphenate(broken).alias("text"))


# Pages with a running header that names language and page, and a page number.
FRAMED = """framed AS (SELECT source AS volid, CAST(doc_id AS INTEGER) AS seq,
  'Journal, ' || lang || ', p. ' || CAST(doc_id AS VARCHAR) || chr(10) || text || chr(10)
  || CASE WHEN lang = 'en' THEN CAST(doc_id AS VARCHAR) ELSE 'Ende' END AS text FROM documents)"""
BODY = rf"""
nl AS (SELECT volid, seq, {NORMAL.replace('{t}', 'text')} AS t FROM framed),
keyed AS (SELECT volid, seq, string_split(t, chr(10)) AS lines FROM nl),
keys AS (SELECT *, trim(lower(regexp_replace(lines[1], '[0-9]+', '', 'g'))) AS head,
                   trim(lower(regexp_replace(lines[-1], '[0-9]+', '', 'g'))) AS foot FROM keyed),
flag AS (SELECT *,
  count(*) OVER (PARTITION BY volid, head ORDER BY seq RANGE BETWEEN 100 PRECEDING AND 100 FOLLOWING) - 1 >= 2 AS dh,
  count(*) OVER (PARTITION BY volid, foot ORDER BY seq RANGE BETWEEN 100 PRECEDING AND 100 FOLLOWING) - 1 >= 2 AS df
  FROM keys),
body AS (SELECT volid, seq, array_to_string(lines[CASE WHEN dh THEN 2 ELSE 1 END :
  CASE WHEN df THEN len(lines) - 1 ELSE len(lines) END], chr(10)) AS text FROM flag)"""


def framed(spark, sf):
    raw = table(spark, sf, "documents")
    return raw.select(
        F.col("source").alias("volid"),
        F.col("doc_id").cast("int").alias("seq"),
        F.concat(
            F.lit("Journal, "), F.col("lang"), F.lit(", p. "), F.col("doc_id").cast("string"),
            F.lit("\n"), F.col("text"), F.lit("\n"),
            F.when(F.col("lang") == "en", F.col("doc_id").cast("string")).otherwise("Ende"),
        ).alias("text"),
    )


@query("strip_running_lines", f"WITH {FRAMED}, {BODY} SELECT volid, seq, text FROM body")
def strip_running_lines(spark, sf):
    lines = framed(spark, sf).withColumn("text", tx.normalise_lines(F.col("text")))
    return pg.strip_running_lines(lines, repeats=2, within=100).select("volid", "seq", "text")


@query("running_lines_blocks", f"WITH {FRAMED}, {BODY} SELECT volid, seq, text FROM body")
def running_lines_blocks(spark, sf):
    """The same in blocks that a volume fills many of."""
    lines = framed(spark, sf).withColumn("text", tx.normalise_lines(F.col("text")))
    return pg.strip_running_lines(lines, repeats=2, within=100, block=128).select("volid", "seq", "text")


@query(
    "split_sentences",
    f"""WITH {DOCS}, s AS (SELECT volid, seq, {SENTENCES.replace('{t}', 'text')} AS s FROM docs)
        SELECT volid, seq, CAST(len(s) AS INTEGER) AS n, array_to_string(s, {LIST}) AS sentences FROM s""",
)
def split_sentences(spark, sf):
    return documents(spark, sf).select(
        "volid", "seq", tx.split_sentences(F.col("text")).alias("s")
    ).select("volid", "seq", F.size("s").alias("n"), F.array_join("s", "|").alias("sentences"))


@query(
    "flatten_sentences",
    f"""WITH {DOCS}, s AS (SELECT volid, seq, {SENTENCES.replace('{t}', 'text')} AS s FROM docs)
        SELECT volid, seq, {FLAT.format(s='s')} AS text FROM s""",
)
def flatten_sentences(spark, sf):
    return documents(spark, sf).select(
        "volid", "seq", tx.flatten_sentences(tx.split_sentences(F.col("text"))).alias("text")
    )


@query(
    "resplit_sentences",
    f"""WITH {DOCS}, s AS (SELECT volid, seq, {SENTENCES.replace('{t}', 'text')} AS s FROM docs),
        f AS (SELECT volid, seq, string_split_regex({FLAT.format(s='s')}, '\\t+') AS s FROM s)
        SELECT volid, seq, CAST(unnest(range(0, len(s))) AS INTEGER) AS i, unnest(s) AS sentence FROM f""",
)
def resplit_sentences(spark, sf):
    flat = flatten_sentences(spark, sf)
    return flat.select("volid", "seq", F.posexplode(tx.resplit_sentences(F.col("text"))).alias("i", "sentence"))


@query(
    "stitch_pages",
    f"""WITH RECURSIVE {CONV}, {stitched_sql('conv', sentences_sql('text'))}
        SELECT volid, seq, CAST(len(s) AS INTEGER) AS n, array_to_string(s, {LIST}) AS sentences FROM stitched""",
)
def stitch_pages(spark, sf):
    stitched = jobs.full_page_sentences(conversations(spark, sf), running_lines=False)
    return stitched.select("volid", "seq", F.size("sentences").alias("n"), F.array_join("sentences", "|").alias("sentences"))


@query(
    "stitch_pages_blocks",
    f"""WITH RECURSIVE {DOCS}, {stitched_sql('docs', sentences_sql('text'))}
        SELECT volid, seq, CAST(len(s) AS INTEGER) AS n, array_to_string(s, {LIST}) AS sentences FROM stitched""",
)
def stitch_pages_blocks(spark, sf):
    """Volumes of many blocks: what crosses a block's edge goes through its summary row."""
    lines = documents(spark, sf).withColumn("text", tx.normalise_lines(F.col("text")))
    stitched = pg.stitch_pages(pg.sentence_pages(lines.select("volid", "seq", "text")), block=16)
    return stitched.select("volid", "seq", F.size("sentences").alias("n"), F.array_join("sentences", "|").alias("sentences"))


# The same with one-sentence pages only: every sentence of a document is a page.
@query(
    "stitch_single_sentence_pages",
    f"""WITH RECURSIVE {DOCS},
        one AS (SELECT volid || '-' || CAST(seq AS VARCHAR) AS volid,
                       CAST(unnest(range(0, len(s))) AS INTEGER) AS seq, unnest(s) AS text
                FROM (SELECT volid, seq, {SENTENCES.replace('{t}', 'text')} AS s FROM docs)),
        {stitched_sql('one', '[text]')}
        SELECT volid, seq, array_to_string(s, {LIST}) AS sentences FROM stitched""",
)
def stitch_single_sentence_pages(spark, sf):
    one = documents(spark, sf).select(
        F.concat_ws("-", "volid", F.col("seq").cast("string")).alias("volid"),
        F.posexplode(tx.split_sentences(F.col("text"))).alias("seq", "text"),
    ).select("volid", "seq", F.array("text").alias("sentences"))
    return pg.stitch_pages(one).select("volid", "seq", F.array_join("sentences", "|").alias("sentences"))


@query(
    "adjacent_pages",
    f"""WITH {DOCS} SELECT volid, seq,
        coalesce(lead(seq) OVER (PARTITION BY volid ORDER BY seq), seq) AS next_seq FROM docs""",
)
def adjacent_pages(spark, sf):
    return pg.adjacent_pages(documents(spark, sf))


def counts_sql(text: str) -> str:
    return ", ".join(
        f"CAST(len(regexp_extract_all({text}, '{p}')) AS INTEGER) AS {n}" for n, p in PATTERNS
    )


WIDE = f"wide AS (SELECT text, volid, seq, {counts_sql('text')} FROM docs)"
NAMES = ", ".join(n for n, _ in PATTERNS)
LONG_HITS = f"""hits AS (SELECT volid, seq, keyword, n FROM
  (UNPIVOT wide ON {NAMES} INTO NAME keyword VALUE n) WHERE n > 0)"""
ANY = " OR ".join(f"{n} > 0" for n, _ in PATTERNS)


@query("count_keywords", f"WITH {DOCS}, {WIDE}, {LONG_HITS} SELECT volid, seq, keyword, n FROM hits")
def count_keywords(spark, sf):
    return kw.count_keywords(documents(spark, sf), PATTERNS)


MANY = """many AS (SELECT DISTINCT word FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS word FROM benchmark)
    WHERE length(word) >= 3),
pw AS (SELECT volid, seq, lower(w) AS w FROM (SELECT volid, seq, unnest(regexp_extract_all(text, '[\\p{L}\\p{N}_]+')) AS w FROM docs))"""


def many_patterns(spark, sf):
    """Every ASCII word of the benchmark as a whole word of any case."""
    words = table(spark, sf, "benchmark").select(
        F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("w")).distinct()
    edge = r"[\p{L}\p{N}_]"
    return [(r["w"], rf"(?i)(?<!{edge}){r['w']}(?!{edge})") for r in words.where("length(w) >= 3").orderBy("w").collect()]


@query("count_keywords_many", f"""WITH {DOCS}, {MANY}
    SELECT volid, seq, word AS keyword, CAST(count(*) AS INTEGER) AS n FROM many JOIN pw ON lower(word) = w
    GROUP BY volid, seq, word""")
def count_keywords_many(spark, sf):
    """More patterns than are tried on every page: an index of letters picks the candidates."""
    return kw.count_keywords(documents(spark, sf), many_patterns(spark, sf))


@query("refused_patterns", """SELECT CAST(item_id AS VARCHAR) AS name, '(' || CAST(item_id AS VARCHAR) AS pattern
    FROM benchmark WHERE item_id % 4 = 0""")
def refused_patterns(spark, sf):
    """Every fourth item gives a pattern that is no regular expression."""
    number = F.col("item_id").cast("string")
    listed = table(spark, sf, "benchmark").select(
        number.alias("name"), F.when(F.col("item_id") % 4 == 0, F.concat(F.lit("("), number)).otherwise(number).alias("pattern"))
    return jobs.refused_patterns(documents(spark, sf), listed).where("reason <> ''").select("name", "pattern")


@query("any_match", f"WITH {DOCS}, {WIDE} SELECT volid, seq FROM wide WHERE {ANY}")
def any_match(spark, sf):
    return kw.any_match(count_keywords(spark, sf))


@query("wide_matches", f"WITH {DOCS}, {WIDE} SELECT text, volid, seq, {NAMES} FROM wide WHERE {ANY}")
def wide_matches(spark, sf):
    return kw.wide_matches(documents(spark, sf), PATTERNS)


@query("pivot_matches", f"WITH {DOCS}, {WIDE} SELECT volid, seq, {NAMES} FROM wide WHERE {ANY}")
def pivot_matches(spark, sf):
    return kw.pivot_matches(count_keywords(spark, sf), PATTERNS)


@query(
    "keyword_totals",
    f"""WITH {DOCS}, {WIDE}, {LONG_HITS}
        SELECT keyword, CAST(sum(n) AS BIGINT) AS hits, count(*) AS pages FROM hits GROUP BY keyword""",
)
def keyword_totals(spark, sf):
    return kw.keyword_totals(count_keywords(spark, sf))


@query(
    "page_matches",
    f"""WITH RECURSIVE {FRAMED}, {BODY},
        {stitched_sql('body', SENTENCES.replace('{t}', HYPHEN.format(t='text')))},
        docs AS (SELECT volid, seq, {FLAT.format(s='s')} AS text FROM stitched), {WIDE}
        SELECT text, volid, seq, {NAMES} FROM wide WHERE {ANY}""",
)
def page_matches(spark, sf):
    return jobs.page_matches(framed(spark, sf), PATTERNS, repeats=2, within=100)


@query(
    "exclude_pages",
    f"""WITH {DOCS} SELECT volid, seq FROM docs
        WHERE seq NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""",
)
def exclude_pages(spark, sf):
    listed = table(spark, sf, "labels").where("toxic = 1").join(
        table(spark, sf, "documents").select("doc_id", "source"), "doc_id"
    ).select(F.col("source").alias("volid"), F.col("doc_id").cast("int").alias("seq"))
    return joins.exclude_pages(documents(spark, sf), listed).select("volid", "seq")


# Pages whose ids are damaged according to their own content.
DAMAGED = """dam AS (SELECT CASE WHEN lang = 'de' THEN NULL ELSE source END AS volid,
  CASE WHEN lang = 'fr' THEN 'p' || CAST(doc_id AS VARCHAR)
       WHEN lang = 'es' THEN CAST(doc_id % 40 AS VARCHAR) ELSE CAST(doc_id AS VARCHAR) END AS seq,
  CASE WHEN n_chars < 100 THEN NULL ELSE text END AS text FROM documents),
chk AS (SELECT *, CASE WHEN volid IS NULL THEN 'volume id is null'
  WHEN TRY_CAST(seq AS INTEGER) IS NULL THEN 'seq is no integer'
  WHEN text IS NULL THEN 'text is null' END AS e FROM dam),
dup AS (SELECT *, CASE WHEN e IS NULL AND count(*) OVER (PARTITION BY e IS NULL, volid, TRY_CAST(seq AS INTEGER)) > 1
  THEN 'seq is not unique in its volume' ELSE e END AS error FROM chk)"""


def damaged(spark, sf):
    return table(spark, sf, "documents").select(
        F.when(F.col("lang") != "de", F.col("source")).alias("volid"),
        F.when(F.col("lang") == "fr", F.concat(F.lit("p"), F.col("doc_id").cast("string")))
        .when(F.col("lang") == "es", (F.col("doc_id") % 40).cast("string"))
        .otherwise(F.col("doc_id").cast("string")).alias("seq"),
        F.when(F.col("n_chars") >= 100, F.col("text")).alias("text"),
    )


@query(
    "quarantine_pages",
    f"""WITH {DAMAGED} SELECT volid, seq, 'pages' AS stage, error FROM dup WHERE error IS NOT NULL""",
)
def quarantine_pages(spark, sf):
    return quality.split_pages(damaged(spark, sf))[1]


@query(
    "accepted_pages",
    f"""WITH {DAMAGED} SELECT volid, CAST(seq AS INTEGER) AS seq, text FROM dup WHERE error IS NULL""",
)
def accepted_pages(spark, sf):
    return quality.split_pages(damaged(spark, sf))[0]
