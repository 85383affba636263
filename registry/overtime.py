"""Catalogue joins, topic weight per year, extreme pages, topic description."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirelens.operators import inspection as ins, joins, overtime as ot
from quirelens.plans import jobs
from registry import query
from registry.inputs import CATALOGUE, TERMS, TOPICS, catalogue, topic_pages, topic_terms

META = "rights_date_used, title, author, access, rights"
JOINED = f"j AS (SELECT long.*, {META} FROM long LEFT JOIN cat ON long.htid = cat.htid)"
BY_TOPIC = """bt AS (SELECT TRY_CAST(rights_date_used AS INTEGER) AS year, topic, sum(weight) AS sum_weight FROM j GROUP BY 1, 2)"""
TOTAL = "ty AS (SELECT year, sum(sum_weight) AS total_weight FROM bt GROUP BY year)"
YT = "yt AS (SELECT bt.year, topic, sum_weight, total_weight FROM bt LEFT JOIN ty ON bt.year = ty.year)"
RANKED = """rk AS (SELECT topic, term, weight, row_number() OVER (PARTITION BY topic ORDER BY weight DESC, term) AS rank FROM tt),
top AS (SELECT topic, term, weight, rank FROM rk WHERE rank <= {n})"""
LABELS = "lab AS (SELECT topic, string_agg(term, ', ' ORDER BY rank) AS topic_terms FROM top GROUP BY topic)"


def r6(*names):
    return [F.round(F.col(n), 6).alias(n) for n in names]


def labels(spark, sf):
    return ins.topic_labels(ins.describe_ranked(ins.top_terms(topic_terms(spark, sf), 20)))


@query("explode_topics", f"WITH {TOPICS} SELECT htid, seq, topic, round(weight, 6) AS weight FROM long")
def explode_topics(spark, sf):
    return ot.explode_topics(topic_pages(spark, sf)).select("htid", "seq", "topic", *r6("weight"))


@query("wide_topics", f"""WITH {TOPICS} SELECT htid, seq,
    {', '.join(f'round(weights[{i + 1}], 6) AS t{i}' for i in range(64))} FROM tp""")
def wide_topics(spark, sf):
    wide = ot.wide_topics(topic_pages(spark, sf), 64)
    return wide.select("htid", "seq", *r6(*[f"t{i}" for i in range(64)]))


@query("attach_catalogue", f"WITH {TOPICS}, {CATALOGUE} SELECT tp.htid, seq, {META} FROM tp LEFT JOIN cat ON tp.htid = cat.htid")
def attach_catalogue(spark, sf):
    return joins.attach_catalogue(topic_pages(spark, sf).drop("weights"), catalogue(spark, sf)).select(
        "htid", "seq", "rights_date_used", "title", "author", "access", "rights")


@query("attach_catalogue_salted", f"WITH {TOPICS}, {CATALOGUE} SELECT tp.htid, seq, {META} FROM tp LEFT JOIN cat ON tp.htid = cat.htid")
def attach_catalogue_salted(spark, sf):
    """The same with a catalogue that is not broadcast: hot volumes are salted."""
    return joins.attach_catalogue(
        topic_pages(spark, sf).drop("weights"), catalogue(spark, sf), max_rows=0
    ).select("htid", "seq", "rights_date_used", "title", "author", "access", "rights")


@query("topic_weight_by_year", f"""WITH {TOPICS}, {CATALOGUE}, {JOINED}, {BY_TOPIC}
    SELECT year, topic, round(sum_weight, 6) AS sum_weight FROM bt""")
def topic_weight_by_year(spark, sf):
    return ot.topic_weight_by_year(topic_pages(spark, sf), catalogue(spark, sf)).select("year", "topic", *r6("sum_weight"))


@query("total_weight_by_year", f"""WITH {TOPICS}, {CATALOGUE}, {JOINED}, {BY_TOPIC}, {TOTAL}
    SELECT year, round(total_weight, 6) AS total_weight FROM ty""")
def total_weight_by_year(spark, sf):
    by_topic = ot.topic_weight_by_year(topic_pages(spark, sf), catalogue(spark, sf))
    return ot.total_weight_by_year(by_topic).select("year", *r6("total_weight"))


@query("attach_year_total", f"""WITH {TOPICS}, {CATALOGUE}, {JOINED}, {BY_TOPIC}, {TOTAL}, {YT}
    SELECT year, topic, round(sum_weight, 6) AS sum_weight, round(total_weight, 6) AS total_weight FROM yt""")
def attach_year_total(spark, sf):
    by_topic = ot.topic_weight_by_year(topic_pages(spark, sf), catalogue(spark, sf))
    return ot.attach_year_total(by_topic).select("year", "topic", *r6("sum_weight", "total_weight"))


@query("normalised_weight", f"""WITH {TOPICS}, {CATALOGUE}, {JOINED}, {BY_TOPIC}, {TOTAL}, {YT}
    SELECT year, topic, round(sum_weight / total_weight, 6) AS norm_weight FROM yt""")
def normalised_weight(spark, sf):
    by_topic = ot.topic_weight_by_year(topic_pages(spark, sf), catalogue(spark, sf))
    return ot.normalised_weight(ot.attach_year_total(by_topic)).select("year", "topic", *r6("norm_weight"))


@query("attach_labels", f"""WITH {TOPICS}, {TERMS}, {RANKED.format(n=20)}, {LABELS}
    SELECT htid, seq, long.topic, topic_terms FROM long LEFT JOIN lab ON long.topic = lab.topic""")
def attach_labels(spark, sf):
    return joins.attach_labels(ot.explode_topics(topic_pages(spark, sf)), labels(spark, sf)).select(
        "htid", "seq", "topic", "topic_terms")


@query("topics_over_time", f"""WITH {TOPICS}, {CATALOGUE}, {JOINED}, {BY_TOPIC}, {TOTAL}, {YT}, {TERMS},
    {RANKED.format(n=20)}, {LABELS}
    SELECT year, yt.topic, round(sum_weight / total_weight, 6) AS norm_weight, topic_terms
    FROM yt LEFT JOIN lab ON yt.topic = lab.topic ORDER BY year NULLS FIRST, yt.topic""")
def topics_over_time(spark, sf):
    table = jobs.topics_over_time(topic_pages(spark, sf), catalogue(spark, sf), labels(spark, sf))
    return table.select("year", "topic", *r6("norm_weight"), "topic_terms")


@query("year_histogram", f"""WITH {TOPICS}, {CATALOGUE}
    SELECT rights_date_used, count(*) AS count FROM tp LEFT JOIN cat ON tp.htid = cat.htid GROUP BY 1""")
def year_histogram(spark, sf):
    return ot.year_histogram(topic_pages(spark, sf), catalogue(spark, sf))


@query("sentinel_years", f"""WITH {TOPICS}, {CATALOGUE}
    SELECT tp.htid, seq, title FROM tp LEFT JOIN cat ON tp.htid = cat.htid WHERE rights_date_used = '9999'""")
def sentinel_years(spark, sf):
    joined = joins.attach_catalogue(topic_pages(spark, sf).drop("weights"), catalogue(spark, sf))
    return ot.sentinel_years(joined).select("htid", "seq", "title")


@query("topic_extremes", f"""WITH {TOPICS}, {CATALOGUE},
    d AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY weight DESC, htid, seq) AS a,
                    row_number() OVER (PARTITION BY topic ORDER BY weight, htid, seq) AS b FROM long),
    u AS (SELECT topic, 'top' AS slice, CAST(a AS INTEGER) AS rank, htid, seq, weight FROM d WHERE a <= 1000
          UNION ALL SELECT topic, 'bottom', CAST(b AS INTEGER), htid, seq, weight FROM d WHERE b <= 100)
    SELECT topic, slice, rank, u.htid, seq, round(weight, 6) AS weight, {META} FROM u LEFT JOIN cat ON u.htid = cat.htid""")
def topic_extremes(spark, sf):
    chosen = jobs.topic_extremes(topic_pages(spark, sf), catalogue(spark, sf))
    return chosen.select("topic", "slice", "rank", "htid", "seq", *r6("weight"),
                         "rights_date_used", "title", "author", "access", "rights")


@query("top_terms", f"""WITH {TERMS}, {RANKED.format(n=20)}
    SELECT topic, CAST(rank AS INTEGER) AS rank, term, round(weight, 6) AS weight FROM top""")
def top_terms(spark, sf):
    return ins.top_terms(topic_terms(spark, sf), 20).select("topic", "rank", "term", *r6("weight"))


@query("describe_ranked", f"""WITH {TERMS}, {RANKED.format(n=20)}
    SELECT topic, string_agg(term, ', ' ORDER BY rank) AS topic_terms,
           string_agg(printf('%.3f*"%s"', weight, term), ', ' ORDER BY rank) AS terms_and_weights,
           round(sum(weight), 6) AS sum_of_weights FROM top GROUP BY topic""")
def describe_ranked(spark, sf):
    return ins.describe_ranked(ins.top_terms(topic_terms(spark, sf), 20)).select(
        "topic", "topic_terms", "terms_and_weights", *r6("sum_of_weights"))
