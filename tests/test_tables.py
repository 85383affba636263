import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from quirelens.operators import coherence as co, inspection as ins, joins, overtime as ot, quality, scale
from quirelens.operators import volumes as vo
from quirelens.plans import jobs


def test_lookup_join_all_routes(spark):
    rnd = random.Random(5)
    keys = ["hot"] * 400 + [f"k{rnd.randint(0, 30)}" for _ in range(200)] + [None] * 5
    rows = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "i int, k string")
    table = spark.createDataFrame([("hot", 1), ("hot", 2), ("k3", 3), ("k9", 4), ("zz", 5)], "k string, v int")
    for how in ("inner", "left", "left_semi", "left_anti"):
        want = sorted(map(tuple, rows.join(table, "k", how).collect()), key=repr)
        for cap in (10**6, 0):
            got = sorted(map(tuple, scale.lookup_join(rows, table, "k", how, ["i"], cap).collect()), key=repr)
            assert got == want, (how, cap)
    with pytest.raises(ValueError):
        scale.lookup_join(rows, table, "k", "full", ["i"])


def test_size_check(spark):
    table = spark.range(100).select(F.col("id").cast("string").alias("w"))
    assert scale.fits_broadcast(table, 100)
    assert not scale.fits_broadcast(table, 99)
    assert not scale.fits_broadcast(spark.range(10).select(F.repeat(F.lit("x"), 1000).alias("w")), 100, 1000)


def test_top_per_group_hot_group(spark):
    rows = [(0 if i % 3 else 1, i * 7919 % 1000, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g int, w int, i int").repartition(7)
    got = scale.top_per_group(df, ["g"], [F.desc("w"), F.asc("i")], 40)
    for g in (0, 1):
        want = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))[:40]
        mine = sorted((r["rank"], r["w"], r["i"]) for r in got.where(F.col("g") == g).collect())
        assert mine == [(n + 1, w, i) for n, (_, w, i) in enumerate(want)]


CATALOGUE = [("a", "T", "A", "1999", "allow", "pd"), ("b", "T2", "B", "n.d.", "deny", "ic"), ("c", "T3", "C", "9999", "deny", "ic")]


def catalogue(spark):
    return spark.createDataFrame(CATALOGUE, "htid string, title string, author string, rights_date_used string, access string, rights string")


def test_topics_over_time(spark):
    pages = spark.createDataFrame(
        [("a", 1, [0.25, 0.75]), ("a", 2, [0.5, 0.5]), ("b", 1, [1.0, 0.0]), ("x", 1, [0.0, 1.0]), ("c", 1, [0.0, 0.0])],
        "htid string, seq int, weights array<double>")
    labels = spark.createDataFrame([(0, "u, v"), (1, "w")], "topic int, topic_terms string")
    got = [tuple(r) for r in jobs.topics_over_time(pages, catalogue(spark), labels).collect()]
    assert got == [
        (None, 0, None, "u, v"), (None, 1, None, "w"),
        (1999, 0, 0.375, "u, v"), (1999, 1, 0.625, "w"),
        (9999, 0, None, "u, v"), (9999, 1, None, "w"),
    ]
    years = [tuple(r) for r in ot.year_histogram(pages, catalogue(spark)).collect()]
    assert years == [("n.d.", 1), ("9999", 1), ("1999", 2), (None, 1)]
    joined = joins.attach_catalogue(pages, catalogue(spark), max_rows=0)
    assert joined.count() == 5
    assert [r["htid"] for r in ot.sentinel_years(joined).collect()] == ["c"]


def test_normalised_weights_sum_to_one(spark, small):
    import __spark_entry__ as se

    rows = se.queries()["topics_over_time"](spark, small).where("year is not null")
    for r in rows.groupBy("year").agg(F.sum("norm_weight").alias("s")).collect():
        assert r["s"] == pytest.approx(1.0, abs=1e-4)


def test_extremes_overlap(spark):
    pages = spark.createDataFrame([("a", i, [i / 10, 1 - i / 10]) for i in range(10)], "htid string, seq int, weights array<double>")
    got = ot.representative_pages(pages, catalogue(spark), top=8, bottom=3)
    top = [r["seq"] for r in got.where("topic = 0 and slice = 'top'").orderBy("rank").collect()]
    low = [r["seq"] for r in got.where("topic = 0 and slice = 'bottom'").orderBy("rank").collect()]
    assert top == [9, 8, 7, 6, 5, 4, 3, 2] and low == [0, 1, 2]
    assert {r["title"] for r in got.collect()} == {"T"}


def mets(spark, *bodies):
    xml = [(f"l.{i}", b if b.startswith("!") else
            f'<METS:mets xmlns:METS="http://www.loc.gov/METS/"><METS:fileSec>{b}</METS:fileSec></METS:mets>')
           for i, b in enumerate(bodies)]
    return spark.createDataFrame(xml, "id string, xml string")


def f(kind, seq):
    return f'<METS:file MIMETYPE="{kind}" SEQ="{seq:08d}" ID="x"><METS:FLocat/></METS:file>'


def test_last_seq(spark):
    df = mets(
        spark,
        '<METS:fileGrp USE="ocr">' + f("text/plain", 1) + f("text/plain", 12) + "</METS:fileGrp>",
        '<METS:fileGrp USE="ocr">' + f("text/plain", 3) + f("text/xml", 4) + "</METS:fileGrp>",
        '<METS:fileGrp USE="image">' + f("text/plain", 3) + "</METS:fileGrp>",
        "!not xml at all <",
        '<METS:fileGrp USE="all"><METS:fileGrp USE="ocr">' + f("text/plain", 8) + "</METS:fileGrp></METS:fileGrp>",
    )
    assert {tuple(r) for r in vo.volume_last_seq(df).collect()} == {("l.0", 12), ("l.1", 3), ("l.4", 8)}
    assert {tuple(r) for r in vo.volume_last_seq(df, strict=True).collect()} == {("l.0", 12), ("l.4", 8)}


def test_quarantine(spark):
    rows = [("a", "1", "x"), ("a", "01", "y"), ("a", "2", "z"), (None, "1", "n"), ("b", "p3", "q"), ("b", "4", None), ("b", None, "r"), ("b", "5", "s")]
    df = spark.createDataFrame(rows, "volid string, seq string, text string")
    good, bad = quality.split_pages(df)
    assert {tuple(r) for r in good.collect()} == {("a", 2, "z"), ("b", 5, "s")}
    assert good.count() + bad.count() == len(rows)
    assert {r["error"] for r in bad.where("volid = 'a'").collect()} == {"seq is not unique in its volume"}


def test_volume_ids(spark):
    ids = spark.createDataFrame([("lib.1",), ("lib.2",), ("nodot",), (".x",)], "volid string")
    good, bad = quality.split_volume_ids(ids, spark.createDataFrame([("lib.1",)], "volid string"))
    assert [r["volid"] for r in good.collect()] == ["lib.1"]
    assert {(r["volid"], r["error"]) for r in bad.collect()} == {
        ("lib.2", "volume not found"), ("nodot", "volume id does not parse"), (".x", "volume id does not parse")}


def test_exclusion_keeps_null_keys(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", None, "y"), ("b", 1, "z")], "volid string, seq int, text string")
    out = spark.createDataFrame([("a", 1), ("a", None)], "volid string, seq int")
    assert {r["text"] for r in joins.exclude_pages(df, out).collect()} == {"y", "z"}


def test_coherence_by_hand(spark):
    rnd = random.Random(3)
    words = list("abcdefgh")
    docs = [[rnd.choice(words) for _ in range(rnd.choice([0, 1, 4, 9, 30]))] for _ in range(25)]
    topics = {0: ["a", "b", "c"], 1: ["c", "d", "zz"]}
    size = 6
    windows = [set(d[s:s + size]) for d in docs if d for s in range(max(len(d) - size + 1, 1))]
    df = spark.createDataFrame([("v", i, d) for i, d in enumerate(docs)], "volid string, seq int, tokens array<string>")
    table = spark.createDataFrame([(t, w) for t, ws in topics.items() for w in ws], "topic int, term string")
    bits = co.topic_term_bits(table)
    pairs = {(r["topic"], r["term_a"], r["term_b"]): r["windows"] for r in co.pair_counts(co.window_masks(df, bits, size), bits).collect()}
    want = {
        (t, x, y): sum(x in w and y in w for w in windows)
        for t, ws in topics.items() for x, y in itertools.product(ws, ws)
    }
    assert pairs == want
    n = len(windows)

    def npmi(t, x, y):
        px, py, pxy = want[t, x, x] / n, want[t, y, y] / n, want[t, x, y] / n + co.EPSILON
        return math.log(pxy / (px * py)) / -math.log(pxy) if px and py else 0.0

    score = {r["topic"]: r["coherence"] for r in co.coherence_cv(df, table, size).collect()}
    for t, ws in topics.items():
        vec = {x: [npmi(t, x, y) for y in ws] for x in ws}
        total = [sum(vec[x][i] for x in ws) for i in range(len(ws))]
        norm = lambda v: math.sqrt(sum(a * a for a in v))
        cos = [
            sum(a * b for a, b in zip(vec[x], total)) / (norm(vec[x]) * norm(total)) if norm(vec[x]) else 0.0
            for x in ws
        ]
        assert score[t] == pytest.approx(sum(cos) / len(cos))


def test_distance_and_relevance(spark):
    tt = spark.createDataFrame([(0, "a", 1.0), (0, "b", 0.0), (1, "a", 0.0), (1, "b", 1.0), (2, "a", 1.0), (2, "b", 0.0)], "topic int, term string, weight double")
    d = {(r["topic_a"], r["topic_b"]): r["divergence"] for r in ins.topic_distance(tt).collect()}
    assert d[0, 1] == pytest.approx(math.log(2)) and d[0, 2] == pytest.approx(0.0)
    freq = spark.createDataFrame([("a", 3), ("b", 1)], "term string, n long")
    rel = {(r["topic"], r["term"]): r["relevance"] for r in ins.term_relevance(tt, freq, 0.5).collect()}
    assert rel == {(0, "a"): pytest.approx(-0.5 * math.log(0.75)), (2, "a"): pytest.approx(-0.5 * math.log(0.75)), (1, "b"): pytest.approx(-0.5 * math.log(0.25))}
