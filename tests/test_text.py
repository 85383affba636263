import random
import re

import pytest
from pyspark.sql import functions as F

from quirelens.functions import arrays as ax, ids, text as tx
from quirelens.operators import cleaning as cl, keywords as kw, phrases as ph, tokens as tk
from quirelens.plans import jobs


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def pages(spark, *texts):
    return spark.createDataFrame([("v", i, t) for i, t in enumerate(texts)], "volid string, seq int, text string")


def texts(df):
    return [r["text"] for r in df.orderBy("seq").collect()]


# look-behind, inline flag, letters by class, bounded repetition, a match over a sentence end
PATTERNS = [
    ("priced", r"(?<=£|\$)\d+(?:\.\d\d)?"),
    ("ship", r"(?i)\bships?\b"),
    ("port", r"(?i)\bport[ -]?of[ -]?\p{Lu}\p{L}*"),
    ("cargo", r"\bcargo\b(?:\W+\w+){1,2}\W+tea\b"),
    ("over", r"sailed\.\s+Later"),
]


def test_keyword_counts(spark):
    df = pages(
        spark,
        "Paid £12.50 and $3, not 7. Two Ships, one ship; SHIP!",
        "the Port of Leith, port-of-Hull and PORT OF Wick",
        "a cargo of fine tea, and then it sailed.\tLater it came back",
        "nothing",
        None,
    )
    wide = {r["seq"]: r for r in kw.wide_matches(df, PATTERNS).collect()}
    assert sorted(wide) == [0, 1, 2]
    assert (wide[0]["priced"], wide[0]["ship"]) == (2, 3)
    assert wide[1]["port"] == 3
    assert (wide[2]["cargo"], wide[2]["over"]) == (1, 1)
    hits = kw.count_keywords(df, PATTERNS)
    long = {(r["seq"], r["keyword"]): r["n"] for r in hits.collect()}
    assert long == {(s, n): wide[s][n] for s in wide for n, _ in PATTERNS if wide[s][n]}
    pivot = {r["seq"]: r for r in kw.pivot_matches(hits, PATTERNS).collect()}
    assert all(pivot[s][n] == wide[s][n] for s in wide for n, _ in PATTERNS)
    table = spark.createDataFrame(PATTERNS, "name string, pattern string")
    assert sorted(kw.count_keywords(df, table).collect()) == sorted(hits.collect())


def test_bad_pattern_is_set_aside(spark):
    df = pages(spark, "One ship sailed. Two came back.", "no match")
    listed = [*PATTERNS, ("open", "(a")]
    assert [r["seq"] for r in jobs.page_matches(df, listed, running_lines=False).collect()] == [0]
    assert [r["name"] for r in jobs.refused_patterns(df, listed).collect()] == ["open"]


def test_pattern_blocks(spark, monkeypatch):
    df = pages(spark, "One ship, two ships for £5")
    want = sorted(kw.count_keywords(df, PATTERNS).collect())
    monkeypatch.setattr(kw, "BLOCK_PATTERNS", 2)
    assert sorted(kw.count_keywords(df, PATTERNS).collect()) == want


ROWS = [
    ("a", 1, "The x one", "k1"), ("a", 1, "the Y two", "k2"), (None, 2, "x y", "k3"),
    ("b", None, "one two", "k4"), ("a", 1, "The x one", "k1"), ("c", 3, None, "k5"),
]


@pytest.mark.parametrize("rows", [500_000, 0])
def test_every_route_keeps_every_row(spark, rows):
    """Repeated keys, null keys and one more column, on the broadcast and the shuffled route."""
    df = spark.createDataFrame(ROWS, "volid string, seq int, text string, note string")

    def seen(out):
        assert out.columns == df.columns
        return sorted((r["note"], r["text"] or "") for r in out.collect())

    words = ["x", "two"]
    assert seen(tk.remove_words(df, words, literal_words=0, max_broadcast_rows=rows)) == seen(tk.remove_words(df, words))
    listed = spark.createDataFrame([("x",), ("two",)], "w string")
    kept = spark.createDataFrame([(w,) for w in ("The", "the", "Y", "y", "one")], "w string")
    by_kept = tk.remove_words(df, listed, kept=kept, literal_words=0, max_broadcast_rows=rows)
    assert seen(by_kept) == seen(tk.remove_words(df, words))
    many = ["x one", "one two", "a, b"]
    assert seen(ph.fuse_phrases(df, many, literal_phrases=0, max_broadcast_rows=rows)) == seen(ph.fuse_phrases(df, many))
    lemmas = spark.createDataFrame([("one", "eins"), ("y", "ypsilon")], "form string, lemma string")
    clean = cl.preprocess_pages(df, ["the"], lemmas=lemmas, max_broadcast_rows=rows)
    assert seen(clean) == [("k1", "eins"), ("k1", "eins"), ("k2", "ypsilon two"), ("k3", "ypsilon"), ("k4", "eins two"), ("k5", "")]


def test_long_stop_list(spark, monkeypatch):
    df = pages(spark, "The quick brown fox. The lazy dog", "quick brown bread")
    short = texts(cl.preprocess_pages(df, ["the", "lazy"]))
    phrases = sorted(jobs.noun_phrase_report(df, ["the", "lazy"], more_than=0).collect())
    monkeypatch.setattr(cl, "LITERAL_WORDS", 1)
    assert texts(cl.preprocess_pages(df, ["the", "lazy"])) == short
    assert sorted(jobs.noun_phrase_report(df, ["the", "lazy"], more_than=0).collect()) == phrases


def test_odd_phrases_beyond_the_literal_list(spark):
    df = pages(spark, "a well-known man, St. Mary 12 of the town", "x-ray film and St. Mary")
    odd = ["well-known man", "St. Mary", "x-ray film", "Mary 12"] + [f"q{i}- z" for i in range(120)]
    assert texts(ph.fuse_phrases(df, odd, literal_phrases=1)) == texts(ph.fuse_phrases(df, odd, literal_phrases=1000))


def test_many_patterns(spark):
    many = [(f"k{i}", rf"\bw{i}\b") for i in range(250)]
    df = pages(spark, "w3 w249 w3", "none")
    assert {(r["keyword"], r["n"]) for r in kw.count_keywords(df, many).collect()} == {("k3", 2), ("k249", 1)}
    assert kw.wide_matches(df, many).count() == 1


def test_fusion_order(spark):
    text = "the united state government and united states"
    for order, want in [
        (["united state", "state government"], "the united__state government and united states"),
        (["state government", "united state"], "the united state__government and united states"),
    ]:
        assert texts(ph.fuse_phrases(pages(spark, text), order)) == [want]
        assert texts(ph.fuse_phrases(pages(spark, text), order, literal_phrases=0)) == [want]
        assert texts(ph.fuse_phrases(pages(spark, text), order, literal_phrases=0, max_broadcast_rows=0)) == [want]


def test_fusion_of_odd_phrases(spark):
    df = pages(spark, "a 1 b c a b, b c; é à b", None, "")
    listed = ["a b", "1 b", "b c", "é à"]
    want = ["a 1__b c a__b, b__c; é__à b", None, ""]
    assert texts(ph.fuse_phrases(df, listed)) == want
    assert texts(ph.fuse_phrases(df, listed, literal_phrases=1)) == want


def test_candidates(spark):
    tokens = tx.words_and_marks(F.lit("The big Red dog, two dogs of old England 3 men walk"))
    got = one(spark, tx.candidate_phrases(tokens, ["the", "OF"]))
    assert got == ["big Red dog", "two dogs", "old England", "men walk"]


def test_phrase_report(spark):
    df = pages(spark, *["red dog. Red dog\tblue cat"] * 6)
    got = jobs.noun_phrase_report(df, more_than=5).collect()
    assert [tuple(r) for r in got] == [("red dog", 12), ("blue cat", 6)]


def test_clean_page(spark):
    df = pages(spark, "The cats_x saw well-known cities in 1850, 1799 and 2020.\tUSA won: a__b 2º done", None)
    lemmas = spark.createDataFrame([("cities", "city"), ("Saw", "see"), ("the", "the")], "form string, lemma string")
    got = texts(cl.preprocess_pages(df, ["the", "IN", "and"], [("$tate", "USA")], ["see well"], lemmas))
    # cats_x is one token; a__b is blacklisted; 2º too; see fuses with well
    assert got == ["cats_x see__well known city 1850 tate won done", ""]
    same = texts(cl.preprocess_pages(df, ["the", "IN", "and"], [("$tate", "USA")], ["see well"], lemmas, max_broadcast_rows=0))
    assert same == got


def test_tokens_and_years(spark):
    got = one(spark, tx.extract_tokens(F.lit("naïve-été x__y a___b 1799 1800 2019 2020 18001 abc1 'tis")))
    assert got == ["naïve-été", "x__y", "1800", "2019", "tis"]


def test_outlier_bounds(spark):
    df = pages(spark, "a a b c d", "a b c", "a b", "a", "", None)
    freq = {r["token"]: r["num_pages"] for r in tk.page_frequency(df.select(tx.whitespace_tokens(F.col("text")).alias("tokens"))).collect()}
    assert freq == {"a": 4, "b": 3, "c": 2, "d": 1}
    report = {r["token"] for r in jobs.outlier_report(df, 2, 3).collect()}
    assert report == {"a", "d"}
    want = ["b c", "b c", "b", "", "", ""]
    for literal, rows in [(2000, 10**6), (0, 10**6), (0, 0)]:
        assert texts(jobs.remove_outliers(df, 2, 3, literal_words=literal, max_broadcast_rows=rows)) == want
    for rows in (10**6, 0):
        assert texts(tk.remove_words(df, ["a", "d"], literal_words=0, max_broadcast_rows=rows)) == want


def test_pairtree_path(spark):
    path = lambda v: one(spark, ids.volume_path(F.lit(v)))
    assert path("lib.ark:/13960/t0ns1") == (
        "lib/pairtree_root/ar/k+/=1/39/60/=t/0n/s1/ark+=13960=t0ns1/ark+=13960=t0ns1.mets.xml")
    assert path("lib.a.b") == "lib/pairtree_root/a,/b/a,b/a,b.mets.xml"
    assert path("lib.a b?é") == "lib/pairtree_root/a^/20/b^/3f/^c/3^/a9/a^20b^3f^c3^a9/a^20b^3f^c3^a9.mets.xml"
    assert path("nodot") is None


def test_term_format(spark):
    got = one(spark, ax.format_terms(F.array(F.lit("a"), F.lit("b")), F.array(F.lit(0.1234), F.lit(0.0625))))
    assert got == ['0.123*"a"', '0.063*"b"']
    assert one(spark, ax.index_terms(F.array(F.lit(1), F.lit(0)), ["x", "y"])) == ["y", "x"]
    assert one(spark, ax.sum_weights(F.array(F.lit(0.25), F.lit(0.5)))) == pytest.approx(0.75)


def test_plans_stay_in_the_jvm(spark, small):
    import __spark_entry__ as se

    for name in ("page_matches", "noun_phrase_report", "clean_pages", "remove_outliers",
                 "topics_over_time", "topic_extremes", "volume_info", "coherence_cv"):
        plan = se.queries()[name](spark, small)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "CartesianProduct" not in plan, name


def test_fusion_routes_agree(spark):
    rnd = random.Random(11)
    words = ["a", "b", "c", "dé", "ée"]
    listed = list(dict.fromkeys(
        " ".join(rnd.choice(words) for _ in range(rnd.choice([2, 2, 3, 4, 6, 7]))) for _ in range(120)))
    docs = [
        "".join(rnd.choice(words) + rnd.choice([" ", " ", " ", " ", ", ", "\t", "-", "_"]) for _ in range(rnd.randint(0, 60)))
        for _ in range(40)
    ]
    want = texts(ph.fuse_phrases(pages(spark, *docs), listed, literal_phrases=1000))
    assert want != docs
    for rows in (10**6, 0):
        assert texts(ph.fuse_phrases(pages(spark, *docs), listed, literal_phrases=10, max_broadcast_rows=rows)) == want


@pytest.mark.parametrize("rows", [500_000, 0])
def test_whole_words_run_no_regex_each(spark, monkeypatch, rows):
    """Patterns that are whole words are counted as words, with the rows that their regexes give."""
    texts = ["Cat cat CAT concat cat_ cat-cat Kat", "écat caté cat2 Dog", None, "", "dog, dog", "dog, dog", "kat İcat"]
    pages = spark.createDataFrame([("v", 1 if t == "dog, dog" else i, t) for i, t in enumerate(texts)], "volid string, seq int, text string")
    edge = lambda w: f"{tx.EDGE_L}{w}{tx.EDGE_R}"
    patterns = [("any", "(?i)" + edge("cat")), ("exact", edge("Cat")), ("any", "(?i)" + edge("cat")),
                ("kat", "(?i)" + edge("kat")), ("dog", edge("dog")), ("part", "cat"), ("none", edge("zebra"))]

    def seen(df):
        return sorted(map(tuple, df.select("volid", "seq", "keyword", "n").collect()))

    want = seen(kw.count_keywords(pages, patterns))
    monkeypatch.setattr(kw, "BLOCK_PATTERNS", 2)
    assert want == seen(kw.count_keywords(pages, patterns, max_broadcast_rows=rows))
    words = [p for p in patterns if p[0] != "part"]
    got = kw.count_keywords(pages, words, max_broadcast_rows=rows)
    assert seen(got) == [r for r in want if r[2] != "part"]
    assert "regexp_count" not in got._jdf.queryExecution().toString().lower()
    assert got.dtypes == kw.count_keywords(pages, patterns[-2:-1]).dtypes


def test_tokens_are_grouped_where_their_page_lies(spark):
    """On the shuffled route pages travel, not each of their tokens, to be grouped."""
    df = spark.createDataFrame([("a", ["x", "Y", "x"]), ("b", None)], "note string, tokens array<string>")
    lemmas = spark.createDataFrame([("y", "z")], "form string, lemma string")
    found = tk.lemmatise(df, lemmas, max_broadcast_rows=0)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(_row#\d+L?, \d+\)", plan)
    assert not re.search(r"hashpartitioning\(_row#\d+L?, token", plan)
    assert sorted(map(tuple, found.collect())) == [("a", ["x", "z", "x"]), ("b", [])]
