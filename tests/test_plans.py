"""What a plan must look like to hold at scale: one shuffle of text, pruned scans, even tasks."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from quirelens.functions.ids import volume_path
from quirelens.functions.literals import required_literals
from quirelens.operators import keywords as kw, overtime, phrases as ph, scale, tokens as tk, topics as tp
from quirelens.plans import jobs
from quirelens.sources import readers, writers
from registry import inputs


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges_with(df, column):
    """Shuffles of the plan whose rows hold a column of the given name."""
    found = []

    def walk(node):
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(node.inputPlan())
        if name == "Exchange" and re.search(rf"\b{column}#", node.output().mkString(" ")):
            found.append(node)
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return len(found)


def test_page_matches_shuffles_text_once(spark):
    df = spark.createDataFrame([("a", i, f"Head\nthe page {i}. More {chr(97 + i)}") for i in range(9)], "volid string, seq int, text string")
    matched = jobs.page_matches(df, [("x", "the")])
    assert exchanges_with(matched, "text") == 1
    # the sorted pages serve both windows and the joining of pages
    assert plan(matched).count("Sort [volid") == 1
    assert matched.count() == 8  # the last page hands its only match to the one before


def token_pages(spark, n):
    return spark.createDataFrame([("a", 1, " ".join(f"w{i}" for i in range(n)))], "volid string, seq int, text string")


@pytest.mark.parametrize("by_kept", [True, False])
def test_words_are_removed_where_pages_lie(spark, by_kept):
    """No token is a row of its own and no page is shuffled, where a list can be broadcast."""
    pages = spark.createDataFrame(
        [("a", 1, " x  one\ttwo\n", "k1"), ("a", 1, "\x0bone\x0c\r", "k2"), (None, None, None, "k3"), ("b", 2, "", "k4"), ("b", 3, "\u00a0x y", "k5")],
        "volid string, seq int, text string, note string")
    drop = spark.createDataFrame([("x",), ("two",), (None,), ("x",)], "w string")
    kept = spark.createDataFrame([("one",), ("y",), ("\u00a0x",), (None,)], "token string") if by_kept else None
    left = tk.remove_words(pages, drop, kept=kept, literal_words=0, in_place=True)
    text = plan(left)
    assert "Generate" not in text and "Exchange" not in text
    assert left.columns == pages.columns
    assert {r["note"]: r["text"] for r in left.collect()} == {"k1": "one", "k2": "one", "k3": "", "k4": "", "k5": "\u00a0x y"}
    routes = [tk.remove_words(pages, drop, kept=kept, literal_words=0, max_broadcast_rows=n) for n in (500_000, 0)]
    assert all(sorted(left.collect(), key=str) == sorted(r.collect(), key=str) for r in routes)


def test_texts_of_a_slice_are_filtered():
    import pyarrow as pa

    texts = pa.array(["gone", "b a", None, "", "  a  c ", "a"], pa.string()).slice(1, 4)
    words = pa.array(["a"], pa.large_string())
    assert tk.filtered_texts(texts, words, True).to_pylist() == ["a", "", "", "a"]
    assert tk.filtered_texts(texts, words, False).to_pylist() == ["b", "", "", "c"]
    assert tk.filtered_texts(texts.slice(0, 0), words, True).to_pylist() == []


def test_a_page_of_many_words_takes_linear_time(spark):
    def seconds(n):
        listed = spark.range(0, n, 2).select(F.concat(F.lit("w"), F.col("id").cast("string")).alias("w"))
        lemmas = listed.select(F.col("w").alias("form"), F.concat(F.lit("l"), "w").alias("lemma"))
        pages = token_pages(spark, n)
        start = time.perf_counter()
        left = tk.remove_words(pages, listed, literal_words=0).first()["text"]
        split = pages.select("volid", F.split("text", " ").alias("tokens"))
        lemma = tk.lemmatise(split, lemmas).first()["tokens"]
        took = time.perf_counter() - start
        assert left.split(" ") == [f"w{i}" for i in range(n) if i % 2]
        assert lemma == [f"lw{i}" if i % 2 == 0 else f"w{i}" for i in range(n)]
        return took

    seconds(1000)
    small = min(seconds(20_000) for _ in range(2))
    assert seconds(80_000) < 5 * small + 1


def test_look_ups_after_a_deal_do_not_shuffle_again(spark):
    pages = spark.createDataFrame([("a", i, f"the Big dogs {i}") for i in range(5)], "volid string, seq int, text string")
    lemmas = spark.createDataFrame([("dogs", "dog")], "form string, lemma string")
    stops = spark.createDataFrame([(f"s{i}",) for i in range(3000)] + [("the",)], "w string")
    clean = jobs.clean_pages(pages, stops, lemmas=lemmas)
    assert plan(clean).count("Exchange hashpartitioning(_row") == 1
    assert {r["text"] for r in clean.collect()} == {"big dog"}


def test_row_numbers_after_a_shuffle_follow_the_rows(spark):
    pages = spark.createDataFrame([("a", i, f"x{i}") for i in range(20)], "volid string, seq int, text string")
    assert "Sort" not in plan(scale.row_ids(pages))
    numbered = scale.row_ids(pages.repartition(3))
    assert "Sort [xxhash64" in plan(numbered) and scale.row_ids(numbered) is numbered
    # rows that reach a task in another order get the same numbers
    again = scale.row_ids(pages.orderBy(F.desc("seq")).repartition(3, "seq"))
    other = scale.row_ids(pages.orderBy("text").repartition(3, "seq"))
    assert sorted(again.collect()) == sorted(other.collect())


LITERALS = {
    r"(?i)\bth(e|at)\b": None, r"\bword\b": ["word"], "abc|defg": ["abc", "defg"], "abc|x": None,
    "abcd?e": ["abc"], "(abc)?def": ["def"], "ab+cde": ["bcde"], r"foo\.bar": ["foo"], "[abc]def": ["def"],
    "(?:abc|def)ghij": ["ghij"], "(?<=abc)def": ["def"], "(?x) abc": None, r"\Qabc\E": None, "abc{0,2}": None,
    r"(?<![\p{L}_])Word(?!\p{L})": ["word"], "a.*b": None, r"\d+ years?": ["year"], "abc(?=defgh)": ["abc"],
}


@pytest.mark.parametrize("pattern", LITERALS)
def test_required_letters(pattern):
    assert required_literals(pattern) == LITERALS[pattern]


def test_required_letters_are_in_every_match():
    rnd = random.Random(2)

    def make(depth):
        kind = rnd.random()
        if depth == 0 or kind < 0.5:
            return "".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 4))) + rnd.choice(["", "", "?", "*", "+", "{2}"])
        if kind < 0.75:
            return f"({make(depth - 1)}|{make(depth - 1)}){rnd.choice(['', '', '?', '+'])}"
        return make(depth - 1) + rnd.choice(["", ".", r"\b", "[ab]", "(?=a)"]) + make(depth - 1)

    keyed = 0
    for _ in range(3000):
        pattern = make(3)
        found = required_literals(pattern)
        text = "".join(rnd.choice("abcd ") for _ in range(60))
        for m in re.finditer(pattern, text):
            if found is not None:
                keyed += 1
                assert any(run in m.group() for run in found), (pattern, found, m.group())
    assert keyed > 100


def test_ten_thousand_patterns_by_brute_force(spark, small):
    words = [r["w"] for r in inputs.documents(spark, small).select(
        F.explode(F.regexp_extract_all("text", F.lit("[a-z]{4,}"), F.lit(0))).alias("w")).distinct().orderBy("w").limit(9_990).collect()]
    odd = [("short", r"\bof\b"), ("either", "(?:thon|tion)s?"), ("mark", r"\."), ("gone", "zzzzqq")]
    listed = [(w, rf"(?<![a-z]){w}(?![a-z])") for w in words] + odd
    pages = inputs.documents(spark, small).where("seq % 4 = 0")
    got = {(r["seq"], r["keyword"]): r["n"] for r in kw.count_keywords(pages, listed, ("seq",)).collect()}
    want, known = {}, set(words)
    for r in pages.collect():
        for run in re.findall("[a-z]+", r["text"]):
            if run in known:
                want[r["seq"], run] = want.get((r["seq"], run), 0) + 1
        for name, pattern in odd:
            n = len(re.findall(pattern, r["text"]))
            if n:
                want[r["seq"], name] = n
    assert len(words) > 5_000 and got == want
    wide = kw.wide_matches(pages, listed[:700])
    some = {(r["seq"], n): r[n] for r in wide.collect() for n, _ in listed[:700] if r[n]}
    assert some == {k: n for k, n in want.items() if k[1] in set(words[:700])}


def test_phrases_without_letters(spark):
    listed = [f"{i} {i + 1}" for i in range(150)] + ["_ _", "$ %", "a $"]
    docs = ["12 13 and 14 15", "112 13", "x$ %y", "a $b", "_ _ 3 4", "140 141 142"]
    df = spark.createDataFrame([("v", i, t) for i, t in enumerate(docs)], "volid string, seq int, text string")
    want = [r["text"] for r in ph.fuse_phrases(df, listed, literal_phrases=1000).orderBy("seq").collect()]
    assert want[0] == "12__13 and 14__15" and want[1] == "112 13"
    for rows in (10**6, 0):
        got = ph.fuse_phrases(df, listed, literal_phrases=10, max_broadcast_rows=rows).orderBy("seq")
        assert [r["text"] for r in got.collect()] == want


def test_vocabulary_is_cut_by_a_histogram(spark):
    rnd = random.Random(4)
    counts = [(f"t{i:04d}", rnd.choice([1, 1, 1, 2, 3, 9])) for i in range(900)]
    rnd.shuffle(counts)
    df = spark.createDataFrame(counts, "term string, n long").repartition(6)
    for size in (1, 10, 150, 151, 480, 899, 900, 2000):
        want = sorted(counts, key=lambda r: (-r[1], r[0]))[:size]
        assert {tuple(r) for r in tp.most_frequent(df, size).collect()} == set(want)
    assert tp.most_frequent(df.limit(0), 5).count() == 0
    assert "Window" not in plan(tp.most_frequent(df, 150))


def test_both_ends_from_one_scan(spark, tmp_path):
    rows = [(f"v{i % 50}", i, [i * 7919 % 6007 / 6007, (i * 31 % 97) / 97]) for i in range(6000)]
    spark.createDataFrame(rows, "htid string, seq int, weights array<double>").write.parquet(str(tmp_path / "p"))
    pages = spark.read.parquet(str(tmp_path / "p"))
    catalogue = spark.createDataFrame(
        [(f"v{i}", "T", "A", "1999", "a", "r") for i in range(49)],
        "htid string, title string, author string, rights_date_used string, access string, rights string")
    seen = []
    real = overtime.durable
    overtime.durable = lambda df: seen.append(df) or real(df)
    try:
        got = overtime.representative_pages(pages, catalogue, top=5000, bottom=700).collect()
    finally:
        overtime.durable = real
    assert plan(seen[0]).split("Initial Plan")[0].count("FileScan parquet") == 1
    for topic in (0, 1):
        for name, n, sign in (("top", 5000, -1), ("bottom", 700, 1)):
            want = sorted(((sign * w[topic], v, s) for v, s, w in rows))[:n]
            mine = sorted((r["rank"], r["htid"], r["seq"]) for r in got if r["topic"] == topic and r["slice"] == name)
            assert mine == [(i + 1, v, s) for i, (_, v, s) in enumerate(want)]
    assert all((r["title"] is None) == (r["htid"] == "v49") for r in got)


def test_split_by_measured_counts_is_even(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        n = 40_000
        rows = spark.range(n).select(
            F.when(F.col("id") < n * 9 // 10, "hot").otherwise(F.concat(F.lit("k"), F.col("id").cast("string"))).alias("k"), "id")
        table = rows.select("k").distinct().withColumn("v", F.lit(1))
        joined = scale.lookup_join(rows, table, "k", "inner", ["id"], 0)
        sizes = sorted(r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect())
        assert sum(sizes) == n and sizes[-1] <= 2 * sizes[len(sizes) // 2]
        factors = {r["k"]: r["_parts"] for r in scale.split_factors(rows, "k").collect()}
        assert set(factors) == {"hot"} and factors["hot"] > 16
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_page_store_prunes_by_volume(spark, tmp_path):
    rows = [(f"v{i % 40}", i, f"text {i}") for i in range(400)]
    pages = spark.createDataFrame(rows, "volid string, seq int, text string")
    writers.write_pages(pages, str(tmp_path / "s"), buckets=32)
    ids = spark.createDataFrame([("v3",), ("v17",), ("gone",), (None,)], "volid string")
    found = readers.read_pages(spark, str(tmp_path / "s"), "store", ids)
    assert {tuple(r) for r in found.collect()} == {r for r in rows if r[0] in ("v3", "v17")}
    assert re.search(r"PartitionFilters: \[[^\]]*bucket_of_32", plan(found))
    everything = readers.read_pages(spark, str(tmp_path / "s"), "store")
    assert everything.count() == 400


def metadata(levels, seq):
    body = f'<m:fileGrp USE="ocr"><m:file MIMETYPE="text/plain" SEQ="{seq}"/></m:fileGrp>'
    for i in range(levels - 1):
        body = f'<m:fileGrp USE="g{i}">{body}<m:fileGrp USE="empty"/></m:fileGrp>'
    return f'<m:mets xmlns:m="urn:m"><m:fileSec>{body}</m:fileSec></m:mets>'


def test_only_listed_metadata_is_opened(spark, tmp_path):
    ids = spark.createDataFrame([(f"lib.a{i}",) for i in range(30)], "volid string")
    for i, r in enumerate(ids.select("volid", volume_path(F.col("volid")).alias("p")).collect()):
        path = tmp_path / "tree" / r["p"]
        path.parent.mkdir(parents=True)
        path.write_text(metadata(1 + i % 11, 100 + i))
    wanted = spark.createDataFrame([("lib.a2",), ("lib.a8",), ("lib.a9",), ("lib.gone",), ("bad",)], "volid string")
    root = str(tmp_path / "tree")
    files = readers.read_mets(spark, root, wanted, batch=2)
    got = {tuple(r) for r in jobs.volume_info(wanted, files).collect()}
    assert got == {("lib.a2", 102), ("lib.a8", 108), ("lib.a9", 109)}  # three, nine and ten levels
    assert files.count() == 3
    whole = jobs.volume_info(wanted, readers.read_mets(spark, root))
    assert {tuple(r) for r in whole.collect()} == got

    def opened(df):
        df.collect()
        node = df._jdf.queryExecution().executedPlan()
        total, todo = 0, [node]
        while todo:
            node = todo.pop()
            if node.nodeName() == "AdaptiveSparkPlan":
                todo.append(node.executedPlan())
            if node.metrics().contains("numFiles"):
                total += node.metrics().apply("numFiles").value()
            todo += [node.children().apply(i) for i in range(node.children().size())]
        return total

    assert opened(files) == 3 and opened(readers.read_mets(spark, root)) == 30


def test_a_short_lemma_table_is_no_join(spark):
    pages = spark.createDataFrame([(1, ["Dogs", "run", None]), (2, None)], "k int, tokens array<string>")
    lemmas = spark.createDataFrame([("dogs", "Dog"), ("Run", None), (None, "x")], "form string, lemma string")
    found = tk.lemmatise(pages, lemmas)
    assert "Join" not in plan(found)
    assert dict(found.collect()) == {1: ["dog", "run"], 2: []}


def test_key_filter_holds_for_every_key_and_few_others(spark):
    table = spark.range(0, 1000).select(F.concat(F.lit("k"), "id").alias("form")).union(spark.sql("select null"))
    test = scale.key_filter(table)
    values = spark.range(0, 11_000).select("id", F.concat(F.lit("k"), "id").alias("form"))
    passed = {r["id"] for r in values.where(test(F.col("form"))).collect()}
    assert set(range(1000)) <= passed and len(passed) < 2000


@pytest.mark.parametrize("most", [500_000, 0])
def test_look_ups_keep_the_tokens_that_stay_in_their_page(spark, most):
    words = [f"w{i}" for i in range(400)]
    pages = spark.createDataFrame(
        [(1, [*words, "Hit", "hit", "w1", None, "hit"]), (2, None), (2, []), (None, ["hit", "other"])],
        "k int, tokens array<string>",
    )
    listed = spark.createDataFrame([("hit",), ("w1",), (None,)], "w string")

    def counted(keep, mark):
        found = tk.mark_words(pages, listed, mark=mark, keep_listed=keep, max_broadcast_rows=most)
        return sorted(((r["k"] or 0, r["tokens"]) for r in found.collect()))

    rest = [w for w in words if w != "w1"]
    assert counted(False, None) == [(0, ["other"]), (1, [*rest, "Hit"]), (2, []), (2, [])]
    assert counted(True, None) == [(0, ["hit"]), (1, ["w1", "hit", "w1", "hit"]), (2, []), (2, [])]
    marked = ["-" if w == "w1" else w for w in words] + ["Hit", "-", "-", "-"]
    assert counted(False, "-") == [(0, ["-", "other"]), (1, marked), (2, []), (2, [])]
    lemmas = spark.createDataFrame([("hit", "Stroke"), ("w1", None)], "form string, lemma string")
    found = tk.lemmatise(pages, lemmas, max_broadcast_rows=most).where("k = 1").first()["tokens"]
    assert found == [*words, "stroke", "stroke", "w1", "stroke"]


def test_words_of_ngrams_are_runs_of_letters(spark):
    row = spark.createDataFrame([("ab cd  ef gh ij-kl mn é",)], "text string").select(ph._ngrams([2, 3]).alias("n")).first()
    assert row["n"] == ["ab cd", "ef gh", "gh ij", "kl mn", "mn é", "ef gh ij", "kl mn é"]
