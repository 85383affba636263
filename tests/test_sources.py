import os

from pyspark.sql import functions as F

from quirelens.sources import readers, writers

PAGES = [
    ("v.1", "1", 'plain, "quoted" \\ back'),
    ("v.1", "2", "\tleading tab and blanks  "),
    ("v.2", "1", "a\tb\tc"),
    ("v.3", "x", "ünï"),
]


def write(path, text):
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return str(path)


def test_stage_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame(PAGES, "volid string, seq string, text string")
    out = str(tmp_path / "stage")
    writers.write_csv(df.select("text", "volid", "seq"), out)
    assert {tuple(r) for r in readers.read_stage_csv(spark, out).collect()} == set(PAGES)
    got = readers.read_pages(spark, out, "csv", ids=spark.createDataFrame([("v.1",), ("v.9",)], "volid string"))
    assert {tuple(r) for r in got.collect()} == {p for p in PAGES if p[0] == "v.1"}


def test_empty_text_needs_parquet(spark, tmp_path):
    df = spark.createDataFrame([("v", "1", ""), ("v", "2", None)], "volid string, seq string, text string")
    writers.write_csv(df.select("text", "volid", "seq"), str(tmp_path / "c"))
    writers.write_stage(df, str(tmp_path / "p"))
    csv = {r["seq"]: r["text"] for r in readers.read_stage_csv(spark, str(tmp_path / "c")).collect()}
    parquet = {r["seq"]: r["text"] for r in readers.read_pages(spark, str(tmp_path / "p")).collect()}
    assert csv == {"1": None, "2": None}
    assert parquet == {"1": "", "2": None}


def test_multiline_csv(spark, tmp_path):
    df = spark.createDataFrame([("two\nlines", "v", "1")], "text string, volid string, seq string")
    writers.write_csv(df, str(tmp_path / "m"))
    assert readers.read_stage_csv(spark, str(tmp_path / "m"), multiline=True).first()["text"] == "two\nlines"


def test_text_files(spark, tmp_path):
    for vol, seq, text in [("a.b", "00000001", "one\ntwo"), ("a.b", "00000002", ""), ("c.d e", "1", "x")]:
        os.makedirs(tmp_path / vol, exist_ok=True)
        write(tmp_path / vol / f"{seq}.txt", text)
    index = spark.createDataFrame([("a.b", "00000001"), ("a.b", "00000002"), ("c.d e", "1")], "volid string, seq string")
    got = {tuple(r) for r in readers.read_pages(spark, str(tmp_path), "text", index=index).collect()}
    assert got == {("a.b", "00000001", "one\ntwo"), ("a.b", "00000002", ""), ("c.d e", "1", "x")}


def test_patterns(spark, tmp_path):
    path = write(tmp_path / "p.tsv", "one\t(?i)\\bone\\b\nbad line\ntwo\tt\\s?wo\nx\ty\tz\n")
    good, bad = readers.read_patterns(spark, path)
    assert [tuple(r) for r in good.orderBy("line").collect()] == [(0, "one", "(?i)\\bone\\b"), (2, "two", "t\\s?wo")]
    assert [tuple(r) for r in bad.orderBy("line").collect()] == [(1, "bad line"), (3, "x\ty\tz")]


def test_word_lists(spark, tmp_path):
    words = write(tmp_path / "w.csv", "the\nof,12\n")
    assert {r["word"] for r in readers.read_word_list(spark, words).collect()} == {"the", "of"}
    phrases = write(tmp_path / "n.csv", "b c,20\na b,30\nx y,20\n")
    got = readers.read_phrase_list(spark, phrases).orderBy("rank").collect()
    assert [r["phrase"] for r in got] == ["a b", "b c", "x y"]
    listed = write(tmp_path / "e.csv", "v.1,3\nv.2,00000004\n")
    assert {tuple(r) for r in readers.read_exclusions(spark, listed).collect()} == {("v.1", "3"), ("v.2", "00000004")}
    ids = write(tmp_path / "i.txt", "v.1\n\nv.2\n")
    got = readers.read_ids(spark, ids, 3)
    assert got.rdd.getNumPartitions() == 3
    assert {r["volid"] for r in got.collect()} == {"v.1", "v.2"}


def test_catalogue(spark, tmp_path):
    head = "htid\tother\ttitle\tauthor\trights_date_used\taccess\trights\n"
    rows = "a.1\tx\tT\tA\t1999\tallow\tpd\na.2\tx\tT2\tB\tn.d.\tdeny\tic\na.3\tx\tT3\tC\t9999\tdeny\tic\n"
    path = write(tmp_path / "cat.tsv", head + rows)
    raw = {r["htid"]: r["rights_date_used"] for r in readers.read_catalogue(spark, path).collect()}
    typed = {r["htid"]: r["rights_date_used"] for r in readers.read_catalogue(spark, path, typed=True).collect()}
    assert raw == {"a.1": "1999", "a.2": "n.d.", "a.3": "9999"}
    assert typed == {"a.1": 1999, "a.2": None, "a.3": 9999}


def test_result_names(spark, tmp_path):
    spark.createDataFrame([("v", "1", ["t"], 0.5)], "_c1 string, _c2 string, tokens array<string>, w double").write.parquet(str(tmp_path / "r"))
    assert readers.read_result(spark, str(tmp_path / "r")).columns == ["htid", "seq", "w"]


def test_header_and_quarantine(spark, tmp_path):
    df = spark.createDataFrame([(1, 2)], "id int, last_seq int")
    writers.write_header(df, str(tmp_path / "h"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "h")).collect()] == ["id,last_seq"]
    assert writers.write_quarantine(df, str(tmp_path / "q"))
    assert not writers.write_quarantine(df.where("id > 1"), str(tmp_path / "q2"))
    assert not os.path.exists(tmp_path / "q2")


def test_per_topic_files(spark, tmp_path):
    rows = [(t, s, r, f"v{r}") for t in range(3) for s in ("top", "bottom") for r in (1, 2)]
    df = spark.createDataFrame(rows, "topic int, slice string, rank int, htid string")
    writers.write_per_topic(df, str(tmp_path / "t"))
    assert sorted(d for d in os.listdir(tmp_path / "t") if d.startswith("topic=")) == [f"topic={t}" for t in range(3)]
    back = spark.read.csv(str(tmp_path / "t"), header=True)
    assert back.count() == len(rows)


def test_mets_files(spark, tmp_path):
    from quirelens.plans import jobs

    base = tmp_path / "lib" / "pairtree_root" / "a+" / "b" / "a+b"
    os.makedirs(base)
    write(base / "a+b.mets.xml",
          '<METS:mets xmlns:METS="http://www.loc.gov/METS/"><METS:fileSec><METS:fileGrp USE="ocr">'
          '<METS:file MIMETYPE="text/plain" SEQ="00000007"/></METS:fileGrp></METS:fileSec></METS:mets>')
    ids = spark.createDataFrame([("lib.a:b",), ("lib.missing",), ("nodot",)], "volid string")
    got = jobs.volume_info(ids, readers.read_mets(spark, str(tmp_path)))
    assert [tuple(r) for r in got.collect()] == [("lib.a:b", 7)]
    assert got.select(F.col("last_seq")).schema["last_seq"].dataType.simpleString() == "int"
