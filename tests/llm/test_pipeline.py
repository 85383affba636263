"""Each stage of the pipeline against brute force on its own input."""

import re

import corpus_pipeline as cp
from quirelens.llm.lines import MIN_CHARS
from quirelens.llm.rows import written
from tests.llm.test_lines import brute as brute_lines
from tests.llm.test_minhash import brute as brute_groups


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def run(spark, docs, sf):
    """The input and the rows of each stage."""
    seen = [docs]
    for _, stage in cp.STAGES:
        seen.append(written(stage(spark, seen[-1], sf)))
    return seen


def check(spark, docs, sf):
    columns = docs.columns
    raw, known, lines, groups, clean, coded = run(spark, docs, sf)
    assert all(x.columns == columns for x in (known, lines, groups, clean))
    texts = lambda df: {r.doc_id: r.text for r in df.collect()}
    a, b, c, d, e = map(texts, (raw, known, lines, groups, clean))
    # language: nothing with a fair amount of letters goes, nothing without a letter stays
    for i, t in a.items():
        letters = sum(x.isalpha() for x in t or "")
        assert not (letters == 0 and i in b) and not (letters > 100 and i not in b), i
        assert i not in b or b[i] == t
    ids = sorted(b)
    kept = dict(zip(ids, brute_lines([b[i] for i in ids], MIN_CHARS)))
    assert c == {i: k for i, k in kept.items() if k == b[i] or k}
    assert all(r.n_chars == len(r.text) for r in lines.collect())
    assert d == {i: c[i] for i, (_, first) in brute_groups(c).items() if i == first}
    items = [s for s in (shingles(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()) if s]
    leaks = {i for i, t in d.items() if any(len(shingles(t) & s) >= 0.75 * len(s) for s in items)}
    assert e == {i: t for i, t in d.items() if i not in leaks}
    rows = coded.collect()
    assert {r.doc_id: r.text for r in rows} == e
    assert all(r.decoded_ok and r.n_tokens == len(r.ids) for r in rows)
    return e


def test_stages(spark, small):
    assert check(spark, spark.read.parquet(f"{small}/documents.parquet"), small)


def test_odd_tables(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(20)
    odd = spark.createDataFrame(
        [(None, "the words of and in on", None, None, None), (1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0)],
        docs.schema,
    )
    for df in (docs.union(odd), docs.limit(0)):
        for x in run(spark, df, small):
            assert set(docs.columns) <= set(x.columns)
            x.count()


def test_python_stages_get_small_batches(spark, small):
    """And a session that asks for smaller ones keeps them."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    docs, was = spark.read.parquet(f"{small}/documents.parquet").limit(20), spark.conf.get(setting)
    try:
        for stage in (cp.language_id, cp.encoding):
            for own, want in (("10000", cp.BATCH_ROWS), ("0", cp.BATCH_ROWS), ("7", 7)):
                spark.conf.set(setting, own)
                stage(spark, docs, small)
                assert int(spark.conf.get(setting)) == want
    finally:
        spark.conf.set(setting, was)
