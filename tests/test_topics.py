import math

import numpy as np
import pytest
from pyspark.ml.clustering import LDAModel
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from quirelens.functions import arrays as ax
from quirelens.operators import inspection as ins, topics as tp
from quirelens.plans import jobs
from quirelens.sources import readers, writers
from registry import modelling as M


@pytest.fixture(scope="module")
def fitted(spark, small, tmp_path_factory):
    pages = M.cleaned_pages(spark, small)
    out = str(tmp_path_factory.mktemp("model") / "m")
    return jobs.topic_model(pages, 4, M.excluded(spark, small), output=out, maxIter=5), pages, out


def test_score_equals_library(spark, small, fitted):
    model, pages, _ = fitted
    _, features = jobs.topic_features(pages, M.excluded(spark, small))
    assert model.log_likelihood == pytest.approx(model.model.logLikelihood(features), rel=1e-3)
    assert model.log_perplexity == pytest.approx(model.model.logPerplexity(features), rel=1e-3)


def test_weights_sum_to_one_or_zero(fitted):
    rows = fitted[0].result.select(ax.topic_array(F.col("topicDistribution")).alias("w")).collect()
    assert rows
    for r in rows:
        assert sum(r["w"]) == pytest.approx(1.0) or sum(r["w"]) == 0.0


def test_same_seed_same_topics(spark, small, fitted):
    model, pages, _ = fitted
    again = jobs.topic_model(pages.repartition(3), 4, M.excluded(spark, small), maxIter=5)

    def words(m):
        rows = ins.describe_topics(m.model, m.vocabulary.vocabulary, 5).collect()
        return [r["topic_terms"] for r in sorted(rows, key=lambda r: r["topic"])]

    assert words(model) == words(again)


def test_save_and_load(spark, fitted):
    model, _, out = fitted
    vocabulary, lda = readers.load_model(out)
    assert vocabulary.vocabulary == model.vocabulary.vocabulary
    assert lda.describeTopics(5).collect() == model.model.describeTopics(5).collect()
    result = readers.read_result(spark, f"{out}/result")
    assert {"htid", "seq", "topicDistribution"} == set(result.columns)
    assert result.count() == model.result.count()


def test_describe_by_literal_and_by_join(fitted):
    model = fitted[0]
    words = model.vocabulary.vocabulary
    assert len(words) <= 5_000
    literal = ins.describe_topics(model.model, words, 7)
    joined = ins.describe_topics(model.model, words + [f"pad{i}" for i in range(6_000)], 7)
    key = lambda r: r["topic"]
    assert sorted(literal.collect(), key=key) == sorted(joined.collect(), key=key)


def test_topic_tables(fitted):
    model = fitted[0]
    table = ins.topic_term_table(model.model)
    assert table.count() == 4 * model.model.vocabSize()
    sums = {r["topic"]: r["s"] for r in table.groupBy("topic").agg(F.sum("weight").alias("s")).collect()}
    assert all(s == pytest.approx(1.0) for s in sums.values())
    long = ins.page_topic_table(model.result)
    assert long.count() == 4 * model.result.count()


def test_sweep_round_trip(spark, small, fitted, tmp_path):
    _, features = jobs.topic_features(fitted[1])
    sweep = tp.sweep_k(features, (2, 3), seed=1, maxIter=2)
    writers.write_sweep(sweep, str(tmp_path / "k"))
    back = spark.read.csv(str(tmp_path / "k"), header=True)
    assert back.columns == ["k", "log_likelihood", "log_perplexity"]
    assert sorted(int(r["k"]) for r in back.collect()) == [2, 3]


def test_minibatch(fitted):
    _, features = jobs.topic_features(fitted[1])
    model = tp.fit_topics_minibatch(features, 3)
    assert tp.model_info(model)["topics"] == 3
    assert tp.score_topics(model, features)[0] < 0


def test_page_without_known_terms(spark):
    pages = spark.createDataFrame([("a", 1, "x y x"), ("a", 2, "x z"), ("a", 3, "")], "volid string, seq int, text string")
    vocabulary, features = jobs.topic_features(pages, min_pages=1)
    model = tp.fit_topics(features.where("seq < 3"), 2, maxIter=2)
    blind = tp.vectorise(vocabulary, spark.createDataFrame([("b", 1, ["q"])], "volid string, seq int, tokens array<string>"))
    got = tp.assign_topics(model, blind).select(ax.topic_array(F.col("topicDistribution")).alias("w")).first()["w"]
    assert got == [0.0, 0.0]


def test_vocabulary_with_any_character(spark):
    from quirelens.operators import topics as tp

    words = ["b\x00c", "dog", "\x00", "x|y"]
    model = tp.vocabulary_model(spark, words, "tokens")
    assert list(model.vocabulary) == words
    with pytest.raises(ValueError, match="no page has a term"):
        tp.vocabulary_model(spark, [], "tokens")


def test_empty_pages_are_not_modelled(spark):
    from quirelens.operators import topics as tp

    df = spark.createDataFrame([("a", 1, ""), ("a", 2, None), ("a", 3, "one two")], "volid string, seq int, text string")
    assert [r["seq"] for r in tp.tokenised(df).collect()] == [3]


def test_coherence_of_a_fitted_model(fitted):
    model = fitted[0]
    got = {r["topic"]: r["coherence"] for r in jobs.model_coherence(model, 20).collect()}
    assert set(got) == {0, 1, 2, 3} and all(-1 <= c <= 1 for c in got.values())
    terms = jobs.heaviest_terms(model, 20).collect()
    assert len(terms) == 80 and {t["term"] for t in terms} <= set(model.vocabulary.vocabulary)


def test_coherence_of_a_hundred_terms(spark):
    """Masks of two numbers: pair counts by hand over all windows."""
    import random

    from quirelens.operators import coherence as co

    rnd = random.Random(9)
    words = [f"w{i:03d}" for i in range(100)]
    docs = [[rnd.choice(words) for _ in range(rnd.choice([1, 40, 300]))] for _ in range(12)]
    size = 15
    want = {}
    for d in docs:
        for s in range(max(len(d) - size + 1, 1)):
            seen = set(d[s : s + size])
            for x in seen:
                for y in seen:
                    want[x, y] = want.get((x, y), 0) + 1
    df = spark.createDataFrame([("v", i, d) for i, d in enumerate(docs)], "volid string, seq int, tokens array<string>")
    topics = spark.createDataFrame([(0, w) for w in words] + [(1, "w000"), (1, "none")], "topic int, term string")
    bits = co.topic_term_bits(topics)
    masks = co.window_masks(df, bits, size)
    assert masks.select(F.max(F.size("mask"))).first()[0] == 2
    got = {(r["term_a"], r["term_b"]): r["windows"] for r in co.pair_counts(masks, bits).where("topic = 0").collect()}
    assert got == {(x, y): want.get((x, y), 0) for x in words for y in words}
    scores = {r["topic"]: r["coherence"] for r in co.coherence_cv(df, topics, size).collect()}
    assert set(scores) == {0, 1}


def test_topic_tables_of_a_job(spark, fitted):
    model = fitted[0]
    tables = jobs.topic_tables(model)
    terms = {(r["topic"], r["term_index"]): r["weight"] for r in tables["topic_terms"].collect()}
    for r in model.model.describeTopics(6).collect():
        for i, w in zip(r["termIndices"], r["termWeights"]):
            assert terms[r["topic"], i] == pytest.approx(w)
    words = {r["term_index"]: r["term"] for r in tables["vocabulary"].collect()}
    assert [words[i] for i in range(len(words))] == list(model.vocabulary.vocabulary)
    counts = {r["term"]: r["n"] for r in tables["frequency"].collect()}
    assert sum(counts.values()) == sum(r["doc_length"] for r in tables["lengths"].collect())
    saved = ins.saved_vocabulary(spark, f"{fitted[2]}/vocab")
    assert {r["term_index"]: r["term"] for r in saved.collect()} == words


def test_fits_side_by_side_score_alike(spark, fitted):
    _, features = jobs.topic_features(fitted[1])
    ks = (2, 3, 4, 6)
    alone = tp.sweep_k(features, ks, seed=5, side_by_side=1, maxIter=3).collect()
    together = tp.sweep_k(features, ks, seed=5, side_by_side=4, maxIter=3).collect()
    assert [r["k"] for r in together] == list(ks)
    for a, b in zip(alone, together):
        assert a["log_likelihood"] == pytest.approx(b["log_likelihood"], rel=1e-9)


def test_score_takes_no_vocabulary_per_page(spark, monkeypatch):
    """The library's bound without its way, which goes through all terms for every page."""
    pages = [{i % 7: 1.0 + i % 3, 7 + i % 5: 2.0, 12: 1.0} for i in range(40)]
    rows = [(Vectors.sparse(13, p),) for p in pages] + [(Vectors.dense([0.0, 3.0] + [1.0] * 11),), (Vectors.sparse(13, {}),)]
    features = spark.createDataFrame(rows, ["features"]).coalesce(1)
    models = [tp.fit_topics(features, 3, maxIter=4), tp.fit_topics(features, 2, maxIter=4, optimizer="em"),
              tp.fit_topics(features, 2, maxIter=4, topicConcentration=0.3, docConcentration=[0.2, 0.7])]
    wanted = [(m.logLikelihood(features), m.logPerplexity(features)) for m in models]

    def refuse(*_):
        raise AssertionError("a pass over pages x vocabulary x topics")

    monkeypatch.setattr(LDAModel, "logLikelihood", refuse)
    for entries in (tp.ENTRIES, 5):
        monkeypatch.setattr(tp, "ENTRIES", entries)
        for model, want in zip(models, wanted):
            assert tp.score_topics(model, features) == pytest.approx(want, rel=1e-3)


def test_gamma_functions():
    x = np.array([1e-4, 0.02, 0.1, 1.0, 1.4616321449683623, 2.0, 9.5, 300.0, 1e7])
    assert tp.lgamma(x) == pytest.approx([math.lgamma(v) for v in x], rel=1e-11, abs=1e-12)
    step = 1e-5
    slope = [(math.lgamma(v * (1 + step)) - math.lgamma(v * (1 - step))) / (2 * step * v) for v in x]
    assert tp.digamma(x) == pytest.approx(slope, rel=1e-6, abs=1e-6)


def plain_masks(pages, bits, size):
    """Window by window; a mask as the set of its bits."""
    out = {}
    for tokens in pages:
        for at in range(max(len(tokens or ()) - size + 1, 1)):
            window = set((tokens or [])[at : at + size])
            for topic in {t for t, _, _ in bits}:
                if mask := frozenset(b for t, term, b in bits if t == topic and term in window):
                    out[topic, mask] = out.get((topic, mask), 0) + 1
    return out


def bit_set(mask):
    from quirelens.operators.coherence import BITS

    return frozenset(b for b in range(BITS * len(mask)) if mask[b // BITS] >> b % BITS & 1)


@pytest.mark.parametrize("cut", [1, 50, 10_000])
def test_masks_of_page_slices(monkeypatch, cut):
    import pyarrow as pa

    from quirelens.operators import coherence as co

    rng = np.random.default_rng(cut)
    words = [f"w{i}" for i in range(90)]
    pages = [None, [], *([words[w] for w in rng.integers(0, 90, n)] for n in (1, 3, 7, 8, 40, 200)), [None, "w3"], []]
    bits = [("a", f"w{i}", i) for i in range(70)] + [("b", "w3", 0), ("b", "w80", 1), ("b", "none", 2)]
    term, topic = sorted({w for _, w, _ in bits}), ["a", "b"]
    rows = sorted(bits, key=lambda r: r[1])
    table = co.TermBits(
        pa.array(term), np.searchsorted([term.index(r[1]) for r in rows], np.arange(len(term) + 1)),
        np.array([topic.index(r[0]) for r in rows]), np.array([r[2] for r in rows]), pa.array(topic),
    )
    monkeypatch.setattr(co, "SLICE", cut)
    found, lists = {}, pa.array([["w3"], *pages], pa.list_(pa.string())).slice(1)
    for part in co.page_slices(lists):
        for r in co.mask_counts(part, table, 8).to_pylist():
            key = r["topic"], bit_set(r["mask"])
            found[key] = found.get(key, 0) + r["windows"]
    assert found == plain_masks(pages, bits, 8)


def test_masks_are_counted_where_pages_lie(spark):
    from quirelens.operators import coherence as co

    def counted(df):
        return {(r["topic"], bit_set(r["mask"])): r["windows"] for r in df.collect()}

    pages = [("v", 1, ["x", "y", "z", "x"]), ("v", 2, ["z", "z"]), ("w", 1, None), ("w", 2, []), (None, 3, ["y", "q", "x"])]
    kind = "volid string, seq int, tokens array<string>"
    listed = [("a", "x", 0), ("a", "y", 1), ("b", "x", 0), (None, "z", 0)]
    bits = spark.createDataFrame(listed, "topic string, term string, bit int")
    masks = co.window_masks(spark.createDataFrame(pages, kind), bits, 2)
    # no token is a row of its own, and no page is shuffled
    plan = masks._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Repartition" not in plan
    assert counted(masks) == plain_masks([p[2] for p in pages], listed, 2)
    # rows that share a key are one page, as they are by the join
    twice = [*pages, pages[0], ("v", 2, ["y", "z", "x"]), (None, 3, ["x"]), (None, None, ["y"]), (None, None, ["x", "x"])]
    df = spark.createDataFrame(twice, kind)
    assert counted(co.window_masks(df, bits, 2)) == counted(co._joined_masks(df, bits, 2, ["volid", "seq"]).groupBy("topic", "mask").agg(F.sum("windows").alias("windows")))


def test_vectors_alone_are_held(spark, small, monkeypatch):
    seen = []
    real = tp.held
    monkeypatch.setattr(tp, "held", lambda f: seen.append(f.columns) or real(f))
    jobs.topic_model(M.cleaned_pages(spark, small), 2, maxIter=1)
    assert seen == [["features"]]


def sparse_pages(spark, n):
    """Pages of two sorts, without a common word."""
    rows = [("v", i, Vectors.sparse(40, {20 * (i % 2) + (i * j) % 20: 1.0 + j for j in range(1, 6)})) for i in range(n)]
    return spark.createDataFrame(rows, ["volid", "seq", "features"]).coalesce(2)


def test_minibatch_reads_a_chunk_per_update(spark, monkeypatch):
    """Each page is in one chunk, and no update samples all of them."""
    features = sparse_pages(spark, 90)
    parts = tp.dealt_chunks(features.select("features"), 4, 23)
    assert sum(n for _, n in parts) == 90 and [p.count() for p, _ in parts] == [n for _, n in parts]
    together = parts[0][0].unionByName(parts[1][0]).unionByName(parts[2][0]).unionByName(parts[3][0])
    assert sorted(map(str, together.collect())) == sorted(map(str, features.select("features").collect()))

    def refuse(*_, **__):
        raise AssertionError("an update that scans all pages")

    monkeypatch.setattr(tp, "fit_topics", refuse)
    models = [tp.fit_topics_minibatch(features, 2, chunk=25, passes=5) for _ in range(2)]
    assert models[0].describeTopics(3).collect() == models[1].describeTopics(3).collect()
    assert models[0].getK() == 2 and models[0].vocabSize() == 40 and models[0].getMaxIter() == 20
    # words of one sort of pages make a topic
    heavy = [{i // 20 for i in r["termIndices"]} for r in models[0].describeTopics(8).collect()]
    assert sorted(heavy, key=str) == [{0}, {1}]
    assert tp.score_topics(models[0], features) == pytest.approx(
        (models[0].logLikelihood(features), models[0].logPerplexity(features)), rel=1e-3)


def test_fits_wait_for_room_on_the_driver(spark, monkeypatch):
    import threading
    import time

    features, lock, running, most, kept = sparse_pages(spark, 30), threading.Lock(), [0], [0], []
    real_fit, real_held = tp.fit_topics, tp.held

    def fit(*args, **options):
        with lock:
            running[0] += 1
            most[0] = max(most[0], running[0])
        try:
            time.sleep(0.3)
            return real_fit(*args, **options)
        finally:
            with lock:
                running[0] -= 1

    monkeypatch.setattr(tp, "fit_topics", fit)
    monkeypatch.setattr(tp, "held", lambda f: kept.append(f.columns) or real_held(f))
    monkeypatch.setattr(tp, "fit_room", lambda _: 5 * tp.FIT_MATRICES * 8 * 40)
    assert [r["k"] for r in tp.sweep_k(features, (3, 4, 6), seed=1, maxIter=1).collect()] == [3, 4, 6]
    assert most[0] == 1 and kept == [["features"]]
    monkeypatch.setattr(tp, "fit_room", lambda _: 13 * tp.FIT_MATRICES * 8 * 40)
    tp.sweep_k(features, (3, 4, 6), seed=1, maxIter=1)
    assert most[0] > 1


def test_topic_bound_takes_some_terms_at_a_time(monkeypatch):
    topics = np.random.default_rng(3).gamma(2.0, 1.0, (50, 4))
    whole = tp.topic_bound(topics, 0.25)
    monkeypatch.setattr(tp, "ENTRIES", 12)
    assert tp.topic_bound(topics, 0.25) == pytest.approx(whole, rel=1e-12)


def test_pages_of_a_model_are_not_shuffled(spark, small, tmp_path):
    """Neither to exclude some of them nor for the result, and no table but the tokens stays."""
    from quirelens.operators import joins, scale

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pages = spark.createDataFrame([("a", i, f"x y w{i % 3}") for i in range(20)] + [(None, 1, "x")], "volid string, seq int, text string")
        out = spark.createDataFrame([("a", 1), ("a", 1), (None, 1)], "volid string, seq int")
        rest = joins.exclude_pages(pages, out)
        assert "SortMergeJoin" not in rest._jdf.queryExecution().executedPlan().toString()
        assert rest.count() == 20
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    clean = scale.stage(pages)
    assert clean.inputFiles()
    folder = clean.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file:")
    model = jobs.topic_model(jobs.remove_outliers(clean, 2, 10**9, in_place=True), 2, out, maxIter=2, scratch=[clean])
    plan = model.result._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" not in plan and "Sort" not in plan
    assert model.result.count() == 20
    import os

    assert not os.path.exists(folder)


def test_only_kept_words_are_written(spark, monkeypatch):
    written = []
    real = jobs.stage
    monkeypatch.setattr(jobs, "stage", lambda df: written.append(df) or real(df))
    monkeypatch.setattr(jobs, "durable", lambda df: (_ for _ in ()).throw(AssertionError("all words")))
    pages = spark.createDataFrame([(1, "a b rare"), (2, " a  b"), (3, None)], "seq int, text string")
    left = jobs.remove_outliers(pages, 2, 10**9, in_place=True)
    assert {r["seq"]: r["text"] for r in left.collect()} == {1: "a b", 2: "a b", 3: ""}
    assert [sorted(r["token"] for r in df.collect()) for df in written] == [["a", "b"]]
