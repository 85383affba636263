"""Toxicity network, language-model scores and nearest vectors."""

import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quirelens.llm import hnsw, lm, toxicity
from quirelens.llm.queries import op1_nearest_vectors, op2_toxicity, op4_lm_score


def test_gradients_are_right():
    rng = np.random.default_rng(0)
    net = toxicity.Network.start(np.arange(5, dtype=np.uint64))
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x = rng.normal(size=(6, toxicity.WORD + toxicity.CHAR))
    index = rng.integers(-1, 6, (4, 5))
    index[:, 0] = 2
    index.sort(1)
    index = index[:, ::-1].copy()
    error = rng.normal(size=4)
    _, rest = net.forward(x, index, keep=True)
    grad, dx = net.backward(x, index, rest, error)

    def loss():
        return float(error @ net.forward(x, index))

    for name in ("wxf", "whb", "bf", "attend", "out", "bias"):
        at = tuple(0 for _ in net.p[name].shape)
        was = net.p[name][at]
        net.p[name][at] = was + 1e-3
        up = loss()
        net.p[name][at] = was - 1e-3
        down = loss()
        net.p[name][at] = was
        assert math.isclose((up - down) / 2e-3, grad[name][at], rel_tol=0.05, abs_tol=1e-3), name
    x[2, 3] += 1e-3
    up = loss()
    x[2, 3] -= 2e-3
    assert math.isclose((up - loss()) / 2e-3, dx[2, 3], rel_tol=0.05, abs_tol=1e-3)


def test_windows_cover_every_word():
    for n in (0, 1, 23, 24, 25, 40, 41, 100):
        text, index = toxicity.windows(np.array([n, 3]))
        own = index[text == 0]
        assert set(own[own >= 0]) == set(range(n)) and (text == 1).sum() == 1
        assert (index[:, 0] >= 0).all()


def test_long_texts_lose_no_window(monkeypatch):
    monkeypatch.setattr(toxicity, "BLOCK", 200)
    text = " ".join(f"w{i}x" for i in range(300))
    parts = [p.split() for p in toxicity._parts(text)]
    words = text.split()
    runs = {tuple(p[i : i + 24]) for p in parts for i in range(max(1, len(p) - 23))}
    assert all(tuple(words[i : i + 24]) in runs for i in range(len(words) - 23))


def test_toxicity(spark, small):
    got = op2_toxicity(spark, small)
    labels = spark.read.parquet(f"{small}/labels.parquet")
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert got.count() == docs.count() and got.where("score < 0 or score > 1").count() == 0
    rows = got.where("not held_out").join(labels, "doc_id").select("score", "toxic").collect()
    bad = np.array([r.score for r in rows if r.toxic])
    good = np.array([r.score for r in rows if not r.toxic])
    assert (bad[:, None] > good).mean() > 0.9
    fit = spark.createDataFrame(
        [(f"the {w} dog number {i}", int(w == "vile")) for i in range(40) for w in ("vile", "nice")] + [(None, 1), ("x", None)],
        "text string, toxic int",
    )
    net = toxicity.fit(fit)
    odd = spark.createDataFrame(
        [(1, "a vile dog", 1.0), (1, "a vile dog", 1.0), (None, None, None), (2, "", 0.0), (3, "12 !", 0.0), (4, "the dog " * 50_000 + "a vile dog", 0.0), (5, "nice dog", 0.0)],
        "doc_id long, text string, score double",
    )
    rows = toxicity.detect(odd, net).collect()
    assert len(rows) == 7
    by = {r.doc_id: r for r in rows}
    assert by[1].is_toxic and by[4].is_toxic and not by[5].is_toxic
    assert all(by[i].toxicity == 0 for i in (None, 2, 3))
    assert toxicity.detect(odd.limit(0), net).count() == 0
    one = toxicity.fit(fit.where("toxic = 0"))
    assert {r.toxicity for r in toxicity.detect(odd, one).collect()} == {0.0}


def test_lm_like_brute_force(spark, monkeypatch):
    texts = [("abcab abd", True), ("Bad cab!\n", True), ("zzz abc", False), ("", False), (None, True), ("é漢z", False)]
    docs = spark.createDataFrame([(i, t, g, 1) for i, (t, g) in enumerate(texts)], "doc_id long, text string, is_target boolean, n_tokens int")
    models = lm.fit(docs)
    chars = Counter("".join((t or "").lower() for t, _ in texts))
    top = sorted(chars, key=lambda c: (-chars[c], ord(c)))[: lm.SYMBOLS - 2]
    code = {c: i + 2 for i, c in enumerate(top)}

    def tokens(t):
        return [0] * 3 + [code.get(c, 1) for c in (t or "").lower()]

    def model(chosen, scale):
        n = Counter()
        for t in chosen:
            s = tokens(t)
            for i in range(3, len(s)):
                n[tuple(s[i - 3 : i + 1])] += scale

        def p(h, c):
            if not h:
                whole = sum(n.values())
                return (sum(v for g, v in n.items() if g[3] == c) + 1) / (whole + lm.SYMBOLS)
            k = len(h)
            seen = sum(v for g, v in n.items() if g[3 - k :] == (*h, c))
            of = sum(v for g, v in n.items() if g[3 - k : 3] == h)
            return (seen + lm.PRIOR * p(h[1:], c)) / (of + lm.PRIOR)

        return p

    good = [t for t, g in texts if g]
    size = lambda x: sum(len(t or "") for t in x)
    target = model(good, 1)
    background = model([t for t, _ in texts], size(good) / size([t for t, _ in texts]))
    for block in (1 << 20, 4):
        monkeypatch.setattr(lm, "BLOCK", block)
        for r in lm.score(docs.drop("n_tokens"), models).collect():
            s = tokens(r.text)
            assert r.n_tokens == len(s) - 3
            if r.n_tokens == 0:
                assert r.lm_score is None and r.target_loss is None
                continue
            for p, got in ((target, r.target_loss), (background, r.background_loss)):
                want = np.mean([-math.log(p(tuple(s[i - 3 : i]), s[i])) for i in range(3, len(s))])
                assert math.isclose(got, want, rel_tol=1e-4)
    assert lm.score(docs.limit(0).drop("n_tokens"), lm.fit(docs.limit(0))).count() == 0


def test_lm_tells_rare_scripts_apart(spark, monkeypatch):
    """A Greek text scores by its letters where Latin fills the most frequent characters."""
    latin = "".join(map(chr, range(33, 127))) * 30
    texts = [(latin, False)] * 4 + [("καλημέρα κόσμε", True), ("θύψξωφβζηδ γχσπ", False)]
    docs = spark.createDataFrame([(i, *x) for i, x in enumerate(texts)], "doc_id long, text string, is_target boolean")
    models = lm.fit(docs)
    asked = spark.createDataFrame(
        [(0, "καλημέρα"), (1, "θύψξωφβζ"), (2, "never 見た"), (3, None), (None, "καλημέρα"), (3, "")], "doc_id long, text string"
    )
    rows = lambda: sorted(map(tuple, lm.score(asked, models).collect()), key=repr)
    want = rows()
    by = {r[1]: r for r in want}
    assert by["καλημέρα"][5] < by["θύψξωφβζ"][5] and by["never 見た"][3] > 0
    # the same by the join, with hardly anything and nothing in memory
    for head in (7, 0):
        monkeypatch.setattr(lm, "HEAD_ROWS", head)
        got = rows()
        assert [r[:3] for r in got] == [r[:3] for r in want]
        for a, b in zip(got, want):
            assert all(x is y is None or math.isclose(x, y, abs_tol=1e-9) for x, y in zip(a[3:], b[3:]))


def test_lm_prefers_good_texts(spark, small):
    labels = spark.read.parquet(f"{small}/labels.parquet")
    means = {
        r.quality: r.m
        for r in op4_lm_score(spark, small).join(labels, "doc_id").groupBy("quality").agg(F.avg("score").alias("m")).collect()
    }
    assert means[1] < means[0]


def brute_nearest(rows, asked, k):
    out = {}
    for q, v in asked:
        near = sorted((-float(np.dot(v, w)), i) for i, w in rows if i != q)
        out[q] = near[:k]
    return out


def test_nearest_recall(spark, small):
    rows = [(r.vec_id, np.array(r.embedding, float)) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    want = brute_nearest(rows, [x for x in rows if x[0] % 20 == 0], 20)
    got: dict = {}
    for r in op1_nearest_vectors(spark, small).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((-r.score, r.vec_id))
        assert r.rank == len(got[r.query_id])
    hits = sum(len({i for _, i in got[q]} & {i for _, i in near}) for q, near in want.items())
    assert set(got) == set(want) and hits >= 0.95 * sum(map(len, want.values()))


def test_graph_recall_in_a_larger_shard():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, 32))
    v = centres[rng.integers(20, size=4000)] + 0.5 * rng.normal(size=(4000, 32))
    v *= rng.uniform(0.2, 2, (4000, 1))
    g = hnsw.build(np.arange(4000), v, float(np.linalg.norm(v, axis=1).max()), 11)
    q = v[:200]
    node, _ = hnsw.search(g, q, 10)
    ids = np.take(g.ids[:, 0], node)
    true = np.argsort(-(q @ v.T), 1, kind="stable")[:, :10]
    found = [np.argsort(-np.einsum("d,nd->n", a, v[i[i >= 0]]))[:10] for a, i in zip(q, ids)]
    hits = sum(len(set(i[i >= 0][f]) & set(t)) for i, f, t in zip(ids, found, true))
    assert hits >= 0.9 * true.size


def test_nearest_odd_rows(spark):
    same = [1.0, 2.0]
    rows = [(i, same, "x") for i in range(40)] + [
        (100, [3.0, 0.0], "x"), (101, [0.0, 0.0], "x"), (102, None, "x"), (103, [float("nan"), 1.0], "x"),
        (104, [float("inf"), 1.0], "x"), (105, [1.0, None], "x"), (None, [1.0, 1.0], "x"), (106, [-1.0, -1.0], "x"), (107, [], "x"),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    use = hnsw.usable(df)
    assert {r.vec_id for r in use.collect()} == {*range(40), 100, 106}
    got = hnsw.nearest(use, use.where("vec_id in (0, 100, 106)"), 5).collect()
    by: dict = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert by[0] == [(i, 5.0) for i in range(1, 6)]
    assert by[100] == [(i, 3.0) for i in range(5)]
    assert [x[0] for x in by[106]] == [0, 1, 2, 3, 4] or by[106][0] == (0, -3.0)
    few = use.where("vec_id in (0, 100)")
    assert sorted((r.query_id, r.vec_id) for r in hnsw.nearest(few, few, 20).collect()) == [(0, 100), (100, 0)]
    assert hnsw.nearest(use.limit(0), use, 5).count() == 0


def net_of(words, seed=3):
    rng = np.random.default_rng(seed)
    _, key, _, _ = toxicity.words([" ".join(words)])
    net = toxicity.Network.start(np.unique(key), seed)
    for p in net.p.values():
        p += rng.normal(0, 0.5, p.shape).astype(np.float32)
    return net


def plain_score(net, text):
    """The network written down word by word: no windows at once, no arrays of texts."""
    def sigmoid(v):
        return 1 / (1 + np.exp(-v))

    def vector(word):
        _, key, tri, _ = toxicity.words([word])
        own = net.p["word"][net.word_rows(key)[0]]
        return np.concatenate([own, net.p["char"][tri].mean(0)]).astype(np.float64)

    def gru(xs, way):
        wx, wh, b = (net.p[f"{n}{way}"].astype(np.float64) for n in ("wx", "wh", "b"))
        h, out = np.zeros(toxicity.HIDDEN), []
        for x in xs:
            g, u = x @ wx + b, h @ wh
            k = toxicity.HIDDEN
            z, r = sigmoid(g[:k] + u[:k]), sigmoid(g[k : 2 * k] + u[k : 2 * k])
            h = (1 - z) * np.tanh(g[2 * k :] + r * u[2 * k :]) + z * h
            out.append(h)
        return out

    found = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    if not found:
        return 0.0
    best, start = -np.inf, 0
    while True:
        xs = [vector(w) for w in found[start : start + toxicity.WINDOW]]
        states = np.column_stack([gru(xs, "f"), gru(xs[::-1], "b")[::-1]])
        a = np.exp(states @ net.p["attend"])
        best = max(best, float((a / a.sum()) @ states @ net.p["out"] + net.p["bias"][0]))
        if start + toxicity.WINDOW >= len(found):
            return sigmoid(best)
        start += toxicity.STRIDE


def test_scores_by_a_plain_network():
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu") for b in ("ra", "so", "ti", "vex")]
    net = net_of(words)
    rng = np.random.default_rng(0)
    texts = [" ".join(rng.choice(words + ["other", "1", "Ünd"], n)) for n in (1, 5, 24, 25, 60, 133)] + ["", "12 !"]
    got = toxicity.scores(net, texts)
    assert np.allclose(got, [plain_score(net, t) for t in texts], atol=1e-4)


def test_a_text_scores_alike_in_blocks(monkeypatch):
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu") for b in ("ra", "so", "ti", "vex")]
    net = net_of(words)
    rng = np.random.default_rng(1)
    for gap in (" ", "\n", "  7  "):
        text = gap.join(rng.choice(words, 900))
        whole = toxicity.scores(net, [text])
        monkeypatch.setattr(toxicity, "BLOCK", 1000)
        assert len(toxicity._parts(text)) > 2
        assert np.allclose(toxicity.scores(net, [text]), whole, atol=1e-5)
        monkeypatch.undo()


def test_a_phrase_is_whole_in_some_window_wherever_it_stands():
    longest = toxicity.WINDOW - toxicity.STRIDE + 1
    for at in range(60):
        _, index = toxicity.windows(np.array([200]))
        assert any(set(range(at, at + longest)) <= set(row) for row in index.tolist())


def test_one_label_scores_texts_without_a_letter_zero(spark):
    rows = spark.createDataFrame([("bad words", 1), ("worse words", 1)], "text string, toxic int")
    net = toxicity.fit(rows)
    odd = spark.createDataFrame([("bad",), ("12 !",), ("",), (None,)], "text string")
    got = {r.text: r.toxicity for r in toxicity.detect(odd, net).collect()}
    assert got == {"bad": 1.0, "12 !": 0.0, "": 0.0, None: 0.0}


def test_sample_without_shuffling_texts(spark):
    from pyspark.sql import functions as F

    from quirelens.llm.rows import labelled_sample

    docs = spark.createDataFrame(
        [(i, f"text {i}") for i in range(300)] + [(5, "text 5"), (5, "other"), (None, "n"), (7, None)],
        "doc_id long, text string",
    )
    labels = spark.createDataFrame([(i, i % 10 == 0) for i in range(200)], "doc_id long, bad boolean")
    got = labelled_sample(docs, labels, "bad", F.col("text").isNotNull(), 40).collect()
    assert sum(r.bad for r in got) == 20 and 15 <= len(got) - 20 <= 20
    assert len({r.text for r in got}) == len(got)
    every = labelled_sample(docs, labels, "bad", F.col("text").isNotNull(), 10_000)
    assert every.count() == 201
    plan = every._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan


def test_nearest_with_repeated_ids_and_uneven_lengths(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(60)]
    twice = rows + [(20, [9.0, 9.0, 9.0, 9.0]), rows[3], (70, [1.0, 2.0]), (80, [1.0, 2.0, 3.0, 4.0, 5.0])]
    df = hnsw.usable(spark.createDataFrame(twice, "vec_id long, embedding array<double>"))
    got: dict = {}
    for r in hnsw.nearest(df, df.where("vec_id % 20 = 0"), 8).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    single = {i: np.array(min(v for j, v in twice if j == i)) for i in range(60)}
    want = brute_nearest(list(single.items()), [(i, single[i]) for i in (0, 20, 40)], 8)
    assert set(got) == {0, 20, 40}  # 80 has another length
    for q, near in want.items():
        assert [i for _, i in got[q]] == [i for _, i in near]
        assert np.allclose([s for s, _ in got[q]], [s for s, _ in near])


def test_new_columns_replace_those_of_the_same_name(spark):
    from quirelens.llm import langid

    docs = spark.createDataFrame(
        [(1, "the words of it", "en", 7, "a", 2.0), (2, None, "en", 7, "b", 2.0)],
        "doc_id long, text string, lang string, n_tokens int, lang_pred string, _lm double",
    )
    found = langid.identify(docs, langid.fit(docs))
    assert found.columns == ["doc_id", "text", "lang", "n_tokens", "_lm", "lang_pred", "lang_score", "lang_rejected"]
    assert {r.doc_id: r.lang_pred for r in found.collect()} == {1: "en", 2: "und"}
    marked = docs.withColumn("is_target", F.lit(True)).withColumn("_number", F.lit(3))
    models = lm.fit(marked)
    scored = lm.score(marked, models)
    assert scored.columns.count("n_tokens") == 1 and {r._number for r in scored.collect()} == {3}
    again = lm.score(marked, models, fitted=True)
    key = lambda r: r.doc_id
    assert sorted(again.collect(), key=key) == sorted(scored.collect(), key=key)
    judged = toxicity.detect(docs.withColumn("toxicity", F.lit("x")), toxicity.Network(np.zeros(0, np.uint64), constant=1.0))
    assert {r.doc_id: r.toxicity for r in judged.collect()} == {1: 1.0, 2: 0.0}


def test_small_shards_find_every_vector(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, rng.normal(size=5).tolist()) for i in range(150)], "vec_id long, embedding array<double>")
    use = hnsw.usable(df)
    got = hnsw.nearest(use, use.where("vec_id in (0, 77, 149)"), 200).groupBy("query_id").count().collect()
    assert sorted((r.query_id, r["count"]) for r in got) == [(0, 149), (77, 149), (149, 149)]
