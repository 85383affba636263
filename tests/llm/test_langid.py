import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from quirelens.llm import langid
from quirelens.llm.queries import op10_language_id


def test_blocks_do_not_change_grams(monkeypatch):
    text = "  One, two... THREE 4 five éàü\n\n漢字 end!! " * 9
    want = np.sort(np.concatenate(list(langid.grams(text))))
    for size in (1, 2, 3, 7, 50):
        monkeypatch.setattr(langid, "BLOCK", size)
        assert np.array_equal(np.sort(np.concatenate(list(langid.grams(text)))), want)


def test_grams_by_hand():
    assert sum(map(len, langid.grams("ab"))) == 2 + 3 + 2
    assert list(langid.grams("12 !")) == list(langid.grams("")) == list(langid.grams(None)) == []


def test_held_out_accuracy(spark, small):
    got = op10_language_id(spark, small)
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "lang")
    right = got.where("held_out").join(docs, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")))
    assert right.first()[0] >= 0.9
    assert got.where("score < 0 or score > 1 or lang_pred is null").count() == 0


def test_odd_rows(spark):
    fit = spark.createDataFrame(
        [("the cat and the dog " * 3, "en"), ("le chat et le chien " * 3, "fr"), (None, "en"), ("12", "fr"), ("x", None)],
        "text string, lang string",
    )
    model = langid.fit(fit)
    assert model.languages == ["en", "fr"]
    docs = spark.createDataFrame(
        [(1, "the dog", "a"), (1, "the dog", "a"), (None, None, None), (2, "", "b"), (3, "1 2!", "c"), (4, "漢字 漢字 漢字", "d"), (5, "le chien " * 100_000, "e")],
        "doc_id long, text string, score string",
    )
    rows = langid.identify(docs, model).collect()
    assert len(rows) == 7 and rows[0].score == "a"
    by = {r.doc_id: r for r in rows}
    assert by[1].lang_pred == "en" and by[5].lang_pred == "fr" and not by[1].lang_rejected
    assert all(by[i].lang_pred == "und" and by[i].lang_rejected and by[i].lang_score == 0 for i in (None, 2, 3))
    assert by[4].lang_rejected and by[4].lang_pred in ("en", "fr")
    assert langid.identify(docs.limit(0), model).count() == 0
    nothing = langid.fit(fit.limit(0))
    assert {r.lang_pred for r in langid.identify(docs, nothing).collect()} == {"und"}


def plain_grams(text):
    """Hashed n-grams letter by letter, with whole numbers."""
    codes, gap = [0], True
    for c in text.lower():
        if c.isalpha():
            codes.append(ord(c))
        elif not gap:
            codes.append(0)
        gap = not c.isalpha()
    codes += [] if gap else [0]
    keys = [c for c in codes if c]
    keys += [(a << 21 | b) | 1 << 62 for a, b in zip(codes, codes[1:])]
    keys += [a << 42 | b << 21 | c for a, b, c in zip(codes, codes[1:], codes[2:])]
    keys = [(k ^ k >> 29) * 0x9E3779B97F4A7C15 % (1 << 64) for k in keys]
    return [k >> 50 for k in keys] if any(codes) else []


def test_nearest_centroid_by_hand():
    rng = np.random.default_rng(6)
    texts = ["one two three", "été à la mer", "1 a", "zz! zz?", "", "12", "the quick brown fox " * 9]
    idf = rng.uniform(1, 5, langid.DIMENSIONS).astype(np.float32)
    centroids = np.zeros((5, langid.DIMENSIONS), np.float32)
    for row, source in zip(centroids, ["one fox", "la mer", "été", "three brown", "zz"]):
        for g in plain_grams(source):
            row[g] += rng.uniform(0.5, 1)
        row /= np.linalg.norm(row)
    floor = rng.uniform(0, 1.2, (3, 8))
    model = langid.Model(["a", "b", "c"], idf, centroids, np.array([0, 1, 1, 0, 2]), floor)
    language, cosine, rejected = model.nearest(langid.counts(texts))
    for i, text in enumerate(texts):
        count = {}
        for g in plain_grams(text):
            count[g] = count.get(g, 0) + 1
        if not count:
            assert language[i] == -1 and rejected[i]
            continue
        weight = {g: n**0.5 * float(idf[g]) for g, n in count.items()}
        norm = sum(w * w for w in weight.values()) ** 0.5
        near = [sum(w * float(c[g]) for g, w in weight.items()) / norm for c in centroids]
        best = max(range(5), key=lambda j: near[j])
        size = min(7, (sum(count.values()).bit_length() - 1) // 2)
        assert language[i] == model.owner[best] and abs(cosine[i] - near[best]) < 1e-5
        assert rejected[i] == (cosine[i] < langid.SLACK * floor[model.owner[best], size])


def test_fit_holds_one_matrix(spark):
    n = 600
    rows = [(f"the word{chr(97 + i % 26)} and the dog{chr(97 + i // 26)} " * 5, "en") for i in range(n)]
    fit = spark.createDataFrame(rows, "text string, lang string")
    tracemalloc.start()
    try:
        model = langid.fit(fit)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(model.owner) == langid.CENTROIDS
    assert peak < 2 * 4 * n * langid.DIMENSIONS
