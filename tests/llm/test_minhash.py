import re

import numpy as np
import pytest

from quirelens.llm import minhash
from quirelens.llm.components import components


def shingles(text):
    low = re.sub(r"[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return set()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


def brute(docs):
    """doc_id -> (size, component)."""
    ids = sorted(docs)
    sets = {i: shingles(docs[i]) for i in ids}
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: (len(sets[i]), find(i)) for i in ids}


def family(seed=3):
    rng = np.random.default_rng(seed)
    bank = [f"w{k}" for k in range(400)]
    texts = []
    for _ in range(6):
        base = list(rng.choice(bank, rng.integers(40, 120)))
        texts.append(" ".join(base))
        for _ in range(12):
            own = list(base)
            for _ in range(rng.integers(0, 5)):
                own[rng.integers(len(own))] = str(rng.choice(bank))
            texts.append(" ".join(own).title() if rng.random() < 0.3 else " ".join(own))
    return texts + ["a b", "A  B", "a", "", "\n", None, "x y z w"]


@pytest.mark.parametrize("block", [2048, 4])
def test_like_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    docs = dict(enumerate(family()))
    df = spark.createDataFrame([(i, t, "x") for i, t in docs.items()], "doc_id long, text string, n long".replace("n long", "n string")).repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.component_table(df).collect()}
    assert got == brute(docs)
    kept = minhash.first_of_each(df)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, (_, c) in got.items() if i == c}


def test_sample_of_the_table_like_brute_force(spark, small):
    df = spark.read.parquet(f"{small}/documents.parquet")
    docs = {r.doc_id: r.text for r in df.collect()}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.component_table(df).collect()}
    assert got == brute(docs)


def test_bound_never_rules_out_a_link():
    rng = np.random.default_rng(5)
    for _ in range(200):
        n = int(rng.integers(1, 3000))
        base = rng.integers(0, 1 << 63, n, np.uint64)
        own = np.unique(np.concatenate([base[: max(1, int(n * 0.9))], rng.integers(0, 1 << 63, n // 20, np.uint64)]))
        base = np.unique(base)
        both = len(np.intersect1d(base, own))
        if 100 * both >= 75 * (len(base) + len(own) - both):
            key = np.concatenate([base, own])
            m = minhash.minima(key, np.array([0, len(base), len(key)]))
            p = [np.unique(x >> np.uint64(48)).astype("<u2").tobytes() for x in (base, own)]
            assert minhash.may_be_linked(len(base), len(own), *p, m[0].tobytes(), m[1].tobytes())


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (102, 101), (7, 7), (200, 200), (103, 5000), (5000, 9)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in [*range(61), 103, 5000]} | {100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_rows(spark):
    text = "one two three four five six seven"
    rows = [(2, text), (None, text), (2, text), (1, None), (3, ""), (1, "solo")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = minhash.component_table(df).collect()
    assert len(got) == 6 and sum(r.kept for r in got) == 4
    assert {r.component_id for r in got if r.n_shingles == 3} == {2}
    assert len(minhash.first_of_each(df).collect()) == 4
    assert minhash.component_table(df.limit(0)).count() == 0
