import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quirelens.llm import arrays, substrings, suffixes


def brute_bytes(docs, length):
    """doc_id -> kept bytes and number of removed runs."""
    first = {}
    for i, t in sorted(docs.items()):
        for k in range(len(t) - length + 1):
            first.setdefault(t[k : k + length], i)
    out = {}
    for i, t in docs.items():
        gone = [False] * len(t)
        for k in range(len(t) - length + 1):
            if first[t[k : k + length]] < i:
                gone[k : k + length] = [True] * length
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (bytes(b for b, g in zip(t, gone) if not g), runs)
    return out


def brute_words(docs, length):
    first = {}
    split = {i: re.findall(rb"[^\x20\x09-\x0D]+", t) for i, t in docs.items()}
    for i, w in sorted(split.items()):
        for k in range(len(w) - length + 1):
            first.setdefault(tuple(w[k : k + length]), (i, k))
    out = {}
    for i, w in split.items():
        gone = [False] * len(w)
        for k in range(len(w) - length + 1):
            if first[tuple(w[k : k + length])] < (i, k):
                gone[k : k + length] = [True] * length
        out[i] = (len(w), b" ".join(x for x, g in zip(w, gone) if not g))
    return out


def random_docs(seed, n=60):
    rng = np.random.default_rng(seed)
    bank = ["".join(rng.choice(list("ab é\n"), 120)) for _ in range(4)]
    texts = []
    for _ in range(n):
        parts = [
            bank[rng.integers(4)][: rng.integers(0, 120)] if rng.random() < 0.6
            else "".join(rng.choice(list("abcdefgh  \t\n"), rng.integers(0, 90)))
            for _ in range(rng.integers(0, 5))
        ]
        texts.append("".join(parts))
    return texts + texts[:10] + ["", "a" * 300, "a" * 200, "a b " * 100]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=300))
def test_suffix_order(values):
    text = np.array(values, np.uint8) + 97
    raw = text.tobytes()
    order = suffixes.suffix_order(text)
    assert sorted(order.tolist()) == list(range(len(raw)))
    want = sorted(range(len(raw)), key=lambda i: raw[i:])
    assert [raw[i : i + 60].ljust(60, b"\0") for i in order] == [raw[i : i + 60].ljust(60, b"\0") for i in want]


@pytest.mark.parametrize("slice_bytes,bucket", [(1 << 22, 4 << 20), (300, 100)])
def test_bytes_like_brute_force(spark, monkeypatch, slice_bytes, bucket):
    from quirelens.llm import superkmers

    monkeypatch.setattr(superkmers, "BUCKET_BYTES", bucket)
    texts = random_docs(1)
    docs = {i: t.encode() for i, t in enumerate(texts)}
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, spans int").repartition(3)
    for length in (12, 50):
        got = {r.doc_id: r for r in suffixes.remove_repeated_bytes(df, length).collect()}
        for i, (kept, runs) in brute_bytes(docs, length).items():
            assert (bytes(got[i].kept), got[i].n_spans) == (kept, runs)
            assert got[i].n_removed == len(docs[i]) - len(kept) and got[i].n_bytes == len(docs[i])


def test_words_like_brute_force(spark, monkeypatch):
    from quirelens.llm import superkmers

    monkeypatch.setattr(superkmers, "BUCKET_BYTES", 500)
    texts = random_docs(2)
    docs = {i: t.encode() for i, t in enumerate(texts)}
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, kept string").repartition(3)
    for length in (3, 7, 20):
        got = {r.doc_id: r for r in substrings.remove_repeated_words(df, length).collect()}
        for i, (n, kept) in brute_words(docs, length).items():
            assert (got[i].n_words, bytes(got[i].kept)) == (n, kept)
            assert got[i].n_removed == n - len(kept.split())


def test_odd_rows(spark):
    passage = "one two three four five six seven eight nine ten " * 8
    rows = [(2, passage), (None, passage), (2, passage), (3, None), (4, ""), (1, "short")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffixes.remove_repeated_bytes(df).collect()
    assert sorted(((r.doc_id or 0), len(r.kept)) for r in got) == sorted(
        [(2, len(passage)), (0, 0), (2, 0), (3, 0), (4, 0), (1, 5)]
    )
    got = substrings.remove_repeated_words(df).collect()
    assert len(got) == 6 and sum(r.n_removed for r in got if r.doc_id is None) == 80
    for f in (suffixes.remove_repeated_bytes, substrings.remove_repeated_words):
        assert f(df.limit(0)).count() == 0


def test_slices_and_words():
    import pyarrow as pa

    rows = pa.array(range(4))
    texts = pa.array(["a b", None, "", " c"])
    ((n, data, edges),) = list(arrays.text_slices(rows, texts))
    assert edges.tolist() == [0, 3, 3, 3, 5]
    start, end, text = arrays.find_words(data, edges)
    assert [bytes(data[a:b]) for a, b in zip(start, end)] == [b"a", b"b", b"c"] and text.tolist() == [0, 0, 3]


@pytest.mark.parametrize("strings", [1, 3])
def test_hot_minimisers_change_no_result(spark, monkeypatch, strings):
    from quirelens.llm import superkmers

    monkeypatch.setattr(superkmers, "HOT_STRINGS", strings)
    monkeypatch.setattr(superkmers, "SAMPLE", 1)
    monkeypatch.setattr(superkmers, "BUCKET_BYTES", 100)
    texts = random_docs(7)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    docs = {i: t.encode() for i, t in enumerate(texts)}
    got = {r.doc_id: (bytes(r.kept), r.n_spans) for r in suffixes.remove_repeated_bytes(df, 24).collect()}
    assert got == brute_bytes(docs, 24)
    got = {r.doc_id: (r.n_words, bytes(r.kept)) for r in substrings.remove_repeated_words(df, 6).collect()}
    assert got == brute_words(docs, 6)


@pytest.mark.parametrize("shape", [suffixes.windows(), substrings.windows()], ids=["bytes", "words"])
def test_edges_of_a_hot_passage_spread(spark, monkeypatch, shape):
    """Texts around one passage in every document do not meet in a few buckets."""
    from quirelens.llm import superkmers

    monkeypatch.setattr(superkmers, "HOT_STRINGS", 200)
    monkeypatch.setattr(superkmers, "SAMPLE", 1)
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), 6))
    passage = " ".join(word() for _ in range(60))
    texts = [" ".join([*(word() for _ in range(40)), passage, *(word() for _ in range(40))]) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "_row long, text string")
    hot = superkmers.hot_minimisers(df, shape)
    whole = pa.RecordBatch.from_pydict({"_row": list(range(400)), "text": texts})
    if shape.counted:
        # the list of shared runs is empty: what is packed are the hot ones
        whole = whole.append_column("runs", pa.array([b""] * 400, pa.binary()))
    fullest = []
    strings = 0
    for batch in superkmers.pack(shape, 64, hot)(iter([whole])):
        held = np.zeros(64 * superkmers.PARTS, np.int64)
        for bucket, kind, blob in zip(*(c.to_pylist() for c in batch.columns)):
            if kind == 0:
                part = superkmers._unpacked(blob)[0]
                held += np.bincount(bucket * superkmers.PARTS + part.astype(np.int64), minlength=len(held))
        strings += held.sum()
        fullest.append(held.max())
    assert len(hot) and strings >= 400 and sum(fullest) < max(60, strings / 64)
