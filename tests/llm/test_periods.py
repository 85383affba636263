import hashlib
import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quirelens.llm import periods, queries


def by_hand(words, least=periods.LEAST):
    """(start, length, period) of every run, by comparing words at each distance."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def kept_by_hand(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return b" ".join(w for i, w in enumerate(words) if i not in gone)


@st.composite
def texts(draw):
    letters = draw(st.integers(1, 4))
    words = draw(st.lists(st.integers(0, letters).map(lambda k: b"w%d" % k), max_size=70))
    if words and draw(st.booleans()):
        a, p = draw(st.integers(0, len(words) - 1)), draw(st.integers(1, 20))
        words = words[:a] + [words[min(len(words) - 1, a + i % p)] for i in range(draw(st.integers(0, 60)))]
    return words


@settings(max_examples=400, deadline=None)
@given(st.lists(texts(), max_size=5))
def test_runs_are_those_found_by_comparing_all_distances(docs):
    for words, got in zip(docs, periods.described(docs), strict=True):
        want = by_hand(words)
        assert [(r["start"], r["length"], r["period"]) for r in got["runs"]] == want
        assert got["collapsed"].encode() == kept_by_hand(words, want)


def test_grammar_derives_its_places():
    text = np.array([1, 2, 3, 1, 2, 3, 1, 2, 3, 7, 7, 7, 7, 7, 1, 2, 3, 9] * 3)
    half, length, symbol, place = periods.grammar(text, np.repeat([0, 1], [30, 24]))
    spelt = {}
    for x, at in zip(symbol.tolist(), place.tolist()):
        own = tuple(text[at : at + length[x]])
        assert spelt.setdefault(x, own) == own and 0 < half[x] < length[x]
        assert at + length[x] <= 30 or at >= 30  # no symbol spans two stretches
    assert 30 in length and 24 in length  # each stretch ends as one symbol
    assert len(symbol) > len(half)  # symbols are shared


def test_long_rows_and_periods():
    one = [b"a"] * 50_000
    many = [b"w%d" % (i % 7001) for i in range(30_000)]
    got = list(periods.described([one, many, [b"u%d" % i for i in range(40_000)]]))
    assert got[0]["runs"] == [{"start": 0, "length": 50_000, "period": 1}] and got[0]["collapsed"] == "a"
    assert got[1]["runs"] == [{"start": 0, "length": 30_000, "period": 7001}]
    assert got[2]["runs"] == []


def test_rows_of_every_kind(spark, monkeypatch):
    monkeypatch.setattr(periods, "STEP", 100)
    cases = [None, "", " \n", "a b " * 6, "a b " * 5 + "a", "x y z " * 30, "x y z " * 30, "w " * 20_000]
    docs = spark.createDataFrame(
        [(i if i else None, t, 1, "r") for i, t in enumerate(cases)],
        "doc_id long, text string, n_words int, runs string",
    )
    out = periods.periodic_runs(docs)
    assert out.columns == ["doc_id", "n_words", "runs", "collapsed"]
    got = sorted((r.doc_id or 0, r) for r in out.collect())
    for (_, r), text in zip(got, cases, strict=True):
        words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
        want = by_hand(words)
        assert r.n_words == len(words) and [tuple(x) for x in r.runs] == want
        assert r.collapsed.encode() == kept_by_hand(words, want)
    assert periods.periodic_runs(docs.limit(0)).count() == 0


def test_query_by_hand(spark, small):
    rows = {r.doc_id: r.text or "" for r in queries.table(spark, small, "documents").collect()}
    got = queries.op13_periodic_runs(spark, small).collect()
    assert len(got) == len(rows) and any(r.n_runs for r in got)
    for r in got:
        words = re.findall(rb"[^\x20\x09-\x0D]+", rows[r.doc_id].encode())
        n, h = len(words), zlib.crc32(str(r.doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = by_hand(words) if n < 1200 else None
        if runs is None:
            continue
        assert r.n_runs == len(runs)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        assert (r.start, r.length, r.period) == best
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        spelt = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
        assert r.runs_sha256 == hashlib.sha256(spelt.encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(kept_by_hand(words, runs)).hexdigest()
