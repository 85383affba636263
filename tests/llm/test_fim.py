import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quirelens.llm import fim, queries


def by_hand(doc_id, text):
    tokens = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    n = len(tokens)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = ("".join(x) for x in (tokens[:a], tokens[a:b], tokens[b:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


TEXT = st.text(alphabet=st.sampled_from("abZ <>PSM\n1é漢🙂"), max_size=60)


@settings(max_examples=300, deadline=None)
@given(TEXT, st.integers(1, 9), st.integers(0, 60), st.integers(0, 60), st.sampled_from(["psm", "spm"]))
def test_cuts_and_restoring_over_small_frames(text, size, a, b, form):
    tokens = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    row = fim.stored(text.encode(), size)
    assert (row["n"], row["chars"]) == (len(tokens), len(text))
    assert b"".join(fim.unpack(f["data"]) for f in row["frames"]).decode() == text
    a, b = sorted((a % (len(tokens) + 1), b % (len(tokens) + 1)))
    own = fim.Frames(row["n"], row["chars"], row["frames"])
    part = b"".join(map(fim.unpack, own.between(own.place(a), own.place(b)))).decode()
    assert part == "".join(tokens[a:b])
    if row["reserved"]:
        return
    cut = fim.rearranged(row, form, a, b)
    assert cut["prefix_chars"] == len("".join(tokens[:a])) and cut["middle_chars"] == len(part)
    assert b"".join(fim.original(cut["output"], form)).decode() == text


def test_only_frames_with_a_cut_are_opened(monkeypatch):
    row = fim.stored(b"word 1, " * 4000, 512)
    opened = []
    real = fim.unpack
    monkeypatch.setattr(fim, "unpack", lambda frame: opened.append(frame) or real(frame))
    out = fim.rearranged(row, "psm", 5000, 9000)["output"]
    assert len(opened) == 2 < len(row["frames"])
    whole = {f["data"] for f in row["frames"]}
    assert sum(f in whole for f in out) >= len(row["frames"]) - 2


def test_rows_of_every_kind(spark):
    texts = [
        "", None, "one two, three", "one two, three", "has <S> inside", "x" * 200_000, "é漢 🙂 " * 30_000,
        "a", "<", "<P", " ",
    ]
    rows = [(i, t, 1, "f") for i, t in enumerate(texts)] + [(None, "no id at all", 1, "f"), (None, None, 1, "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int, form string")
    kept = fim.store(docs)
    made = fim.transform(kept, *fim.drawn(F.col("doc_id"), F.col("n")))
    out = made.select(
        "*",
        fim.text_of(F.col("output"), F.col("form")).alias("t"),
        fim.restored(F.col("output"), F.col("form")).alias("back"),
        fim.digests(F.col("output"), F.col("form")).alias("sha"),
    )
    got = sorted((r.doc_id is None, r.doc_id or 0, r.back, r) for r in out.collect())
    assert len(got) == len(rows)
    want = sorted((i is None, i or 0, t or "", (i, t)) for i, t, _, _ in rows)
    for (*_, r), (*_, (doc_id, text)) in zip(got, want):
        n, form, prefix, middle, output = by_hand(doc_id, text or "")
        assert (r.n, r.form, r.prefix_chars, r.middle_chars) == (n, form, prefix, middle)
        assert r.t == output and r.back == (text or "")
        assert r.sha.output_sha256 == hashlib.sha256(output.encode()).hexdigest()
        assert r.sha.restored_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert fim.transform(fim.store(docs.limit(0)), F.lit("psm"), F.lit(0), F.lit(0)).count() == 0


def test_ranges_of_units(spark):
    docs = spark.createDataFrame([("one two, three " * 9000,), (None,)], "text string")
    kept = fim.store(docs, frame=100)
    got = kept.select(fim.units(kept, F.lit(2), F.lit(5)).alias("t")).collect()
    assert [r.t for r in got] == ["two, ", ""]


def test_query_against_regular_expressions(spark, small):
    texts = {r.doc_id: r.text or "" for r in queries.table(spark, small, "documents").collect()}
    got = queries.op12_fill_in_middle(spark, small).collect()
    assert len(got) == len(texts) and len({r.form for r in got}) == 3
    for r in got:
        *head, output = by_hand(r.doc_id, texts[r.doc_id])
        assert (r.n, r.form, r.prefix_chars, r.middle_chars) == tuple(head)
        assert r.output_sha256 == hashlib.sha256(output.encode()).hexdigest()
        assert r.restored_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
