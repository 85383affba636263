import hashlib

import numpy as np
import pytest
import public_tokenizers as P
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from quirelens.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def both():
    with open(PATH, "rb") as f:
        blob = f.read()
    enc = tiktoken.Encoding(
        "own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(blob), special_tokens={}
    )
    return bpe.codec(blob, bpe.BYTE_LEVEL), enc


def test_pattern_is_the_published_one():
    assert bpe.BYTE_LEVEL == P.PATTERN


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("'  \n\tstrevmld1!aé　\x1c"), st.characters(exclude_categories=["Cs"])), max_size=40), max_size=5))
def test_same_ids_as_tiktoken(both, texts):
    own, enc = both
    ids, sizes = own.encode(texts)
    want = [enc.encode_ordinary(t) for t in texts]
    assert ids.tolist() == [i for w in want for i in w] and sizes.tolist() == [len(w) for w in want]
    assert bytes(own.decode(ids)[0]).decode() == "".join(texts)


def test_every_character_is_split_alike(both):
    own, enc = both
    texts = [
        "".join(f"a{chr(c)}1{chr(c)} {chr(c)}{chr(c)}!\n" for c in range(k, k + 256))
        for k in [*range(0, 0x32000, 256), 0xE0000, 0xE0100, 0x10FF00]
        if not 0xD800 <= k < 0xE000
    ]
    ids, _ = own.encode(texts)
    assert ids.tolist() == [i for t in texts for i in enc.encode_ordinary(t)]


def test_blocks_do_not_change_ids(both, monkeypatch):
    own, enc = both
    text = "it's  the\n\n word-list, x" * 40 + "y" * 300 + "   end "
    want = enc.encode_ordinary(text)
    monkeypatch.setattr(bpe, "BLOCK", 50)
    assert own.encode([text, None, "", text])[0].tolist() == want + want


def test_columns(spark, both):
    own, enc = both
    texts = ["It's über 漢字 🙂!", "", None, "It's über 漢字 🙂!", "x" * 5000]
    docs = spark.createDataFrame(
        [(i, t, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, ids string, n_tokens int"
    )
    pairs = bpe.BytePairs(spark, PATH)
    got = {r.doc_id: r for r in bpe.digests(docs, pairs).collect()}
    for i, t in enumerate(texts):
        ids = enc.encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    from pyspark.sql import functions as F

    rows = (
        docs.select("text", pairs.encode(F.col("text")).alias("i"), pairs.starts(F.col("text")).alias("s"))
        .withColumn("t", pairs.token_texts(F.col("i")))
        .withColumn("d", pairs.decode(F.col("i")))
        .collect()
    )
    for r in rows:
        assert r.d == (r.text or "") and "".join(r.t) == r.d and len(r.s) == len(r.i)
        if r.text:
            _, want = enc.decode_with_offsets(r.i)
            assert r.s == want
    assert bpe.round_trip(docs.select("doc_id", "text"), pairs).where("decoded <> text").count() == 0
    assert bpe.digests(docs.limit(0), pairs).count() == 0
