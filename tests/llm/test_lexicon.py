import hashlib
import json

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quirelens.llm import arrays, lexicon, queries

PATH = P.path("byte_bpe_50k.json")
WORDS = [b" the", b"the", b" there", b" and", b"ing", b"'s", b"  ", b"\n", " é".encode(), b"a" * 40]


@pytest.fixture(scope="module")
def both():
    with open(PATH, encoding="utf-8") as f:
        file = f.read()
    plain = lexicon.Codec(file)
    words = sorted(WORDS)
    made = lexicon.compiled(words, [plain.merge(w) for w in words])
    library = Tokenizer.from_file(PATH)
    library.no_truncation()
    library.no_padding()
    return lexicon.Codec(file, lexicon.Transducer(made)), library


def encoded(own, texts):
    ids, sizes = own.encode(*arrays.flat(pa.array(texts, pa.string())))
    return [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] if texts else []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=6).map(lambda b: bytes(x % 4 + 97 for x in b)), max_size=60))
def test_automaton_numbers_its_words_and_no_others(words):
    known = sorted(set(words))
    own = lexicon.Transducer(lexicon.compiled(known, [[i, i + 7] for i in range(len(known))]))
    tried = known + [w + b"a" for w in known] + [w[:-1] for w in known] + [b"", b"zz"]
    data = np.frombuffer(b"".join(tried), np.uint8)
    end = np.cumsum([len(w) for w in tried])
    got = own.numbers(data, end - [len(w) for w in tried], end)
    assert got.tolist() == [known.index(w) if w in known else -1 for w in tried]


def test_equal_suffixes_are_one_state():
    words = sorted(a + b for a in (b"k", b"l", b"m") for b in (b"ation", b"ations", b"ed"))
    states = lexicon.minimal_states(words)
    # start, the branch after the first letter, a-t-i-o-n, accepting n, e: shared by all nine words
    assert len(states) == len(set(states)) == 9


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("'  \n\tsthe andé1!　\x1c<|endoftext|>"), st.characters(exclude_categories=["Cs"])), max_size=40), max_size=5))
def test_same_ids_as_the_library(both, texts):
    own, library = both
    got = encoded(own, texts)
    assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_added_tokens(both):
    own, library = both
    mark = "<|endoftext|>"
    texts = [mark, f"a  {mark}  the{mark}{mark}", f"<|endof", "text|>", f"x{mark}", "  ", "", f"{mark} the there's"]
    got = encoded(own, texts)
    assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert got[0] == [50256] and got[2] != [50256]


def test_every_character_is_split_alike(both):
    own, library = both
    texts = [
        "".join(f"a{chr(c)}1{chr(c)} {chr(c)}{chr(c)}!\n" for c in range(k, k + 256))
        for k in [*range(0, 0x32000, 256), 0xE0000, 0xE0100, 0x10FF00]
        if not 0xD800 <= k < 0xE000
    ]
    assert encoded(own, texts) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 50_300), max_size=12), max_size=6))
def test_decoding_any_ids(both, lists):
    own, library = both
    sizes = np.array([len(x) for x in lists], np.int64)
    raw, width = own.decode(np.array([i for x in lists for i in x], np.int64), sizes)
    edge = np.concatenate([[0], np.cumsum(width)]).astype(int)
    got = [raw[a:b].decode() for a, b in zip(edge[:-1], edge[1:])]
    assert got == [library.decode(x, skip_special_tokens=False) for x in lists]


def test_frequent_words_by_whole_counts(spark):
    docs = spark.createDataFrame([("b b b a a c d",), ("a c",), (None,), ("",)], "text string")
    counts = {r.word: r.n for r in lexicon.word_counts(docs).collect()}
    assert counts == {"b": 1, " b": 2, " a": 2, " c": 2, " d": 1, "a": 1}
    assert lexicon.frequent(lexicon.word_counts(docs), 10) == [b" a", b" b", b" c"]
    # three words share the least count: they stay out together
    assert lexicon.frequent(lexicon.word_counts(docs), 2) == []
    assert lexicon.frequent(lexicon.word_counts(docs.limit(0)), 5) == []


def test_columns_and_steps(spark, monkeypatch):
    library = Tokenizer.from_file(PATH)
    texts = ["It's the über 漢字 🙂!", "", None, "It's the über 漢字 🙂!", "the there " * 3000, "x" * 9000]
    docs = spark.createDataFrame(
        [(i, t, 7, "own") for i, t in enumerate(texts)], "doc_id long, text string, ids int, decoded string"
    )
    monkeypatch.setattr(lexicon, "STEP", 64)
    pieces = lexicon.WordPieces.fitted(docs, PATH, most=20)
    out = lexicon.encoded(docs, pieces)
    assert out.columns == ["doc_id", "text", "ids", "decoded"]
    for r in out.collect():
        assert r.ids == library.encode(r.text or "", add_special_tokens=False).ids
        assert r.decoded == (r.text or "")
    assert lexicon.encoded(docs.limit(0), pieces).count() == 0
    again = docs.select(pieces.decode(pieces.encode(docs.text)).alias("t")).collect()
    assert [r.t for r in again] == [t or "" for t in texts]


def test_other_tokenizers_are_refused(tmp_path):
    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f)
    spec["pre_tokenizer"]["add_prefix_space"] = True
    with pytest.raises(ValueError, match="splitting"):
        lexicon.Codec(json.dumps(spec))


def test_query_against_the_library(spark, small):
    library = Tokenizer.from_file(PATH)
    texts = {r.doc_id: r.text or "" for r in queries.table(spark, small, "documents").collect()}
    got = queries.op11_lexicon_bpe(spark, small).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
