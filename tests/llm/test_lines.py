import random

import pytest

from quirelens.llm import decontaminate, lines
from tests import oracle


def brute(texts, least):
    """Kept text of each, in order; null stays null.

    For every run of lines of every length: if it has enough characters outside blank
    lines and also starts at an earlier place, it goes.
    """
    split = [[] if t is None else t.split("\n") for t in texts]
    chars = [[len(y) if y.strip(" \t\x0b\x0c\r") else 0 for y in x] for x in split]
    gone = [set() for _ in texts]
    # places whose run of ``width`` lines repeats; longer runs can only repeat there
    alive = [(k, i) for k, x in enumerate(split) for i in range(len(x))]
    width = 1
    while alive:
        seen = {}
        for k, i in alive:
            if i + width <= len(split[k]):
                seen.setdefault(tuple(split[k][i : i + width]), []).append((k, i))
        alive = sorted(p for places in seen.values() if len(places) > 1 for p in places)
        for places in seen.values():
            for k, i in places[1:]:
                if sum(chars[k][i : i + width]) >= least:
                    gone[k] |= set(range(i, i + width))
        width += 1
    return [
        t if t is None else "\n".join(y for i, y in enumerate(x) if i not in g)
        for t, x, g in zip(texts, split, gone)
    ]


TEXTS = [
    "alpha beta\ngamma delta\nepsilon\nzeta eta",
    "start\nalpha beta\ngamma delta\nepsilon\nend",
    "x\nx\nx\nx\nx\nx\nx\nx",
    "\n \nalpha beta\n\ngamma delta\n",
    None,
    "",
    "epsilon\nzeta eta\nalpha beta\ngamma delta\nepsilon\nzeta eta",
    "alpha beta\ngamma delta\nepsilon\nzeta eta",
    "y" * 500 + "\nx\nx\nx\nx",
    "own\nthe first of three\nsecond\nthird\n\n  \nfourth after blanks\nz",
    "the first of three\nsecond\nthird\n\n  \nfourth after blanks\nother",
    "third\n\n  \nfourth after blanks",
]


@pytest.mark.parametrize("least", [1, 4, 20, 30])
def test_like_brute_force(spark, least):
    df = spark.createDataFrame([(i, t, len(t or ""), "z") for i, t in enumerate(TEXTS)], "doc_id long, text string, n_chars int, pos string")
    got = {r.doc_id: r.kept for r in lines.line_report(df, least).collect()}
    want = brute(TEXTS, least)
    assert got == dict(enumerate(want))
    rows = {r.doc_id: r for r in lines.drop_repeated_lines(df, least).collect()}
    for i, (t, k) in enumerate(zip(TEXTS, want)):
        assert (i in rows) == (k == t or k != "")
        if i in rows:
            assert rows[i].text == k and rows[i].n_chars == len(k or "") and rows[i].pos == "z"


def paragraph(k, n=105):
    return (f"paragraph {k} " * 20)[:n]


def test_runs_of_any_length_and_blank_lines(spark):
    three = "\n".join(paragraph(k, 80) for k in range(3))
    five = "\n\n".join(paragraph(k) for k in range(10, 15))
    tail = "q" * 150 + "\n" + "r" * 60 + "\n" + "s" * 20
    texts = [f"one\n{three}\nnext", f"two\n{three}\nlast", f"three\n{five}\nend", f"{five}\nnew", tail, tail, "short\n\nlines", "short\n\nlines"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.kept for r in lines.line_report(df).collect()}
    assert got == {
        0: texts[0], 1: "two\nlast", 2: texts[2], 3: "new", 4: tail, 5: "", 6: texts[6], 7: texts[7],
    }
    assert list(got[i] for i in range(8)) == brute(texts, lines.MIN_CHARS)


@pytest.mark.parametrize("least", [1, 3, 7, 12])
def test_random_lines_like_brute_force(spark, least):
    rnd = random.Random(least)
    texts = []
    for _ in range(60):
        own = [rnd.choice(["a", "bb", "ccc", "", " ", "dddd", "eeeee"]) for _ in range(rnd.randint(0, 14))]
        if texts and rnd.random() < 0.6:
            other = rnd.choice(texts).split("\n")
            i = rnd.randrange(len(other))
            own[len(own) // 2 : len(own) // 2] = other[i : i + rnd.randint(1, 8)]
        texts.append("\n".join(own))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.kept for r in lines.line_report(df, least).collect()}
    assert got == dict(enumerate(brute(texts, least)))


def test_odd_rows(spark):
    t = "a line of text\nand another one"
    df = spark.createDataFrame([(5, t), (None, t), (5, t), (1, None)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_lines, r.n_removed, r.n_runs) for r in lines.line_report(df, 10).collect())
    assert got == [(0, 2, 2, 1), (1, 0, 0, 0), (5, 2, 0, 0), (5, 2, 2, 1)]
    assert lines.line_report(df.limit(0)).count() == 0
    assert lines.drop_repeated_lines(df.limit(0)).count() == 0


def test_same_as_sql(spark, small):
    con = oracle.connect(small)
    assert oracle.compare(spark, "op3_line_dedup", small, con) is None
    assert oracle.compare(spark, "op5_decontamination", small, con) is None


@pytest.mark.parametrize("rows", [500_000, 0])
def test_leaks(spark, monkeypatch, rows):
    if not rows:
        monkeypatch.setattr(decontaminate, "fits_broadcast", lambda *a: False)
    item = "one two three four five six seven eight nine ten eleven twelve"
    pad = "lorem ipsum dolor sit amet " * 400
    docs = spark.createDataFrame(
        [(1, pad + item.upper() + " " + pad, "k"), (2, pad, "k"), (3, item[:40], "k"), (4, None, "k"), (5, "", "k"), (6, "Tiny item", "k"), (6, "tiny item", "k"), (None, item, "k"), (7, pad + "tiny item " + pad, "k")],
        "doc_id long, text string, item string",
    )
    bench = spark.createDataFrame(
        [(10, item, 1), (11, "tiny  item", 1), (12, None, 1), (13, "", 1), (None, "sit amet lorem ipsum dolor", 1)],
        "item_id long, text string, n long",
    )
    got = sorted((r.doc_id or 0, r.item_id or 0, r.n_shared, r.n_item) for r in decontaminate.leaks(docs, bench).collect())
    assert got == sorted([(1, 10, 8, 8), (0, 10, 8, 8), (6, 11, 1, 1), (6, 11, 1, 1), (7, 11, 1, 1), (1, 0, 1, 1), (2, 0, 1, 1), (7, 0, 1, 1)])
    kept = decontaminate.drop_leaks(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 5]
    assert decontaminate.leaks(docs.limit(0), bench).count() == 0
    assert decontaminate.leaks(docs, bench.limit(0)).count() == 0
    assert decontaminate.drop_leaks(docs, bench.limit(0)).count() == 9


@pytest.mark.parametrize("rows", [500_000, 0])
def test_leaks_of_every_size_by_brute_force(spark, monkeypatch, rows):
    """Items of 1 to 40 words, whole or with a part cut off, inside long documents."""
    if not rows:
        monkeypatch.setattr(decontaminate, "fits_broadcast", lambda *a: False)
    rnd = random.Random(3)
    word = lambda: f"w{rnd.randrange(300)}"
    sizes = (1, 2, 3, 4, 5, 6, 8, 9, 12, 20, 40)
    items = {i: [word() for _ in range(sizes[i % len(sizes)])] for i in range(44)}
    docs = {}
    for d in range(60):
        text = [word() for _ in range(rnd.choice([3, 60, 200]))]
        for i in rnd.sample(sorted(items), 2):
            part = items[i][: rnd.choice([len(items[i]), max(1, len(items[i]) * 4 // 5)])]
            at = rnd.randrange(len(text))
            text[at:at] = part
        docs[d] = text

    def runs(w, n):
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}

    want = set()
    for i, w in items.items():
        n = min(len(w), 5)
        own = runs(w, n)
        for d, text in docs.items():
            shared = len(own & runs(text, n))
            if shared >= 0.75 * len(own):
                want.add((d, i, shared, len(own)))
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in docs.items()], "doc_id long, text string")
    bench = spark.createDataFrame([(i, "  ".join(w).upper()) for i, w in items.items()], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.n_shared, r.n_item) for r in decontaminate.leaks(df, bench).collect()}
    assert got == want and {min(len(items[i]), 5) for _, i, _, _ in want} == {1, 2, 3, 4, 5}
