import random

import pytest
from pyspark.sql import functions as F

from quirelens.functions import text as tx
from quirelens.operators import pages as pg
from quirelens.plans import jobs

# volume -> page number -> (text, sentences once pages are joined)
VOLUMES = {
    "loom.wool": {
        10: ("Wool was dyed in\nvats?  Yes! And", ["Wool was dyed in\nvats?", "Yes!", "And then dried on racks."]),
        11: ("   then dried on racks.\nNo one hur-\nried; all waited", ["No one hurried;\nall waited for noon."]),
        14: ("for noon.", []),
    },
    "loom.flax": {1: (" \n\t", []), 2: ("Only this.", ["Only this."])},
    "loom.silk": {
        0: ("\n \nOne (of many). Two", ["One (of many).", "Two"]),
        7: ("", []),
        8: ("three. Four", ["three.", "Four five"]),
        9: ("five", []),
        12: ("Six.", ["Six."]),
    },
}
ROWS = [(v, n, text) for v, numbered in VOLUMES.items() for n, (text, _) in numbered.items()]


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def test_volumes_by_hand(spark):
    df = spark.createDataFrame(ROWS, "volid string, seq int, text string").repartition(3)
    got = {(r["volid"], r["seq"]): r["sentences"] for r in jobs.full_page_sentences(df, running_lines=False).collect()}
    assert got == {(v, n): want for v, numbered in VOLUMES.items() for n, (_, want) in numbered.items()}


def stitch_by_hand(volume):
    """Page by page, in order, on mutable lists."""
    out = [list(s) for s in volume]
    for i in range(len(out) - 1):
        if out[i] and out[i + 1]:
            out[i][-1] += " " + out[i + 1].pop(0)
    return out


@pytest.mark.parametrize("block", [3, 7, 4096])
def test_stitch_random_volumes(spark, block):
    rnd = random.Random(7 + block)
    volumes, rows = {}, []
    for v in range(60):
        seqs = sorted(rnd.sample(range(0, 90), rnd.randint(1, 40)))
        sents = [[f"{v}.{s}.{j}" for j in range(rnd.choice([0, 1, 1, 1, 1, 2, 3]))] for s in seqs]
        volumes[str(v)] = dict(zip(seqs, stitch_by_hand(sents)))
        rows += [(str(v), s, x) for s, x in zip(seqs, sents)]
    df = spark.createDataFrame(rows, "volid string, seq int, sentences array<string>")
    got = {}
    for r in pg.stitch_pages(df, block=block).collect():
        got.setdefault(r["volid"], {})[r["seq"]] = r["sentences"]
    assert got == volumes


@pytest.mark.parametrize("block", [4, 64])
def test_running_lines(spark, block):
    rnd = random.Random(block)
    rows = []
    for v in range(8):
        for s in sorted(rnd.sample(range(60), 35)):
            head = rnd.choice([f"Chapter {s}", "Intro", f"Solo{v}x{chr(97 + s % 26)}{chr(97 + s // 26)}"])
            foot = rnd.choice([str(s), "end note", f"foot{chr(97 + s % 26)}{chr(97 + s // 26)}"])
            rows.append((str(v), s, rnd.choice([f"{head}\nbody {s}\n{foot}", head, ""])))
    df = spark.createDataFrame(rows, "volid string, seq int, text string")
    w, m = 3, 2

    def key(line):
        return "".join(c for c in line if not c.isdigit()).lower().strip()

    expected = {}
    for v, s, t in rows:
        if not t:
            expected[v, s] = t
            continue
        lines = t.split("\n")

        def others(i):
            k = key(lines[i])
            return sum(
                1 for v2, s2, t2 in rows
                if v2 == v and s2 != s and abs(s2 - s) <= w and t2 and key(t2.split("\n")[i]) == k
            )

        keep = list(lines)
        drop_head, drop_foot = others(0) >= m, others(-1) >= m
        if drop_foot:
            keep = keep[:-1]
        if drop_head:
            keep = keep[1:] if len(keep) and (not drop_foot or len(lines) > 1) else keep
        expected[v, s] = "\n".join(keep)
    got = {(r["volid"], r["seq"]): r["text"] for r in pg.strip_running_lines(df, m, w, block).collect()}
    assert got == expected


def test_adjacent_pages(spark):
    df = spark.createDataFrame([("a", 1), ("a", 5), ("a", 9), ("b", 2)], "volid string, seq int")
    for block in (4, 4096):
        got = {tuple(r) for r in pg.adjacent_pages(df, block).collect()}
        assert got == {("a", 1, 5), ("a", 5, 9), ("a", 9, 9), ("b", 2, 2)}


def test_lines_and_hyphens(spark):
    assert one(spark, tx.normalise_lines(F.lit("  a b \n \t\n\n c  d\r\n"))) == "a b\nc  d"
    assert one(spark, tx.dehyphenate(F.lit("can-\ndle; lit\nwell-kept 5-\n6"))) == "candle;\nlit\nwell-kept 5-\n6"


def test_sentences(spark):
    text = F.lit('He said "Go." Then Dr. Who left! Really?) Yes')
    assert one(spark, tx.split_sentences(text)) == ['He said "Go."', "Then Dr.", "Who left!", "Really?)", "Yes"]
    assert one(spark, tx.split_sentences(text, ("Dr",))) == ['He said "Go."', "Then Dr. Who left!", "Really?)", "Yes"]
    assert one(spark, tx.flatten_sentences(F.array(F.lit("a\nb\tc"), F.lit("d")))) == "a b c\td"


def test_no_python_in_plan(spark):
    df = spark.createDataFrame(ROWS, "volid string, seq int, text string")
    plan = jobs.page_matches(df, [("x", "the")])._jdf.queryExecution().toString()
    assert "Python" not in plan
