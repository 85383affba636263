"""Language-model scores by cross-entropy difference of two matched n-gram models.

Both models are n-gram models of characters over one shared vocabulary: every lower-case
code point, and one symbol for what stands before a text.  The target model counts the
target documents, the background model all documents, scaled to as many tokens as the
target has, so that both smooth alike.  A document's score is its mean loss per token
under the target model less that under the background model: the lower, the more it is
like the target.

The n-grams are rows of a table that grows with the corpus and stays in the cluster.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirelens.llm.rows import written

ORDER = 4
#: Size of the shared vocabulary: what stands before a text, and all code points.
SYMBOLS = 0x110001
START = 0
#: Weight of the shorter context in counts.
PRIOR = 8.0
#: Characters handled at a time.
BLOCK = 1 << 20
#: The most frequent n-grams, which tasks look up in memory; the others are joined.
HEAD_ROWS = 2_000_000

_GRAM = [f"s{j}" for j in range(ORDER)]


def blocks(texts: list[str | None]) -> Iterator[tuple[list[int], list[str], list[str]]]:
    """(text numbers, pieces, what stands before each piece) of up to BLOCK characters."""
    number, piece, before, held = [], [], [], 0
    for i, text in enumerate(texts):
        text = (text or "").lower()
        for at in range(0, len(text), BLOCK):
            part = text[at : at + BLOCK]
            if held + len(part) > BLOCK and number:
                yield number, piece, before
                number, piece, before, held = [], [], [], 0
            number.append(i)
            piece.append(part)
            before.append(text[max(0, at - ORDER + 1) : at])
            held += len(part)
    if number:
        yield number, piece, before


def symbols(piece: list[str], before: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, where the n-gram that ends at each character begins, characters per piece."""
    context = ORDER - 1
    joined = "".join(x for pair in zip(before, piece) for x in pair)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    have = np.array([len(x) for x in before])
    size = np.array([len(x) for x in piece])
    # every piece gets a full context: what stands before it, else start symbols
    flat = np.full(int((size + context).sum()), START, np.int32)
    begin = np.cumsum(size + context) - (size + context)
    put = np.ones(len(flat), bool)
    missing = context - have
    pad = np.repeat(begin, missing) + np.arange(missing.sum()) - np.repeat(np.cumsum(missing) - missing, missing)
    put[pad] = False
    flat[put] = codes + 1
    inside = np.repeat(begin, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return flat, inside, size


def packed(flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, Callable]:
    """A 64-bit key of the n-gram at each place, and what gives a key's symbols back."""
    present = np.zeros(SYMBOLS, bool)
    present[flat] = True
    used = np.flatnonzero(present)
    local = (np.cumsum(present) - 1)[flat]
    pair, found = local[:-1] * len(used) + local[1:], None
    if len(used) > 1 << 16:
        found, pair = np.unique(pair, return_inverse=True)
    pair = pair.astype(np.uint64)

    def unpacked(key: np.ndarray) -> list[np.ndarray]:
        out = []
        for half in (key >> np.uint64(32), key & np.uint64(0xFFFFFFFF)):
            half = half.astype(np.int64) if found is None else found[half.astype(np.int64)]
            out += [used[half // len(used)], used[half % len(used)]]
        return out

    return (pair[at] << np.uint64(32)) | pair[at + 2], unpacked


def count_grams(docs: DataFrame) -> DataFrame:
    """``(s0 ... s3, target, total)``: counts over all of ``docs(text, is_target)``.

    A task adds up each block before rows leave it.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = np.array(batch["is_target"].to_pylist(), bool)
            for number, piece, before in blocks(batch["text"].to_pylist()):
                flat, at, size = symbols(piece, before)
                key, unpacked = packed(flat, at)
                own, n = np.unique(key[np.repeat(wanted[number], size)], return_counts=True)
                key, total = np.unique(key, return_counts=True)
                target = np.zeros(len(key), np.int64)
                target[np.searchsorted(key, own)] = n
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(s, pa.int32()) for s in unpacked(key)), pa.array(target), pa.array(total, pa.int64())],
                    names=[*_GRAM, "target", "total"],
                )

    return (
        docs.select("text", "is_target")
        .mapInArrow(work, ", ".join(f"{s} int" for s in _GRAM) + ", target long, total long")
        .groupBy(*_GRAM)
        .agg(F.sum("target").alias("target"), F.sum("total").alias("total"))
    )


@dataclass
class Models:
    #: (s0 ... s3, target, total) of all documents
    counts: DataFrame
    target: int
    total: int


def fit(docs: DataFrame) -> Models:
    """Both models of ``docs(text, is_target)``, from every document.

    Without a target document the target model is flat.
    """
    counts = written(count_grams(docs))
    target, total = counts.agg(F.sum("target"), F.sum("total")).first()
    return Models(counts, target or 0, total or 0)


def losses(models: Models, grams: DataFrame) -> DataFrame:
    """``(s0 ... s3, total, target_loss, background_loss)`` in nats, of the last symbol.

    Has all n-grams of the models and of ``grams``; one that was never counted is as
    likely as its shorter contexts make it.
    """
    scale = models.target / models.total if models.target else 1.0
    unseen = grams.select(*_GRAM, F.lit(0).cast("long").alias("target"), F.lit(0).cast("long").alias("total"))
    counts = written(
        models.counts.union(unseen).groupBy(*_GRAM).agg(F.sum("target").alias("target"), F.sum("total").alias("total"))
    )
    shorter = None
    for k in range(1, ORDER + 1):
        keys = _GRAM[ORDER - k :]
        n = counts if k == ORDER else counts.groupBy(*keys).agg(F.sum("target").alias("target"), F.sum("total").alias("total"))
        if shorter is None:
            shorter = n.select(
                *keys,
                ((F.col("target") + 1.0) / (models.target + SYMBOLS)).alias("p"),
                ((F.col("total") * scale + 1.0) / (models.total * scale + SYMBOLS)).alias("q"),
            )
            continue
        context = Window.partitionBy(*keys[:-1])
        shorter = (
            n.withColumn("_target", F.sum("target").over(context))
            .withColumn("_total", F.sum("total").over(context))
            .join(shorter, keys[1:])
            .select(
                *keys, "total",
                ((F.col("target") + PRIOR * F.col("p")) / (F.col("_target") + PRIOR)).alias("p"),
                ((F.col("total") * scale + PRIOR * F.col("q")) / (F.col("_total") * scale + PRIOR)).alias("q"),
            )
        )
        if k < ORDER:
            shorter = shorter.drop("total")
    return written(
        shorter.select(*_GRAM, "total", (-F.log("p")).alias("target_loss"), (-F.log("q")).alias("background_loss"))
    )


class Head:
    """Losses of the most frequent n-grams, in memory."""

    def __init__(self, table: pa.Table):
        s = [table[c].to_numpy() for c in _GRAM]
        used, times = np.unique(np.concatenate(s), return_counts=True)
        used = used[np.argsort(-times, kind="stable")][: (1 << 16) - 1]
        #: 16 bits for a symbol; 0 for one that no n-gram here has
        self.short = np.zeros(SYMBOLS, np.uint16)
        self.short[used] = np.arange(1, len(used) + 1)
        key, inside = self.keys(s)
        order = np.flatnonzero(inside)[np.argsort(key[inside])]
        self.key = key[order]
        self.loss = np.stack([table[c].to_numpy()[order] for c in ("target_loss", "background_loss")])

    def keys(self, s: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        key, inside = np.zeros(len(s[0]), np.uint64), np.ones(len(s[0]), bool)
        for x in s:
            short = self.short[x]
            key = (key << np.uint64(16)) | short.astype(np.uint64)
            inside &= short > 0
        return key, inside

    def find(self, s: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Losses of n-grams, 0 for those that are not here; and which are."""
        key, inside = self.keys(s)
        if not len(self.key):
            return np.zeros((2, len(key))), np.zeros(len(key), bool)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        inside &= self.key[at] == key
        return np.where(inside, self.loss[:, at], 0.0), inside


def _lists(n: int, parts: list[list[np.ndarray]]) -> pa.Array:
    """Per text a list of (s0 ... s3, n), from parts of (text, s0 ... s3, n)."""
    empty = [np.zeros(0, np.int64)] * (ORDER + 2)
    text, *columns = (np.concatenate(x) for x in zip(empty, *parts))
    order = np.argsort(text, kind="stable")
    edges = np.searchsorted(text[order], np.arange(n + 1))
    kinds = [pa.int32()] * ORDER + [pa.int64()]
    rows = [pa.array(c[order], k) for c, k in zip(columns, kinds)]
    return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.StructArray.from_arrays(rows, names=[*_GRAM, "n"]))


def score(docs: DataFrame, models: Models, fitted: bool = False) -> DataFrame:
    """``docs`` with n_tokens, target_loss, background_loss and lm_score, per whole text.

    ``fitted`` tells that the models were fitted on these documents (and perhaps more), so
    that their n-grams need not be counted again; columns of ``docs`` with the new names
    are replaced.  Losses are means per token in nats; null and empty texts have no token and null
    losses.  Rows are scored one by one, repeated ones and ones without an id too.
    Frequent n-grams are looked up in memory, and no join has a hot one; where the table
    is larger, a text's other n-grams, distinct and counted, are joined to it.
    """
    grams = models.counts.limit(0) if fitted else count_grams(docs.select("text", F.lit(False).alias("is_target")))
    table = losses(models, grams)
    whole = table.count() <= HEAD_ROWS
    head = table if whole else table.orderBy(F.desc("total"), *_GRAM).limit(HEAD_ROWS)
    shared = docs.sparkSession.sparkContext.broadcast(Head(head.drop("total").toArrow()))

    def work(texts: pa.Array) -> pa.Array:
        m = shared.value
        n = np.zeros(len(texts), np.int64)
        sums = np.zeros((2, len(texts)))
        rest = []
        for number, piece, before in blocks(texts.to_pylist()):
            flat, at, size = symbols(piece, before)
            key, unpacked = packed(flat, at)
            key, which = np.unique(key, return_inverse=True)
            found = unpacked(key)
            loss, inside = m.find(found)
            edge = np.concatenate([[0], np.cumsum(size)])
            np.add.at(n, number, size)
            for row in range(2):
                total = np.concatenate([[0.0], np.cumsum(loss[row][which])])
                np.add.at(sums[row], number, np.diff(total[edge]))
            if not inside.all():
                out = ~inside[which]
                text = np.repeat(np.array(number), size)[out]
                pair, times = np.unique(text * len(key) + which[out], return_counts=True)
                text, gram = np.divmod(pair, len(key))
                rest.append([text, *(s[gram] for s in found), times])
        return pa.StructArray.from_arrays(
            [pa.array(n), pa.array(sums[0]), pa.array(sums[1]), _lists(len(texts), rest)],
            names=["n", "target", "background", "rest"],
        )

    gram = ", ".join(f"{s}: int" for s in _GRAM)
    scored = F.arrow_udf(work, f"n long, target double, background double, rest array<struct<{gram}, n: bigint>>")
    own = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]
    rows = docs.select(F.struct(*own).alias("_doc"), scored(F.col("text")).alias("_lm"))
    if not whole:
        # numbered once: the numbers are read from the written rows
        rows = written(rows.withColumn("_number", F.monotonically_increasing_id()))
        sums = (
            rows.select("_number", F.inline("_lm.rest"))
            .join(table.drop("total"), _GRAM)
            .groupBy("_number")
            .agg(
                F.sum(F.col("n") * F.col("target_loss")).alias("_target"),
                F.sum(F.col("n") * F.col("background_loss")).alias("_background"),
            )
        )
        rows = rows.join(sums, "_number", "left")
    target, background = (
        (F.col(f"_lm.{c}") + (F.lit(0.0) if whole else F.coalesce(f"_{c}", F.lit(0.0))))
        / F.nullif(F.col("_lm.n"), F.lit(0))
        for c in ("target", "background")
    )
    new = ("n_tokens", "target_loss", "background_loss", "lm_score")
    return rows.select(
        *[F.col(f"_doc.c{i}").alias(c) for i, c in enumerate(docs.columns) if c not in new],
        F.col("_lm.n").alias("n_tokens"),
        target.alias("target_loss"),
        background.alias("background_loss"),
        (target - background).alias("lm_score"),
    )
