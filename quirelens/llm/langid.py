"""Language identification by the nearest of several centroids per language.

Texts become normalised TF-IDF vectors of hashed letter n-grams; each language is
split into clusters by spherical k-means; a text takes the language of the centroid
with the largest cosine and is rejected when that centroid is too far.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelens.llm.rows import bounded_sample

DIMENSIONS = 1 << 14
#: Labelled rows the model is fitted on, over all languages together.
FIT_ROWS = 4_000
CENTROIDS = 4
#: A text is rejected when its cosine is below this part of the least cosine that
#: texts of its language and length class had in fitting.
SLACK = 0.5
#: Characters turned into n-grams at a time.
BLOCK = 1 << 20
UNKNOWN = "und"

_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def grams(text: str | None) -> Iterator[np.ndarray]:
    """Hashed 1-, 2- and 3-grams of the letters of the whole text, block by block.

    Letters are lower-cased, every run of anything else is one gap; the text begins and
    ends with a gap.  Blocks overlap by two letters, so no gram is lost or counted twice.
    """
    if not text:
        return
    letter = _is_letter()
    tail = np.zeros(1, np.uint64)
    seen = False
    for at in range(0, len(text), BLOCK):
        last = at + BLOCK >= len(text)
        codes = np.frombuffer(
            text[at : at + BLOCK].lower().encode("utf-32-le", "surrogatepass"), "<u4"
        )
        codes = np.where(letter[codes], codes, 0).astype(np.uint64)
        codes = np.concatenate([tail, codes, np.zeros(int(last), np.uint64)])
        new = len(tail)
        keep = np.ones(len(codes), bool)
        keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
        keep[:new] = True
        codes = codes[keep]
        if not codes.any():
            tail = codes[-1:]
            continue
        seen = True
        one = codes[new:]
        one = one[one != 0]
        two = (codes[:-1] << np.uint64(21)) | codes[1:]
        two = two[max(0, new - 1) :]
        parts = [one, two | np.uint64(1 << 62)]
        if len(codes) > 2:
            three = (codes[:-2] << np.uint64(42)) | (codes[1:-1] << np.uint64(21)) | codes[2:]
            parts.append(three[max(0, new - 2) :])
        key = np.concatenate(parts)
        key = key ^ (key >> np.uint64(29))
        key = key * np.uint64(0x9E3779B97F4A7C15)
        yield (key >> np.uint64(64 - 14)).astype(np.int64)
        tail = codes[-2:]
    if not seen:
        return


def counts(texts: list[str | None]) -> np.ndarray:
    """(texts, DIMENSIONS) n-gram counts."""
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    for i, text in enumerate(texts):
        for block in grams(text):
            out[i] += np.bincount(block, minlength=DIMENSIONS)
    return out


def length_class(n: np.ndarray) -> np.ndarray:
    """Number of n-grams by powers of four, 0 to 7."""
    return np.clip(np.log2(np.maximum(n, 1)) // 2, 0, 7).astype(int)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # (all centroids, DIMENSIONS)
    owner: np.ndarray  # language of each centroid
    floor: np.ndarray  # (languages, 8) least cosine in fitting by length class

    def vectors(self, n: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
        """Normalised vectors of n-gram counts; ``out`` may be the counts themselves."""
        x = np.sqrt(n, out=out)
        x *= self.idf
        norm = np.sqrt(np.einsum("ij,ij->i", x, x))
        x /= np.maximum(norm, 1e-12)[:, None]
        return x

    def nearest(self, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language index (-1 without letters), cosine, and whether it is rejected."""
        total = n.sum(1)
        if not len(self.languages):
            return np.full(len(n), -1), np.zeros(len(n)), np.ones(len(n), bool)
        near = self.vectors(n) @ self.centroids.T
        best = near.argmax(1)
        cosine = np.clip(near[np.arange(len(n)), best], 0.0, 1.0).astype(float)
        language = np.where(total > 0, self.owner[best], -1)
        least = self.floor[self.owner[best], length_class(total)]
        return language, cosine, (language < 0) | (cosine < SLACK * least)


def _mean(x: np.ndarray, rows: np.ndarray, width: int = 1 << 10) -> np.ndarray:
    """Mean of some rows, a block of columns at a time: they are never copied as a whole."""
    return np.concatenate([x[rows, at : at + width].mean(0) for at in range(0, x.shape[1], width)])


def _clusters(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; starts from texts far from each other."""
    chosen = [0]
    near = x @ x[0]
    while len(chosen) < min(k, len(x)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, x @ x[chosen[-1]])
    c = x[chosen]
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        means = [_mean(x, own == j) if (own == j).any() else c[j] for j in range(len(c))]
        c = np.stack([m / max(np.linalg.norm(m), 1e-12) for m in means]).astype(np.float32)
    return c


def fit(labelled: DataFrame, rows: int = FIT_ROWS, centroids: int = CENTROIDS) -> Model:
    """Model of ``labelled(text, lang)``, from at most ``rows`` of its rows.

    Null labels and texts without a letter take no part.  N-grams are counted on the
    executors; the driver gets at most ``rows`` sparse vectors of DIMENSIONS entries.
    """
    usable = labelled.select("text", "lang").where(
        F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")
    )

    def sparse(batches):
        for batch in batches:
            for text, lang in zip(batch["text"].to_pylist(), batch["lang"].to_pylist()):
                n = counts([text])[0]
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang], pa.string()),
                        pa.array([at.astype("<i4").tobytes()], pa.binary()),
                        pa.array([n[at].astype("<f4").tobytes()], pa.binary()),
                    ],
                    names=["lang", "at", "n"],
                )

    got = (
        bounded_sample(usable, "lang", rows)
        .mapInArrow(sparse, "lang string, at binary, n binary")
        .toArrow()
        .to_pylist()
    )
    got = sorted((r for r in got if r["at"]), key=lambda r: (r["lang"], r["at"], r["n"]))
    languages = sorted({r["lang"] for r in got})
    seen = np.zeros(DIMENSIONS)
    for r in got:
        seen[np.frombuffer(r["at"], "<i4")] += 1
    idf = (np.log((1 + len(got)) / (1 + seen)) + 1).astype(np.float32)
    model = Model(
        languages, idf, np.zeros((0, DIMENSIONS), np.float32), np.zeros(0, int),
        np.zeros((len(languages), 8)),
    )
    everything, centres, owner = [], [], []
    for j, language in enumerate(languages):
        n = np.zeros((sum(r["lang"] == language for r in got), DIMENSIONS), np.float32)
        for row, r in zip(n, (r for r in got if r["lang"] == language)):
            row[np.frombuffer(r["at"], "<i4")] = np.frombuffer(r["n"], "<f4")
        size = length_class(n.sum(1))
        # the driver holds one dense matrix, of one language, at a time
        x = model.vectors(n, out=n)
        c = _clusters(x, centroids)
        centres.append(c)
        owner += [j] * len(c)
        everything.append((size, (x @ c.T).max(1)))
        del n, x
    if not languages:
        return model
    model.centroids, model.owner = np.concatenate(centres), np.asarray(owner)
    for j, (size, cosine) in enumerate(everything):
        for k in range(8):
            # the least of this and the shorter classes; of all, where fitting saw none
            own = cosine[size <= k]
            model.floor[j, k] = (own if len(own) else cosine).min()
    return model


def identify(docs: DataFrame, model: Model, batch: int = 64) -> DataFrame:
    """All columns of ``docs`` with ``lang_pred``, ``lang_score`` and ``lang_rejected``.

    Only the whole text is read.  Null text and text without a letter give ``und``, 0.0
    and a rejection; other texts always get a learned language, and are rejected when
    they are further from its centroids than texts like them should be.  Rows are judged
    one by one, repeated ones too; columns of ``docs`` with the new names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(texts: pa.Array) -> pa.Array:
        m = shared.value
        names = [*m.languages, UNKNOWN]
        lang, score, rejected = [], [], []
        for at in range(0, len(texts), batch):
            own, cosine, far = m.nearest(counts(texts.slice(at, batch).to_pylist()))
            lang += [names[j] for j in own]
            score += [float(c) if j >= 0 else 0.0 for j, c in zip(own, cosine)]
            rejected += far.tolist()
        return pa.StructArray.from_arrays(
            [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())],
            names=["lang", "score", "rejected"],
        )

    found = F.arrow_udf(predict, "lang string, score double, rejected boolean")
    new = ("lang_pred", "lang_score", "lang_rejected")
    rest = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]
    kept = [F.col(f"_doc.c{i}").alias(c) for i, c in enumerate(docs.columns) if c not in new]
    return docs.select(F.struct(*rest).alias("_doc"), found(F.col("text")).alias("_found")).select(
        *kept,
        F.col("_found.lang").alias("lang_pred"),
        F.col("_found.score").alias("lang_score"),
        F.col("_found.rejected").alias("lang_rejected"),
    )
