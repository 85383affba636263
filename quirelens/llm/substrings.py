"""Substring deduplication by words: windows that already stand earlier are removed."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelens.llm import arrays, superkmers
from quirelens.llm.rows import keyed

#: Words in a window.
WINDOW = 20
#: Words in a minimiser: long enough that only shared passages share it.
SEED = 4


def _symbols(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, ...]:
    start, end, text = arrays.find_words(data, edges)
    return start, end, text, arrays.span_hashes(data, start, end)


def _classes(length: int):
    def classes(value, first, width, window):
        """Windows are equal when both of two 64-bit hashes of their words are."""
        a = arrays.rolled(value, length)[window]
        b = arrays.rolled(value, length, 0xD6E8FEB86659FD93)[window]
        order = np.lexsort((b, a))
        new = np.ones(len(order), bool)
        new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
        label = np.empty(len(order), np.int64)
        label[order] = np.cumsum(new)
        return label

    return classes


def windows(length: int = WINDOW) -> superkmers.Windows:
    seed = max(1, min(SEED, length // 2))
    return superkmers.Windows(length, seed, _symbols, _classes(length), across=False)


def _kept(text: bytes, spans: np.ndarray) -> tuple[int, int, bytes]:
    data = np.frombuffer(text, np.uint8)
    start, end, _ = arrays.find_words(data, np.array([0, len(data)]))
    words = [text[a:b] for a, b in zip(start.tolist(), end.tolist())]
    kept, at = [], 0
    for a, b in spans.tolist():
        kept += words[at:a]
        at = b
    kept += words[at:]
    return len(words), len(words) - len(kept), b" ".join(kept)


def remove_repeated_words(docs: DataFrame, length: int = WINDOW) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept)``: words outside windows that stand earlier.

    A window is ``length`` consecutive words of one document, unchanged; earlier means a
    smaller doc_id, or the same document and an earlier start.  All windows are judged
    on the input.  Null text has no words.  Rows that share a doc_id, or have none, are
    documents of their own in the order of their texts, those without an id last.
    Other columns are dropped.
    """
    rows = keyed(docs)
    cut = superkmers.cut("n_words long, n_removed long, kept binary", _kept)
    return (
        superkmers.with_spans(rows, windows(length))
        .select("doc_id", cut(F.col("text"), F.col("spans")).alias("_"))
        .select("doc_id", "_.*")
    )


#: The query in SQL.
REMOVED_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
win AS (
  SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + {WINDOW - 1}), ' ')) AS k
  FROM (SELECT doc_id, w, UNNEST(range(1, len(w) - {WINDOW - 2})) AS i FROM d WHERE len(w) >= {WINDOW})
),
later AS (
  SELECT doc_id, i FROM (
    SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM win
  ) WHERE r > 1
),
word AS (SELECT doc_id, UNNEST(w) AS t, generate_subscripts(w, 1) AS pos FROM d),
marked AS (
  SELECT word.doc_id, pos, t,
         coalesce(max(later.i) OVER (PARTITION BY word.doc_id ORDER BY pos) > pos - {WINDOW}, false) AS gone
  FROM word LEFT JOIN later ON later.doc_id = word.doc_id AND later.i = word.pos
),
kept AS (
  SELECT doc_id, count(*) AS n, count(CASE WHEN gone THEN 1 END) AS n_removed,
         string_agg(CASE WHEN NOT gone THEN t END, ' ' ORDER BY pos) AS kept
  FROM marked GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""
