"""Counting regex keywords per page."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelens.functions.literals import LEAST, required_literals
from quirelens.functions.text import EDGE_L, EDGE_R
from quirelens.operators.scale import BROADCAST_ROWS, dealt_rows, lookup_join, row_lookup

Patterns = Sequence[tuple[str, str]]

# Lists up to this length are tried whole on every page; longer ones go through an index.
BLOCK_PATTERNS = 500
_WHOLE_WORD = re.compile(rf"(\(\?i\))?{re.escape(EDGE_L)}([A-Za-z]+){re.escape(EDGE_R)}")


def pattern_list(patterns: Patterns | DataFrame) -> list[tuple[str, str]]:
    """The user's keyword list as literals; it becomes part of the plan."""
    if isinstance(patterns, DataFrame):
        patterns = [(r["name"], r["pattern"]) for r in patterns.select("name", "pattern").collect()]
    return list(patterns)


def split_patterns(df: DataFrame, patterns: Patterns | DataFrame) -> tuple[Patterns, DataFrame]:
    """The patterns that can be counted, and ``(name, pattern, reason)`` of the others."""
    listed = pattern_list(patterns)
    reasons = dict(check_patterns(df, listed))
    good = [(n, p) for n, p in listed if n not in reasons]
    bad = [(n, p, reasons[n]) for n, p in listed if n in reasons]
    return good, df.sparkSession.createDataFrame(bad, "name string, pattern string, reason string")


def check_patterns(df: DataFrame, patterns: Patterns) -> list[tuple[str, str]]:
    """Patterns the Java regex engine refuses, with its message; run before the job."""
    jvm = df.sparkSession._jvm
    bad = []
    for name, pattern in patterns:
        try:
            jvm.java.util.regex.Pattern.compile(pattern)
        except Exception as err:  # noqa: BLE001 - py4j wraps the Java exception
            bad.append((name, str(getattr(err, "java_exception", err)).splitlines()[0]))
    return bad


def _counts(text: Column, patterns: Patterns) -> list[Column]:
    return [F.regexp_count(text, F.lit(p)).cast("int") for _, p in patterns]


def count_keywords(
    pages: DataFrame,
    patterns: Patterns,
    keys: Sequence[str] = ("volid", "seq"),
    max_broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Long form ``(keys, keyword, n)``: one row per page and keyword that occurs.

    Every regex runs once per page: the counts sit inside a generator, which a
    filter cannot be pushed through, and only hits leave it.  With more than
    ``BLOCK_PATTERNS`` patterns those that are whole words are counted as words
    (``word_hits``), and of the others a page runs only those whose letters it holds
    (``page_hits``).
    """
    patterns = pattern_list(patterns)
    if len(patterns) > BLOCK_PATTERNS:
        words = [(name, p, word) for name, p in patterns if (word := whole_word(p))]
        if words:
            others = [(name, p) for name, p in patterns if not whole_word(p)]
            found = word_hits(pages.select(*keys, "text"), words, keys, max_broadcast_rows)
            return found.union(count_keywords(pages, others, keys, max_broadcast_rows)) if others else found
        hit = page_hits(pages.select(*keys, "text"), patterns, max_broadcast_rows)
        return hit.select(*keys, F.inline("_hits")).drop("place")
    hits = F.filter(
        F.array(
            *[
                F.struct(F.lit(name).alias("keyword"), n.alias("n"))
                for (name, _), n in zip(patterns, _counts(F.col("text"), patterns))
            ]
        ),
        lambda h: h["n"] > 0,
    )
    return pages.select(*keys, F.inline(hits))


def whole_word(pattern: str) -> str | None:
    """The form of a pattern that is an ASCII word between the edges of a word, else None.

    Its matches are the words (runs of ``WORD_CHAR``) that are equal to it: as they stand,
    marked with ``=``, or without regard to the case of ASCII letters.
    """
    found = _WHOLE_WORD.fullmatch(pattern)
    return None if not found else found[2].lower() if found[1] else f"={found[2]}"


def word_hits(
    pages: DataFrame,
    words: Sequence[tuple[str, str, str]],
    keys: Sequence[str],
    max_broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """``count_keywords`` for patterns that are whole words, ``(name, pattern, form)``.

    No regex runs per pattern: the words of a page are taken once, meet the table of
    forms and are counted, in a time that grows with the words and the hits.
    """
    table = pages.sparkSession.createDataFrame(
        [(form, i, name) for i, (name, _, form) in enumerate(words)], "form string, place int, keyword string"
    )
    found = F.regexp_extract_all("text", F.lit(f"{EDGE_L}[A-Za-z]+{EDGE_R}"), F.lit(0))
    lower, cased = F.transform(found, F.lower), F.transform(found, lambda w: F.concat(F.lit("="), w))
    marked = {form.startswith("=") for _, _, form in words}
    forms = F.concat(*[f for f, mark in ((lower, False), (cased, True)) if mark in marked])
    stream = dealt_rows(pages).select("_row", *keys, F.explode(forms).alias("form"))
    return (
        lookup_join(stream, table, "form", "inner", ["_row"], max_broadcast_rows)
        .groupBy("_row", *keys, "place", "keyword")
        .agg(F.count("*").cast("int").alias("n"))
        .select(*keys, "keyword", "n")
    )


def literal_index(pages: DataFrame, patterns: Patterns) -> tuple[DataFrame, list[int]]:
    """``(form, literal, place, keyword, pattern)`` and the places of patterns without a key.

    A pattern is filed under three neighbouring letters of a run that every match of it
    holds (one per alternative), the three that fewest patterns share.
    """
    runs = [(i, required_literals(p)) for i, (_, p) in enumerate(patterns)]
    threes = lambda run: [run[j : j + LEAST] for j in range(len(run) - LEAST + 1)]
    shared = Counter(t for _, rs in runs for r in rs or () for t in set(threes(r)))
    rows = [
        (min(threes(r), key=lambda t: (shared[t], t)), r, i, *patterns[i])
        for i, rs in runs
        for r in sorted(set(rs or ()))
    ]
    table = pages.sparkSession.createDataFrame(
        rows, "form string, literal string, place int, keyword string, pattern string"
    )
    return table, [i for i, rs in runs if rs is None]


def page_hits(
    pages: DataFrame, patterns: Patterns, max_broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """``pages`` with ``_hits``: ``(place, keyword, n)`` of the patterns that occur, in order.

    An inverted index of letters picks the candidates of a page in one read, however many
    patterns there are; a candidate whose whole run of letters the page holds is then
    counted by its regex.  Patterns without a run of letters are tried on every page.
    """
    index, everywhere = literal_index(pages, patterns)
    lower = F.lower(F.coalesce("text", F.lit("")))
    forms = F.regexp_extract_all(lower, F.lit(rf"(?=([a-z]{{{LEAST}}}))"), F.lit(1))
    found = row_lookup(
        pages, forms, index, F.struct("literal", "place", "keyword", "pattern"), max_broadcast_rows
    )
    # the lower-case text and the candidates are made once, behind a generator
    held = found.select(
        *[F.col(f"`{c}`") for c in pages.columns],
        F.inline(F.array(F.struct(lower.alias("_lower"), F.col("hits").alias("_found")))),
    )
    able = F.array_distinct(
        F.transform(
            F.filter("_found", lambda h: F.contains("_lower", h["literal"])),
            lambda h: F.struct(h["place"].alias("place"), h["keyword"].alias("keyword"), h["pattern"].alias("pattern")),
        )
    )
    counted = F.transform(
        able,
        lambda h: F.struct(
            h["place"].alias("place"), h["keyword"].alias("keyword"),
            F.regexp_count("text", h["pattern"]).cast("int").alias("n"),
        ),
    )
    if everywhere:
        tried = [patterns[i] for i in everywhere]
        counted = F.concat(counted, F.array(*[
            F.struct(F.lit(i).alias("place"), F.lit(name).alias("keyword"), n.alias("n"))
            for i, (name, _), n in zip(everywhere, tried, _counts(F.col("text"), tried))
        ]))
    hits = F.array_sort(F.filter(counted, lambda h: h["n"] > 0))
    return held.select(
        *[F.col(f"`{c}`") for c in pages.columns], F.explode(F.array(hits)).alias("_hits")
    )


def wide_matches(pages: DataFrame, patterns: Patterns) -> DataFrame:
    """``text, volid, seq`` plus one count column per keyword, for pages with a match."""
    patterns = pattern_list(patterns)
    if not patterns:
        return pages.select("text", "volid", "seq").where(F.lit(False))
    if len(patterns) > BLOCK_PATTERNS:
        counted = page_hits(pages.select("text", "volid", "seq"), patterns).where(F.size("_hits") > 0)
        # zeros up to each hit, the hit, and zeros after the last one
        zeros = lambda n: F.array_repeat(F.lit(0), n)
        before = lambda i: F.coalesce(F.get("_hits", i - 1)["place"], F.lit(-1))
        filled = F.flatten(F.transform(
            "_hits", lambda h, i: F.concat(zeros(h["place"] - before(i) - 1), F.array(h["n"]))))
        rest = zeros(F.lit(len(patterns) - 1) - F.element_at("_hits", -1)["place"])
        counted = counted.select("text", "volid", "seq", F.explode(F.array(F.concat(filled, rest))).alias("_n"))
    else:
        counted = pages.select(
            "text", "volid", "seq",
            F.explode(F.array(F.array(*_counts(F.col("text"), patterns)))).alias("_n"),
        ).where(F.exists("_n", lambda n: n > 0))
    return counted.select(
        "text", "volid", "seq",
        *[
            F.coalesce(F.get("_n", F.lit(i)), F.lit(0)).alias(name)
            for i, (name, _) in enumerate(patterns)
        ],
    )


def pivot_matches(hits: DataFrame, patterns: Patterns) -> DataFrame:
    """The wide table from the long one (no page text)."""
    names = [name for name, _ in patterns]
    return hits.groupBy("volid", "seq").pivot("keyword", names).agg(F.sum("n").cast("int")).na.fill(0, names)


def any_match(hits: DataFrame) -> DataFrame:
    """Pages with at least one keyword."""
    return hits.where(F.col("n") > 0).select("volid", "seq").distinct()


def keyword_totals(hits: DataFrame) -> DataFrame:
    """Hits and matched pages per keyword."""
    return hits.groupBy("keyword").agg(
        F.sum("n").alias("hits"), F.count("*").alias("pages")
    )
