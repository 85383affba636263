"""Line deduplication: repeated runs of lines from a suffix array built by prefix doubling.

A document is a sequence of line ids.  Level 0 ranks single lines; each later level
ranks twice as many lines by the pair (rank at i, rank at i + width), sorted over the
cluster, so ranks keep the order of the suffixes.

A run is worth deleting when its lines that are not blank have ``min_chars`` characters
together.  Whatever run repeats, each of its lines is in the shortest such run that
starts, or that ends, at some line of it; so two depths for each line are enough for all
runs of any length.  The suffixes that agree to a depth of m lines are an interval of the
longest common prefix; its name is m and the ranks of the first and the last 2 ** k of
the m lines, 2 ** k <= m < 2 ** (k + 1).  All suffixes of an interval but the first one
repeat it, and what they cover together are the maximal repeated runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirelens.llm.rows import keyed, own_tables, written

#: Characters that a repeated run of lines must have to be deleted.
MIN_CHARS = 200


def _ranked(places: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """``places(_row, pos, chars, *key)`` whose key repeats, with ``rank`` and ``first``.

    Keys are counted before they are sorted, so a key in a third of all places is one
    row; ranks rise with the keys, and the join back can be split where a key is hot.
    """
    intervals = (
        places.groupBy(*key)
        .agg(F.count("*").alias("_n"), F.min(F.struct("_row", "pos")).alias("_first"))
        .where("_n > 1")
        .orderBy(*key)
        .select(*key, F.monotonically_increasing_id().alias("rank"), "_first")
    )
    # sorted numbering is fixed by writing it: a task run again could number otherwise
    return written(
        places.join(written(intervals), list(key)).select(
            "_row", "pos", "chars", "rank",
            (F.struct("_row", "pos") == F.col("_first")).alias("first"),
        )
    )


def _depths(lines: DataFrame, min_chars: int) -> DataFrame:
    """``(_row, pos, m)``: for each line the shortest runs of m > 1 lines that start or end
    there and have ``min_chars`` characters or more.

    ``lines(_row, pos, chars)`` with 0 characters for a blank line.  A line belongs to the
    shortest run from a line on if fewer characters than that stand between the starts of
    the two, which is a range of running sums; so no run is ever walked.
    """
    order = Window.partitionBy("_row").orderBy("pos")
    summed = lines.select("_row", "pos", "chars", F.sum("chars").over(order).alias("_sum"))
    summed = summed.withColumn("_before", F.col("_sum") - F.col("chars"))
    ahead = Window.partitionBy("_row").orderBy("_before").rangeBetween(0, min_chars - 1)
    behind = Window.partitionBy("_row").orderBy("_sum").rangeBetween(-(min_chars - 1), 0)
    found = (
        summed.withColumn("_last", F.max("pos").over(ahead))
        .withColumn("_end", F.max("_sum").over(ahead))
        .withColumn("_first", F.min("pos").over(behind))
        .withColumn("_begin", F.min("_before").over(behind))
    )
    from_here = F.struct(F.col("pos").alias("pos"), (F.col("_last") - F.col("pos") + 1).alias("m"),
                         (F.col("_end") - F.col("_before")).alias("c"))
    to_here = F.struct(F.col("_first").alias("pos"), (F.col("pos") - F.col("_first") + 1).alias("m"),
                       (F.col("_sum") - F.col("_begin")).alias("c"))
    return (
        found.where(F.col("chars") < min_chars)
        .select("_row", F.inline(F.array(from_here, to_here)))
        .where((F.col("m") > 1) & (F.col("c") >= min_chars))
        .select("_row", "pos", "m")
        .distinct()
    )


def repeated_runs(rows: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``(_row, begin, end)``: maximal runs of lines [begin, end) that stand earlier too.

    A run is what repeated runs of at least ``min_chars`` characters cover together, each
    of which also starts earlier, in a smaller row or further up in the same one.  Blank
    lines belong to runs and have no characters; lines are compared as they are.
    """
    with own_tables(rows.sparkSession) as result:
        blank = F.translate("line", " \t\x0b\x0c\r", "") == ""
        split = rows.select("_row", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
        lines = written(
            split.select(
                "_row", "pos", F.when(blank, 0).otherwise(F.length("line")).cast("long").alias("chars"),
                F.xxhash64("line").alias("a"), F.xxhash64(F.lit(1), "line").alias("b"),
            )
        )
        depths = written(_depths(lines.select("_row", "pos", "chars"), min_chars))
        level = _ranked(lines, ("a", "b"))
        found = level.where(~F.col("first") & (F.col("chars") >= min_chars)).select(
            "_row", F.col("pos").alias("begin"), (F.col("pos") + 1).alias("end")
        )
        # the levels that some depth is named by
        step = F.length(F.bin("m")) - 1
        named = {1 << r["step"] for r in depths.select(step.alias("step")).distinct().collect()}
        width = 1
        while any(width < w for w in named) and not level.isEmpty():
            after = level.select("_row", (F.col("pos") - width).alias("pos"), F.col("rank").alias("after"))
            width *= 2
            pairs = level.withColumnRenamed("rank", "before").join(after, ["_row", "pos"])
            level = _ranked(pairs.select("_row", "pos", "chars", "before", "after"), ("before", "after"))
            if width not in named:
                continue
            front = level.select("_row", "pos", F.col("rank").alias("front"))
            back = level.select("_row", (F.col("pos") + width).alias("_end"), F.col("rank").alias("back"))
            own = (
                depths.where((F.col("m") >= width) & (F.col("m") < 2 * width))
                .join(front, ["_row", "pos"])
                .withColumn("_end", F.col("pos") + F.col("m"))
                .join(back, ["_row", "_end"])
            )
            place = F.struct("_row", "pos")
            first = own.groupBy("m", "front", "back").agg(F.min(place).alias("_first"), F.count("*").alias("_n"))
            repeated = own.join(written(first.where("_n > 1")), ["m", "front", "back"]).where(place != F.col("_first"))
            found = found.union(
                written(repeated.select("_row", F.col("pos").alias("begin"), F.col("_end").alias("end")))
            )
        order = Window.partitionBy("_row").orderBy("begin", "end")
        reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
        starts = F.when(F.col("begin") <= reach, 0).otherwise(1)
        return result(
            found.withColumn("_new", starts)
            .withColumn("_run", F.sum("_new").over(order))
            .groupBy("_row", "_run")
            .agg(F.min("begin").alias("begin"), F.max("end").alias("end"))
            .drop("_run")
        )


def _with_kept(rows: DataFrame, min_chars: int) -> DataFrame:
    """``rows`` with ``_runs`` (null without any) and ``_kept``, the text that is left."""
    runs = (
        repeated_runs(rows.select("_row", "text"), min_chars)
        .groupBy("_row")
        .agg(F.sort_array(F.collect_list(F.struct("begin", "end"))).alias("_runs"))
    )
    lines = F.split("text", "\n")
    gaps = F.zip_with(
        F.concat(F.array(F.lit(0)), F.col("_runs.end")),
        F.concat(F.col("_runs.begin"), F.array(F.size(lines))),
        lambda begin, end: F.slice(lines, begin + 1, end - begin),
    )
    return rows.join(runs, "_row", "left").withColumn(
        "_kept",
        F.when(F.col("_runs").isNull(), F.col("text")).otherwise(F.array_join(F.flatten(gaps), "\n")),
    )


def line_report(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``(doc_id, n_lines, n_removed, n_runs, kept)``, one row per document.

    Null text has no line and stays null; empty text is one blank line.  Rows that share
    a doc_id, or have none, are documents of their own in the order of their texts, those
    without an id last.  Other columns are dropped.
    """
    removed = F.aggregate(
        F.col("_runs"), F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["begin"]
    )
    return _with_kept(keyed(docs), min_chars).select(
        "doc_id",
        F.when(F.col("text").isNull(), 0)
        .otherwise(F.size(F.split("text", "\n")))
        .cast("long")
        .alias("n_lines"),
        F.coalesce(removed, F.lit(0)).cast("long").alias("n_removed"),
        F.when(F.col("_runs").isNull(), 0).otherwise(F.size("_runs")).cast("long").alias("n_runs"),
        F.col("_kept").alias("kept"),
    )


def drop_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` without later copies of repeated runs; ``n_chars``, if there, follows.

    A document that repeated runs cover from end to end goes; every other row stays,
    with all its columns, and unchanged where nothing in it repeats.
    """
    rows = _with_kept(keyed(docs, whole=True), min_chars)
    columns = []
    for c in docs.columns:
        column = F.col(f"_doc.`{c}`")
        if c == "text":
            column = F.col("_kept")
        elif c == "n_chars":
            column = F.when(F.col("_runs").isNull(), column).otherwise(
                F.length("_kept").cast(docs.schema[c].dataType)
            )
        columns.append(column.alias(c))
    return rows.where("_runs is null or _kept <> ''").select(*columns)


#: The same in SQL: each shortest run of MIN_CHARS characters from a line on, and up to a
#: line, that is not the first of its content.
REPORT_SQL = f"""
WITH line AS (
  SELECT doc_id, UNNEST(string_split(text, chr(10))) AS t,
         generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents
),
marked AS (
  SELECT *, CASE WHEN translate(t, ' ' || chr(9) || chr(11) || chr(12) || chr(13), '') = '' THEN 0 ELSE length(t) END AS c
  FROM line
),
summed AS (SELECT *, sum(c) OVER (PARTITION BY doc_id ORDER BY pos) AS s FROM marked),
ends AS (
  SELECT doc_id, pos,
         max(pos) OVER (PARTITION BY doc_id ORDER BY s - c RANGE BETWEEN CURRENT ROW AND {MIN_CHARS - 1} FOLLOWING) AS z,
         max(s) OVER (PARTITION BY doc_id ORDER BY s - c RANGE BETWEEN CURRENT ROW AND {MIN_CHARS - 1} FOLLOWING) - (s - c) AS fc,
         min(pos) OVER (PARTITION BY doc_id ORDER BY s RANGE BETWEEN {MIN_CHARS - 1} PRECEDING AND CURRENT ROW) AS a,
         s - min(s - c) OVER (PARTITION BY doc_id ORDER BY s RANGE BETWEEN {MIN_CHARS - 1} PRECEDING AND CURRENT ROW) AS bc
  FROM summed
),
win AS (
  SELECT doc_id, pos AS b, z AS e FROM ends WHERE fc >= {MIN_CHARS}
  UNION
  SELECT doc_id, a, pos FROM ends WHERE bc >= {MIN_CHARS}
),
keyed AS (
  SELECT w.doc_id, b, e, md5(array_to_string(list_slice(string_split(d.text, chr(10)), b, e), chr(10))) AS k
  FROM win w JOIN documents d ON d.doc_id = w.doc_id
),
later AS (
  SELECT doc_id, b, e FROM (
    SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, b) AS r FROM keyed
  ) WHERE r > 1
),
gone AS (
  SELECT DISTINCT l.doc_id, l.pos FROM line l JOIN later x
  ON x.doc_id = l.doc_id AND l.pos >= x.b AND l.pos <= x.e
),
kept AS (
  SELECT l.doc_id, count(*) AS n_lines, count(g.pos) AS n_removed,
         count(CASE WHEN g.pos IS NOT NULL AND p.pos IS NULL THEN 1 END) AS n_runs,
         coalesce(string_agg(CASE WHEN g.pos IS NULL THEN l.t END, chr(10) ORDER BY l.pos), '') AS kept
  FROM line l
  LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.pos = l.pos
  LEFT JOIN gone p ON p.doc_id = l.doc_id AND p.pos = l.pos - 1
  GROUP BY l.doc_id
)
SELECT doc_id, n_lines, n_removed, n_runs, sha256(kept) AS kept_sha256 FROM kept
"""
