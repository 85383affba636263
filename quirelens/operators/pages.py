"""Operators over the ordered pages of a volume.

A volume may hold any share of all pages, so no window is partitioned by volume
alone.  Pages are grouped by ``(volid, block)`` with ``block = seq div BLOCK``;
``(volid, seq)`` is unique and ``seq`` a 32-bit integer, so a block has at most
BLOCK pages and a volume at most 2**31 / BLOCK blocks.  What has to cross a block
edge travels as halo rows (running lines) or as one summary row per block
(stitching).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirelens.functions import text as tx

BLOCK = 4096
_KEY = ["volid", "_block"]


def block_of(seq: Column, block: int = BLOCK) -> Column:
    return F.floor(seq / F.lit(block)).cast("int")


def line_key(line: Column) -> Column:
    """Running lines differ in their page number only: no digits, lower case, trimmed."""
    return F.trim(F.lower(F.regexp_replace(line, "[0-9]+", "")))


def strip_running_lines(
    pages: DataFrame, repeats: int = 2, within: int = 5, block: int = BLOCK, keep_block: bool = False
) -> DataFrame:
    """Page body without running headers and footers.

    ``pages(volid, seq, text)`` with normalised lines.  The first (last) line of
    a page goes when its key is also the first (last) line of at least
    ``repeats`` other pages of the volume whose ``seq`` is at most ``within``
    away.  Pages near a block edge are also sent, without their text, to the
    neighbouring block.

    Text is shuffled and sorted once: both lines are compared within one window in
    ``seq`` order, whose frame holds at most ``2 * within + 1`` short keys.
    ``keep_block`` leaves the column ``_block`` in place; ``stitch_pages`` of the same
    ``block`` then works on the partitions and the order that are already there.
    """
    if within >= block:
        raise ValueError("within must be smaller than the block size")
    own = block_of(F.col("seq"), block)
    near = F.array_distinct(
        F.array(
            own,
            block_of(F.col("seq") - within, block),
            block_of(F.col("seq") + within, block),
        )
    )
    has_text = F.coalesce(F.col("text"), F.lit("")) != ""
    keyed = (
        pages.withColumn(
            "_head", F.when(has_text, line_key(F.substring_index("text", "\n", 1)))
        )
        .withColumn("_foot", F.when(has_text, line_key(F.substring_index("text", "\n", -1))))
        .withColumn("_block", F.explode(near))
        .withColumn("_own", F.col("_block") == own)
        .withColumn("text", F.when(F.col("_own"), F.col("text")))
        .repartition(*_KEY)
    )
    around = Window.partitionBy(*_KEY).orderBy("seq").rangeBetween(-within, within)

    def others(line: str) -> Column:
        # the frame is a column of its own: the filter looks at it once per page
        return F.size(F.filter(f"{line}s", lambda other: other == F.col(line))) - 1

    flagged = (
        keyed.withColumn("_heads", F.collect_list("_head").over(around))
        .withColumn("_foots", F.collect_list("_foot").over(around))
        .where("_own")
        .withColumn("_drop_head", others("_head") >= repeats)
        .withColumn("_drop_foot", others("_foot") >= repeats)
    )
    headless = F.when(
        F.col("_drop_head"), F.regexp_replace("text", r"^[^\n]*\n?", "")
    ).otherwise(F.col("text"))
    body = F.when(
        F.col("_drop_foot"), F.regexp_replace(headless, r"(?:^|\n)[^\n]*\z", "")
    ).otherwise(headless)
    done = flagged.withColumn("text", body).drop(
        "_head", "_foot", "_heads", "_foots", "_own", "_drop_head", "_drop_foot"
    )
    return done if keep_block else done.drop("_block")


def sentence_pages(pages: DataFrame, abbreviations: tuple[str, ...] = ()) -> DataFrame:
    """``text`` -> ``sentences`` (null text gives no sentences)."""
    cleaned = tx.dehyphenate(F.coalesce(F.col("text"), F.lit("")))
    return pages.withColumn(
        "sentences", tx.split_sentences(cleaned, abbreviations)
    ).drop("text")


def _toggle(base: Column, order: Column, flips: Column) -> Column:
    """State of a 0/1 switch: the last known base, turned once per later flip."""
    last = F.last(F.when(base.isNotNull(), F.struct(base.alias("v"), flips.alias("f"))), True)
    known = last.over(order)
    return known["v"].bitwiseXOR(F.pmod(flips - known["f"], F.lit(2)).cast("int"))


def has_long_volumes(pages: DataFrame, block: int = BLOCK) -> bool:
    """Whether any page lies outside block 0; reads ``seq`` only and stops at a hit."""
    return not pages.where((F.col("seq") >= block) | (F.col("seq") < 0)).select("seq").isEmpty()


def stitch_pages(
    pages: DataFrame, block: int = BLOCK, long_volumes: bool | None = None
) -> DataFrame:
    """Move the first sentence of page i+1 to the end of page i's last sentence.

    ``pages(volid, seq, sentences)``; pages are paired in ``seq`` order, from the
    first to the last, and a page that lost its only sentence pairs as an empty
    one.  Whether a page loses its first sentence (``r``) is known from the
    sentence counts n: 0 if it is the first page, is empty or follows an empty page; 1
    after a page with two or more sentences; otherwise the opposite of the page
    before.  Runs of one-sentence pages are thus a switch that flips per page.

    Without long volumes (``has_long_volumes``, checked here when not given) every
    volume is one block and a single shuffle does.  Otherwise the exchange of
    the sentences is read twice, for the pages and for the block summaries.
    Pages with a null key are no pages (see ``quality.split_pages``).  Pages that have
    ``_block`` (``strip_running_lines``) lie by it already and are not shuffled again.
    """
    if long_volumes is None:
        long_volumes = has_long_volumes(pages, block)
    order = Window.partitionBy(*_KEY).orderBy("seq")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    dealt = "_block" in pages.columns
    if not dealt:
        pages = pages.withColumn("_block", block_of(F.col("seq"), block))
    placed = pages.withColumn("_n", F.size("sentences")).where(
        F.col("volid").isNotNull() & F.col("_block").isNotNull()
    )
    if long_volumes and not dealt:
        placed = placed.repartition(*_KEY)
    placed = (
        placed.withColumn("_i", F.row_number().over(order))
        .withColumn("_before", F.lag("_n").over(order))
    )
    base = (
        F.when((F.col("_n") == 0) | (F.col("_before") == 0), 0)
        .when(F.col("_before") >= 2, 1)
        .otherwise(F.lit(None).cast("int"))
    )
    # _r is null until the first page of the block whose state does not depend
    # on the block before.
    inner = placed.withColumn("_base", base).withColumn(
        "_r", _toggle(F.col("_base"), upto, F.col("_i"))
    )
    if long_volumes:
        linked = inner.join(_block_edges(inner), _KEY, "left")
    else:
        linked = inner.select(
            "*",
            F.lit(None).cast("int").alias("_enter"),
            F.lit(None).cast("int").alias("_next_r"),
            F.lit(None).cast("string").alias("_next_first"),
        )
    follow = F.coalesce(F.lead("_r0").over(order), F.col("_next_r"))
    first = F.coalesce(
        F.lead(F.get("sentences", F.lit(0))).over(order), F.col("_next_first")
    )
    solved = (
        linked.withColumn(
            "_r0",
            F.coalesce(
                F.col("_r"),
                F.coalesce("_enter", F.lit(0)).bitwiseXOR(F.pmod(F.col("_i") - 1, F.lit(2)).cast("int")),
            ),
        )
        .withColumn("_taken", follow == 1)
        .withColumn("_extra", F.when(F.col("_taken"), first))
    )
    own = F.slice("sentences", F.col("_r0") + 1, F.greatest(F.col("_n") - F.col("_r0"), F.lit(0)))
    grown = F.transform(
        own,
        lambda s, i: F.when(
            i == F.col("_n") - F.col("_r0") - 1, F.concat(s, F.lit(" "), F.col("_extra"))
        ).otherwise(s),
    )
    return solved.withColumn(
        "sentences", F.when(F.col("_extra").isNotNull(), grown).otherwise(own)
    ).select(*[c for c in pages.columns if c != "_block"])


def _block_edges(inner: DataFrame) -> DataFrame:
    """Per block: state of its first page, and what the next block hands back.

    One short row per block, at most 2**31 / BLOCK of them per volume, and only
    blocks with a neighbour are handed on.
    """
    first = F.struct("_n", F.get("sentences", F.lit(0)).alias("s"))
    last = F.struct("_n", "_r")
    summary = inner.groupBy(*_KEY).agg(
        F.min_by(first, "seq").alias("first"),
        F.max_by(last, "seq").alias("last"),
        F.count("*").alias("pages"),
    )
    order = Window.partitionBy("volid").orderBy("_block")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    linked = (
        summary.withColumn("_prev_n", F.lag("last._n").over(order))
        .withColumn("_prev_r", F.lag("last._r").over(order))
        .withColumn("_prev_pages", F.lag("pages").over(order))
        .withColumn("_blocks", F.count("*").over(Window.partitionBy("volid")))
        .where(F.col("_blocks") > 1)
    )
    # After a one-sentence page: known if that page's state is known inside its
    # block, else the state of that block's first page flipped once per page.
    base = (
        F.when((F.col("first._n") == 0) | F.col("_prev_n").isNull() | (F.col("_prev_n") == 0), 0)
        .when(F.col("_prev_n") >= 2, 1)
        .otherwise(1 - F.col("_prev_r"))
    )
    flips = F.sum(F.coalesce(F.col("_prev_pages"), F.lit(0))).over(upto)
    return (
        linked.withColumn("_base", base)
        .withColumn("_flips", flips)
        .withColumn("_enter", _toggle(F.col("_base"), upto, F.col("_flips")))
        .withColumn("_next_r", F.lead("_enter").over(order))
        .withColumn("_next_first", F.lead("first.s").over(order))
        .select(*_KEY, "_enter", "_next_r", "_next_first")
    )


def adjacent_pages(pages: DataFrame, block: int = BLOCK) -> DataFrame:
    """Each page with the ``seq`` of the following page; the last page is paired with itself."""
    order = Window.partitionBy(*_KEY).orderBy("seq")
    keys = pages.select("volid", "seq").withColumn("_block", block_of(F.col("seq"), block))
    heads = keys.groupBy(*_KEY).agg(F.min("seq").alias("_head"))
    across = heads.select(
        *_KEY,
        F.lead("_head").over(Window.partitionBy("volid").orderBy("_block")).alias("_next_head"),
    )
    return (
        keys.repartition(*_KEY)
        .withColumn("_lead", F.lead("seq").over(order))
        .join(across, _KEY, "left")
        .select(
            "volid", "seq", F.coalesce("_lead", "_next_head", "seq").alias("next_seq")
        )
    )
