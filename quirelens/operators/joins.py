"""Restricting pages and attaching catalogue data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelens.operators.scale import BROADCAST_ROWS, fits_broadcast, lookup_join


def exclude_pages(pages: DataFrame, excluded: DataFrame) -> DataFrame:
    """Pages that are not listed; a page with a null key matches nothing and stays.

    A list measured to be small is broadcast, so that no page is shuffled.  ``(volid, seq)``
    has no hot key, so the join strategy is otherwise left to the optimizer.
    """
    listed = excluded.select("volid", "seq")
    if fits_broadcast(listed):
        listed = F.broadcast(listed)
    return pages.join(listed, ["volid", "seq"], "left_anti")


def only_volumes(pages: DataFrame, ids: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Pages of the listed volumes."""
    return lookup_join(
        pages, ids.select("volid").distinct(), "volid", "left_semi", ["volid", "seq"], max_rows
    )


def attach_catalogue(
    pages: DataFrame,
    catalogue: DataFrame,
    spread_by: tuple[str, ...] = ("htid", "seq"),
    max_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Left join on ``htid``: pages of unknown volumes stay, with null metadata."""
    return lookup_join(pages, catalogue, "htid", "left", spread_by, max_rows)


def attach_labels(rows: DataFrame, labels: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Topic number -> term string; a label table of one row per topic, broadcast if it is small."""
    spread_by = [c for c in rows.columns if c != "topic"]
    return lookup_join(rows, labels, "topic", "left", spread_by, max_rows)
