"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelens.llm.rows import own_tables, written


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the least of node and neighbours."""
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
    least = both.groupBy("a").agg(F.min("b").alias("_m")).select(
        "a", F.least("a", "_m").alias("_m")
    )
    return (
        both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("_m").alias("b"))
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of these."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("_m"))
    moved = down.join(least, "a").where("b <> _m").select(F.col("b").alias("a"), F.col("_m").alias("b"))
    return moved.union(least.select("a", F.col("_m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for the nodes of ``edges(a, b)``: the least node that is reached.

    Each round is a table in the shared folder; hubs are summed before the shuffle and
    their joins can be split, so a component may hold any part of the nodes.  Loops and
    repeated edges are harmless; a node with loops only is not returned.
    """
    with own_tables(edges.sparkSession) as result:
        edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        edges = written(edges.where("a <> b").distinct())
        state = None
        while True:
            now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
            if now == state or not now[0]:
                break
            state = now
            edges = written(_small_star(_large_star(edges)).where("a <> b").distinct())
        nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
        return result(nodes.union(roots))
