"""Approximate nearest neighbours: a navigable small-world graph per shard, merged.

Vectors are dealt to shards by a hash of their id.  A shard's graph is flat arrays:
one (rows, 2 * M) array of neighbours for the ground level and one (rows, M) array per
upper level, -1 where there is none.  Rows enter in batches that are searched together,
and so are queries: a step expands the best open node of every query at once.

Inner products become distances by one more component that gives every vector the
length of the longest one, so that graph search is sound; scores are inner products of
the original vectors in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelens.llm.rows import written

#: Neighbours per node; twice as many on the ground level.
M = 16
#: Width of the search beam when building and when searching.
BUILD, SEARCH = 64, 160
#: Rows that a shard should hold at most, and the number of shards for fewer rows.
SHARD_ROWS, SHARDS = 12_500, 12
#: Queries searched together, and rows entered together.
BATCH = 256
INDEX = "shard int, slot int, ids binary, vectors binary, levels binary, ground binary, upper array<binary>"


@dataclass
class Graph:
    """Distinct vectors of a shard with their neighbours; ``ids`` has up to ``keep`` per vector."""

    vectors: np.ndarray  # (n, d) float64, original
    ids: np.ndarray  # (n, keep) ascending, -1 where there are no more
    points: np.ndarray  # (n, d + 1) float32, all of one length
    level: np.ndarray
    links: list[np.ndarray]  # per level (n, width)

    @property
    def entry(self) -> int:
        return int(self.level.argmax())


def _beam(points, links, queries, start, width: int):
    """Best ``width`` nodes of one level for each query, nearest first: nodes and products.

    ``start`` (q, s) are the nodes to begin with.  All queries step together until none
    has an open node among its best.
    """
    n, q = len(points), len(queries)
    seen = np.zeros((q, n), bool)
    rows = np.arange(q)
    node = np.full((q, width), -1, np.int64)
    near = np.full((q, width), -np.inf, np.float32)
    s = min(start.shape[1], width)
    node[:, :s] = start[:, :s]
    near[:, :s] = np.where(
        node[:, :s] >= 0, np.einsum("qd,qsd->qs", queries, points[node[:, :s]]), -np.inf
    )
    # the first start is always a node; -1 would mark the last one
    seen[rows[:, None], np.where(node[:, :s] >= 0, node[:, :s], node[:, :1])] = True
    open_ = np.isfinite(near)
    live = rows
    while len(live):
        score = np.where(open_[live], near[live], -np.inf)
        best = score.argmax(1)
        go = np.isfinite(score[np.arange(len(live)), best])
        live, best = live[go], best[go]
        if not len(live):
            break
        open_[live, best] = False
        around = links[node[live, best]]
        fresh = (around >= 0) & ~seen[live[:, None], around]
        seen[live[:, None], np.where(fresh, around, node[live, best][:, None])] = True
        product = np.where(
            fresh, np.einsum("qd,qsd->qs", queries[live], points[around]), -np.inf
        ).astype(np.float32)
        product[product <= near[live].min(1)[:, None]] = -np.inf
        all_near = np.concatenate([near[live], product], 1)
        all_node = np.concatenate([node[live], around], 1)
        all_open = np.concatenate([open_[live], np.isfinite(product)], 1)
        top = np.argpartition(-all_near, width - 1, 1)[:, :width]
        near[live] = np.take_along_axis(all_near, top, 1)
        node[live] = np.take_along_axis(all_node, top, 1)
        open_[live] = np.take_along_axis(all_open, top, 1) & np.isfinite(near[live])
    order = np.argsort(-near, 1, kind="stable")
    near, node = np.take_along_axis(near, order, 1), np.take_along_axis(node, order, 1)
    return np.where(np.isfinite(near), node, -1), near


def _diverse(points, candidates, products, width: int) -> np.ndarray:
    """Up to ``width`` neighbours: a candidate nearer to a chosen one than to the node waits.

    Candidates come nearest first.  What the rule leaves free is filled by the nearest
    of those that wait.
    """
    n, c = candidates.shape
    vectors = points[candidates]
    between = np.einsum("ncd,nkd->nck", vectors, vectors)
    good = candidates >= 0
    chosen = np.zeros((n, c), bool)
    for k in range(c):
        hidden = (chosen & (between[:, k, :] > products[:, k, None])).any(1)
        chosen[:, k] = good[:, k] & ~hidden & (chosen.sum(1) < width)
    rank = np.where(chosen, 0, np.where(good, 1, 2)) * c + np.arange(c)
    order = np.argsort(rank, 1)[:, :width]
    out = np.take_along_axis(np.where(good, candidates, -1), order, 1)
    return out if out.shape[1] == width else np.pad(out, ((0, 0), (0, width - out.shape[1])), constant_values=-1)


def _link_back(points, links, new: np.ndarray) -> None:
    """Adds the reverse of the links of ``new``; full lists are thinned out again."""
    width = links.shape[1]
    source = np.repeat(new, width)
    target = links[new].ravel()
    source, target = source[target >= 0], target[target >= 0]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    nodes, begin, count = np.unique(target, return_index=True, return_counts=True)
    slot = np.arange(len(source)) - np.repeat(begin, count)
    most = 2 * width
    extra = np.full((len(nodes), min(int(count.max(initial=0)), most)), -1, np.int64)
    fits = slot < extra.shape[1]
    extra[np.repeat(np.arange(len(nodes)), count)[fits], slot[fits]] = source[fits]
    for a in range(0, len(nodes), BATCH):
        own = nodes[a : a + BATCH]
        both = np.concatenate([links[own], extra[a : a + BATCH]], 1)
        both = np.sort(both, 1)[:, ::-1]
        both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
        product = np.where(both >= 0, np.einsum("nd,ncd->nc", points[own], points[both]), -np.inf)
        order = np.argsort(-product, 1, kind="stable")
        both, product = np.take_along_axis(both, order, 1), np.take_along_axis(product, order, 1)
        links[own] = _diverse(points, both, product, width)


def build(ids: np.ndarray, vectors: np.ndarray, longest: float, keep: int) -> Graph:
    """Graph of a shard; equal vectors are one node with their ``keep`` least ids.

    More ids of one vector can be in no result of fewer than ``keep`` neighbours, since
    equal scores go to smaller ids.
    """
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    _, first, back, count = np.unique(
        vectors + 0.0, axis=0, return_index=True, return_inverse=True, return_counts=True
    )
    by = np.argsort(back.ravel(), kind="stable")
    place = np.arange(len(ids)) - np.repeat(np.cumsum(count) - count, count)
    few = place < keep
    table = np.full((len(first), keep), -1, np.int64)
    table[back.ravel()[by][few], place[few]] = ids[by][few]
    order = np.argsort(table[:, 0], kind="stable")
    vectors, table = vectors[first][order], table[order]
    n = len(vectors)
    rest = np.sqrt(np.maximum(longest**2 - np.einsum("ij,ij->i", vectors, vectors), 0))
    points = np.column_stack([vectors, rest]).astype(np.float32)
    draw = np.random.default_rng(11).random(n)
    level = np.minimum((-np.log(np.maximum(draw, 1e-12)) / np.log(M)).astype(int), 6)
    # nodes enter from the highest level down, so every level's graph holds its entry
    enter = np.argsort(-level, kind="stable")
    top = int(level.max(initial=0))
    links = [np.full((n, 2 * M if k == 0 else M), -1, np.int64) for k in range(top + 1)]
    graph = Graph(vectors, table, points, level, links)
    done = 1
    while done < n:
        # batches no larger than what the graph holds already
        batch = enter[done : done + min(BATCH, done)]
        start = np.full((len(batch), 1), enter[0])
        for k in range(top, -1, -1):
            found, near = _beam(points, links[k], points[batch], start, BUILD)
            inside = level[batch] >= k
            if inside.any():
                own = batch[inside]
                # members of the batch see each other too
                mate = points[own] @ points[own].T
                np.fill_diagonal(mate, -np.inf)
                take = min(M, len(own))
                peers = np.argpartition(-mate, take - 1, 1)[:, :take]
                product = np.take_along_axis(mate, peers, 1)
                peers = np.where(np.isfinite(product), own[peers], -1)
                both = np.concatenate([found[inside], peers], 1)
                product = np.concatenate([near[inside], product], 1)
                order = np.argsort(-product, 1, kind="stable")[:, :BUILD]
                links[k][own] = _diverse(
                    points, np.take_along_axis(both, order, 1),
                    np.take_along_axis(product, order, 1), links[k].shape[1],
                )
                _link_back(points, links[k], own)
            start = found[:, :4] if k else found
        done += len(batch)
    return graph


def search(graph: Graph, queries: np.ndarray, k: int, width: int = SEARCH) -> tuple[np.ndarray, np.ndarray]:
    """(q, k') nearest nodes and their exact scores for original query vectors."""
    points = np.column_stack([queries, np.zeros(len(queries))]).astype(np.float32)
    start = np.full((len(queries), 1), graph.entry)
    for links in reversed(graph.links):
        ground = links is graph.links[0]
        start, _ = _beam(graph.points, links, points, start, max(width, k) if ground else 8)
    score = np.einsum("qd,qsd->qs", queries, graph.vectors[start])
    return start, np.where(start >= 0, score, -np.inf)


def _usable(vector: Column) -> Column:
    """Whether a vector is there, finite in every component, and not zero."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(
        ~F.exists(vector, odd) & F.exists(vector, lambda x: x != 0), F.lit(False)
    )


def usable(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(vec_id, v)`` of vectors that take part: with an id, finite and not zero."""
    return rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).where(
        F.col("vec_id").isNotNull() & _usable(F.col("v"))
    )


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def build_index(vectors: DataFrame, shards: int, width: int, longest: float, keep: int) -> DataFrame:
    """One row per shard of ``vectors(vec_id, v)`` with the flat arrays of its graph."""

    def work(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        g = build(
            group["vec_id"].to_numpy(), _matrix(group["v"].chunk(0), width), longest, keep
        )
        raw = lambda a, kind: a.astype(kind).tobytes()
        return pa.table(
            {
                "shard": pa.array([group["shard"][0].as_py()], pa.int32()),
                "slot": pa.array([0], pa.int32()),
                "ids": pa.array([raw(g.ids, "<i8")], pa.binary()),
                "vectors": pa.array([raw(g.vectors, "<f8")], pa.binary()),
                "levels": pa.array([raw(g.level, "<i4")], pa.binary()),
                "ground": pa.array([raw(g.links[0], "<i4")], pa.binary()),
                "upper": pa.array([[raw(x, "<i4") for x in g.links[1:]]], pa.list_(pa.binary())),
            }
        )

    shard = F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")
    return vectors.withColumn("shard", shard).groupBy("shard").applyInArrow(work, INDEX)


def _opened(row: dict, width: int, longest: float, keep: int) -> Graph:
    vectors = np.frombuffer(row["vectors"], "<f8").reshape(-1, width)
    n = len(vectors)
    rest = np.sqrt(np.maximum(longest**2 - np.einsum("ij,ij->i", vectors, vectors), 0))
    links = [np.frombuffer(x, "<i4").reshape(n, -1).astype(np.int64) for x in (row["ground"], *row["upper"])]
    return Graph(
        vectors, np.frombuffer(row["ids"], "<i8").reshape(-1, keep),
        np.column_stack([vectors, rest]).astype(np.float32), np.frombuffer(row["levels"], "<i4"), links,
    )


def _single(rows: DataFrame) -> DataFrame:
    """One vector per id; rows are left as they lie where ids are unique."""
    n, ids = rows.agg(F.count("*"), F.count_distinct("vec_id")).first()
    return rows if n == ids else rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def nearest(vectors: DataFrame, queries: DataFrame, k: int, beam: int = SEARCH) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: nearest rows to ``queries(vec_id, v)`` but itself.

    Both have the columns that ``usable`` returns.  Vectors of another length than the
    commonest (the larger of two) take no part, neither as candidates nor as queries.  An
    id stands for one vector: of rows that share one, the least vector by its components.
    Every query visits every shard: a shard's partition holds its index first and then
    streams the queries in batches, so a task holds one shard and one batch.  Shards are
    merged by score, ties by vec_id.
    """
    schema = "query_id long, vec_id long, score double"
    sizes = vectors.groupBy(F.size("v").alias("w")).agg(F.count("*").alias("n"))
    most = sizes.orderBy(F.desc("n"), F.desc("w")).first()
    width = most["w"] if most else 0
    vectors, queries = (_single(x.where(F.size("v") == width)) for x in (vectors, queries))
    n, longest = vectors.agg(
        F.count("*"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    ).first()
    if not n:
        return queries.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    longest = float(np.sqrt(longest))
    shards = max(SHARDS, -(-n // SHARD_ROWS))
    keep = k + 1
    index = written(build_index(vectors, shards, width, longest, keep))
    asked = queries.select(
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"),
        F.lit(1).alias("slot"), "vec_id", "v",
    )
    both = index.withColumns({"vec_id": F.lit(None).cast("long"), "v": F.lit(None).cast("array<double>")}).unionByName(
        asked, allowMissingColumns=True
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, at = None, None
        for batch in batches:
            slot, shard = batch["slot"].to_numpy(), batch["shard"].to_numpy()
            edge = np.flatnonzero(np.append(True, (slot[1:] != slot[:-1]) | (shard[1:] != shard[:-1])))
            for a, b in zip(edge, [*edge[1:], len(slot)]):
                part = batch.slice(a, b - a)
                if slot[a] == 0:
                    graph, at = _opened(part.to_pylist()[0], width, longest, keep), shard[a]
                    continue
                if at != shard[a]:
                    continue  # a shard without vectors
                ids = part["vec_id"].to_numpy()
                matrix = _matrix(part["v"], width)
                for i in range(0, len(ids), BATCH):
                    yield _answers(graph, ids[i : i + BATCH], matrix[i : i + BATCH], k, beam)

    found = (
        both.repartitionByRange(shards, "shard")
        .sortWithinPartitions("shard", "slot")
        .mapInArrow(work, schema)
    )
    ranked = found.groupBy("query_id").agg(
        F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id"))), 1, k).alias("best")
    )
    return ranked.select("query_id", F.posexplode("best").alias("rank", "b")).select(
        "query_id", (F.col("rank") + 1).alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.far")).alias("score")
    )


def _answers(graph: Graph, ids: np.ndarray, queries: np.ndarray, k: int, beam: int) -> pa.RecordBatch:
    node, score = search(graph, queries, k + 1, beam)
    candidate = graph.ids[node]
    real = (candidate >= 0) & np.isfinite(score)[:, :, None] & (candidate != ids[:, None, None])
    score = np.where(real, score[:, :, None], -np.inf).reshape(len(ids), -1)
    candidate = candidate.reshape(len(ids), -1)
    order = np.lexsort((candidate, -score), axis=1)[:, :k]
    score, candidate = np.take_along_axis(score, order, 1), np.take_along_axis(candidate, order, 1)
    good = np.isfinite(score)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.repeat(ids, good.sum(1))),
            pa.array(candidate[good]),
            pa.array(score[good] + 0.0),
        ],
        names=["query_id", "vec_id", "score"],
    )
