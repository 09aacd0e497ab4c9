"""Exact top-k search by inner product: ball trees per shard, searched by branch and bound.

1. Components become whole numbers, so scores are exact.  A few levels of a ball tree,
   fitted on at most ``FIT_ROWS`` vectors drawn by hash, split space into cells; every
   vector goes to its cell, and a cell with more than ``shard_rows`` vectors is dealt over
   several shards.  Each cell's centre, radius and largest norm are aggregated exactly.
2. A query visits the cell with the highest upper bound ``q.c + |q| r`` first, there in
   one shard.  Its k-th score is then shared: it goes with the query, which visits only
   the other shards whose cell's bound reaches it.
3. A task streams one shard after the other: the shard's vectors, from which it builds a
   ball tree, then all queries sent to it, in batches.  Nodes are descended for all
   queries of a batch at once while their bound reaches the query's k-th score, and the
   leaves left are visited from the highest bound down, raising that score.
4. The few results per query and shard are merged per query.

Bounds are widened by the error of doubles, so pruning never loses a result; nodes that
reach the k-th score exactly are visited, as a smaller id may win the tie.

Defined cases: vectors that are null or hold null or non-finite components take no part,
nor do those with a squared norm of 2**62 or more (their scores would not fit a long);
vectors of different lengths are never compared; a row without an id is found, after all
ids of the same score, but asks nothing; rows that repeat an id are rows of their own,
each finding the others; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from labelflow import session
from labelflow.functions.columns import by_name

FIT_ROWS = 20_000
MAX_CELLS = 1024
# Vector lengths with cells of their own; vectors of others are not divided by place.
MAX_SIZES = 16
SHARD_ROWS = 32_768
LEAF_ROWS = 256
QUERY_BATCH = 512
# Products of vectors whose norms multiply to less than this are exact in doubles, sums included.
EXACT = 2.0**53
MAX_SQUARE = 2.0**62
LAST = np.iinfo(np.int64).max


@dataclass
class Tree:
    """Nodes of a ball tree in arrays; node k's children are ``left[k]`` and ``left[k] + 1``, a leaf's is -1."""

    centre: np.ndarray
    radius: np.ndarray
    left: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    order: np.ndarray


def _halves(points: np.ndarray) -> np.ndarray:
    """Which points go right: along the line through two far points, cut at the median."""
    far = points[np.argmax(((points - points[0]) ** 2).sum(axis=1))]
    other = points[np.argmax(((points - far) ** 2).sum(axis=1))]
    along = points @ (other - far)
    right = np.zeros(len(points), bool)
    right[np.argsort(along, kind="stable")[len(points) // 2 :]] = True
    return right


def build(points: np.ndarray, leaf_rows: int) -> Tree:
    order = np.arange(len(points))
    nodes: list[list] = [[0, len(points), -1]]
    centres, radii = [], []
    k = 0
    while k < len(nodes):
        start, stop, _ = nodes[k]
        inside = points[order[start:stop]]
        centre = inside.mean(axis=0)
        centres.append(centre)
        radii.append(np.sqrt(((inside - centre) ** 2).sum(axis=1).max(initial=0.0)))
        if stop - start > leaf_rows:
            right = _halves(inside)
            order[start:stop] = np.concatenate([order[start:stop][~right], order[start:stop][right]])
            middle = stop - int(right.sum())
            nodes[k][2] = len(nodes)
            nodes += [[start, middle, -1], [middle, stop, -1]]
        k += 1
    start, stop, left = np.array(nodes).T
    return Tree(np.array(centres), np.array(radii), left, start, stop, order)


def bounds(queries: np.ndarray, norms: np.ndarray, centre: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """Upper bounds of the inner products of each query (paired with a ball), never too low."""
    value = np.einsum("ij,ij->i", queries, centre) + norms * radius
    return value + 1e-9 * (norms * (np.sqrt((centre**2).sum(axis=1)) + radius)) + 1e-6


class Shard:
    """The vectors of one shard with their ball tree."""

    def __init__(self, points: np.ndarray, rows: np.ndarray, ids: np.ndarray):
        self.tree = build(points.astype(np.float64), LEAF_ROWS)
        order = self.tree.order
        self.points, self.rows, self.ids = points[order], rows[order], ids[order]
        self.float = self.points.astype(np.float64)
        self.norm = np.sqrt((self.float**2).sum(axis=1).max(initial=0.0))

    def scores(self, queries: np.ndarray, start: int, stop: int, exact: bool) -> np.ndarray:
        if exact:
            return (queries.astype(np.float64) @ self.float[start:stop].T).astype(np.int64)
        return queries @ self.points[start:stop].T

    def search(self, queries: np.ndarray, rows: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Up to ``k`` results with at least the floor for each query: query numbers, ids, scores."""
        q = queries.astype(np.float64)
        norms = np.sqrt((q**2).sum(axis=1))
        exact = bool(norms.max(initial=0.0) * self.norm < EXACT)
        best = np.full((len(q), k), np.iinfo(np.int64).min)
        ids = np.full((len(q), k), LAST)
        found = np.zeros(len(q), np.int64)
        low = floor.astype(np.float64)
        pairs = self._leaves(q, norms, low)
        # Each round visits the next best leaf of every query that still has one.
        turn = pairs["turn"]
        for number in range(int(turn.max(initial=-1)) + 1):
            at = turn == number
            asking, leaf = pairs["query"][at], pairs["leaf"][at]
            going = pairs["bound"][at] >= low[asking]
            asking, leaf = asking[going], leaf[going]
            by_leaf = np.argsort(leaf, kind="stable")
            for part in np.split(by_leaf, np.flatnonzero(np.diff(leaf[by_leaf])) + 1):
                if not len(part):
                    continue
                some, node = asking[part], leaf[part[0]]
                start, stop = self.tree.start[node], self.tree.stop[node]
                score = self.scores(queries[some], start, stop, exact)
                usable = (self.rows[start:stop] != rows[some, None]) & (score >= floor[some, None]) & (score >= low[some, None])
                some, score, usable = (x[usable.any(axis=1)] for x in (some, score, usable))
                score = np.where(usable, score, np.iinfo(np.int64).min)
                wide_score = np.concatenate([best[some], score], axis=1)
                wide_id = np.concatenate([ids[some], np.where(usable, self.ids[start:stop], LAST)], axis=1)
                # Whether a place is taken tells a result of the lowest score from none.
                taken = np.concatenate([np.arange(k) < found[some, None], usable], axis=1)
                top = np.lexsort((wide_id, -wide_score, ~taken), axis=1)[:, :k]
                best[some], ids[some] = np.take_along_axis(wide_score, top, 1), np.take_along_axis(wide_id, top, 1)
                found[some] = np.take_along_axis(taken, top, 1).sum(axis=1)
                full = found[some] == k
                low[some[full]] = np.maximum(low[some[full]], best[some[full], k - 1])
        of, place = np.nonzero(np.arange(k) < found[:, None])
        return of, ids[of, place], best[of, place]

    def _leaves(self, q: np.ndarray, norms: np.ndarray, low: np.ndarray) -> dict[str, np.ndarray]:
        """(query, leaf) pairs whose bounds, from the root down, reach the floor; ``turn`` orders a query's leaves by bound."""
        asking, node = np.arange(len(q)), np.zeros(len(q), np.int64)
        done = []
        while len(asking):
            bound = np.concatenate([bounds(q[asking[s : s + 65536]], norms[asking[s : s + 65536]], self.tree.centre[node[s : s + 65536]], self.tree.radius[node[s : s + 65536]]) for s in range(0, len(asking), 65536)])
            keep = bound >= low[asking]
            asking, node, bound = asking[keep], node[keep], bound[keep]
            leaf = self.tree.left[node] < 0
            done.append((asking[leaf], node[leaf], bound[leaf]))
            inner = self.tree.left[node[~leaf]]
            asking, node = np.repeat(asking[~leaf], 2), np.stack([inner, inner + 1], axis=1).reshape(-1)
        query, leaf, bound = (np.concatenate([d[k] for d in done]) if done else np.zeros(0) for k in range(3))
        order = np.lexsort((-bound, query))
        query, leaf, bound = query[order].astype(np.int64), leaf[order].astype(np.int64), bound[order]
        first = np.searchsorted(query, query, side="left")
        return {"query": query, "leaf": leaf, "bound": bound, "turn": np.arange(len(query)) - first}


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), size)


def quantised(vectors: DataFrame, id_col: str, vector_col: str, levels: int) -> DataFrame:
    """Usable rows: ``row``, ``vec_id``, ``v`` (floor of ``levels`` times each component) and its ``size``."""
    rows = vectors.select(by_name(id_col).cast("long").alias("vec_id"), by_name(vector_col).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.col("v").isNotNull() & ~bad)
    whole = F.transform("v", lambda x: F.least(F.greatest(F.lit(float(levels)) * x, F.lit(-1e10)), F.lit(1e10)))
    rows = rows.select("vec_id", F.transform(whole, lambda x: F.floor(x).cast("long")).alias("v"), F.size("v").alias("size"))
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return rows.where(square < MAX_SQUARE).withColumn("row", F.monotonically_increasing_id())


def _cell_count(count: int, shard_rows: int, spark: SparkSession) -> int:
    """Cells for this many vectors: one a shard, some for every core if that leaves them enough vectors."""
    return min(MAX_CELLS, max(1, -(-count // shard_rows), min(2 * spark.sparkContext.defaultParallelism, count // LEAF_ROWS)))


def _cells(rows: DataFrame, size: int, cells: int) -> np.ndarray:
    """Centres of about ``cells`` leaves of a ball tree over a bounded sample."""
    found = rows.where(F.col("size") == size).orderBy(F.xxhash64("row"), "row").limit(FIT_ROWS).select("v").toArrow()
    sample = np.concatenate([_matrix(b.column(0), size) for b in found.to_batches() if b.num_rows]).astype(np.float64)
    tree = build(sample, max(1, -(-len(sample) // cells)))
    return tree.centre[tree.left < 0]


def _assigned(rows: DataFrame, centres: dict[int, np.ndarray]) -> DataFrame:
    """Adds ``cell`` (the nearest centre), and the vector's ``distance`` and ``norm``."""
    shared = rows.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(3).to_numpy()
            cell, distance, norm = np.zeros(len(sizes), np.int32), np.zeros(len(sizes)), np.zeros(len(sizes))
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                points = _matrix(batch.column(2).take(pa.array(at)), size).astype(np.float64)
                centre = shared.value.get(int(size), np.zeros((1, size)))
                cell[at] = np.argmin((centre**2).sum(axis=1) - 2 * points @ centre.T, axis=1)
                distance[at] = np.sqrt(((points - centre[cell[at]]) ** 2).sum(axis=1))
                norm[at] = np.sqrt((points**2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, (cell, distance, norm))], ["row", "vec_id", "v", "size", "cell", "distance", "norm"])

    schema = "row long, vec_id long, v array<long>, size int, cell int, distance double, norm double"
    return rows.select("row", "vec_id", "v", "size").mapInArrow(run, schema)


def _routed(queries: DataFrame, balls: dict[int, tuple], first: bool) -> DataFrame:
    """Queries with the cells to visit: the one of the highest bound, or all whose bound reaches ``floor``."""
    shared = queries.sparkSession.sparkContext.broadcast(balls)
    names = ["row", "vec_id", "v", "size", "floor"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, QUERY_BATCH):
                batch = whole.slice(begin, QUERY_BATCH)
                sizes, floor = batch.column(3).to_numpy(), batch.column(4).to_numpy()
                asking, cells = [], []
                for size in np.unique(sizes):
                    at = np.flatnonzero(sizes == size)
                    q = _matrix(batch.column(2).take(pa.array(at)), size).astype(np.float64)
                    norms = np.sqrt((q**2).sum(axis=1))
                    # Rare lengths have one cell without a bound.
                    unbounded = (np.zeros(1, np.int32), np.zeros((1, size)), np.full(1, np.inf), np.full(1, np.inf))
                    number, centre, radius, largest = shared.value.get(int(size), unbounded)
                    scale = np.maximum(norms, 1.0)[:, None]
                    reach = scale * (np.sqrt((centre**2).sum(axis=1)) + radius)
                    bound = np.minimum(q @ centre.T + scale * radius, scale * largest) + 1e-9 * reach + 1e-6
                    if first:
                        asking.append(at)
                        cells.append(number[np.argmax(bound, axis=1)])
                    else:
                        of, cell = np.nonzero(bound >= floor[at][:, None])
                        asking.append(at[of])
                        cells.append(number[cell])
                of, cell = np.concatenate([*asking, np.zeros(0, np.int64)]).astype(np.int64), np.concatenate([*cells, np.zeros(0, np.int32)])
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(of)) for c in batch.columns), pa.array(cell.astype(np.int32))], [*names, "cell"])

    return queries.select(*names).mapInArrow(run, "row long, vec_id long, v array<long>, size int, floor long, cell int")


def _searched(shards: DataFrame, visits: DataFrame, k: int) -> DataFrame:
    """Results of all visits, at most ``k`` each: ``row`` and ``query_id`` of the query, ``vec_id``, ``score``."""
    keys = ["size", "cell", "sub"]
    nothing = F.lit(None).cast("long")
    points = shards.select(*keys, F.lit(0).alias("kind"), "row", "vec_id", "v", nothing.alias("floor"))
    both = points.unionByName(visits.select(*keys, F.lit(1).alias("kind"), "row", "vec_id", "v", "floor"))
    placed = both.repartition(*keys).sortWithinPartitions(*keys, "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, shard = None, [], None
        for batch in batches:
            marks = np.stack([batch.column(c).to_numpy() for c in range(4)], axis=1)
            cuts = np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1
            for start, stop in zip([0, *cuts], [*cuts, len(marks)] if len(marks) else []):
                part = batch.slice(start, stop - start)
                here = tuple(marks[start][:3].tolist())
                if here != key:
                    key, held, shard = here, [], None
                rows, ids, v = part.column(4).to_numpy(), part.column(5).fill_null(LAST).to_numpy(), _matrix(part.column(6), here[0])
                if marks[start][3] == 0:
                    held.append((v, rows, ids))
                    continue
                if shard is None:
                    if not held:
                        continue
                    shard = Shard(*(np.concatenate(c) for c in zip(*held)))
                    held = []
                floor = part.column(7).to_numpy()
                for b in range(0, len(v), QUERY_BATCH):
                    cut = slice(b, b + QUERY_BATCH)
                    of, found, score = shard.search(v[cut], rows[cut], floor[cut], k)
                    missing = pa.array(found == LAST)
                    yield pa.RecordBatch.from_arrays([pa.array(rows[cut][of]), pa.array(ids[cut][of]), pa.array(found, mask=missing.to_numpy(zero_copy_only=False)), pa.array(score)], ["row", "query_id", "vec_id", "score"])

    return placed.mapInArrow(run, "row long, query_id long, vec_id long, score long")


def search(vectors: DataFrame, asks: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", levels: int = 256, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The ``k`` highest inner products of every row for which ``asks`` (a condition on ``vec_id``) holds with all other rows.

    Returns ``query_id``, ``rank`` (from 1), ``vec_id`` and ``score``; ties go to the smaller id.
    """
    spark = vectors.sparkSession
    rows = session.materialize(quantised(vectors, id_col, vector_col, levels), "vectors")
    common = rows.groupBy("size").count().orderBy(F.desc("count"), "size").limit(MAX_SIZES).collect()
    centres = {r["size"]: _cells(rows, r["size"], _cell_count(r["count"], shard_rows, spark)) for r in common}
    cells = session.materialize(_assigned(rows, centres), "cells")
    parts = F.ceil(F.count(F.lit(1)) / shard_rows).alias("parts")
    grouped = cells.groupBy("size", "cell").agg(parts, F.max("distance").alias("radius"), F.max("norm").alias("largest"))
    grouped, seen = session.measure(grouped, "balls")
    balls = {}
    for size in centres:
        own = grouped.where(F.col("size") == size).orderBy("cell").collect()
        number = np.array([r["cell"] for r in own], np.int32)
        balls[size] = (number, centres[size][number], np.array([r["radius"] for r in own]), np.array([r["largest"] for r in own]))
    parts = session.broadcast_if_small(grouped.select("size", "cell", "parts"), seen)
    dealt = cells.join(parts, ["size", "cell"]).withColumn("sub", F.pmod(F.xxhash64("row"), F.col("parts")))
    lowest = F.lit(np.iinfo(np.int64).min).cast("long")
    queries = rows.where(F.col("vec_id").isNotNull() & asks).select("row", "vec_id", "v", "size", lowest.alias("floor"))
    home = _routed(queries, balls, True).join(parts, ["size", "cell"]).withColumn("sub", F.pmod(F.xxhash64("row"), F.col("parts"))).drop("parts")
    home, asked = session.measure(home, "home")
    near = session.materialize(_searched(dealt, home, k), "near")
    kth = near.groupBy("row").agg(F.min("score").alias("kth"), F.count(F.lit(1)).alias("found")).where(F.col("found") == k).select("row", "kth")
    kth, counted = session.measure(kth, "kth")
    raised = queries.join(session.broadcast_if_small(kth, counted), "row", "left").withColumn("floor", F.coalesce("kth", "floor")).drop("kth")
    others = _routed(raised, balls, False).join(parts, ["size", "cell"])
    others = others.withColumn("sub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
    others = others.join(session.broadcast_if_small(home.select("row", "size", "cell", "sub"), asked), ["row", "size", "cell", "sub"], "left_anti")
    far = _searched(dealt, others, k)
    best = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    merged = near.union(far).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return merged.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
