"""Connected components of a link table, by alternating star operations.

Each round points nodes at smaller neighbours (large star, then small star) and is
written to the scratch folder, so lineage stays short and lost executors cost one
round.  Minima are combined before the shuffle and written.  They then meet the
links by broadcast while their measured size allows it, and else in a shuffle join of
two plain tables, in which Spark can split a hub's links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelflow import session


ROWS_PER_TASK = 200_000


def sized(df: DataFrame, rows: int) -> DataFrame:
    """``df`` in no more partitions than its (at most) ``rows`` narrow rows need."""
    return df.coalesce(max(1, -(-rows // ROWS_PER_TASK)))


def _with_least(edges: DataFrame, rows: int) -> DataFrame:
    """``edges`` with the smallest neighbour of ``u`` as ``m``."""
    least, seen = session.measure(sized(edges.groupBy("u").agg(F.min("v").alias("m")), rows), "least")
    return edges.join(session.broadcast_if_small(least, seen), "u")


def _large_star(edges: DataFrame, rows: int) -> DataFrame:
    """All larger neighbours of u point at the smallest of u and its neighbours."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both, 2 * rows).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))


def _small_star(edges: DataFrame, rows: int) -> DataFrame:
    """``edges`` hold u > v; all smaller neighbours of u, and u, point at the smallest."""
    moved = F.when(F.col("v") != F.col("m"), F.col("v")).otherwise(F.col("u"))
    return _with_least(edges, rows).select(moved.alias("u"), F.col("m").alias("v"))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every node that has a link to another; component is the smallest node reachable."""
    edges = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    edges, state = _written(edges, None)
    while state["rows"]:
        following, reached = _written(_small_star(_large_star(edges, state["rows"]), state["rows"]), state["rows"])
        if reached == state:
            break
        edges, state = following, reached
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _written(edges: DataFrame, rows: int | None) -> tuple[DataFrame, dict]:
    edges = edges.distinct() if rows is None else sized(edges.distinct(), rows)
    return session.measure(edges, "edges", sum=F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
