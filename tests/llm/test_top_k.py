"""Exact top-k search against all inner products."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelflow.llm import top_k
from labelflow.llm.queries import op13_exact_top_k

SCHEMA = "vec_id long, embedding array<double>"
def asks():
    return F.col("vec_id") % 50 == 0


def brute(rows, k=5):
    usable = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    usable = [(i, v) for i, v in usable if sum(x * x for x in v) < 2**62]
    out = []
    for a, (i, v) in enumerate(usable):
        if i is None or i % 50:
            continue
        scores = [(sum(x * y for x, y in zip(v, w)), j) for b, (j, w) in enumerate(usable) if a != b and len(v) == len(w)]
        scores.sort(key=lambda s: (-s[0], s[1] is None, s[1]))
        out += [(i, r, j, s) for r, (s, j) in enumerate(scores[:k], start=1)]
    return sorted(out, key=repr)


def result(df):
    assert df.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(map(tuple, df.collect()), key=repr)


def test_given_vectors(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert result(op13_exact_top_k(spark, "/root/testdata/sf0.001")) == brute(rows)


@pytest.mark.parametrize("shard_rows", [40, 700, 10_000])
def test_clusters_copies_and_ties(spark, shard_rows):
    source = np.random.default_rng(2)
    centres = source.standard_normal((6, 16))
    vectors = centres[source.integers(0, 6, 1500)] + 0.2 * source.standard_normal((1500, 16))
    vectors[200:600] = vectors[0]  # a group of copies that no shard holds whole
    vectors[600:700] = np.round(vectors[600:700])
    rows = [(int(k) - 300, [float(x) for x in v]) for k, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert result(top_k.search(df, asks(), shard_rows=shard_rows)) == brute(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.1, 0.2]), (0, [0.1, 0.2]), (50, [0.1, 0.3]), (1, [0.1, 0.2]), (None, [0.1, 0.2]), (None, [5.0, 5.0]), (2, None), (3, [nan, 1.0])]
    rows += [(4, [inf, 1.0]), (5, [None, 1.0]), (100, []), (150, []), (6, [0.0, 0.0]), (200, [-1.0, -1.0, 2.0]), (250, [1.0])]
    rows += [(7, [1e300, 1.0]), (8, [3e6, -3e6]), (300, [2e6, 1e6]), (350, [1e-300, -1e-300])]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"score": F.lit("x"), "row": F.lit(1), "a.b": F.lit(2)})
    assert result(top_k.search(df, asks())) == brute(rows)
    assert top_k.search(df.limit(0), asks()).collect() == []
    assert top_k.search(df, asks() & (F.col("vec_id") > 9999)).collect() == []


def test_products_beyond_doubles_are_exact(spark):
    source = np.random.default_rng(4)
    rows = [(k, [float(x) for x in source.uniform(-1e6, 1e6, 8)]) for k in range(120)]
    assert result(top_k.search(spark.createDataFrame(rows, SCHEMA), asks())) == brute(rows)


def test_more_lengths_than_have_cells(spark, monkeypatch):
    monkeypatch.setattr(top_k, "MAX_SIZES", 2)
    source = np.random.default_rng(5)
    rows = [(k * 10, [float(x) for x in source.standard_normal(k % 7)]) for k in range(140)]
    assert result(top_k.search(spark.createDataFrame(rows, SCHEMA), asks())) == brute(rows)


def test_bounds_are_never_too_low():
    source = np.random.default_rng(6)
    points = np.floor(source.standard_normal((500, 12)) * 100)
    tree = top_k.build(points, 16)
    queries = np.floor(source.standard_normal((20, 12)) * 100)
    norms = np.sqrt((queries**2).sum(axis=1))
    for node in range(len(tree.left)):
        inside = points[tree.order[tree.start[node] : tree.stop[node]]]
        bound = top_k.bounds(queries, norms, np.repeat(tree.centre[[node]], 20, 0), np.repeat(tree.radius[[node]], 20))
        assert (queries @ inside.T <= bound[:, None]).all()
    assert sorted(tree.order) == list(range(500))
