import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from labelflow.operators import splits


def rows(spark, labels):
    return spark.createDataFrame([(i, label) for i, label in enumerate(labels, start=1)], "__record_id long, label string").repartition(4)


def expected_counts(n, ratios):
    raw = [n * r for r in ratios]
    counts = [math.floor(v) for v in raw]
    order = sorted(range(3), key=lambda i: (counts[i] - raw[i], i))
    for i in order[: n - sum(counts)]:
        counts[i] += 1
    if n >= 3:
        for i in range(3):
            donor = counts.index(max(counts))
            if counts[i] == 0 and counts[donor] > 1:
                counts[i], counts[donor] = 1, counts[donor] - 1
    return counts


def expected_parts(labels, ratios, seed, counts_of):
    ids = {}
    for i, label in enumerate(labels, start=1):
        if label:
            ids.setdefault(label, []).append(i)
    parts = {}
    for label, members in ids.items():
        members = sorted(members, key=lambda i: hashlib.md5(f"{i}{seed}".encode()).hexdigest())
        train, upto = counts_of(len(members))
        for rank, i in enumerate(members):
            parts[i] = "train" if rank < train else "val" if rank < upto else "test"
    return parts


def assigned(df):
    return {r["__record_id"]: r["split"] for r in df.collect()}


def test_floor_split_of_twenty_rows(spark):
    df = splits.assign_splits(rows(spark, ["是"] * 10 + ["否"] * 10), "label")
    assert splits.split_sizes(df).first().asDict() == {"train_count": 16, "val_count": 2, "test_count": 2, "total_count": 20}


@pytest.mark.parametrize("limits", [{}, {"task_rows": 2}, {"max_broadcast": 1, "task_rows": 2}])
def test_floor_split_adds_ratios_as_doubles(spark, monkeypatch, limits):
    monkeypatch.setattr("labelflow.session.MAX_TASK_ROWS", 1)
    labels = ["hot"] * 200 + ["a"] * 10 + ["b"] * 3 + ["c"] + [None, ""] + [" "] * 2
    ratios = (0.7, 0.1, 0.2)
    df = splits.assign_splits(rows(spark, labels), "label", *ratios, seed=3, **limits)
    expected = expected_parts(labels, ratios, 3, lambda n: (math.floor(n * 0.7), math.floor(n * (0.7 + 0.1))))
    assert assigned(df) == expected


@pytest.mark.parametrize("limits", [{}, {"task_rows": 2}])
def test_largest_remainder_split(spark, limits):
    labels = ["hot"] * 150 + ["a"] * 7 + ["b"] * 3 + ["c"] * 2 + ["d"] + [None, "　"]
    ratios = (0.8, 0.1, 0.1)

    def counts_of(n):
        counts = expected_counts(n, ratios)
        return counts[0], counts[0] + counts[1]

    df = splits.assign_splits(rows(spark, labels), "label", *ratios, seed=5, rule="largest_remainder", **limits)
    assert assigned(df) == expected_parts([(v or "").strip() for v in labels], ratios, 5, counts_of)


def test_split_counts_agree_with_restatement(spark):
    rng = random.Random(3)
    for ratios in [(0.8, 0.1, 0.1), (0.7, 0.1, 0.2), (1.0, 0.0, 0.0), (0.34, 0.33, 0.33), (0.98, 0.01, 0.01), (0.0, 0.5, 0.5)]:
        sizes = list(range(0, 40)) + [rng.randint(40, 10**6) for _ in range(40)]
        df = spark.createDataFrame([(n,) for n in sizes], "n long")
        got = {r["n"]: r["c"] for r in df.select("n", splits.split_counts(F.col("n"), *ratios).alias("c")).collect()}
        for n in sizes:
            assert got[n] == expected_counts(n, ratios), (n, ratios)


def test_every_part_holds_every_label(spark):
    df = splits.assign_splits(rows(spark, ["是"] * 10 + ["否"] * 10), "label", seed=1, rule="largest_remainder")
    assert {(r["label"], r["split"]) for r in df.select("label", "split").distinct().collect()} == {
        (label, part) for label in ("是", "否") for part in ("train", "val", "test")
    }


def test_arguments_are_checked(spark):
    df = rows(spark, ["a"])
    for bad in [(0.8, 0.1, 0.2), (1.1, -0.1, 0.0)]:
        with pytest.raises(ValueError):
            splits.assign_splits(df, "label", *bad)
    with pytest.raises(ValueError):
        splits.assign_splits(df, "nope")
    with pytest.raises(ValueError):
        splits.assign_splits(df, "label", rule="other")


def test_wide_rows_are_not_shuffled(spark, tmp_path):
    rows(spark, ["a", "b"] * 50).withColumn("wide", F.lit("w" * 100)).write.parquet(str(tmp_path / "t"))
    df = splits.assign_splits(spark.read.parquet(str(tmp_path / "t")), "label")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    before_join = plan.split("Join Inner", 1)
    assert "Window" not in before_join[0]
    physical = df._jdf.queryExecution().sparkPlan().toString()
    assert "wide" in physical and "SortMergeJoin" not in physical.split("wide", 1)[0]
