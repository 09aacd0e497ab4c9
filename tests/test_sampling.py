import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from labelflow.operators import ordering, sampling
from labelflow.operators.paging import head, max_page, page

MISSING = "未填写"


def shuffled(ids, seed):
    return sorted(ids, key=lambda i: hashlib.md5(f"{i}{seed}".encode()).hexdigest())


def records(spark, groups):
    """Rows with ids from 1 and the given group values."""
    return spark.createDataFrame([(i, g) for i, g in enumerate(groups, start=1)], "__record_id long, grp string").repartition(5)


def expected_allocation(sizes, n):
    """Plain restatement of the proportional allocation over sorted groups."""
    total = sum(sizes.values())
    n = min(n, total)
    share = {g: sizes[g] / total * n for g in sorted(sizes)}
    take = {g: math.floor(share[g]) for g in share}
    budget = n - sum(take.values())
    for g in [g for g in take if take[g] == 0][:budget]:
        take[g] = 1
    budget = n - sum(take.values())
    by_fraction = sorted((g for g in take if take[g] < sizes[g]), key=lambda g: (math.floor(share[g]) - share[g], g))
    for g in by_fraction[:budget]:
        take[g] += 1
    return take


def allocate(spark, sizes, n, **kwargs):
    df = spark.createDataFrame(list(sizes.items()), "__stratum string, size long")
    return {r["__stratum"]: r["take"] for r in sampling.proportional_allocation(df, n, **kwargs).collect()}


def test_random_sample_is_exact_and_reproducible(spark):
    df = records(spark, ["x"] * 200)
    first = [r[0] for r in sampling.random_sample(df, 40, 7).select("__record_id").collect()]
    again = [r[0] for r in sampling.random_sample(df.repartition(1), 40, 7).select("__record_id").collect()]
    assert sorted(first) == sorted(again) == sorted(shuffled(range(1, 201), 7)[:40])
    assert sampling.random_sample(df, 500).count() == 200
    assert sampling.random_sample(df, 0, allow_zero=True).count() == 0
    assert [r[0] for r in sampling.random_sample(df, 3).select("__sample_source").collect()] == ["random"] * 3
    with pytest.raises(ValueError):
        sampling.random_sample(df, 0)


def test_select_cut_refines_large_prefixes(spark):
    ids = list(range(3000))
    keys = spark.createDataFrame([(i,) for i in ids], "id long").select(ordering.sort_key("id", 3).alias("__key"))
    wanted = sorted(hashlib.md5(f"{i}3".encode()).hexdigest() for i in ids)
    for n in (1, 2, 1500, 2999):
        assert ordering.select_cut(keys, n, task_rows=1) == (wanted[n - 1], 3000)


def test_allocation_examples(spark):
    assert allocate(spark, {"A": 8, "B": 2}, 5) == {"A": 4, "B": 1}
    assert allocate(spark, {"a": 94, "b": 3, "c": 3}, 10) == {"a": 9, "b": 1, "c": 0}
    assert allocate(spark, {"a": 9, "b": 18, "c": 13}, 4) == expected_allocation({"a": 9, "b": 18, "c": 13}, 4)
    assert allocate(spark, {"a": 2, "b": 1}, 10) == {"a": 2, "b": 1}
    assert allocate(spark, {"a": 2, "b": 1}, 0) == {"a": 0, "b": 0}


@pytest.mark.parametrize("max_strata", [100_000, 3])
def test_allocation_agrees_with_restatement_in_one_task_and_in_parallel(spark, max_strata):
    rng = random.Random(5)
    for _ in range(4):
        sizes = {f"g{i:03d}": rng.choice([1, 1, 2, 7, 60, 900]) for i in range(rng.randint(4, 40))}
        n = rng.randint(1, sum(sizes.values()))
        got = allocate(spark, sizes, n, max_strata=max_strata)
        assert got == expected_allocation(sizes, n)
        assert sum(got.values()) == n and all(got[g] <= sizes[g] for g in sizes)


def expected_stratified(groups, n, seed):
    ids = {}
    for i, g in enumerate(groups, start=1):
        ids.setdefault(g or MISSING, []).append(i)
    take = expected_allocation({g: len(v) for g, v in ids.items()}, n)
    return sorted(i for g in ids for i in shuffled(ids[g], seed)[: take[g]])


@pytest.mark.parametrize(
    "limits",
    [{}, {"task_rows": 2}, {"max_broadcast": 2}, {"task_rows": 2, "max_broadcast": 2, "max_strata": 3}],
)
def test_stratified_sample_with_a_hot_stratum(spark, monkeypatch, limits):
    monkeypatch.setattr("labelflow.session.MAX_TASK_ROWS", 2)
    rng = random.Random(1)
    groups = ["hot"] * 300 + [rng.choice([None, "", "b", "c", "d", "e"]) for _ in range(300)]
    rng.shuffle(groups)
    sample = sampling.stratified_sample(records(spark, groups), "grp", 101, 9, **limits)
    assert sample.columns == ["__record_id", "grp", "__sample_source"]
    assert sorted(r[0] for r in sample.select("__record_id").collect()) == expected_stratified(groups, 101, 9)


def test_stratified_sample_by_region(spark):
    sample = sampling.stratified_sample(records(spark, ["北京"] * 5 + ["上海"] * 5), "grp", 4, 1)
    assert {r["grp"]: r["count"] for r in sample.groupBy("grp").count().collect()} == {"北京": 2, "上海": 2}
    assert {r[0] for r in sample.select("__sample_source").collect()} == {"stratified"}
    with pytest.raises(ValueError):
        sampling.stratified_sample(sample, "", 4)
    with pytest.raises(ValueError):
        sampling.stratified_sample(sample, "nope", 4)


def test_id_at_rank_and_pages(spark):
    rng = random.Random(2)
    ids = sorted(rng.sample(range(-(10**12), 10**12), 500))
    df = spark.createDataFrame([(i, f"v{i}") for i in ids], "__record_id long, v string").repartition(3)
    for rank in (1, 2, 250, 500):
        assert ordering.id_at_rank(df, "__record_id", rank, task_rows=8) == ids[rank - 1]
    assert ordering.id_at_rank(df, "__record_id", 501) is None
    assert [r[0] for r in page(df, 100, 7).collect()] == ids[100:107]
    assert [r[0] for r in page(df, 0, 3).collect()] == ids[:3]
    assert [r[0] for r in page(df, 498, 10).collect()] == ids[498:]
    assert page(df, 500, 10).count() == 0
    assert [r[0] for r in page(df.withColumn("s", F.lpad("v", 20, "0")), 1, 2, "s").select("s").collect()] == sorted(f"v{i}".rjust(20, "0") for i in ids)[1:3]
    assert head(df, -1).count() == 0 and head(df, 2).count() == 2
    assert (max_page(0, 50), max_page(50, 50), max_page(51, 50)) == (1, 1, 2)


def test_global_rank_by_ranges(spark):
    values = [(k, i) for i, k in enumerate(["same"] * 50 + [f"k{j}" for j in range(40)])]
    df = spark.createDataFrame(values, "k string, i long")
    ranked = ordering.global_rank(df, [F.desc("k"), F.col("i")], "rank", len(values), task_rows=7)
    got = [(r["k"], r["i"]) for r in sorted(ranked.collect(), key=lambda r: r["rank"])]
    assert got == sorted(values, key=lambda v: ([-ord(c) for c in v[0]] + [1], v[1]))
    assert sorted(r["rank"] for r in ranked.collect()) == list(range(1, 91))
