"""How often operators read their input, and what they refuse."""

import pytest
from pyspark.sql import functions as F

from labelflow.operators import filters, ordering, sampling, splits
from labelflow.operators.paging import page
from labelflow.plans.stages import StageStore


def counted(spark, rows=400):
    """A table whose text column counts how often it is computed."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def noted(k):
        seen.add(1)
        return f"label{k % 3}"

    return spark.range(rows).select("id", noted.asNondeterministic()("id").alias("label")), seen


@pytest.mark.parametrize("limits", [{}, {"task_rows": 20}])
def test_splits_and_strata_compute_each_row_twice(spark, limits):
    df, seen = counted(spark)
    splits.assign_splits(df, "label", id_col="id", **limits).collect()
    assert seen.value <= 800
    df, seen = counted(spark)
    sampling.stratified_sample(df, "label", 50, id_col="id", **limits).collect()
    assert seen.value <= 800


def test_filtered_sample_and_page_compute_each_row_twice(spark):
    df, seen = counted(spark)
    assert sampling.filtered_sample(df, ["label"], ["label1"], 20, id_col="id").count() == 20
    assert seen.value <= 800
    df, seen = counted(spark)
    assert page(df, 10, 20, "id").count() == 20
    assert seen.value <= 400


def test_ids_without_value_are_refused(spark):
    df = spark.createDataFrame([(1, "a"), (None, "a"), (2, "b")], "id long, label string")
    for call in (lambda: sampling.random_sample(df, 1, id_col="id"), lambda: splits.assign_splits(df, "label", id_col="id"), lambda: sampling.stratified_sample(df, "label", 1, id_col="id")):
        with pytest.raises(ValueError, match="NULL"):
            call().collect()
    assert [r["id"] for r in page(df, 0, 5, "id").collect()] == [1, 2]


def test_pages_of_repeated_and_far_ids(spark):
    df = spark.createDataFrame([(k,) for k in (3, 1, 1, 2, 2, 2)], "id long")
    assert [r["id"] for r in page(df, 1, 2, "id").collect()] == [1, 2]
    assert page(df, 1, 2, "id", shallow=0).count() == 2
    ends = [-(1 << 63), -5, 0, 7, (1 << 63) - 1]
    far = spark.createDataFrame([(k,) for k in ends], "id long")
    assert [ordering.id_at_rank(far, "id", k + 1, task_rows=3) for k in range(5)] == ends
    assert [r["id"] for r in page(far, 1, 3, "id", shallow=0).collect()] == ends[1:4]


def test_the_driver_settles_few_keys(spark):
    keys = spark.range(5000).select(ordering.sort_key("id", 1).alias(ordering.KEY))
    wanted = sorted(r[0] for r in keys.collect())
    assert ordering.select_cut(keys, 2500, task_rows=2) == (wanted[2499], 5000)


def test_a_thousand_keywords(spark):
    df = spark.createDataFrame([(1, "has W0999 in it", None), (2, "nothing", "50% off"), (3, "w_1", "back\\slash 'q'"), (4, None, None)], "id long, a string, `b.c` string")
    words = [f"w{k:04d}" for k in range(1000)]
    find = lambda words, **modes: sorted(r["id"] for r in df.filter(filters.keyword_filter(df, ["a", "b.c"], words, **modes)).collect())
    assert find(words) == [1]
    assert find([*words, "50%"], literal=True) == [1, 2]
    assert find(["w%9 in"]) == [1] and find(["w%9 in"], literal=True) == []
    assert find(["w_1"], literal=True) == [3] and find(["w_1"]) == [3] and find(["w_09"], literal=True) == []
    assert find(["back\\slash", "'Q'"], keyword_mode="all") == [3]
    assert find(["back\\slash", "w_1"], keyword_mode="all") == [3]
    assert find(["back\\slash", "w_1"], keyword_mode="all", field_mode="same_field") == []
    assert find(["nothing", "50%"], keyword_mode="all", literal=True) == [2]
    assert find(words, keyword_mode="all") == []


def test_append_refuses_other_types_and_leaves_the_stage(spark, tmp_path):
    store = StageStore(spark, str(tmp_path / "dataset"))
    store.append("predictions", spark.range(3))
    for other in (spark.range(3).select(F.col("id").cast("string")), spark.range(3).select(F.col("id").alias("key")), spark.range(3).select(F.col("id").cast("int"))):
        with pytest.raises(ValueError, match="differ"):
            store.append("predictions", other)
    store.append("predictions", spark.range(3, 5))
    assert sorted(r["id"] for r in store.read("predictions").collect()) == [0, 1, 2, 3, 4]


def test_repeated_ids_are_scored_once(spark, tmp_path):
    from labelflow.streaming import incremental

    store = StageStore(spark, str(tmp_path / "dataset"))
    rows = spark.createDataFrame([(1,), (1,), (2,)], "__record_id long")
    assert incremental.resume_scoring(store, rows, lambda df: df) == 2
    assert incremental.resume_scoring(store, rows.union(spark.createDataFrame([(3,), (3,)], "id long")), lambda df: df) == 1
    assert sorted(r[0] for r in store.read("predictions").collect()) == [1, 2, 3]


@pytest.mark.parametrize("prefix", ["", "https://example.org/a long common beginning/"])
@pytest.mark.parametrize("task_rows", [3, 50, 65_536])
def test_text_at_rank(spark, prefix, task_rows):
    import random

    source = random.Random(4)
    ids = sorted({prefix + "".join(source.choice("ab中é0\U0001f600") for _ in range(source.randint(0, 7))) for _ in range(500)})
    df = spark.createDataFrame([(i,) for i in source.sample(ids, len(ids))] + [(None,)], "id string")
    for rank in (1, 2, 17, len(ids) // 2, len(ids)):
        assert ordering.text_at_rank(df, "id", rank, task_rows) == ids[rank - 1]
    assert ordering.text_at_rank(df, "id", 0, task_rows) is None
    assert ordering.text_at_rank(df, "id", len(ids) + 1, task_rows) is None


def test_deep_pages_over_text_ids_sort_no_rows_before_them(spark):
    df = spark.range(2000).selectExpr("concat('k', lpad(id * 7 % 2000, 5, '0')) as id", "id as v")
    for offset, limit in [(1500, 100), (1990, 100), (2000, 5), (0, 1200)]:
        rows = page(df, offset, limit, "id", shallow=50)
        assert [r["id"] for r in rows.collect()] == [f"k{k:05d}" for k in range(2000)][offset : offset + limit]
    plan = page(df, 1500, 100, "id", shallow=50)._jdf.queryExecution().optimizedPlan().toString()
    assert ">= k01500" in plan and "Offset" not in plan


@pytest.mark.parametrize("id_type", ["string", "long"])
@pytest.mark.parametrize("shallow", [0, 10_000])
def test_pages_of_repeated_ids_hold_each_row_once(spark, id_type, shallow):
    rows = [(str(100 + k // 3), float(-k), {"k": k}) for k in range(30)]
    df = spark.createDataFrame(rows, "id string, v double, m map<string,int>").withColumn("id", F.col("id").cast(id_type)).repartition(5)
    pages = [[(str(r["id"]), r["v"]) for r in page(df, first, 4, "id", shallow=shallow).collect()] for first in range(0, 32, 4)]
    assert [len(p) for p in pages] == [4] * 7 + [2]
    assert sum(pages, []) == sorted((k, v) for k, v, _ in rows)
