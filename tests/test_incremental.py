import pytest
from pyspark.sql import functions as F

from labelflow.plans.stages import StageStore
from labelflow.sources.imports import ImportOptions
from labelflow.streaming import incremental
from labelflow.streaming.finished import FinishedIds


@pytest.fixture()
def store(spark, tmp_path):
    return StageStore(spark, str(tmp_path / "dataset"))


def double(rows):
    return rows.withColumn("score", F.col("__record_id") * 2)


def ids(spark, low, high):
    return spark.range(low, high).withColumnRenamed("id", "__record_id")


def test_resumed_scoring_adds_only_what_is_missing(spark, store):
    assert incremental.resume_scoring(store, ids(spark, 0, 10), double) == 10
    assert incremental.resume_scoring(store, ids(spark, 0, 15), double) == 5
    assert incremental.resume_scoring(store, ids(spark, 0, 15), double) == 0
    assert sorted(tuple(r) for r in store.read("predictions").collect()) == [(i, 2 * i) for i in range(15)]
    assert incremental.resume_scoring(store, ids(spark, 0, 3), double, restart=True) == 3


def test_a_failed_run_keeps_its_finished_slices(spark, store):
    def fragile(rows):
        return double(rows.withColumn("__record_id", F.when(F.col("__record_id") < 8, F.col("__record_id")).otherwise(F.raise_error(F.lit("stop")).cast("long"))))

    with pytest.raises(Exception, match="stop"):
        incremental.resume_scoring(store, ids(spark, 0, 11), fragile, slices=3)
    assert store.read("predictions").count() == 8
    assert incremental.resume_scoring(store, ids(spark, 0, 11), double, slices=3) == 3
    assert sorted(tuple(r) for r in store.read("predictions").collect()) == [(i, 2 * i) for i in range(11)]
    assert incremental.resume_scoring(store, ids(spark, 5, 5), double, slices=3) == 0


def test_incremental_scoring(spark, store, tmp_path):
    source = str(tmp_path / "in")
    schema = ids(spark, 0, 1).schema
    expected = [10, 15, 15]
    for (low, high), total in zip([(0, 10), (8, 15), (0, 15)], expected):
        ids(spark, low, high).write.mode("append").parquet(source)
        incremental.incremental_scoring(store, source, schema, double)
        assert store.read("predictions").count() == total
    store.drop("predictions")
    incremental.incremental_scoring(store, source, schema, double)
    assert store.read("predictions").select("__record_id").distinct().count() == 15


def test_incremental_import(spark, store, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.csv").write_text("x,y\n1,2\n")
    incremental.incremental_import(store, str(source), ImportOptions(allow_extra_columns=True))
    incremental.incremental_import(store, str(source), ImportOptions(allow_extra_columns=True))
    (source / "a b.csv").write_text("y,x,w\n4,3,5\n")
    (source / "notes.txt").write_text("not a table")
    incremental.incremental_import(store, str(source), ImportOptions(allow_extra_columns=True))
    got = store.read("raw").orderBy("__record_id").select("__record_id", "__source_file", "x", "y", "w").collect()
    assert [tuple(r) for r in got] == [(1, "a.csv", "1", "2", ""), (2, "a b.csv", "3", "4", "5")]
    assert store.import_history().count() == 2


def hashed(spark, low, high):
    return spark.range(low, high).select(F.md5(F.col("id").cast("string")).alias("__record_id"))


def test_only_buckets_that_may_hold_an_id_are_read(spark, store):
    for part, (low, high) in {"one": (0, 20_000), "two": (20_000, 40_000)}.items():
        store.append("predictions", hashed(spark, low, high), part=part)
        FinishedIds(store, "__record_id").add(part)
    index = FinishedIds(store, "__record_id")
    new = index.maybe_finished(hashed(spark, 50_000, 50_200))
    assert len(new.inputFiles()) <= 4
    some = index.maybe_finished(hashed(spark, 19_995, 20_005))
    assert 10 <= len(some.inputFiles()) <= 16
    known = {r[0] for r in some.collect()}
    assert {r[0] for r in hashed(spark, 19_995, 20_005).collect()} <= known and len(known) < 2500
    assert {r[0] for r in hashed(spark, 20_000, 20_005).collect()}.isdisjoint(r[0] for r in index.maybe_finished(hashed(spark, 20_000, 20_005), without_part="two").collect())
    assert index.maybe_finished(hashed(spark, 0, 0)).count() == 0


def test_parts_without_an_index_are_read_themselves(spark, store):
    index = FinishedIds(store, "__record_id")
    store.append("predictions", ids(spark, 0, 100), part="plain")
    assert index.maybe_finished(ids(spark, 50, 150)).count() == 100
    store.append("predictions", ids(spark, 100, 200), part="more")
    index.add("more")
    found = {r[0] for r in index.maybe_finished(ids(spark, 150, 160)).collect()}
    assert set(range(100)) | set(range(150, 160)) <= found
    index.add("more")  # a replayed part is indexed anew
    store.drop("predictions")
    assert index.maybe_finished(ids(spark, 0, 5)) is None


def test_a_crash_before_the_index_scores_nothing_twice(spark, store, tmp_path, monkeypatch):
    source = str(tmp_path / "in")
    hashed(spark, 0, 50).write.parquet(source)

    def twice(rows):
        return rows.withColumn("score", F.lit(1))

    with monkeypatch.context() as broken:
        broken.setattr(FinishedIds, "add", lambda self, part: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(Exception, match="lost"):
            incremental.incremental_scoring(store, source, hashed(spark, 0, 1).schema, twice)
    for low, high in ((0, 50), (40, 90)):
        hashed(spark, low, high).write.mode("append").parquet(source)
        incremental.incremental_scoring(store, source, hashed(spark, 0, 1).schema, twice)
    assert store.read("predictions").count() == store.read("predictions").distinct().count() == 90
