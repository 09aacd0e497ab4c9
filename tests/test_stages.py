import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from labelflow.operators import judge, quality, sampling, splits
from labelflow.plans import stages
from labelflow.plans.stages import StageStore
from labelflow.sources import imports

cloudpickle.register_pickle_by_value(sys.modules[__name__])


@pytest.fixture()
def store(spark, tmp_path):
    return StageStore(spark, str(tmp_path / "dataset"))


def labelled(spark, n=20):
    return spark.range(1, n + 1).select(F.col("id").alias("__record_id"), F.concat(F.lit("text-"), "id").alias("摘要"), F.when(F.col("id") <= n / 2, "是").otherwise("否").alias("标签"))


def counts(store):
    return {r["stage"]: r["rows"] for r in store.counts().collect()}


def filled(spark, store):
    store.replace("raw", labelled(spark))
    store.write_sample(sampling.random_sample(store.read("raw"), 20, 1))
    store.write_labels(store.read("sampled").withColumn("LLM_ERROR", F.when(F.col("__record_id") == 3, "x").otherwise("")))
    store.promote("LLM_ERROR")
    store.write_splits(splits.assign_splits(store.read("sampled"), "标签"))
    store.append("predictions", labelled(spark).select("__record_id"))
    return store


def test_every_stage(spark, store):
    filled(spark, store)
    assert counts(store) == {"raw": 20, "sampled": 20, "labeled": 20, "reviewed": 19, "train": 16, "val": 2, "test": 2, "predictions": 20}
    assert store.read("train").columns == ["__record_id", "摘要", "标签", "__sample_source"]
    assert store.read("train").schema["__record_id"].dataType.simpleString() == "bigint"


def test_a_new_sample_clears_what_follows(spark, store):
    filled(spark, store)
    store.write_sample(sampling.random_sample(store.read("raw"), 5, 2))
    assert counts(store) == {"raw": 20, "sampled": 5, "labeled": 0, "reviewed": 0, "train": 0, "val": 0, "test": 0, "predictions": 0}


def test_clearing_from_reviewed_keeps_the_sample(spark, store):
    filled(spark, store)
    store.clear_downstream("reviewed")
    assert counts(store) == {"raw": 20, "sampled": 20, "labeled": 20, "reviewed": 19, "train": 0, "val": 0, "test": 0, "predictions": 0}
    store.clear_downstream("nothing")
    store.clear("derived")
    assert {stage for stage, rows in counts(store).items() if rows} == {"raw"}
    with pytest.raises(ValueError):
        store.clear("some")
    store.clear("all")
    assert set(counts(store).values()) == {0}


def test_one_split_can_be_dropped(spark, store):
    filled(spark, store)
    store.drop("val")
    assert not store.exists("val") and store.read("train").count() == 16
    with pytest.raises(ValueError):
        store.read("val")


def test_replace_reads_itself_and_refuses_nothing(spark, store):
    store.replace("labeled", labelled(spark))
    store.replace("labeled", store.read("labeled").filter("`标签` = '是'"))
    assert store.read("labeled").count() == 10
    with pytest.raises(ValueError):
        store.replace("labeled", labelled(spark).limit(0))
    assert store.read("labeled").count() == 10
    for call in (store.replace, store.append):
        with pytest.raises(ValueError):
            call("train", labelled(spark))
    with pytest.raises(ValueError):
        store.replace("other", labelled(spark))


def test_stringify_keeps_the_id(spark, store):
    df = spark.createDataFrame([(1, None, 2.5)], "__record_id long, a string, b double")
    store.replace("labeled", df, stringify=True)
    assert tuple(store.read("labeled").first()) == (1, "", "2.5")


def test_append_checks_the_columns(spark, store):
    df = spark.createDataFrame([(1, "x")], "id long, v string")
    assert store.append("predictions", df) == 1
    assert store.append("predictions", df.limit(0)) == 0
    assert store.append("predictions", df, part="p") == store.append("predictions", df, part="p") == 1
    assert store.read("predictions").count() == 2
    assert store.read("predictions", without_part="p").count() == 1
    with pytest.raises(ValueError):
        store.append("predictions", df.select("v", "id"))


def test_preview_and_guards(spark, store):
    assert store.preview("sampled").collect() == []
    store.replace("raw", labelled(spark))
    assert [r["__record_id"] for r in store.preview("raw", 3, 9).collect()] == [10, 11, 12]
    assert store.preview_raw(2).columns == ["摘要", "标签"]
    store.require_column("raw", "摘要")
    with pytest.raises(ValueError):
        store.require_column("raw", "nope")
    with pytest.raises(ValueError):
        store.read("sampled")


def test_imports_widen_the_raw_table(spark, store, tmp_path):
    def add(name, text, **options):
        path = tmp_path / name
        path.write_text(text)
        source = imports.csv_source(spark, [str(path)])
        imported = imports.import_files(source, store.columns(), imports.ImportOptions(**options), store.next_id())
        return store.add_import(imported)

    assert store.dataset_stats().first().asDict() == {"row_count": 0, "column_count": 0, "raw_data_ready": False}
    assert store.import_history().count() == 0 and store.columns() == []
    add("a.csv", "x,y\n1,2\n3,4\n")
    add("b.csv", "y,z,x\n5,6,7\n", allow_extra_columns=True)
    add("c.csv", "x,y,z\n8,9,0\n")
    got = store.read("raw").orderBy("__record_id").drop("__batch_id").collect()
    assert [tuple(r) for r in got] == [(1, "a.csv", "1", "2", ""), (2, "a.csv", "3", "4", ""), (3, "b.csv", "7", "5", "6"), (4, "c.csv", "8", "9", "0")]
    assert store.columns() == ["x", "y", "z"]
    assert store.dataset_stats().first().asDict() == {"row_count": 4, "column_count": 3, "raw_data_ready": True}
    assert [r["file_name"] for r in store.import_history(2).collect()] == ["c.csv", "b.csv"]
    store.clear("raw")
    assert store.columns() == [] and store.import_history().count() == 0 and store.next_id() == 1


def test_csv_output(spark, tmp_path):
    df = spark.createDataFrame([(i, None if i % 2 else f'q"{i},\n') for i in range(25)], "id long, v string").coalesce(1)
    stages.export_csv(df, str(tmp_path / "out"), sheet_rows=11)
    files = sorted((tmp_path / "out").glob("part-*.csv"))
    assert len(files) == 3 and all(f.read_text("utf-8").startswith("\ufeffid,v\n") for f in files)
    assert '0,"q""0,\n"\n1,\n' in files[0].read_text()
    stages.write_csv(df, str(tmp_path / "plain"))
    imported = imports.import_files(imports.csv_source(spark, [str(tmp_path / "plain")]))
    assert imported.rows.count() == 25


def test_union_records(spark):
    a, b = spark.createDataFrame([(1, 2)], "x int, y int"), spark.createDataFrame([(3, 4)], "z int, x int")
    assert stages.union_records(a, b).columns == ["x", "y", "z"]
    assert {tuple(r) for r in stages.union_records(a, b).collect()} == {(1, 2, None), (4, None, 3)}


def test_odd_column_names_go_through_the_whole_flow(spark, store, tmp_path):
    path = tmp_path / "odd.csv"
    path.write_text('a.b,"x`y, (z)",size,split,rank\n' + "".join(f"g{i % 2},text {i},{i},s,r\n" for i in range(20)))
    store.add_import(imports.import_files(imports.csv_source(spark, [str(path)])))
    names = ["a.b", "x`y, (z)", "size", "split", "rank"]
    assert store.read("raw").columns == ["__record_id", "__batch_id", "__source_file", *names]
    store.write_sample(sampling.stratified_sample(store.read("raw"), "a.b", 10))
    assert store.read("sampled").columns[3:-1] == names
    parts = splits.assign_splits(store.read("sampled"), "a.b")
    assert parts.columns == [*[c for c in store.read("sampled").columns if c != "split"], "split"]
    scorer = lambda texts: ['{"is_target": true}' for _ in texts]
    config = judge.JudgeConfig(text_column="x`y, (z)", raw_column="raw.json")
    judged = judge.judge(judge.judge(store.read("sampled"), scorer, config), scorer, config)
    store.write_labels(judged)
    assert store.promote("LLM_ERROR") == 10
    assert store.read("reviewed").columns == [*store.read("sampled").columns, "LLM判定", "LLM理由", "raw.json", "LLM_ERROR"]
    assert quality.label_distribution(store.read("reviewed"), "a.b").count() == 2
    assert store.preview("reviewed", 3, 2).count() == 3
    assert sampling.filtered_sample(store.read("raw"), ["x`y, (z)"], ["text 1"], 50).count() == 11
    stages.export_csv(store.read("reviewed"), str(tmp_path / "out"))
    assert sum(len(f.read_text().splitlines()) - 1 for f in (tmp_path / "out").glob("part-*.csv")) == 10


def delivery(tmp_path, name, text):
    folder = tmp_path / "in"
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(text)
    return str(folder / name)


@pytest.mark.parametrize("step", ["write", "publish", "ledger"])
@pytest.mark.parametrize("earlier", [False, True])
def test_an_import_that_fails_is_not_seen_and_can_be_repeated(spark, store, tmp_path, monkeypatch, step, earlier):
    options = imports.ImportOptions(allow_extra_columns=True)
    if earlier:
        store.import_csv([delivery(tmp_path, "a.csv", "x\n1\n")], options)
        store.write_sample(store.read("raw"))
    path = delivery(tmp_path, "b.csv", "x,y\n2,3\n4,5\n")

    def fail(*args, **kwargs):
        raise RuntimeError("lost")

    with monkeypatch.context() as broken:
        if step == "write":
            broken.setattr(store, "clear_downstream", fail)
        elif step == "publish":
            broken.setattr(store, "_finish", fail)
        else:
            broken.setattr(imports, "LEDGER", "")
            true = store._finish
            broken.setattr(store, "_finish", lambda batch, imported, schema: true(batch, stages.replace(imported, ledger=imported.ledger.withColumn("x", F.raise_error(F.lit("lost")))), schema))
        with pytest.raises(Exception, match="lost"):
            store.import_csv([path], options)
    assert store.exists("raw") == earlier
    assert store.columns() == (["x"] if earlier else [])
    assert store.import_history().count() == int(earlier)
    assert store.next_id() == 1 + int(earlier)
    if earlier:
        assert [tuple(r)[3:] for r in store.read("raw").collect()] == [("1",)]
    if step == "write" and earlier:
        assert store.exists("sampled")
    assert store.import_csv([path], options) == 2
    got = sorted(tuple(r)[3:] for r in store.read("raw").collect())
    assert got == ([("1", "")] if earlier else []) + [("2", "3"), ("4", "5")]
    assert sorted(r["__record_id"] for r in store.read("raw").collect()) == list(range(1, len(got) + 1))
    assert store.import_history().count() == 1 + int(earlier)
    assert not store.exists("sampled")
    assert [r["column_name"] for r in store.published_schema().orderBy("column_index").collect()] == ["x", "y"]


def test_a_part_imported_again_replaces_itself(spark, store, tmp_path):
    first, second = delivery(tmp_path, "a.csv", "x\n1\n2\n"), delivery(tmp_path, "b.csv", "x\n3\n")
    store.import_csv([first], part="one")
    store.import_csv([second], part="two")
    assert store.next_id(without_part="two") == 3
    store.import_csv([second], part="two")
    assert sorted(tuple(r)[0::3] for r in store.read("raw").collect()) == [(1, "1"), (2, "2"), (3, "3")]
    assert store.import_history().count() == 2
    store.clear("raw")
    assert not store.exists("raw") and store.columns() == [] and store.import_history().count() == 0
    assert store.import_csv([second]) == 1


def test_known_files_are_skipped(spark, store, tmp_path):
    first = delivery(tmp_path, "a.csv", "x\n1\n2\n")
    assert store.import_csv([first], skip_known=True) == 2
    again, new, twice = delivery(tmp_path, "again.csv", "x\n1\n2\n"), delivery(tmp_path, "b.csv", "x\n3\n"), delivery(tmp_path, "c.csv", "x\n3\n")
    assert store.import_csv([again, new, twice], skip_known=True) == 1
    assert store.import_csv([first], skip_known=True) == 0
    assert sorted(r["x"] for r in store.read("raw").collect()) == ["1", "2", "3"]
    ledger = sorted((r["file_name"], r["status"], r["row_count"]) for r in store.import_history().collect())
    assert ledger == [("a.csv", "imported", 2), ("a.csv", "skipped", 0), ("again.csv", "skipped", 0), ("b.csv", "imported", 1), ("c.csv", "skipped", 0)]
    assert store.columns() == ["x"]
    assert store.import_csv([first]) == 2


@pytest.mark.parametrize("text_ids", [False, True])
def test_sheets_follow_the_ids(spark, tmp_path, text_ids):
    ids = [f"k{k * 37 % 250:03d}" if text_ids else k * 37 % 250 * 10**15 for k in range(250)]
    kind = "string" if text_ids else "long"
    df = spark.createDataFrame([(i, f"v,{i}") for i in ids], f"`a.b` {kind}, sheet string").repartition(7)
    stages.export_csv(df, str(tmp_path / "out"), sheet_rows=101, id_col="a.b")
    files = sorted((tmp_path / "out").glob("sheet_number=*/*.csv"))
    assert [f.parent.name for f in files] == [f"sheet_number={k}" for k in (1, 2, 3)]
    got = [[line.split(",")[0] for line in f.read_text(encoding="utf-8-sig").splitlines()[1:]] for f in files]
    assert [len(sheet) for sheet in got] == [100, 100, 50]
    assert [i for sheet in got for i in sheet] == [str(i) for i in sorted(ids)]


def test_sheets_of_nothing_and_of_rows_without_id(spark, tmp_path):
    df = spark.createDataFrame([(None, "a"), (2, "b"), (1, "c")], "id long, v string")
    stages.export_csv(df.limit(0), str(tmp_path / "none"), id_col="id")
    stages.export_csv(df, str(tmp_path / "some"), sheet_rows=3, id_col="id")
    back = spark.read.csv(str(tmp_path / "some"), header=True).collect()
    assert sorted((r["v"], r["sheet"]) for r in back) == [("a", 1), ("b", 1), ("c", 1)]
