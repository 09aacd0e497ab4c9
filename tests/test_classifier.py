import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from labelflow.operators import classifier

CONFIG = classifier.TrainConfig(text_column="text", label_column="label", id_column="id", features=1 << 10, max_iterations=20, regularizations=(0.01, 0.1))


def documents(spark, n=120):
    words = F.when(F.col("id") % 2 == 0, "低空物流 drone delivery").otherwise("电池系统 battery cell")
    part = F.when(F.col("id") % 10 < 8, "train").when(F.col("id") % 10 == 8, "val").otherwise("test")
    # Parts 8 and 9 each hold one class, so ids shift them by tens.
    label = F.when(F.col("id") % 2 == 0, "是").otherwise("否")
    return spark.range(n).select("id", F.concat(words, F.lit(" "), F.col("id") % 7).alias("text"), label.alias("label"), part.alias("split"))


def test_training_samples(spark):
    df = spark.createDataFrame([(1, " hello ", "是"), (2, "", "否"), (3, "x", None), (4, "y", ""), (5, "z", "maybe")], "id long, text string, label string")
    kept = classifier.training_samples(df, "text", "label", "id", strict=False)
    assert [tuple(r) for r in kept.collect()] == [(1, "hello", 1)]
    with pytest.raises(PySparkException):
        classifier.training_samples(df, "text", "label", "id").collect()


def test_train_score_save_and_reevaluate(spark, tmp_path):
    df = documents(spark)
    result = classifier.train_classifier(df, CONFIG)
    metrics = {r["split"]: r for r in result.metrics.collect()}
    assert {part: metrics[part]["support"] for part in metrics} == {"train": 96, "val": 12, "test": 12}
    assert metrics["train"]["accuracy"] == metrics["test"]["accuracy"] == 1.0 and metrics["test"]["loss"] < 0.5
    assert [c[0] for c in result.candidates] == [0.01, 0.1]
    details = result.details.filter("split = 'test'").collect()
    assert len(details) == 12 and all(r["is_correct"] and 0.5 <= r["confidence"] <= 1 for r in details)
    assert result.details.columns == ["split", "index", "text", "true_label", "predicted_label", "positive_probability", "confidence", "is_correct", "loss"]

    scored = classifier.score(df.select("id", "text"), result.model, "text")
    assert scored.columns == ["id", "text", "预测标签", "正样本概率", "预测置信度"] and scored.count() == 120
    assert scored.filter("(id % 2 = 0) <> (`预测标签` = '正样本')").count() == 0

    path = str(tmp_path / "runs" / "one")
    classifier.save_result(result, path)
    again = {r["split"]: r["support"] for r in classifier.reevaluate(df.filter("id < 60"), path, CONFIG).collect()}
    assert again == {"train": 48, "val": 6, "test": 6}
    assert spark.read.parquet(f"{path}/details").count() == 60
    classifier.save_result(result, str(tmp_path / "runs" / "two"))
    assert [r["run"] for r in classifier.newest_runs(spark, str(tmp_path / "runs"), 5).collect()] == ["two", "one"]


def test_first_candidate_wins_without_validation_rows(spark):
    result = classifier.train_classifier(documents(spark).filter("split = 'train'"), CONFIG)
    assert [c[1] for c in result.candidates] == [0.0, 0.0]
    assert {r["split"] for r in result.metrics.collect()} == {"train"}


def test_training_needs_two_classes(spark):
    df = documents(spark)
    with pytest.raises(ValueError, match="both classes"):
        classifier.train_classifier(df.filter("id % 2 = 0"), CONFIG)
    with pytest.raises(ValueError, match="two samples"):
        classifier.train_classifier(df.filter("id = 0"), CONFIG)
