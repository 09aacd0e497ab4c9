import numpy as np
import pytest
from pyspark.sql import functions as F

from labelflow.operators import classifier, epochs

CONFIG = epochs.EpochConfig(text_column="text", label_column="label", id_column="id", features=1 << 12, epochs=5)


def documents(spark, n=400):
    """The first word tells the class; the others say nothing."""
    word = F.when(F.col("id") % 2 == 0, "kite").otherwise("stone")
    part = F.when(F.col("id") % 10 < 7, "train").when(F.col("id") % 10 < 9, "val").otherwise("test")
    noise = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(20)), lambda k: F.concat(F.lit("w"), (F.xxhash64("id", k) % 50).cast("string"))), " ")
    return spark.range(n).select("id", F.concat_ws(" ", word, word, word, noise).alias("text"), F.when(F.col("id") % 2 == 0, 1).otherwise(0).alias("label"), part.alias("split"))


def test_epochs_learn_and_score(spark, tmp_path):
    df = documents(spark)
    result = epochs.train_by_epochs(df, CONFIG)
    metrics = {r["split"]: r for r in result.metrics.collect()}
    assert {part: metrics[part]["support"] for part in metrics} == {"train": 280, "val": 80, "test": 40}
    assert metrics["test"]["accuracy"] >= 0.95 and metrics["train"]["loss"] < 0.5
    assert [epoch for epoch, _ in result.candidates] == [1, 2, 3, 4, 5]
    result.model.save(spark, str(tmp_path / "model"))
    model = epochs.LinearModel.load(spark, str(tmp_path / "model"))
    scored = classifier.score(df.select("id", "text"), model, "text")
    assert scored.columns == ["id", "text", "预测标签", "正样本概率", "预测置信度"] and scored.count() == 400
    assert scored.filter("(id % 2 = 0) = (`预测标签` = '正样本')").count() >= 380
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "kite " * 100_000), (4, "!!")], "id long, text string")
    found = {r["id"]: r["正样本概率"] for r in classifier.score(odd, model, "text").collect()}
    assert found[3] > 0.75 and found[1] == found[2] == found[4] == pytest.approx(1 / (1 + np.exp(-model.bias)))


def test_the_best_epoch_wins_even_an_early_one(spark, monkeypatch):
    true, seen = epochs.binary_metrics, []

    def falling(rows, **options):
        seen.append(rows)
        measured = true(rows, **options).withColumn("f1", F.lit([0.5, 0.9, 0.9, 0.1][len(seen) - 1]))
        return measured.withColumn("loss", F.lit([0.4, 0.1, 0.2, 0.0][len(seen) - 1]))

    monkeypatch.setattr(epochs, "binary_metrics", falling)
    states = []
    step = epochs._epoch
    monkeypatch.setattr(epochs, "_epoch", lambda *a: states.append(step(*a)) or states[-1])
    result = epochs.train_by_epochs(documents(spark), epochs.EpochConfig(**{**CONFIG.__dict__, "epochs": 4}))
    assert result.candidates == [(1, 0.5), (2, 0.9), (3, 0.9), (4, 0.1)]
    assert np.allclose(result.model.weights, states[1].weights, atol=1e-6)
    assert not np.allclose(result.model.weights, states[3].weights, atol=1e-6)


def test_a_run_goes_on_from_its_checkpoints(spark, tmp_path, monkeypatch):
    path, df = str(tmp_path / "epochs"), documents(spark)
    whole = epochs.train_by_epochs(df, CONFIG, str(tmp_path / "whole"))
    step, calls = epochs._epoch, []

    def failing(*arguments):
        calls.append(1)
        if len(calls) == 3:
            raise RuntimeError("lost")
        return step(*arguments)

    monkeypatch.setattr(epochs, "_epoch", failing)
    with pytest.raises(RuntimeError):
        epochs.train_by_epochs(df, CONFIG, path)
    resumed = epochs.train_by_epochs(df, CONFIG, path)
    assert len(calls) == 6
    assert [epoch for epoch, _ in resumed.candidates] == [1, 2, 3, 4, 5]
    assert np.allclose(resumed.model.weights, whole.model.weights, atol=1e-5)


def test_tasks_without_rows_and_one_class(spark):
    df = documents(spark, 60).repartition(40)
    assert len(epochs.train_by_epochs(df, CONFIG).candidates) == 5
    with pytest.raises(ValueError, match="both classes"):
        epochs.train_by_epochs(df.filter("label = 1"), CONFIG)
    with pytest.raises(ValueError, match="two samples"):
        epochs.train_by_epochs(df.filter("split = 'val'"), CONFIG)


def test_weights_do_not_depend_on_the_cut_of_the_input(spark, monkeypatch):
    monkeypatch.setattr(epochs, "TASK_ROWS", 70)
    config = epochs.EpochConfig(**{**CONFIG.__dict__, "epochs": 2})
    first, second = (epochs.train_by_epochs(documents(spark).repartition(n), config) for n in (3, 11))
    assert np.array_equal(first.model.weights, second.model.weights) and first.model.bias == second.model.bias
    assert first.candidates == second.candidates
