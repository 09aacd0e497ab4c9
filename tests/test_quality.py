import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from labelflow.operators import metrics, quality


def frame(spark, values, name="label"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"id long, {name} string")


def test_label_distribution(spark):
    df = frame(spark, ["是", "否", "", None, "是", " 是"])
    assert [(r["label"], r["rows"]) for r in quality.label_distribution(df, "label").collect()] == [
        ("是", 2), ("未标注", 2), (" 是", 1), ("否", 1),
    ]
    assert {r["label"]: r["rows"] for r in quality.label_distribution(df, "label", trim=True).collect()} == {"是": 3, "否": 1, "未标注": 2}
    with pytest.raises(ValueError):
        quality.label_distribution(df, "nope")


def test_missing_labels_and_low_confidence(spark):
    assert [r["id"] for r in quality.missing_label_rows(frame(spark, ["是", "", None, "　"]), "label").collect()] == [1, 2, 3]
    scores = frame(spark, ["0.9", "0.5", "bad", None, "nan", "-inf"], "score")
    assert [r["id"] for r in quality.low_confidence_rows(scores, "score").collect()] == [1, 5]
    assert quality.low_confidence_rows(scores.withColumn("n", F.col("id") / 2), "n", 0.6).count() == 2


def kappa(spark, pairs, **kwargs):
    df = spark.createDataFrame(pairs, "a string, b string")
    return quality.cohen_kappa(df, "a", "b", **kwargs).first()


def test_cohen_kappa(spark):
    assert kappa(spark, list(zip("是是否否", "是否否否")))["kappa"] == pytest.approx(0.5)
    assert kappa(spark, [])["kappa"] == 0.0
    assert kappa(spark, [("x", " x ")] * 3)["kappa"] == 1.0
    assert kappa(spark, [(None, ""), ("a", "b")]) == kappa(spark, [("", "　"), ("a", "b")])
    assert kappa(spark, [(None, ""), ("a", "a"), ("a", "b")], drop_missing=True)["pairs"] == 2


def test_cohen_kappa_agrees_with_plain_counts(spark):
    rng = random.Random(4)
    pairs = [(rng.choice("aaab"), rng.choice("aabc")) for _ in range(400)]
    n = len(pairs)
    first, second = Counter(a for a, _ in pairs), Counter(b for _, b in pairs)
    expected = sum(first[k] * second[k] for k in first) / n**2
    observed = sum(a == b for a, b in pairs) / n
    assert kappa(spark, pairs)["kappa"] == pytest.approx((observed - expected) / (1 - expected))


def test_quality_summary(spark):
    df = frame(spark, ["是", "", None, "否 ", "否"]).withColumn("score", F.array(*[F.lit(v) for v in ["0.1", "x", "0.2", "0.9", None]])[F.col("id")])
    got = {(r["item"], r["label"]): r["rows"] for r in quality.quality_summary(df, "label", "score").collect()}
    assert got == {
        ("total", None): 5,
        ("missing_label_count", None): 2,
        ("low_confidence_count", None): 2,
        ("label_distribution", "是"): 1,
        ("label_distribution", "否"): 2,
        ("label_distribution", "未标注"): 2,
    }
    assert "low_confidence_count" not in {r["item"] for r in quality.quality_summary(df, "label").collect()}


def test_next_record_id(spark):
    df = spark.createDataFrame([(4,), (9,)], "__record_id long")
    assert quality.next_record_id(df).first()["next_id"] == 10
    assert quality.next_record_id(df.limit(0)).first()["next_id"] == 1


def predictions(spark, rows, schema="prediction int, label int, split string"):
    return spark.createDataFrame(rows, schema)


def test_binary_metrics(spark):
    df = predictions(spark, list(zip([1, 0, 1, 0], [1, 0, 0, 0], ["a"] * 4)))
    m = metrics.binary_metrics(df).first()
    assert (m["accuracy"], m["precision"], m["recall"], m["support"]) == (0.75, 0.5, 1.0, 4)
    assert (m["tp"], m["tn"], m["fp"], m["fn"]) == (1, 2, 1, 0)
    assert m["f1"] == pytest.approx(2 / 3)
    empty = metrics.binary_metrics(df.limit(0)).first()
    assert empty["accuracy"] == empty["f1"] == 0.0 and empty["support"] == 0
    assert {r["split"] for r in metrics.binary_metrics(df, by="split").collect()} == {"a"}


def test_metric_support(spark):
    rows = [("5", 1, 1, 1, 1), ("0", 1, 2, 3, 4), (None, 1, 1, 0, 0), ("bad", 0, 0, 0, 3)]
    df = spark.createDataFrame(rows, "support string, tp long, tn long, fp long, fn long")
    got = df.select(metrics.metric_support(*[F.col(c) for c in df.columns]).alias("s")).collect()
    assert [r["s"] for r in got] == [5, 10, 2, 3]


@pytest.mark.parametrize(
    "accuracies, findings",
    [
        ((0.95, 0.80, 0.82), ["overfit", "stable"]),
        ((0.9, 0.9, 0.75), ["unstable"]),
        ((0.5, 0.5, 0.55), ["low"]),
        ((0.8, 0.8, 0.75), ["ok"]),
        ((0.8, None, 0.75), []),
    ],
)
def test_assessment(spark, accuracies, findings):
    df = spark.createDataFrame(list(zip(["train", "val", "test"], accuracies)), "split string, accuracy double")
    assert metrics.assessment(df).first()["findings"] == findings


def test_prediction_distribution_and_misclassified(spark):
    df = spark.createDataFrame([(1, "正样本", True), (2, "负样本", False), (3, "", False), (4, None, True)], "id long, p string, is_correct boolean")
    assert metrics.prediction_distribution(df, "p").first().asDict() == {"total": 4, "positive": 1, "negative": 1, "other": 2}
    assert [r["id"] for r in metrics.misclassified(df, "id", 1).collect()] == [2]
