"""Binary classification metrics and what they say about a model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelflow.functions.columns import by_name, quote
from labelflow.functions.labels import NEGATIVE_LABEL, POSITIVE_LABEL
from labelflow.operators.paging import page

RATIOS = ("accuracy", "precision", "recall", "f1")
COUNTS = ("support", "tp", "tn", "fp", "fn")

# Accuracy gaps and levels used to judge a model.
OVERFIT_GAP = 0.1
STABLE_GAP = 0.03
UNSTABLE_GAP = 0.1
LOW_ACCURACY = 0.7


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(0.0)


def binary_metrics(
    df: DataFrame,
    prediction: str = "prediction",
    label: str = "label",
    by: str | None = None,
    loss: str | None = None,
) -> DataFrame:
    """Confusion counts and ratios over 0/1 columns, per value of ``by`` if given.

    A ratio with nothing below the line is 0.  ``loss`` adds the mean of a
    per-row loss column.
    """
    p, y = by_name(prediction), by_name(label)
    counts = {
        "support": F.count(F.lit(1)),
        "correct": F.count_if(p == y),
        "tp": F.count_if((p == 1) & (y == 1)),
        "tn": F.count_if((p == 0) & (y == 0)),
        "fp": F.count_if((p == 1) & (y == 0)),
        "fn": F.count_if((p == 0) & (y == 1)),
    }
    aggregates = [value.alias(name) for name, value in counts.items()]
    if loss:
        aggregates.append(F.coalesce(F.avg(quote(loss)), F.lit(0.0)).alias("loss"))
    grouped = df.groupBy(quote(by)) if by else df.groupBy()
    sums = grouped.agg(*aggregates)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    sums = (
        sums.withColumn("accuracy", _ratio(F.col("correct"), F.col("support")))
        .withColumn("precision", _ratio(tp, tp + fp))
        .withColumn("recall", _ratio(tp, tp + fn))
    )
    both = F.col("precision") + F.col("recall")
    sums = sums.withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), both))
    keep = ([by] if by else []) + list(RATIOS) + list(COUNTS) + (["loss"] if loss else [])
    return sums.select(*[quote(name) for name in keep])


def metric_support(support: Column, tp: Column, tn: Column, fp: Column, fn: Column) -> Column:
    """The stated support, or the confusion counts' sum where none is stated."""
    def whole(col: Column) -> Column:
        return F.coalesce(col.try_cast("long"), F.lit(0))

    return F.when(whole(support) > 0, whole(support)).otherwise(whole(tp) + whole(tn) + whole(fp) + whole(fn))


def assessment(metrics: DataFrame, by: str = "split") -> DataFrame:
    """One row with findings from the accuracies of train, val and test.

    Findings are ``overfit``, ``stable`` or ``unstable``, ``low``, and ``ok``
    when there is none of them; an unknown accuracy gives an empty list.
    """
    def accuracy(part: str) -> Column:
        return F.max(F.when(F.col(by) == part, F.col("accuracy"))).alias(part)

    train, val, test = F.col("train"), F.col("val"), F.col("test")
    gap = F.abs(val - test)
    found = F.filter(
        F.array(
            F.when(train - F.greatest(val, test) >= OVERFIT_GAP, "overfit"),
            F.when(gap <= STABLE_GAP, "stable").when(gap >= UNSTABLE_GAP, "unstable"),
            F.when(F.greatest(train, val, test) < LOW_ACCURACY, "low"),
        ),
        lambda finding: finding.isNotNull(),
    )
    known = train.isNotNull() & val.isNotNull() & test.isNotNull()
    findings = (
        F.when(~known, F.array().cast("array<string>"))
        .when(F.size(found) == 0, F.array(F.lit("ok")))
        .otherwise(found)
    )
    row = metrics.agg(accuracy("train"), accuracy("val"), accuracy("test"))
    return row.select("train", "val", "test", findings.alias("findings"))


def prediction_distribution(df: DataFrame, label_text: str) -> DataFrame:
    """One row: total, positive, negative and other predictions."""
    text = by_name(label_text)
    counts = df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(text == POSITIVE_LABEL).alias("positive"),
        F.count_if(text == NEGATIVE_LABEL).alias("negative"),
    )
    return counts.withColumn("other", F.col("total") - F.col("positive") - F.col("negative"))


def misclassified(df: DataFrame, id_col: str, limit: int = 200) -> DataFrame:
    """The first ``limit`` wrongly predicted rows by id, for review."""
    return page(df.filter(~F.col("is_correct")), 0, limit, id_col)
