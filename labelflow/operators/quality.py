"""Label quality: distributions, missing labels, confidence and agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelflow.functions.columns import by_name, quote
from labelflow.functions.labels import normalize_label
from labelflow.functions.text import MISSING_LABEL, fold_missing, is_missing, to_number


def _column(df: DataFrame, name: str) -> Column:
    if name not in df.columns:
        raise ValueError(f"no such column: {name}")
    return by_name(name)


def label_distribution(df: DataFrame, label: str, trim: bool = False) -> DataFrame:
    """Rows per label, most frequent first; missing labels count as one value."""
    value = fold_missing(_column(df, label), MISSING_LABEL, trim).alias("label")
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("rows"))
    return counts.orderBy(F.desc("rows"), "label")


def missing_label_rows(df: DataFrame, label: str) -> DataFrame:
    """The rows whose label is NULL or white space."""
    return df.filter(is_missing(_column(df, label), trim=True))


def confidence(df: DataFrame, name: str) -> Column:
    """The column as a double; text that is no number gives NULL."""
    col = _column(df, name)
    if isinstance(df.schema[name].dataType, (T.NumericType, T.BooleanType)):
        return col.cast("double")
    return to_number(col)


def low_confidence_rows(df: DataFrame, name: str, threshold: float = 0.7) -> DataFrame:
    return df.filter(confidence(df, name) < threshold)


def cohen_kappa(df: DataFrame, first: str, second: str, drop_missing: bool = False) -> DataFrame:
    """One row with Cohen's kappa of two label columns.

    A missing label is a category of its own unless ``drop_missing`` is set.
    The table is reduced once to counts per label pair; both marginals and the
    agreement come from those counts without a join.
    """
    a, b = normalize_label(_column(df, first)), normalize_label(_column(df, second))
    pairs = df.select(a.alias("a"), b.alias("b"))
    if drop_missing:
        pairs = pairs.filter("a <> '' and b <> ''")
    pairs = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    none = F.lit(0).cast("long")
    same = F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)

    def side(label: str, n_a: Column, n_b: Column, same: Column) -> Column:
        return F.struct(F.col(label).alias("label"), n_a.alias("n_a"), n_b.alias("n_b"), same.alias("same"))

    n = F.col("n")
    sides = pairs.select(F.inline(F.array(side("a", n, none, same), side("b", none, n, none))))
    marginals = sides.groupBy("label").agg(*[F.sum(name).alias(name) for name in ("n_a", "n_b", "same")])
    total = F.sum("n_a")
    chance = F.sum(F.col("n_a").cast("double") * F.col("n_b").cast("double"))
    sums = marginals.agg(total.alias("n"), F.sum("same").alias("same"), chance.alias("chance"))
    n = F.col("n").cast("double")
    observed, expected = F.col("same") / n, F.col("chance") / (n * n)
    kappa = (
        F.when(F.col("n").isNull() | (F.col("n") == 0), 0.0)
        .when(F.col("chance") == n * n, 1.0)
        .otherwise(F.try_divide(observed - expected, 1 - expected))
    )
    return sums.select(F.coalesce("n", none).alias("pairs"), kappa.alias("kappa"))


def quality_summary(
    df: DataFrame, label: str, confidence_column: str | None = None, threshold: float = 0.7
) -> DataFrame:
    """Rows ``(item, label, rows)`` from one pass over the table.

    Items are ``total``, ``missing_label_count``, ``low_confidence_count``
    (with a confidence column) and one ``label_distribution`` row per label.
    """
    low = F.lit(False)
    if confidence_column:
        low = confidence(df, confidence_column) < threshold
    reduced = df.select(normalize_label(_column(df, label)).alias("label"), F.coalesce(low, F.lit(False)).alias("low"))
    by_label = reduced.groupBy("label").agg(F.count(F.lit(1)).alias("rows"), F.count_if("low").alias("low"))
    shown = fold_missing(F.col("label"), MISSING_LABEL)
    missing = F.when(F.col("label") == "", F.col("rows")).otherwise(0)

    def entry(item: str, rows: Column, label: Column = F.lit(None)) -> Column:
        return F.struct(F.lit(item).alias("item"), label.cast("string").alias("label"), rows.cast("long").alias("rows"))

    entries = [
        entry("label_distribution", F.col("rows"), shown),
        entry("total", F.col("rows")),
        entry("missing_label_count", missing),
    ]
    if confidence_column:
        entries.append(entry("low_confidence_count", F.col("low")))
    parts = by_label.select(F.inline(F.array(*entries)))
    return parts.groupBy("item", "label").agg(F.sum("rows").alias("rows"))


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"))


def next_record_id(df: DataFrame, id_col: str = "__record_id") -> DataFrame:
    """One row with the id that follows the largest one in use."""
    return df.agg((F.coalesce(F.max(quote(id_col)), F.lit(0)) + 1).cast("long").alias("next_id"))
