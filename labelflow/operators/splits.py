"""Label-stratified train / validation / test splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelflow.functions.columns import by_name, columns_except
from labelflow.functions.text import is_missing, none_to_empty, strip
from labelflow.operators import ordering as o
from labelflow.operators.sampling import RECORD_ID
from labelflow.session import MAX_BROADCAST_ROWS, join_groups, materialize

LABEL = "__label"
PARTS = ("train", "val", "test")
RULES = ("floor", "largest_remainder")


def validate_ratios(train: float, val: float, test: float) -> None:
    if min(train, val, test) < 0:
        raise ValueError("split ratios must not be negative")
    if abs(train + val + test - 1.0) > 1e-6:
        raise ValueError("split ratios must add up to 1")


def split_counts(size: Column, train: float, val: float, test: float) -> Column:
    """Rows per part, as an array, by largest remainder.

    With three rows or more no part stays empty: it takes one row from the
    largest part that can spare one.
    """
    raw = F.array(*[size.cast("double") * F.lit(ratio) for ratio in (train, val, test)])
    parts = F.transform(raw, lambda value: F.struct(F.floor(value).alias("whole"), (value - F.floor(value)).alias("rest")))
    left = size - F.aggregate(parts, F.lit(0).cast("long"), lambda total, part: total + part["whole"])

    def with_remainder(part: Column, i: Column) -> Column:
        ahead = F.filter(
            parts,
            lambda other, j: (other["rest"] > part["rest"]) | ((other["rest"] == part["rest"]) & (j < i)),
        )
        return part["whole"] + (F.size(ahead) < left).cast("long")

    def fill(counts: Column, i: Column) -> Column:
        donor = F.array_position(counts, F.array_max(counts)) - 1
        needs = (size >= 3) & (F.element_at(counts, i + 1) == 0) & (F.array_max(counts) > 1)
        moved = F.transform(counts, lambda n, j: n + (j == i).cast("long") - (j == donor).cast("long"))
        return F.when(needs, moved).otherwise(counts)

    return F.aggregate(F.array(F.lit(0), F.lit(1), F.lit(2)), F.transform(parts, with_remainder), fill)


def split_ends(size: Column, train: float, val: float, test: float, rule: str) -> tuple[Column, Column]:
    """Last rank of the train part and of the validation part."""
    if rule == "floor":
        # Ratios are added as doubles, so 0.7 + 0.1 stays just below 0.8.
        number = size.cast("double")
        return F.floor(number * F.lit(train)), F.floor(number * F.lit(train + val))
    counts = split_counts(size, train, val, test)
    return counts[0], counts[0] + counts[1]


def assign_splits(
    df: DataFrame,
    label: str,
    train: float = 0.8,
    val: float = 0.1,
    test: float = 0.1,
    seed: int = 42,
    id_col: str = RECORD_ID,
    rule: str = "floor",
    trim: bool | None = None,
    task_rows: int = o.MAX_TASK_ROWS,
    max_broadcast: int = MAX_BROADCAST_ROWS,
) -> DataFrame:
    """Add ``split`` to every labelled row; rows without a label are left out.

    ``rule="floor"`` cuts each label's shuffle at the rounded-down ratios, so
    small labels lean to the test part; ``"largest_remainder"`` keeps every
    part filled.  ``trim`` also treats white space as no label (the default for
    the second rule).  Each label has two cut keys and a row compares its own
    key with them, so wide rows are not shuffled while the labels fit a broadcast.
    """
    validate_ratios(train, val, test)
    if label not in df.columns:
        raise ValueError(f"no such column: {label}")
    if rule not in RULES:
        raise ValueError(f"unknown split rule: {rule}")
    trim = rule == "largest_remainder" if trim is None else trim
    col = by_name(label)
    text = strip(none_to_empty(col)) if trim else none_to_empty(col)
    keyed = df.filter(~is_missing(col, trim)).withColumn(LABEL, text)
    keyed = keyed.withColumn(o.KEY, o.sort_key(id_col, seed))
    keys = materialize(keyed.select(LABEL, o.KEY), "keys")
    sizes, seen = o.group_sizes(keys, LABEL)
    ends = split_ends(F.col("size"), train, val, test, rule)
    sizes = sizes.withColumn("__ends", F.array(*[end.cast("long") for end in ends]))
    targets = sizes.select(LABEL, "size", F.posexplode("__ends").alias("cut", "rank"))
    inner = targets.filter("rank > 0 and rank < size").select(LABEL, "cut", "rank")
    cuts = o.group_cuts(keys, inner, LABEL, seen, task_rows)
    edge = F.when(F.col("rank") <= 0, o.NONE_CUT).when(F.col("rank") >= F.col("size"), o.ALL_CUT)
    bounds = targets.join(cuts, [LABEL, "cut"], "left").withColumn("__cut", F.coalesce(edge, o.KEY))
    bounds = bounds.groupBy(LABEL).agg(
        F.max("size").alias("__size"),
        F.max(F.when(F.col("cut") == 0, F.col("__cut"))).alias("__cut_train"),
        F.max(F.when(F.col("cut") == 1, F.col("__cut"))).alias("__cut_val"),
    )
    rows = join_groups(keyed, bounds, LABEL, seen, "__size", max_broadcast)
    part = (
        F.when(F.col(o.KEY) <= F.col("__cut_train"), "train")
        .when(F.col(o.KEY) <= F.col("__cut_val"), "val")
        .otherwise("test")
    )
    return rows.select(*columns_except(df, "split"), part.alias("split"))


def split_sizes(splits: DataFrame) -> DataFrame:
    """One row: train_count, val_count, test_count, total_count."""
    part = F.col("split")
    return splits.agg(
        *[F.count_if(part == name).alias(f"{name}_count") for name in PARTS],
        F.count(F.lit(1)).alias("total_count"),
    )
