"""Exact, reproducible samples: random, keyword-filtered and stratified."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelflow.functions.columns import by_name, columns_except
from labelflow.functions.text import MISSING_STRATUM, fold_missing
from labelflow.operators import ordering as o
from labelflow.operators.filters import keyword_filter
from labelflow.session import MAX_BROADCAST_ROWS, is_small, join_groups, materialize, measure

RECORD_ID = "__record_id"
SOURCE = "__sample_source"
STRATUM = "__stratum"
# Strata allocated by one task; more are ranked in parallel.
MAX_STRATA = 100_000


def _check_size(n: int, allow_zero: bool) -> None:
    if n < 0 or (n == 0 and not allow_zero):
        raise ValueError("the sample size must be positive")


def random_sample(
    df: DataFrame,
    n: int,
    seed: int = 42,
    id_col: str = RECORD_ID,
    allow_zero: bool = False,
    source: str = "random",
) -> DataFrame:
    """``min(n, rows)`` rows, the first in the seeded shuffle, tagged with their source."""
    _check_size(n, allow_zero)
    return _first_in_shuffle(df, n, seed, id_col, source)[0]


def _first_in_shuffle(df: DataFrame, n: int, seed: int, id_col: str, source: str) -> tuple[DataFrame, int]:
    key = o.sort_key(id_col, seed)
    # Written once: counting passes read keys, not the plan behind them.
    cut, total = o.select_cut(materialize(df.select(key.alias(o.KEY)), "keys"), n)
    rows = df if cut == o.ALL_CUT else df.filter(key <= cut)
    return rows.withColumn(SOURCE, F.lit(source)), total


def filtered_sample(
    df: DataFrame,
    columns: list[str],
    keywords: list[str],
    n: int,
    seed: int = 42,
    id_col: str = RECORD_ID,
    **modes,
) -> DataFrame:
    """Random sample of the rows that match a keyword predicate."""
    _check_size(n, False)
    matching = df.filter(keyword_filter(df, columns, keywords, **modes))
    sample, total = _first_in_shuffle(matching, n, seed, id_col, "keyword_filter")
    if total == 0:
        raise ValueError("no row matches; change the columns or the keywords")
    return sample


def strata_sizes(df: DataFrame, column: str) -> DataFrame:
    """Rows per stratum, with missing values folded into one stratum."""
    stratum = fold_missing(by_name(column), MISSING_STRATUM).alias(STRATUM)
    return df.groupBy(stratum).agg(F.count(F.lit(1)).alias("size"))


def proportional_allocation(
    sizes: DataFrame,
    n: int,
    key: str = STRATUM,
    seen: dict | None = None,
    max_strata: int = MAX_STRATA,
) -> DataFrame:
    """Share ``n`` draws among the groups of ``sizes`` (``key``, ``size``).

    Each group gets the floor of its proportional share.  Groups left with
    nothing get one draw each, in key order, while draws remain.  What is left
    goes one by one to the groups with the largest fraction, key order breaking
    ties.  Adds ``take``.  ``seen`` is the measured size, with the ``total``.
    """
    if seen is None:
        sizes, seen = measure(sizes, "sizes", bytes=F.sum(F.octet_length(key)), total=F.sum("size"))
    total = seen["total"] or 0
    n = max(0, min(n, total))
    if n == 0:
        return sizes.withColumn("take", F.lit(0).cast("long"))
    share = F.col("size").cast("double") / F.lit(float(total)) * F.lit(n)
    shares = sizes.withColumn("__share", share).withColumn("__floor", F.floor("__share"))
    shares = shares.withColumn("__fraction", F.col("__share") - F.col("__floor"))
    by_key, by_fraction = [F.col(key)], [F.desc("__fraction"), F.col(key)]
    if is_small(seen, max_strata):
        allocated = _allocate_in_one_task(shares, n, by_key, by_fraction)
    else:
        allocated = _allocate_in_parallel(shares, n, by_key, by_fraction, max_strata)
    return allocated.select(*sizes.columns, F.col("take").cast("long").alias("take"))


def _bump(flag: Column, rank: str, left) -> Column:
    return F.when(flag & (F.col(rank) <= left), 1).otherwise(0)


def _allocate_in_one_task(shares: DataFrame, n: int, by_key: list, by_fraction: list) -> DataFrame:
    everything = Window.partitionBy()
    empty, open_ = F.col("__floor") == 0, F.col("__base") < F.col("size")
    return (
        shares.withColumn("__left", n - F.sum("__floor").over(everything))
        .withColumn("__rank", F.row_number().over(Window.partitionBy(empty).orderBy(*by_key)))
        .withColumn("__base", F.col("__floor") + _bump(empty, "__rank", F.col("__left")))
        .withColumn("__left", n - F.sum("__base").over(everything))
        .withColumn("__rank", F.row_number().over(Window.partitionBy(open_).orderBy(*by_fraction)))
        .withColumn("take", F.col("__base") + _bump(open_, "__rank", F.col("__left")))
    )


def _allocate_in_parallel(shares: DataFrame, n: int, by_key: list, by_fraction: list, limit: int) -> DataFrame:
    empty, open_ = F.col("__floor") == 0, F.col("__base") < F.col("size")

    def add_one(df: DataFrame, flag: Column, used: str, order: list, name: str) -> DataFrame:
        used_now, flagged = df.agg(F.sum(used), F.count_if(flag)).first()
        ranked = o.global_rank(df.filter(flag), order, "__rank", flagged, limit)
        ranked = ranked.withColumn(name, F.col(used) + _bump(F.lit(True), "__rank", n - used_now))
        return ranked.drop("__rank").unionByName(df.filter(~flag).withColumn(name, F.col(used)))

    based = materialize(add_one(shares, empty, "__floor", by_key, "__base"), "based")
    return add_one(based, open_, "__base", by_fraction, "take")


def stratified_sample(
    df: DataFrame,
    column: str,
    n: int,
    seed: int = 42,
    id_col: str = RECORD_ID,
    allow_zero: bool = False,
    task_rows: int = o.MAX_TASK_ROWS,
    max_strata: int = MAX_STRATA,
    max_broadcast: int = MAX_BROADCAST_ROWS,
) -> DataFrame:
    """``min(n, rows)`` rows, shared over the values of ``column`` by proportion."""
    _check_size(n, allow_zero)
    if not column:
        raise ValueError("a strata column is needed")
    if column not in df.columns:
        raise ValueError(f"no such column: {column}")
    stratum = fold_missing(by_name(column), MISSING_STRATUM)
    keyed = df.withColumn(STRATUM, stratum).withColumn(o.KEY, o.sort_key(id_col, seed))
    keys = materialize(keyed.select(STRATUM, o.KEY), "keys")
    sizes, seen = o.group_sizes(keys, STRATUM)
    plan = proportional_allocation(sizes, n, seen=seen, max_strata=max_strata).filter("take > 0")
    targets = plan.filter("take < size").select(STRATUM, F.lit(0).alias("cut"), F.col("take").alias("rank"))
    cuts = o.group_cuts(keys, targets, STRATUM, seen, task_rows, max_rank=n).withColumnRenamed(o.KEY, "__cut")
    bounds = plan.join(cuts.drop("cut"), STRATUM, "left")
    bounds = bounds.select(STRATUM, F.col("size").alias("__size"), F.coalesce("__cut", F.lit(o.ALL_CUT)).alias("__cut"))
    rows = join_groups(keyed, bounds, STRATUM, seen, "__size", max_broadcast)
    return (
        rows.filter(F.col(o.KEY) <= F.col("__cut"))
        .select(*columns_except(df))
        .withColumn(SOURCE, F.lit("stratified"))
    )
