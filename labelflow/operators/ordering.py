"""Exact selection by rank without sorting the table.

A seeded shuffle is the order of ``md5(id || seed)``.  Taking the first ``n``
rows of that order, or the row at a given rank, needs no global sort: rows are
counted per hash prefix, the prefix that holds the wanted rank is located from
the counts, and only the rows of that one prefix are ranked.  The result is a
*cut key*; a row is inside exactly when its own key is not above the cut, so
the wide rows are filtered in place and never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelflow.functions.columns import by_name
from labelflow.session import MAX_BROADCAST_ROWS, MAX_TASK_ROWS, broadcast_if_small, materialize, measure

KEY = "__key"
PREFIX = "__prefix"
ROWS = "__rows"
# Hex digits added per counting pass: 4,096 prefixes, each holding an even
# share of the rows because md5 spreads distinct ids evenly.
DIGITS = 3
# Keys whose order the driver settles at the end.
MAX_DRIVER_KEYS = 65_536
# A key below every md5 text and one above every md5 text.
NO_ID = "the id column holds NULL"
REPEATED_ID = "the id column must be unique"
NONE_CUT = ""
ALL_CUT = "~"


def sort_key(id_col: str, seed: int) -> Column:
    """Sort key of the seeded shuffle; ids must be unique and not NULL."""
    return F.md5(F.concat(by_name(id_col).cast("string"), F.lit(str(seed))))


def prefix(digits: int = DIGITS) -> Column:
    return F.substring(KEY, 1, digits)


def select_cut(keys: DataFrame, n: int, task_rows: int = MAX_DRIVER_KEYS) -> tuple[str, int]:
    """Key of the ``n``-th row of ``keys`` (one column ``__key``), and the row count.

    The driver sees at most 4,096 prefix counts per pass, and at most
    ``task_rows`` keys at the end.
    """
    inside, total, digits, wanted = keys, None, DIGITS, n
    while True:
        counts = inside.groupBy(prefix(digits).alias(PREFIX)).count().collect()
        if any(c[PREFIX] is None for c in counts):
            raise ValueError(NO_ID)
        counts.sort()
        if total is None:
            total = sum(c["count"] for c in counts)
            if n <= 0 or total == 0:
                return NONE_CUT, total
            if n >= total:
                return ALL_CUT, total
        for found in counts:
            if wanted <= found["count"]:
                break
            wanted -= found["count"]
        inside = inside.filter(prefix(digits) == found[PREFIX])
        if found["count"] <= task_rows or digits >= 30:
            break
        digits += DIGITS
    last = [row[KEY] for row in inside.orderBy(KEY).offset(wanted - 1).limit(2).collect()]
    if len(set(last)) < len(last):
        raise ValueError(REPEATED_ID)
    return last[0], total


def group_sizes(keys: DataFrame, by: str) -> tuple[DataFrame, dict]:
    """Rows per group, written once, with the extent of the table and the largest size."""
    sizes = keys.groupBy(by).agg(F.count(F.lit(1)).alias("size"), F.count_if(F.col(KEY).isNull()).alias("__no_id"))
    key_bytes = F.sum(F.octet_length(by))
    sizes, seen = measure(sizes, "sizes", bytes=key_bytes, total=F.sum("size"), largest=F.max("size"), no_id=F.sum("__no_id"))
    if seen["no_id"]:
        raise ValueError(NO_ID)
    return sizes.drop("__no_id"), seen


def group_cuts(
    keys: DataFrame,
    targets: DataFrame,
    by: str,
    seen: dict,
    task_rows: int = MAX_TASK_ROWS,
    max_rank: int | None = None,
) -> DataFrame:
    """Cut key for each ``(by, cut, rank)`` row of ``targets``.

    Groups that fit one task are ranked as they are.  Otherwise only the hash
    prefixes that hold a wanted rank are ranked; one that is still too large
    for a task is first divided by further digits.
    """
    if (seen["largest"] or 0) <= task_rows:
        ranked = keys.withColumn("rank", _row_number(by))
        if max_rank is not None:  # a literal bound lets each task keep only its first rows
            ranked = ranked.filter(F.col("rank") <= max_rank)
        wanted = broadcast_if_small(targets, seen)
        return ranked.join(wanted, [by, "rank"]).select(by, "cut", KEY)
    counts = keys.groupBy(by, prefix().alias(PREFIX)).agg(F.count(F.lit(1)).alias(ROWS))
    running = Window.partitionBy(by).orderBy(PREFIX)
    located = _locate(targets, counts.withColumn("__upto", F.sum(ROWS).over(running)), [by], PREFIX)
    digits = DIGITS
    while True:
        key_bytes = F.sum(F.octet_length(by))
        located, found = measure(located, "located", bytes=key_bytes, largest=F.max(ROWS))
        buckets = broadcast_if_small(located.select(by, PREFIX).distinct(), found)
        inside = keys.withColumn(PREFIX, prefix(digits)).join(buckets, [by, PREFIX])
        if (found["largest"] or 0) <= task_rows or digits >= 30:
            break
        digits += DIGITS
        finer = inside.groupBy(by, PREFIX, prefix(digits).alias("__next")).agg(F.count(F.lit(1)).alias(ROWS))
        running = Window.partitionBy(by, PREFIX).orderBy("__next")
        finer = finer.withColumn("__upto", F.sum(ROWS).over(running))
        located = _locate(located.drop(ROWS), finer, [by, PREFIX], "__next")
    ranked = inside.withColumn("rank", _row_number(by, PREFIX))
    wanted = broadcast_if_small(located.select(by, "cut", PREFIX, "rank"), found)
    return ranked.join(wanted, [by, PREFIX, "rank"]).select(by, "cut", KEY)


def _row_number(*by: str) -> Column:
    return F.row_number().over(Window.partitionBy(*by).orderBy(KEY)).cast("long")


def _locate(targets: DataFrame, before: DataFrame, on: list[str], bucket: str) -> DataFrame:
    start = F.col("__upto") - F.col(ROWS)
    return (
        targets.join(before, on)
        .filter((F.col("rank") > start) & (F.col("rank") <= F.col("__upto")))
        .select(on[0], "cut", F.col(bucket).alias(PREFIX), (F.col("rank") - start).alias("rank"), ROWS)
    )


def id_at_rank(df: DataFrame, id_col: str, rank: int, task_rows: int = 65_536) -> int | None:
    """The ``rank``-th smallest value of an integer column, repeats counted (1-based).

    Counts rows per equal-width range of ids, keeps the range that holds the
    rank, and repeats inside it; the driver sees at most ``task_rows`` counts.
    """
    ids = df.select(by_name(id_col).alias("id")).filter("id is not null")
    low, high, total = ids.agg(F.min("id"), F.max("id"), F.count("id")).first()
    if rank < 1 or rank > total:
        return None
    while high - low >= task_rows:
        width = (high - low) // task_rows + 1
        ranges = ids.filter(F.col("id").between(low, high))
        # As decimals: ids may lie further apart than a long can hold.
        slot = F.expr(f"cast((cast(id as decimal(20,0)) - ({low}BD)) div ({width}BD) as long)")
        counts = sorted(ranges.groupBy(slot.alias("slot")).count().collect())
        for found in counts:
            if rank <= found["count"]:
                break
            rank -= found["count"]
        low, high = low + found["slot"] * width, min(high, low + (found["slot"] + 1) * width - 1)
    last = ids.filter(F.col("id").between(low, high)).orderBy("id").offset(rank - 1).limit(1)
    return last.first()["id"]


def text_at_rank(df: DataFrame, id_col: str, rank: int, task_rows: int = 65_536) -> str | None:
    """The ``rank``-th smallest value of a text column, repeats counted (1-based).

    Counts rows per first differing character, keeps the beginning that holds the
    rank, and repeats inside it; the driver sees a count per character at most.
    """
    ids = df.select(by_name(id_col).alias("id")).filter("id is not null")
    inside, total = ids, None
    while True:
        low, high, count = inside.agg(F.min("id"), F.max("id"), F.count("id")).first()
        if total is None:
            total = count
            if rank < 1 or rank > total:
                return None
        if count <= task_rows or low == high:
            break
        shared = next((k for k, (a, b) in enumerate(zip(low, high)) if a != b), min(len(low), len(high)))
        beginning = F.substring("id", 1, shared + 1)
        # Python orders texts by code points, as Spark orders them by their bytes.
        counts = sorted(inside.groupBy(beginning.alias("start")).count().collect())
        for found in counts:
            if rank <= found["count"]:
                break
            rank -= found["count"]
        inside = inside.filter(beginning == found["start"])
    return inside.orderBy("id").offset(rank - 1).limit(1).first()["id"]


def global_rank(
    df: DataFrame,
    order: list[Column],
    name: str,
    rows: int,
    task_rows: int = MAX_BROADCAST_ROWS,
) -> DataFrame:
    """Dense 1-based rank of every row in a total order, at any size.

    Beyond ``task_rows`` the rows are range-partitioned and written, so that
    each range ranks by itself on top of the counts of the ranges before it.
    """
    if rows <= task_rows:
        return df.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("long"))
    parts = max(2, -(-rows // task_rows))
    ranged = df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id())
    ranged = materialize(ranged, "ranged")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias(ROWS))
    offsets = offsets.select("__part", F.coalesce(F.sum(ROWS).over(before), F.lit(0)).alias("__before"))
    within = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return (
        ranged.join(F.broadcast(offsets), "__part")
        .withColumn(name, (F.col("__before") + within).cast("long"))
        .drop("__part", "__before")
    )
