"""Scratch tables and size-checked broadcasts.

Operators that need an intermediate result twice write it as Parquet below the
folder the cluster names in ``spark.checkpoint.dir``.  A written table cuts the
lineage, survives lost executors, and knows its row count.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelflow.functions.columns import by_name

# Rows of a helper table (a key and a few numbers) that every executor may hold,
# and the bytes its keys may take per row: about 100 MB of keys in all.
MAX_BROADCAST_ROWS = 1_000_000
KEY_BYTES = 100
# Rows one task may sort by itself; larger inputs are divided first.
MAX_TASK_ROWS = 4_000_000


def checkpoint_root(spark: SparkSession) -> str:
    """The shared scratch folder; a temporary one only in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    chosen = spark.sparkContext.getCheckpointDir()
    if chosen:
        return chosen
    if not re.match(r"local($|\[)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="labelflow-"))
    return spark.sparkContext.getCheckpointDir()


def _application_root(spark: SparkSession) -> str:
    return f"{checkpoint_root(spark).rstrip('/')}/labelflow-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{_application_root(spark)}/{name}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete this application's scratch tables; DataFrames built on them end here."""
    root = spark._jvm.org.apache.hadoop.fs.Path(_application_root(spark))
    root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(root, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the scratch folder and read it back."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def measure(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, dict]:
    """Materialize ``df`` and count its ``rows``, with further aggregates if given."""
    written = materialize(df, name)
    columns = [F.count(F.lit(1)).alias("rows")] + [c.alias(k) for k, c in metrics.items()]
    return written, written.agg(*columns).first().asDict()


def is_small(seen: dict, limit: int) -> bool:
    """Whether a measured table has at most ``limit`` rows of ordinary width."""
    return seen["rows"] <= limit and (seen.get("bytes") or 0) <= limit * KEY_BYTES


def broadcast_if_small(df: DataFrame, seen: dict, limit: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast when the measured size allows it."""
    return F.broadcast(df) if is_small(seen, limit) else df


def join_groups(
    df: DataFrame,
    groups: DataFrame,
    key: str,
    seen: dict,
    weight: str,
    limit: int = MAX_BROADCAST_ROWS,
) -> DataFrame:
    """Inner join of a large table with one row per group.

    ``seen`` is the measured size of ``groups`` and ``weight`` its column with
    the rows each group holds in ``df``.  A group table beyond ``limit`` is
    joined in two parts: every key with more than ``MAX_TASK_ROWS`` rows by a
    broadcast whose size is measured again, so no key floods a task, and the
    others by a shuffle.
    """
    if is_small(seen, limit):
        return df.join(F.broadcast(groups), key)
    groups = materialize(groups, "groups")
    heavy, found = measure(groups.filter(F.col(weight) > MAX_TASK_ROWS), "heavy", bytes=F.sum(F.octet_length(key)))
    if not found["rows"] or not is_small(found, MAX_BROADCAST_ROWS):
        return df.join(groups, key)
    light = df.join(F.broadcast(heavy.select(key)), key, "left_anti")
    return df.join(F.broadcast(heavy), key).unionByName(light.join(groups, key))
