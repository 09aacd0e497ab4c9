"""Incremental jobs: import new files, score new rows.

Both run as ``availableNow`` streams with a checkpoint, so each run takes what
arrived since the last one.  A batch replayed after a failure writes the same
part again instead of adding its rows twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelflow.functions.columns import by_name
from labelflow.operators.sampling import RECORD_ID
from labelflow.plans.stages import StageStore
from labelflow.session import broadcast_if_small, measure
from labelflow.sources.files import literal_path
from labelflow.sources.imports import ImportOptions
from labelflow.streaming.finished import FinishedIds

# Files one batch takes: their names pass through the driver.
FILES_PER_BATCH = 10_000
# Files one scoring batch takes: a failure costs one batch.
SCORED_FILES_PER_BATCH = 1_000
LISTING = "path string, modificationTime timestamp, length long, content binary"


def pending_rows(rows: DataFrame, done: DataFrame | None, id_col: str = RECORD_ID) -> DataFrame:
    """One row for each id that is not scored yet.

    Only ids meet the finished ids; the wide rows are shuffled neither then nor
    afterwards, unless more ids are pending than a broadcast may hold or ids repeat.
    """
    counts = rows.select(by_name(id_col).alias("__id")).groupBy("__id").agg(F.count(F.lit(1)).alias("__rows"))
    if done is not None:
        counts = counts.join(done.select(by_name(id_col).alias("__id")), "__id", "left_anti")
    ids, seen = measure(counts, "pending", most=F.max("__rows"), bytes=F.sum(F.octet_length(F.col("__id").cast("string"))))
    if done is not None:
        rows = rows.join(broadcast_if_small(ids.select("__id"), seen), by_name(id_col) == F.col("__id"), "left_semi")
    return rows.dropDuplicates([id_col]) if (seen["most"] or 0) > 1 else rows


def score_pending(
    rows: DataFrame, done: DataFrame | None, scorer: Callable[[DataFrame], DataFrame], id_col: str = RECORD_ID
) -> DataFrame:
    """Scores of the rows whose id is not scored yet, one for each id."""
    return scorer(pending_rows(rows, done, id_col))


def resume_scoring(
    store: StageStore,
    rows: DataFrame,
    scorer: Callable[[DataFrame], DataFrame],
    id_col: str = RECORD_ID,
    restart: bool = False,
    slices: int = 1,
) -> int:
    """Score a whole table into the predictions stage, going on where a run stopped.

    With several ``slices`` the table is scored in that many ranges of its
    integer id, each kept once it is written, so that a failure costs one range.
    Returns the number of rows scored.
    """
    if restart:
        store.drop("predictions")
    if slices == 1:
        return _score_missing(store, rows, scorer, id_col)
    low, high = rows.agg(F.min(id_col), F.max(id_col)).first()
    if low is None:
        return 0
    width, scored = -(-(high - low + 1) // slices), 0
    for start in range(low, high + 1, width):
        inside = by_name(id_col).between(start, start + width - 1)
        scored += _score_missing(store, rows.filter(inside), scorer, id_col, inside)
    return scored


def _score_missing(
    store: StageStore,
    rows: DataFrame,
    scorer: Callable[[DataFrame], DataFrame],
    id_col: str,
    inside: Column | None = None,
) -> int:
    done = store.read("predictions") if store.exists("predictions") else None
    if done is not None and inside is not None:
        done = done.filter(inside)
    return store.append("predictions", score_pending(rows, done, scorer, id_col))


def incremental_scoring(
    store: StageStore,
    source: str,
    schema: T.StructType,
    scorer: Callable[[DataFrame], DataFrame],
    id_col: str = RECORD_ID,
    files_per_batch: int = SCORED_FILES_PER_BATCH,
) -> None:
    """Score the Parquet files that arrived in ``source`` since the last run.

    A backlog is taken in batches of files, each kept once it is written.  Finished
    ids are found by their index, of which only the buckets that may hold an id of
    the batch are read, however the ids are spread.
    """
    def score_batch(batch: DataFrame, number: int) -> None:
        # Rows of a failed attempt at this batch do not count as done.
        part, finished = f"batch-{number}", FinishedIds(store, id_col)
        done = finished.maybe_finished(batch.select(by_name(id_col)), without_part=part) if store.exists("predictions") else None
        store.append("predictions", score_pending(batch, done, scorer, id_col), part=part)
        finished.add(part)

    stream = store.spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    query = (
        stream.writeStream.foreachBatch(score_batch)
        .option("checkpointLocation", f"{store.root}/streams/scoring")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def incremental_import(
    store: StageStore, source: str, options: ImportOptions = ImportOptions(), skip_known: bool = False
) -> None:
    """Import the CSV files that arrived in ``source`` since the last run.

    The stream discovers files only; each batch of files goes through the
    reconciled import and appends to the raw stage.  With ``skip_known`` a file
    that arrives again under another name is not imported again.
    """
    def import_batch(batch: DataFrame, number: int) -> None:
        names = batch.select("file_path").orderBy("file_path").collect()
        paths = [literal_path(row["file_path"]) for row in names]
        if paths:
            store.import_csv(paths, options, skip_known, part=f"batch-{number}")

    stream = (
        store.spark.readStream.format("binaryFile")
        .schema(LISTING)
        .options(pathGlobFilter="*.csv", maxFilesPerTrigger=FILES_PER_BATCH)
        .load(source)
    )
    query = (
        stream.select("_metadata.file_path")
        .writeStream.foreachBatch(import_batch)
        .option("checkpointLocation", f"{store.root}/streams/import")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
