"""Counter tables of a fixed size, filled by tasks and added up by Spark.

A task fills its own copy and emits it in slices; slices with the same key meet in
one task each and are added as they arrive, so no task holds more than its share of
the table, whatever the input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SLICE = 1 << 12
SCHEMA = "slice int, counts binary"


def _pack(counts: np.ndarray) -> bytes:
    return (counts.astype(np.uint32) if counts.max(initial=0) < 1 << 32 else counts).tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint32 if len(raw) == 4 * SLICE else np.int64).astype(np.int64)


def _emit(slices: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for k, v in slices.items():
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([_pack(v)], pa.binary())], ["slice", "counts"])


def count(df: DataFrame, size: int, fill: Callable[[pa.RecordBatch, np.ndarray], None]) -> np.ndarray:
    """Add ``fill(batch, table)`` over all batches of ``df``; the sum has ``size`` cells (a multiple of 4,096)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(size, np.int64)
        for batch in batches:
            fill(batch, table)
        yield from _emit({k: v for k, v in enumerate(table.reshape(-1, SLICE)) if v.any()})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                slices[k] = slices.get(k, 0) + _unpack(raw)
        yield from _emit(slices)

    parts = df.sparkSession.sparkContext.defaultParallelism
    table = np.zeros((size // SLICE, SLICE), np.int64)
    for row in df.mapInArrow(run, SCHEMA).repartition(parts, "slice").mapInArrow(add, SCHEMA).collect():
        table[row["slice"]] = _unpack(bytes(row["counts"]))
    return table.reshape(-1)
