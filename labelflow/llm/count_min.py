"""Count-min sketch of 128-bit digests, with counters that stop at two.

A digest is a pair of long columns.  Each of ``ROWS`` rows of the sketch counts it in
one cell; the least of its cells is never below its true count, so an estimate of one
proves that the digest occurs once.  Tasks fill a sketch each and emit it in slices,
which are added where they meet.  The width follows the number of digests up to
``MAX_CELLS`` a row (64 MB in all); with more digests the sketch proves less.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

ROWS = 2
MIN_CELLS = 1 << 14
MAX_CELLS = 1 << 25
CELLS_PER_DIGEST = 8
SLICE = 1 << 12
SCHEMA = "slice int, counts binary"


def width(digests: int) -> int:
    """Cells per row for this many digests, a power of two."""
    return min(MAX_CELLS, max(MIN_CELLS, 1 << max(0, CELLS_PER_DIGEST * digests - 1).bit_length()))


def cells(first: np.ndarray, second: np.ndarray, size: int) -> np.ndarray:
    """Cell numbers of digests, one line per row of the sketch."""
    a, b = first.view(np.uint64), second.view(np.uint64)
    return np.stack([((a + np.uint64(k) * b) & np.uint64(size - 1)).astype(np.int64) + k * size for k in range(ROWS)])


def estimate(table: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Counts, never too low; two stands for two or more."""
    return table[cells(first, second, len(table) // ROWS)].min(axis=0)


def _emit(slices: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for k, counts in slices.items():
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([counts.tobytes()], pa.binary())], ["slice", "counts"])


def build(digests: DataFrame, count: int) -> np.ndarray:
    """The sketch of a table of two long columns with about ``count`` rows."""
    size = width(count)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(ROWS * size, np.uint8)
        for batch in batches:
            at, times = np.unique(cells(batch.column(0).to_numpy(), batch.column(1).to_numpy(), size), return_counts=True)
            table[at] = np.minimum(2, table[at] + times)
        yield from _emit({k: part for k, part in enumerate(table.reshape(-1, SLICE)) if part.any()})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts = np.frombuffer(raw, np.uint8)
                slices[k] = np.minimum(2, slices[k] + counts) if k in slices else counts
        yield from _emit(slices)

    parts = digests.sparkSession.sparkContext.defaultParallelism
    table = np.zeros((ROWS * size // SLICE, SLICE), np.uint8)
    for row in digests.mapInArrow(fill, SCHEMA).repartition(parts, "slice").mapInArrow(add, SCHEMA).collect():
        table[row["slice"]] = np.frombuffer(bytes(row["counts"]), np.uint8)
    return table.reshape(-1)
