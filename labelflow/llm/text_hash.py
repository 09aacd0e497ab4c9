"""Words and hashes of whole texts, computed with numpy over Arrow string buffers.

A text's bytes are hashed by prefix sums of ``value(byte) * P**position`` modulo
2**64, so the hash of any span is one subtraction and one multiplication.  Work
is cut into runs of whole texts of about a megabyte; memory grows with the longest
text only (about 50 bytes per byte of it).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
CHUNK_ROWS = 2048
SEED = 20_240_229
_P = 0x9E3779B97F4A7C15
_P_INVERSE = pow(_P, -1, 1 << 64)
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)

_random = np.random.Generator(np.random.PCG64(SEED))
BYTE_VALUES = _random.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
FOLDED_VALUES = BYTE_VALUES.copy()
FOLDED_VALUES[ord("A") : ord("Z") + 1] = BYTE_VALUES[ord("a") : ord("z") + 1]
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
# ASCII letters and digits, and all bytes of other characters.
IS_LETTER = np.zeros(256, bool)
IS_LETTER[[b for b in range(256) if b >= 128 or chr(b).isalnum()]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (the finalizer of SplitMix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, CHUNK_BYTES + 1)
        factors = np.full(size, _P, np.uint64)
        factors[0] = 1
        _powers = np.multiply.accumulate(factors)
        factors[1:] = np.uint64(_P_INVERSE)
        _inverses = np.multiply.accumulate(factors)
    return _powers[:n], _inverses[:n]


@dataclass
class Chunk:
    """A run of whole texts: rows ``start`` to ``stop`` of the batch and their bytes."""

    start: int
    stop: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def rows(self) -> int:
        return self.stop - self.start

    def rows_of(self, positions: np.ndarray) -> np.ndarray:
        """The text, counted from 0, that holds each byte position."""
        return np.searchsorted(self.offsets, positions, side="right") - 1

    def sums(self, values: np.ndarray = BYTE_VALUES) -> np.ndarray:
        powers, _ = _tables(len(self.data))
        out = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(values[self.data] * powers, out=out[1:])
        return out

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Byte starts and ends of the maximal runs without ASCII white space."""
        if not len(self.data):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        inside = ~IS_SPACE[self.data]
        first = np.zeros(len(self.data), bool)
        begins = self.offsets[:-1]
        first[begins[begins < len(self.data)]] = True
        starts, ends = inside.copy(), inside.copy()
        starts[1:] &= ~inside[:-1] | first[1:]
        ends[:-1] &= ~inside[1:] | first[1:]
        return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, inverses = _tables(len(sums))
    return mix((sums[ends] - sums[starts]) * inverses[starts])


def chunks(texts: pa.Array, size: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Cut an Arrow string column into runs of texts; a null text is empty."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    _, offsets, data = texts.buffers()
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(offsets, width)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, width)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    start = 0
    while start < len(texts):
        stop = int(np.searchsorted(offsets, int(offsets[start]) + size, side="right")) - 1
        stop = min(max(stop, start + 1), start + CHUNK_ROWS, len(texts))
        yield Chunk(start, stop, data[offsets[start] : offsets[stop]], offsets[start : stop + 1].astype(np.int64) - offsets[start])
        start = stop


def windows(hashes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words inside one text, and the index of their first word."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.zeros(count, np.uint64)
    for k in range(n):
        out = out * np.uint64(_P) + hashes[k : k + count]
    at = np.flatnonzero(rows[:count] == rows[n - 1 :])
    return mix(out[at]), at


def per_row(rows: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Counts, or sums of whole-number weights, for each of ``n`` texts."""
    return np.bincount(rows, weights=weights, minlength=n).astype(np.int64)
