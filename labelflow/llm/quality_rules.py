"""Repetition rules: characters inside duplicated word n-grams and duplicated lines.

Rolling hashes give every window of 5 to 10 words one 64-bit value; equal values
in one text are equal windows.  A window of ``n + 1`` words can only be
duplicated where the window of ``n`` words is, so each length sorts the
duplicates of the one before.  The scan has no shuffle and no state across rows.

Defined cases: a null or empty text has zero words and fails; a row without an
id keeps its null id; repeated rows are judged one by one; an empty table gives
no rows.  Columns other than the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from labelflow.functions.columns import by_name
from labelflow.llm import text_hash as th

REPEAT_WINDOW = 8


@dataclass(frozen=True)
class Limits:
    """Largest shares that a kept text may have (fixed values of a published web-text filter).

    Lines and their characters count when an equal line stands above them; the
    characters of a window of n words count when an equal window stands before it.
    """

    min_words: int = 20
    repeat_words_pct: int = 30
    line_share: float = 0.30
    line_char_share: float = 0.20
    window_char_share: dict[int, float] = field(default_factory=lambda: {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10})


def measure(docs: DataFrame, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per text: counts, shares of duplicated characters and the verdict."""
    lengths = sorted(limits.window_char_share)
    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
    schema += "n_lines long, dup_line_chars long" + "".join(f", dup_chars_{n} long" for n in lengths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for chunk in th.chunks(batch.column(1)):
                columns = _measure(chunk, limits)
                yield pa.RecordBatch.from_arrays([ids.slice(chunk.start, chunk.rows), *map(pa.array, columns.values())], ["doc_id", *columns])

    return docs.select(by_name(id_col).cast("long").alias("doc_id"), by_name(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def _duplicates(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Masks of the keys that occur twice or more, and of those that follow an equal one."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    later = np.zeros(len(keys), bool)
    later[order[1:][same]] = True
    several = later.copy()
    several[order[:-1][same]] = True
    return several, later


def _covered(at: np.ndarray, n: int, words: int) -> np.ndarray:
    """Mask of the words inside the windows of ``n`` words that begin at ``at``."""
    steps = np.zeros(words + 1, np.int64)
    np.add.at(steps, at, 1)
    np.subtract.at(steps, at + n, 1)
    return np.cumsum(steps[:-1]) > 0


def _measure(chunk: th.Chunk, limits: Limits) -> dict[str, np.ndarray]:
    rows, data = chunk.rows, chunk.data
    sums = chunk.sums()
    points = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=points[1:])
    starts, ends = chunk.words()
    of = chunk.rows_of(starts)
    chars = points[ends] - points[starts]
    n_words, word_chars = th.per_row(of, rows), th.per_row(of, rows, chars)
    symbols = np.zeros(256, bool)
    symbols[list(b"#*$%&|<>")] = True
    n_symbols = th.per_row(chunk.rows_of(np.flatnonzero(symbols[data])), rows)

    salt = th.mix(np.arange(1, rows + 1, dtype=np.uint64))
    dup_chars = {}
    repeated = np.zeros(len(starts), bool)
    hashes = th.span_hashes(sums, starts, ends)
    candidates: np.ndarray | None = None
    for n in sorted({*limits.window_char_share, REPEAT_WINDOW}):
        keys, at = th.windows(hashes, of, n)
        if candidates is not None:
            wanted = candidates[at]
            keys, at = keys[wanted], at[wanted]
        several, later = _duplicates(keys ^ salt[of[at]])
        candidates = np.zeros(len(starts), bool)
        candidates[at[several]] = True
        if n == REPEAT_WINDOW:
            repeated = _covered(at[several], n, len(starts))
        if n in limits.window_char_share:
            inside = _covered(at[later], n, len(starts))
            dup_chars[n] = th.per_row(of[inside], rows, chars[inside])
    n_repeat = th.per_row(of[repeated], rows)

    n_lines, n_dup_lines, dup_line_chars = _lines(chunk, sums, points, starts, salt)
    base_failed = (n_words < limits.min_words) | (100 * n_repeat > limits.repeat_words_pct * n_words)
    kept = ~base_failed & (n_dup_lines <= limits.line_share * n_lines) & (dup_line_chars <= limits.line_char_share * word_chars)
    for n, share in limits.window_char_share.items():
        kept &= dup_chars[n] <= share * word_chars
    return {
        "n_words": n_words,
        "word_chars": word_chars,
        "n_symbols": n_symbols,
        "n_dup_lines": n_dup_lines,
        "n_repeat_words": n_repeat,
        "base_failed": base_failed,
        "kept": kept,
        "n_lines": n_lines,
        "dup_line_chars": dup_line_chars,
        **{f"dup_chars_{n}": dup_chars[n] for n in sorted(dup_chars)},
    }


def _lines(chunk: th.Chunk, sums: np.ndarray, points: np.ndarray, word_starts: np.ndarray, salt: np.ndarray):
    """Lines that hold a word: how many, how many follow an equal one, and the word characters of those."""
    breaks = np.flatnonzero(chunk.data == 0x0A)
    begins = np.unique(np.concatenate([chunk.offsets[:-1], breaks + 1]))
    begins = begins[begins < len(chunk.data)]
    if not len(begins):
        zero = np.zeros(chunk.rows, np.int64)
        return zero, zero, zero
    stops = np.append(begins[1:], len(chunk.data))
    stops = np.where((stops > begins) & (chunk.data[stops - 1] == 0x0A), stops - 1, stops)
    words = np.searchsorted(word_starts, stops) - np.searchsorted(word_starts, begins)
    begins, stops = begins[words > 0], stops[words > 0]
    of = chunk.rows_of(begins)
    _, later = _duplicates(th.span_hashes(sums, begins, stops) ^ salt[of])
    spaces = np.zeros(len(chunk.data) + 1, np.int64)
    np.cumsum(th.IS_SPACE[chunk.data], out=spaces[1:])
    chars = (points[stops] - points[begins]) - (spaces[stops] - spaces[begins])
    return th.per_row(of, chunk.rows), th.per_row(of[later], chunk.rows), th.per_row(of[later], chunk.rows, chars[later])
