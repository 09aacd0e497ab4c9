"""CSV files whose records cross line ends, read in parallel.

A line end inside quotes does not end a record, and whether a place of a file lies
inside quotes depends on everything before it.  So a file is cut into pieces of whole
lines first.  Each piece tells how quotes stand at its end if it starts outside of them
and if it starts inside; both answers are a few bytes.  Chained over the file they give
the state in which every piece really starts, and then each piece yields its records by
itself.  A record that crosses pieces is put together from its fragments.

A quote opens a cell only at the cell's start; a quote elsewhere in an unquoted cell is
text.  Lines end with a line feed, a carriage return or both.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelflow.session import broadcast_if_small, materialize, measure

PIECE_CHARS = 1 << 20
# A carriage return in the middle of what a line feed ends.
INNER_RETURN = re.compile(r"(?<=\r)(?!$)")
# What a row of a parsed piece is: a record, or the end, the start or the middle of one.
RECORD, END, START, MIDDLE, HEADER_START = range(5)
PIECES = "file_path string, block long, text string, after_out boolean, after_in boolean, starts_out long, starts_in long"
ROWS = "file_path string, block long, kind int, record string"


def ends_inside(line: str, inside: bool) -> bool:
    """Whether the end of a line lies inside quotes, given that of its start."""
    at = 0
    while True:
        if inside:
            quote = line.find('"', at)
            if quote < 0:
                return True
            at = quote + 1
            if line[at : at + 1] == '"':
                at += 1
                continue
            inside = False
        elif line[at : at + 1] == '"':
            inside, at = True, at + 1
            continue
        comma = line.find(",", at)
        if comma < 0:
            return False
        at = comma + 1


def _units(line: str) -> list[str]:
    """What carriage returns end inside a line, with them."""
    return INNER_RETURN.split(line) if "\r" in line[:-1] else [line]


def _after(unit: str, inside: bool) -> bool:
    return ends_inside(unit, inside) if '"' in unit else inside


class _Piece:
    """Whole lines of one block, and how quotes and records stand in them for both possible starts."""

    def __init__(self, path: str, block: int):
        self.path, self.block = path, block
        self.lines: list[str] = []
        self.size = 0
        self.state = [False, True]
        self.starts = [0, 0]

    def add(self, line: str) -> None:
        self.lines.append(line)
        self.size += len(line) + 1
        for unit in _units(line):
            filled = unit not in ("", "\r")
            for k in (0, 1):
                self.starts[k] += filled and not self.state[k]
                self.state[k] = _after(unit, self.state[k])

    def row(self) -> tuple:
        return self.path, self.block, "\n".join(self.lines), *self.state, *self.starts


def _cut(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    names = ["file_path", "block", "text", "after_out", "after_in", "starts_out", "starts_in"]

    def batch_of(piece: _Piece) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v]) for v in piece.row()], names)

    piece, start = None, (None, None)
    for batch in batches:
        for path, block, line in zip(*(column.to_pylist() for column in batch.columns)):
            if (path, block) != start:
                if piece is not None:
                    yield batch_of(piece)
                start, piece = (path, block), _Piece(path, block)
            elif piece.size >= limit:
                yield batch_of(piece)
                piece = _Piece(path, piece.block + piece.size)
            piece.add(line)
    if piece is not None:
        yield batch_of(piece)


def pieces(spark: SparkSession, paths: list[str], path: Column, limit: int = PIECE_CHARS) -> DataFrame:
    """The lines of files in written pieces of about a million characters, cut by Spark's reader into parallel ranges.

    ``block`` grows along a file.  The pieces are written once, so every later job
    sees the same cuts.
    """
    lines = spark.read.option("lineSep", "\n").text(paths).select(path, F.col("_metadata.file_block_start").alias("block"), "value")
    return materialize(lines.mapInArrow(lambda batches: _cut(batches, limit), PIECES), "pieces")


def starts(cut: DataFrame) -> DataFrame:
    """Per piece whether it starts inside quotes, whether no record starts before it, and the number of records that start in it.

    A piece keeps the state, flips it, or ends in one state whatever came before.  So
    a piece starts in the state after the last piece of the third kind, flipped as
    often as the pieces since then flip it.
    """
    fixed = F.col("after_out") == F.col("after_in")
    flips = (F.col("after_out") & ~F.col("after_in")).cast("int")
    rows = cut.select("file_path", "block", "after_out", "starts_out", "starts_in", fixed.alias("fixed"), flips.alias("flips"))
    along = Window.partitionBy("file_path").orderBy("block")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("upto", F.sum("flips").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    last = F.last(F.when(F.col("fixed"), F.struct("after_out", "upto")), ignorenulls=True).over(before)
    since = F.col("upto") - F.col("flips") - F.coalesce(last["upto"], F.lit(0))
    inside = (F.coalesce(last["after_out"], F.lit(False)).cast("int") + since) % 2 == 1
    rows = rows.select("file_path", "block", inside.alias("inside"), "starts_out", "starts_in")
    rows = rows.withColumn("records", F.when(F.col("inside"), F.col("starts_in")).otherwise(F.col("starts_out")))
    first = F.coalesce(F.sum("records").over(before), F.lit(0)) == 0
    return rows.select("file_path", "block", "inside", first.alias("first"), "records")


def _records(text: str, inside: bool, first: bool) -> Iterator[tuple[int, str]]:
    """Records and fragments of a piece in order."""
    open_before, header, parts = inside, first, []
    for line in text.split("\n"):
        units = _units(line)
        for unit in units:
            if not parts and not inside and unit in ("", "\r"):
                continue
            parts.append(unit)
            inside = _after(unit, inside)
            if inside:
                continue
            record = "".join(parts).removesuffix("\r")
            parts = []
            if open_before:
                yield END, record
            elif header:
                header = False
            else:
                yield RECORD, record
            open_before = False
        if parts:
            parts.append("\n")
    if parts:
        record = "".join(parts).removesuffix("\n")
        yield MIDDLE if open_before else HEADER_START if header else START, record


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, block, text, inside, first in zip(*(column.to_pylist() for column in batch.columns)):
            found = list(_records(text, inside, first))
            kinds, records = zip(*found) if found else ((), ())
            columns = [pa.array([path] * len(found), pa.string()), pa.array([block] * len(found), pa.int64()), pa.array(kinds, pa.int32()), pa.array(records, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["file_path", "block", "kind", "record"])


def records(cut: DataFrame) -> DataFrame:
    """Records below the headers, and fragments of those that cross pieces, in the order of each piece."""
    known, seen = measure(starts(cut).drop("records"), "starts", bytes=F.sum(F.octet_length("file_path")))
    joined = cut.select("file_path", "block", "text").join(broadcast_if_small(known, seen), ["file_path", "block"])
    return joined.select("file_path", "block", "text", "inside", "first").mapInArrow(_parse, ROWS)


def joined(fragments: DataFrame) -> DataFrame:
    """``(file_path, block, record)`` of the records that cross pieces, at the block where they start."""
    opening = F.col("kind").isin(START, HEADER_START)
    along = Window.partitionBy("file_path").orderBy("block", opening)
    numbered = fragments.withColumn("number", F.sum(opening.cast("long")).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    part = F.struct("block", opening.cast("int").alias("opens"), "record")
    whole = numbered.groupBy("file_path", "number").agg(F.min("block").alias("block"), F.max(F.col("kind") == HEADER_START).alias("header"), F.sort_array(F.collect_list(part)).alias("parts"))
    return whole.where("not header").select("file_path", "block", F.array_join(F.transform("parts", lambda p: p["record"]), "\n").alias("record"))
