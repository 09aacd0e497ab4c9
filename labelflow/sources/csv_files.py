"""CSV files with differing headers as one table of cells."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelflow.session import materialize
from labelflow.sources import quoted_lines
from labelflow.sources.files import file_system, list_files, literal_path, one_slash

FILES_PER_TASK = 256
# Low bits of Spark's monotonic id: the position of a row inside its task.
ROW_BITS = (1 << 33) - 1
PARSING = dict(quote='"', escape='"', mode="PERMISSIVE")


def profiles(spark: SparkSession, paths: list[str], multi_line: bool | None = None) -> DataFrame:
    """Per file: header cells and whether a record may cross a line end.

    A file is line-safe when no record crosses a line end, so that its lines are
    its records.  That is read off the lines (an odd number of quotes) unless
    ``multi_line`` says it.
    """
    if not paths:
        return spark.createDataFrame([], "file_no long, file_path string, cells array<string>, line_safe boolean")
    files = list_files(spark, paths)
    tasks = -(-files.count() // FILES_PER_TASK)
    heads = files.repartition(max(1, tasks)).mapInPandas(
        _read_heads, "file_no long, file_path string, cells array<string>"
    )
    if multi_line is not None:
        return materialize(heads.withColumn("line_safe", F.lit(not multi_line)), "heads")
    line = F.col("value")
    quotes = F.length(line) - F.length(F.replace(line, F.lit('"')))
    odd = F.when(line.contains('"'), quotes % 2 == 1).otherwise((F.ltrim(line) == "") & (line != ""))
    lines = spark.read.text(paths).select(
        _path(),
        odd.alias("odd"),
        (line != "").alias("filled"),
    )
    counted = lines.groupBy("file_path").agg((~F.max("odd")).alias("line_safe"), F.count_if("filled").alias("lines"))
    heads = heads.join(counted, "file_path", "left").fillna({"line_safe": True, "lines": 0})
    return materialize(heads.withColumn("row_count", F.greatest(F.col("lines") - 1, F.lit(0))).drop("lines"), "heads")


def _path() -> Column:
    return one_slash(F.col("_metadata.file_path")).alias("file_path")


def _layout(heads: DataFrame) -> dict[bool, tuple[list[str], int]]:
    """File names and the widest header, apart for line-safe files and others."""
    found = heads.select("file_path", "line_safe", F.size("cells").alias("width")).orderBy("file_path").collect()
    layout = {}
    for line_safe in (True, False):
        files = [row for row in found if row["line_safe"] == line_safe]
        names = [literal_path(row["file_path"]) for row in files]
        layout[line_safe] = names, max([row["width"] for row in files], default=0)
    return layout


def _read_heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Header record of each file (the first that is not a blank line), reading only the start of the file."""
    for batch in batches:
        heads = []
        for uri in batch["file_path"]:
            system, name = file_system(uri)
            with system.open_input_stream(name) as stream:
                text = io.TextIOWrapper(stream, encoding="utf-8-sig", newline="")
                heads.append(next((row for row in csv.reader(text) if row), []))
        yield batch.assign(cells=heads)


def read(spark: SparkSession, heads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The profiled files with their row counts, and all their records as written ``(file_path, block, seq, c0, c1, ...)``.

    Cells are read by position with one schema as wide as the widest header, so
    files with any mix of headers need one scan.  Sequence numbers have no gaps
    inside a block.
    """
    layout, tables = _layout(heads), []
    paths, width = layout[True]
    if paths:
        columns = _columns(width)
        scan = spark.read.schema(_schema(columns)).options(header=True, **PARSING).csv(paths)
        rows = scan.select(_path(), F.col("_metadata.file_block_start").alias("block"), *columns)
        tables.append(materialize(_numbered(rows, columns), "cells"))
    paths, width = layout[False]
    if paths:
        pieces = quoted_lines.pieces(spark, paths, _path())
        tables += _quoted_cells(pieces, _columns(width))
        if "row_count" in heads.columns:
            counted = quoted_lines.starts(pieces).groupBy("file_path").agg(F.sum("records").alias("records"))
            heads = heads.join(counted, "file_path", "left")
            below = F.greatest(F.coalesce("records", F.lit(0)) - 1, F.lit(0))
            heads = materialize(heads.withColumn("row_count", F.when(F.col("line_safe"), F.col("row_count")).otherwise(below)).drop("records"), "heads")
    if not tables:
        return heads, spark.createDataFrame([], "file_path string, block long, seq long, c0 string")
    return heads, reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def _columns(width: int) -> list[str]:
    return [f"c{i}" for i in range(max(1, width))]


def _schema(columns: list[str]) -> str:
    return ", ".join(f"{name} string" for name in columns)


def _numbered(rows: DataFrame, columns: list[str], *keep: Column) -> DataFrame:
    """Rows that are not blank, or to be kept anyway, with their place in the task."""
    # Blank records go first: the sequence numbers must have no gaps.
    kept = rows.filter(reduce(or_, [F.coalesce(name, F.lit("")) != "" for name in columns] + list(keep)))
    return kept.withColumn("seq", F.monotonically_increasing_id().bitwiseAND(F.lit(ROW_BITS)))


def _quoted_cells(pieces: DataFrame, columns: list[str]) -> list[DataFrame]:
    """Records inside pieces, and those put together from fragments.

    A record's block is twice its piece's, one more for the record that begins
    at the end of the piece, so that blocks keep the order of the file.
    """
    parsed = lambda record: F.from_csv(record, _schema(columns), PARSING | {"multiLine": "true"})
    inner = F.col("kind") == quoted_lines.RECORD
    rows = quoted_lines.records(pieces).withColumn("cells", parsed(F.when(inner, F.col("record"))))
    rows = rows.select("file_path", "block", "kind", F.when(~inner, F.col("record")).alias("record"), "cells.*")
    rows = materialize(_numbered(rows, columns, F.col("kind") != quoted_lines.RECORD), "cells")
    whole = rows.filter(inner).select("file_path", (2 * F.col("block")).alias("block"), "seq", *columns)
    crossing = quoted_lines.joined(rows.filter(~inner)).select("file_path", (2 * F.col("block") + 1).alias("block"), parsed(F.col("record")).alias("cells"))
    crossing = _numbered(crossing.select("file_path", "block", "cells.*"), columns)
    return [whole, materialize(crossing.withColumn("seq", F.lit(0).cast("long")), "crossing")]


def cells_as_array(records: DataFrame) -> DataFrame:
    """The same records with their cells as one array."""
    columns = [name for name in records.columns if name not in ("file_path", "block", "seq")]
    return records.select("file_path", "block", "seq", F.array(*columns).alias("cells"))
