"""Spreadsheet workbooks (.xlsx) as a table of cells.

Each workbook is read by the task that parses it; only its cells move on.  A sheet holds at most 1,048,576 rows and is streamed row by row.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelflow.session import broadcast_if_small, materialize, measure
from labelflow.sources.files import list_files, one_slash

ROWS_PER_BATCH = 5_000
CELL_SCHEMA = "file_no long, file_path string, row_no long, seq long, cells array<string>"
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
# Built-in number formats that show a date or a time.
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}


def read_workbooks(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Sheet rows of workbook files in the order given; the bytes are not shuffled."""
    content = spark.read.format("binaryFile").load(paths)
    content = content.select(F.lit(0).cast("long"), one_slash(F.col("_metadata.file_path")), "content")
    rows = sheet_rows(content.toDF("file_no", "file_path", "content")).drop("file_no")
    files, seen = measure(list_files(spark, paths), "files", bytes=F.sum(F.octet_length("file_path")))
    return rows.join(broadcast_if_small(files, seen), "file_path").select("file_no", *rows.columns)


def sheet_rows(workbooks: DataFrame) -> DataFrame:
    """Rows of the first sheet of ``(file_no, file_path, content)`` workbooks, parsed once and written.

    Row 0 only says that the workbook was read; row 1 is the header; ``seq``
    numbers the rows below it that hold a value.
    """
    given = workbooks.select("file_no", "file_path", "content")
    return materialize(given.mapInPandas(_read_batches, CELL_SCHEMA), "sheets")


def profiles(rows: DataFrame) -> DataFrame:
    """Per workbook: header cells and the number of rows below the header."""
    heads = rows.filter("row_no = 1").select("file_path", "cells")
    files = rows.groupBy("file_no", "file_path").agg(F.greatest(F.max("row_no") - 1, F.lit(0)).alias("row_count"))
    profiled = files.join(heads, "file_path", "left")
    return profiled.withColumn("cells", F.coalesce("cells", F.array().cast("array<string>")))


def cells(rows: DataFrame) -> DataFrame:
    """Records below the header that hold any value."""
    filled = rows.filter("seq is not null")
    return filled.select("file_path", F.lit(0).cast("long").alias("block"), "seq", "cells")


def _read_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for file_no, path, content in batch.itertuples(index=False):
            rows, seq = [(file_no, path, 0, None, [])], 0
            for row_no, values in _first_sheet(content):
                filled = row_no > 1 and any(values)
                rows.append((file_no, path, row_no, seq if filled else None, values))
                seq += filled
                if len(rows) == ROWS_PER_BATCH:
                    yield _frame(rows)
                    rows = []
            if rows:
                yield _frame(rows)


def _frame(rows: list) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=["file_no", "file_path", "row_no", "seq", "cells"])
    return frame.astype({"seq": "Int64"})


def _first_sheet(content: bytes) -> Iterator[tuple[int, list[str]]]:
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = set(book.namelist())
        strings = _shared_strings(book) if "xl/sharedStrings.xml" in names else []
        dates = _date_styles(book) if "xl/styles.xml" in names else set()
        workbook = ElementTree.fromstring(book.read("xl/workbook.xml"))
        base = datetime(1904, 1, 1) if _is_1904(workbook) else datetime(1899, 12, 30)
        sheet_id = workbook.find(f"{MAIN}sheets")[0].get(RELATION)
        links = ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
        target = next(link.get("Target") for link in links if link.get("Id") == sheet_id)
        path = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        with book.open(path) as stream:
            number, parent = 0, None
            for event, row in ElementTree.iterparse(stream, ("start", "end")):
                if event == "start":
                    parent = row if row.tag == f"{MAIN}sheetData" else parent
                    continue
                if row.tag != f"{MAIN}row":
                    continue
                number = int(row.get("r") or number + 1)
                values: list[str] = []
                for cell in row.iter(f"{MAIN}c"):
                    at = _column(cell.get("r")) if cell.get("r") else len(values)
                    values.extend([""] * (at + 1 - len(values)))
                    values[at] = _text(cell, strings, dates, base)
                # Finished rows leave the tree, so a full sheet takes the memory of one row.
                parent.clear()
                yield number, values


def _is_1904(workbook: ElementTree.Element) -> bool:
    properties = workbook.find(f"{MAIN}workbookPr")
    return properties is not None and properties.get("date1904") in ("1", "true")


def _shared_strings(book: zipfile.ZipFile) -> list[str]:
    items = ElementTree.fromstring(book.read("xl/sharedStrings.xml"))
    return [_plain(item) for item in items.iter(f"{MAIN}si")]


def _plain(item: ElementTree.Element) -> str:
    """Text of a string item; phonetic guides do not count."""
    direct = [t.text or "" for t in item.findall(f"{MAIN}t")]
    runs = [t.text or "" for run in item.findall(f"{MAIN}r") for t in run.findall(f"{MAIN}t")]
    return "".join(direct + runs)


def _date_styles(book: zipfile.ZipFile) -> set[str]:
    styles = ElementTree.fromstring(book.read("xl/styles.xml"))
    codes = {int(f.get("numFmtId")): f.get("formatCode", "") for f in styles.iter(f"{MAIN}numFmt")}
    formats = styles.find(f"{MAIN}cellXfs")
    dates = set()
    for i, style in enumerate(formats if formats is not None else []):
        number = int(style.get("numFmtId", "0"))
        code = re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", codes.get(number, ""))
        if number in DATE_FORMATS or re.search(r"[dmyhs]", code, re.IGNORECASE) and "General" not in code:
            dates.add(str(i))
    return dates


def _column(reference: str) -> int:
    column = 0
    for letter in reference.rstrip("0123456789"):
        column = column * 26 + ord(letter) - 64
    return column - 1


def _text(cell: ElementTree.Element, strings: list[str], dates: set[str], base: datetime) -> str:
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        inline = cell.find(f"{MAIN}is")
        return "" if inline is None else _plain(inline)
    value = cell.findtext(f"{MAIN}v") or ""
    if value == "" or kind in ("str", "e", "d"):
        return value
    if kind == "s":
        return strings[int(value)]
    if kind == "b":
        return "True" if value == "1" else "False"
    number = float(value)
    if cell.get("s") in dates:
        moment = base + timedelta(milliseconds=round(number * 86_400_000))
        return str(moment.time() if 0 <= number < 1 else moment)
    return str(int(value)) if re.fullmatch(r"[+-]?\d+", value) else str(number)
