"""Files that queries derive from the given tables before they read them back."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelflow.plans.stages import CSV_OPTIONS
from labelflow.sources.files import file_system

CSV_FILES = 4
WORKBOOK_ROWS = 5_000
SPREADSHEET = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006/relationships"


def write_csv_in_order(df: DataFrame, key: str, path: str, mode: str = "overwrite") -> str:
    """CSV files whose names sort in the order of ``key``."""
    ordered = df.repartitionByRange(CSV_FILES, key).sortWithinPartitions(key)
    ordered.write.mode(mode).options(**CSV_OPTIONS).csv(path)
    return path


def workbooks(df: DataFrame, key: str) -> DataFrame:
    """One workbook for every 5,000 values of ``key``, as ``(file_no, file_path, content)``."""
    columns = df.columns

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        number = int(pdf["file_no"].iloc[0])
        rows = pdf.sort_values(key)[columns].values.tolist()
        return pd.DataFrame({"file_no": [number], "file_path": [f"book-{number}.xlsx"], "content": [workbook_bytes([columns, *rows])]})

    numbered = df.withColumn("file_no", F.floor(F.col(key) / WORKBOOK_ROWS))
    return numbered.groupBy("file_no").applyInPandas(build, "file_no long, file_path string, content binary")


def write_workbooks(df: DataFrame, key: str, path: str) -> str:
    """The same workbooks as files, each written by the task that builds it."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for number, content in zip(batch["file_no"], batch["content"]):
                system, folder = file_system(path)
                system.create_dir(folder)
                with system.open_output_stream(f"{folder}/book-{number:06d}.xlsx") as stream:
                    stream.write(content)
            yield batch[["file_no"]]

    workbooks(df, key).mapInPandas(write, "file_no long").count()
    return path


def workbook_bytes(rows: list[list], dimension: str | None = None) -> bytes:
    """A minimal workbook: text as inline strings, numbers as numbers, None as no cell."""
    lines = []
    for r, row in enumerate(rows, start=1):
        cells = []
        for c, value in enumerate(row):
            at = f"{_letters(c)}{r}"
            if isinstance(value, str):
                cells.append(f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(value)}</t></is></c>')
            elif value is not None:
                cells.append(f'<c r="{at}"><v>{value!r}</v></c>')
        lines.append(f'<row r="{r}">{"".join(cells)}</row>')
    size = f'<dimension ref="{dimension}"/>' if dimension else ""
    parts = {
        "xl/workbook.xml": f'<workbook xmlns="{SPREADSHEET}" xmlns:r="{OFFICE}"><sheets><sheet name="s" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{PACKAGE}"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{SPREADSHEET}">{size}<sheetData>{"".join(lines)}</sheetData></worksheet>',
    }
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as book:
        for name, text in parts.items():
            book.writestr(name, text)
    return buffer.getvalue()


def _letters(column: int) -> str:
    letters = ""
    column += 1
    while column:
        column, digit = divmod(column - 1, 26)
        letters = chr(65 + digit) + letters
    return letters
