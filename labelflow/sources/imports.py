"""Preflight and reconciled import of files with differing headers."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelflow.session import broadcast_if_small, materialize, measure
from labelflow.sources import csv_files, headers as h, workbook
from labelflow.sources.files import file_hashes, file_name, list_files, literal_path

LEDGER = (
    "batch_id string, file_name string, file_path string, file_hash string, row_count long, "
    "header_hash string, status string, created_at string, error_message string"
)
SYSTEM_COLUMNS = ["__record_id", "__batch_id", "__source_file"]
NAMES_IN_ERROR = 20
# The file types that can be read.
CSV_SUFFIX = ".csv"
WORKBOOK_SUFFIXES = (".xlsx", ".xlsm", ".xltx", ".xltm")


@dataclass(frozen=True)
class ImportOptions:
    """What a file may lack or add; reordered columns are always aligned."""

    allow_extra_columns: bool = False
    allow_missing_columns: bool = False
    hash_files: bool = True


@dataclass(frozen=True)
class Preflight:
    """Reference header and one classified row per file."""

    reference: list[str]
    files: DataFrame

    def summary(self) -> DataFrame:
        """One row: number of files, their rows, and whether all can be imported as they are."""
        strict = F.col("status").isin(h.MATCHED, h.REORDERED)
        return self.files.agg(
            F.count(F.lit(1)).alias("files"),
            F.coalesce(F.sum("row_count"), F.lit(0)).alias("total_rows"),
            F.coalesce(F.every(strict), F.lit(False)).alias("can_import_strict"),
        )


@dataclass(frozen=True)
class Imported:
    """Imported rows with ids, the ledger of files, and the data columns."""

    rows: DataFrame
    ledger: DataFrame
    columns: list[str]


@dataclass(frozen=True)
class Source:
    """Profiled files and their records, whatever the file format.

    The records are a written table, parsed once for a preflight and an import.
    Block and sequence number of a record that is parsed on the fly would hold
    for one job only, since Spark may cut the files differently in the next.
    """

    profiles: DataFrame
    cells: DataFrame
    paths: list[str]
    hashes: DataFrame | None = None


@dataclass(frozen=True)
class NewFiles:
    """Files whose bytes are new, the hashes of all files, and ledger rows of those left out."""

    paths: list[str]
    hashes: DataFrame
    skipped: DataFrame


def csv_source(spark: SparkSession, paths: list[str], multi_line: bool | None = None) -> Source:
    heads = csv_files.profiles(spark, paths, multi_line)
    return Source(*csv_files.read(spark, heads), paths)


def workbook_source(spark: SparkSession, paths: list[str]) -> Source:
    return _sheet_source(workbook.read_workbooks(spark, paths), paths)


def workbook_content_source(workbooks: DataFrame, paths: list[str]) -> Source:
    """Workbooks given as ``(file_no, file_path, content)`` rows."""
    return _sheet_source(workbook.sheet_rows(workbooks), paths)


def _sheet_source(rows: DataFrame, paths: list[str]) -> Source:
    return Source(workbook.profiles(rows), workbook.cells(rows), paths)


def open_source(spark: SparkSession, paths: list[str]) -> Source:
    """CSV files and workbooks by their suffix, in the order given."""
    books = [path.lower().endswith(WORKBOOK_SUFFIXES) for path in paths]
    for path, is_book in zip(paths, books):
        if not is_book and not path.lower().endswith(CSV_SUFFIX):
            raise ValueError(f"neither a CSV file nor a workbook: {path}")
    if all(books) and paths:
        return workbook_source(spark, paths)
    if not any(books):
        return csv_source(spark, paths)
    profiles, cells = [], []
    for wanted, open_one in ((False, csv_source), (True, workbook_source)):
        places = [i for i, is_book in enumerate(books) if is_book == wanted]
        part = open_one(spark, [paths[i] for i in places])
        numbers = F.array(*[F.lit(i).cast("long") for i in places])
        profiles.append(part.profiles.drop("line_safe").withColumn("file_no", F.get(numbers, F.col("file_no").cast("int"))))
        cells.append(part.cells if "cells" in part.cells.columns else csv_files.cells_as_array(part.cells))
    return Source(profiles[0].unionByName(profiles[1]), cells[0].unionByName(cells[1]), paths)


def _classified(source: Source, reference: list[str] | None) -> Preflight:
    files = source.profiles.withColumn("positions", h.normalize_headers(F.col("cells")))
    files = files.withColumn("headers", h.named(F.col("positions")))
    if not reference:
        first = files.orderBy("file_no").select("headers").first()
        reference = list(first["headers"]) if first else []
    wanted = F.array(*[F.lit(name) for name in reference]).cast("array<string>")
    have = F.col("headers")
    classified = files.select(
        "file_no",
        "file_path",
        file_name(F.col("file_path")).alias("file_name"),
        "headers",
        "positions",
        *[name for name in ("row_count",) if name in files.columns],
        h.header_hash(have).alias("header_hash"),
        h.header_status(have, wanted).alias("status"),
        h.missing_columns(have, wanted).alias("missing_columns"),
        h.extra_columns(have, wanted).alias("extra_columns"),
    )
    return Preflight(reference, materialize(classified, "classified"))


def preflight(source: Source, reference: list[str] | None = None) -> Preflight:
    """Compare the header of every file with the reference, or with the first file's.

    ``records`` counts the rows an import would take; ``row_count`` also counts
    blank rows where the profile knows them.
    """
    report = _classified(source, reference)
    records = source.cells.groupBy("file_path").agg(F.count(F.lit(1)).alias("records"))
    files = report.files.join(records, "file_path", "left").fillna(0, ["records"])
    if "row_count" not in files.columns:
        files = files.withColumn("row_count", F.col("records"))
    return Preflight(report.reference, files)


def import_files(
    source: Source,
    reference: list[str] | None = None,
    options: ImportOptions = ImportOptions(),
    start: int = 1,
) -> Imported:
    """Align the records of all files by column name and number them.

    Ids are dense from ``start`` in file order, then row order.  A missing
    column is empty text.  Extra columns widen the schema if allowed.  Fails
    before numbering any record when a header does not fit the options.
    """
    report = _classified(source, reference)
    _reject(report.files, options)
    columns = list(report.reference)
    if options.allow_extra_columns:
        columns += _added_columns(report.files)
    cells = source.cells
    blocks = cells.groupBy("file_path", "block").agg(F.count(F.lit(1)).alias("records"), F.min("seq").alias("first_seq"))
    blocks = materialize(blocks, "blocks")
    records = blocks.groupBy("file_path").agg(F.sum("records").alias("records"))
    run = uuid.uuid4().hex
    batch = F.concat(F.lit("batch_"), F.substring(F.md5(F.concat(F.lit(run), "file_path")), 1, 10))
    places = F.array(*[F.array_position("positions", F.lit(name)) for name in columns]).cast("array<int>")
    files = report.files.join(records, "file_path", "left").select(
        "file_no",
        "file_path",
        F.col("file_name").alias("__source_file"),
        batch.alias("__batch_id"),
        F.coalesce("records", F.lit(0)).alias("records"),
        "header_hash",
        places.alias("places"),
    )
    files = materialize(files, "files")
    # Blocks are of even size, so a join on them has no heavy keys.
    offsets, seen = _offsets(files, blocks, start)
    layouts = [row["places"] for row in files.select("places").distinct().limit(2).collect()]
    if len(layouts) == 1 and "cells" not in cells.columns:
        values = [F.coalesce(f"c{i - 1}", F.lit("")) if i else F.lit("") for i in layouts[0]]
    else:
        cells = cells if "cells" in cells.columns else csv_files.cells_as_array(cells)
        values = [F.coalesce(F.get("cells", F.get("places", F.lit(i)) - 1), F.lit("")) for i in range(len(columns))]
    rows = cells.join(broadcast_if_small(offsets, seen), ["file_path", "block"])
    rows = rows.select(
        (F.col("shift") + F.col("seq")).alias("__record_id"),
        "__batch_id",
        "__source_file",
        *[value.alias(name) for value, name in zip(values, columns)],
    )
    return Imported(rows, _ledger(files, source, options), columns)


def rejected_files(files: DataFrame, options: ImportOptions) -> DataFrame:
    """The files of a preflight that an import with these options refuses."""
    bad = F.col("status") == h.EMPTY
    if not options.allow_missing_columns:
        bad = bad | (F.size("missing_columns") > 0)
    if not options.allow_extra_columns:
        bad = bad | (F.size("extra_columns") > 0)
    return files.filter(bad)


def _reject(files: DataFrame, options: ImportOptions) -> None:
    bad_files = rejected_files(files, options)
    total = bad_files.count()
    if total:
        first = bad_files.orderBy("file_no").select("file_name").limit(NAMES_IN_ERROR).collect()
        names = ", ".join(row["file_name"] for row in first)
        raise ValueError(f"headers of {total} files do not fit (rejected_files lists them all): {names}")


def _added_columns(files: DataFrame) -> list[str]:
    """Extra columns in order of first appearance."""
    extras = files.select("file_no", F.posexplode("extra_columns").alias("pos", "name"))
    firsts = extras.groupBy("name").agg(F.min(F.struct("file_no", "pos")).alias("at"))
    return [row["name"] for row in firsts.orderBy("at").collect()]


def _offsets(files: DataFrame, blocks: DataFrame, start: int) -> tuple[DataFrame, dict]:
    """Per block what its rows need: the shift from sequence number to id, and its file's columns."""
    by_file = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    by_block = Window.partitionBy("file_path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before_file = files.withColumn("before_file", F.coalesce(F.sum("records").over(by_file), F.lit(0)))
    before_block = blocks.withColumn("before_block", F.coalesce(F.sum("records").over(by_block), F.lit(0)))
    shift = F.lit(start) + F.col("before_file") + F.col("before_block") - F.col("first_seq")
    offsets = before_block.drop("records").join(before_file, "file_path")
    offsets = offsets.select("file_path", "block", shift.alias("shift"), "__batch_id", "__source_file", "places")
    texts = F.octet_length("file_path") + F.octet_length("__source_file") + 4 * F.size("places")
    return measure(offsets, "offsets", bytes=F.sum(texts))


def _ledger(files: DataFrame, source: Source, options: ImportOptions) -> DataFrame:
    hashed = files.withColumn("file_hash", F.lit(""))
    if options.hash_files and source.paths:
        hashes = file_hashes(files.sparkSession, source.paths) if source.hashes is None else source.hashes
        hashed = files.join(hashes, "file_path", "left")
    return hashed.select(
        F.col("__batch_id").alias("batch_id"),
        F.col("__source_file").alias("file_name"),
        "file_path",
        "file_hash",
        F.col("records").alias("row_count"),
        "header_hash",
        *_outcome("imported"),
    )


def _outcome(status: str) -> list[Column]:
    now = datetime.now(timezone.utc).isoformat()
    return [F.lit(status).alias("status"), F.lit(now).alias("created_at"), F.lit("").alias("error_message")]


def new_files(spark: SparkSession, paths: list[str], ledger: DataFrame) -> NewFiles:
    """The files that the ledger holds under no name, each content once, by the first of its names.

    Hashes and names meet as rows; the names of new files pass through the
    driver, as they do in any Spark file scan.
    """
    hashes = materialize(file_hashes(spark, paths), "hashes")
    named = list_files(spark, paths).join(hashes, "file_path")
    copies = F.row_number().over(Window.partitionBy("file_hash").orderBy("file_no"))
    known = ledger.filter(F.col("status") == "imported").select("file_hash", F.lit(True).alias("known")).distinct()
    marked = named.withColumn("copy", copies).join(known, "file_hash", "left")
    marked = materialize(marked.withColumn("new", F.col("known").isNull() & (F.col("copy") == 1)), "marked")
    fresh = [literal_path(row["file_path"]) for row in marked.filter("new").orderBy("file_no").select("file_path").collect()]
    empty = F.lit("")
    left_out = marked.filter("not new").select(
        empty.alias("batch_id"),
        file_name(F.col("file_path")).alias("file_name"),
        "file_path",
        "file_hash",
        F.lit(0).cast("long").alias("row_count"),
        empty.alias("header_hash"),
        *_outcome("skipped"),
    )
    return NewFiles(fresh, hashes, left_out)


def schema_table(spark: SparkSession, columns: list[str], created_at: str | None = None) -> DataFrame:
    """The published schema: column names with their 1-based index."""
    now = created_at or datetime.now(timezone.utc).isoformat()
    rows = [(name, i, "text", now) for i, name in enumerate(columns, start=1)]
    return spark.createDataFrame(rows, "column_name string, column_index int, data_type_guess string, created_at string")


def newest_imports(ledger: DataFrame, limit: int = 20) -> DataFrame:
    return ledger.orderBy(F.desc("created_at"), F.desc("batch_id")).limit(limit)
