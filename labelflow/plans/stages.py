"""The stage tables of a dataset, kept as versioned Parquet folders.

A stage is a folder of versions ``v1``, ``v2``, ...; its current version is the
highest one that was written completely.  Replacing a stage writes the next
version and then removes the older ones, so a failed job leaves the stage as it
was and a job may read the stage it replaces.  Appends add folders to the
current version.

An import is seen when its ledger is complete: the raw part, the widened schema and
the published columns count from that moment, all at once.  What an import that
failed before has left is never read, and removed by the next import.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace
from datetime import datetime, timezone

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelflow.functions.columns import by_name, quote
from labelflow.functions.text import none_to_empty
from labelflow.operators.judge import promote
from labelflow.operators.ordering import global_rank
from labelflow.operators.paging import page
from labelflow.operators.sampling import RECORD_ID
from labelflow.operators.splits import PARTS
from labelflow.session import measure
from labelflow.sources.imports import (
    LEDGER,
    SYSTEM_COLUMNS,
    Imported,
    ImportOptions,
    csv_source,
    import_files,
    new_files,
    newest_imports,
    schema_table,
)

# The stages in order, and the stages to drop after a step.
STAGES = ("raw", "sampled", "labeled", "reviewed", "train", "val", "test", "predictions")
DOWNSTREAM = {
    "raw": STAGES[1:],
    "sampled": STAGES[2:],
    "labeled": STAGES[3:],
    "reviewed": STAGES[4:],
    "splits": ("predictions",),
}
SCOPES = ("derived", "raw", "models", "history", "all")
# Fixed value: rows of a spreadsheet sheet, header included.
SHEET_ROWS = 1_048_576
# Quotes are doubled, and white space around a value is part of the value.
CSV_OPTIONS = dict(
    header=True, quote='"', escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
)


@dataclass(frozen=True, order=True)
class Batch:
    """An import: its place among the imports, the raw version it belongs to, and its name."""

    number: int
    version: int
    part: str

    @property
    def name(self) -> str:
        return f"import-{self.number:06d}-v{self.version}-{self.part}"

    @staticmethod
    def parse(name: str) -> Batch | None:
        found = re.fullmatch(r"import-(\d+)-v(\d+)-(.+)", name)
        return Batch(int(found[1]), int(found[2]), found[3]) if found else None


class StageStore:
    """Stage tables below one shared folder."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.root = root.rstrip("/")

    # --- folders ------------------------------------------------------------

    def _fs(self, path: str):
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), hadoop

    def _exists(self, path: str) -> bool:
        fs, hadoop = self._fs(path)
        return fs.exists(hadoop)

    def _children(self, path: str) -> list[str]:
        fs, hadoop = self._fs(path)
        return [status.getPath().getName() for status in fs.listStatus(hadoop)] if fs.exists(hadoop) else []

    def _delete(self, path: str) -> None:
        fs, hadoop = self._fs(path)
        fs.delete(hadoop, True)

    def _versions(self, table: str) -> list[int]:
        names = self._children(f"{self.root}/{table}")
        return sorted(int(name[1:]) for name in names if name[1:].isdigit())

    def _current(self, table: str) -> str | None:
        imported = {batch.version for batch in self._imports()} if table == "raw" else set()
        for version in reversed(self._versions(table)):
            path = f"{self.root}/{table}/v{version}"
            if version in imported or self._exists(f"{path}/_SUCCESS"):
                return path
        return None

    def _imports(self) -> list[Batch]:
        """The imports that count, oldest first: those whose ledger was written completely."""
        fs, pattern = self._fs(f"{self.root}/import_batches/*/_SUCCESS")
        names = [status.getPath().getParent().getName() for status in fs.globStatus(pattern) or []]
        return sorted(batch for batch in map(Batch.parse, names) if batch)

    def _last_import(self) -> dict | None:
        """What the newest import of the current raw version published."""
        current = self._current("raw")
        batches = [batch for batch in self._imports() if current and current.endswith(f"/v{batch.version}")]
        if not batches:
            return None
        return json.loads(self._load(f"{self.root}/import_batches/{batches[-1].name}/_import"))

    @staticmethod
    def _table(stage: str) -> str:
        if stage not in STAGES:
            raise ValueError(f"no such stage: {stage}")
        return "splits" if stage in PARTS else stage

    # --- reading ------------------------------------------------------------

    def exists(self, stage: str) -> bool:
        current = self._current(self._table(stage))
        if current is None:
            return False
        return stage not in PARTS or not self._exists(f"{current}/_dropped_{stage}")

    def read(self, stage: str, without_part: str | None = None) -> DataFrame:
        """The rows of a stage, if asked without one appended part."""
        if not self.exists(stage):
            raise ValueError(f"no such table: {stage}")
        table = self._table(stage)
        path = self._current(table)
        if stage in PARTS:
            return self.spark.read.schema(self._schema(table)).parquet(path).filter(F.col("split") == stage).drop("split")
        rows = self.spark.read.schema(self._schema(table)).option("recursiveFileLookup", "true").parquet(path)
        hidden = self._unfinished() if table == "raw" else []
        if without_part:
            hidden += [f"part-{without_part}", *(f"part-{batch.name}" for batch in self._imports() if batch.part == without_part)]
        for name in hidden:
            rows = rows.filter(~F.col("_metadata.file_path").contains(f"/{name}/"))
        # Files written before a column was added have no such column.
        added = {field.name for field in rows.schema.fields if field.metadata.get("added")}
        filled = [F.coalesce(quote(c), F.lit("")).alias(c) if c in added else by_name(c) for c in rows.columns]
        return rows.select(*filled) if added else rows

    def parts(self, stage: str) -> list[str]:
        """Folders that were appended to the current version of a stage."""
        current = self._current(self._table(stage))
        return sorted(name for name in self._children(current) if name.startswith("part-")) if current else []

    def read_parts(self, stage: str, names: list[str]) -> DataFrame:
        """The rows of some appended parts."""
        current = self._current(self._table(stage))
        return self.spark.read.schema(self._schema(self._table(stage))).parquet(*[f"{current}/{name}" for name in names])

    def _unfinished(self) -> list[str]:
        """Raw parts of imports that never got their ledger."""
        done = {f"part-{batch.name}" for batch in self._imports()}
        parts = self._children(self._current("raw")) if self._current("raw") else []
        return [name for name in parts if Batch.parse(name.removeprefix("part-")) and name not in done]

    def _schema(self, table: str) -> T.StructType:
        published = self._last_import() if table == "raw" else None
        if published:
            return T.StructType.fromJson(published["schema"])
        return T.StructType.fromJson(json.loads(self._load(f"{self._current(table)}/_schema")))

    def _load(self, path: str) -> str:
        fs, hadoop = self._fs(path)
        stream = fs.open(hadoop)
        stored = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return stored

    def _store(self, path: str, text: str = "") -> None:
        fs, hadoop = self._fs(path)
        stream = fs.create(hadoop, True)
        stream.write(bytearray(text, "utf-8"))
        stream.close()

    def _store_schema(self, path: str, schema: T.StructType) -> None:
        self._store(f"{path}/_schema", schema.json())

    def require_column(self, stage: str, name: str) -> None:
        if name not in self.read(stage).columns:
            raise ValueError(f"no such column: {name}")

    def preview(self, stage: str, limit: int = 100, offset: int = 0, id_col: str = RECORD_ID) -> DataFrame:
        """A page in id order; an absent stage gives an empty table without columns."""
        if not self.exists(stage):
            return self.spark.createDataFrame([], T.StructType())
        return page(self.read(stage), offset, limit, id_col)

    def preview_raw(self, limit: int = 100, offset: int = 0) -> DataFrame:
        """A page of the data columns of the raw records."""
        return self.preview("raw", limit, offset).drop(*SYSTEM_COLUMNS)

    def counts(self) -> DataFrame:
        """``(stage, rows)``; 0 for a stage that does not exist."""
        parts = []
        for i, stage in enumerate(STAGES):
            rows = self.read(stage) if self.exists(stage) else self.spark.range(0)
            rows = rows.agg(F.count(F.lit(1)).alias("rows"))
            parts.append(rows.select(F.lit(i).alias("position"), F.lit(stage).alias("stage"), "rows"))
        table = parts[0]
        for part in parts[1:]:
            table = table.unionByName(part)
        return table.orderBy("position").drop("position")

    # --- writing ------------------------------------------------------------

    def _write(self, table: str, df: DataFrame, partition: str | None = None) -> int:
        versions = self._versions(table)
        path = f"{self.root}/{table}/v{(versions[-1] if versions else 0) + 1}"
        # The schema goes first: the version only counts once its rows are there.
        self._store_schema(path, df.schema)
        writer = df.write.mode("append")
        (writer.partitionBy(partition) if partition else writer).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path).count()

    def _drop_older(self, table: str) -> None:
        for version in self._versions(table)[:-1]:
            self._delete(f"{self.root}/{table}/v{version}")

    def replace(self, stage: str, df: DataFrame, stringify: bool = False) -> int:
        """Replace a stage and return its row count; an empty table is refused."""
        if stage in PARTS:
            raise ValueError("train, val and test are written together by write_splits")
        rows = self._write(self._table(stage), _as_text(df) if stringify else df)
        if rows == 0:
            self._delete(f"{self.root}/{stage}/v{self._versions(stage)[-1]}")
            raise ValueError("there are no rows to write")
        self._drop_older(stage)
        return rows

    def append(self, stage: str, df: DataFrame, stringify: bool = False, part: str | None = None) -> int:
        """Append rows with the same columns and types in the same order; returns the rows added.

        Writing the same ``part`` again replaces it, which makes a replayed
        batch harmless.
        """
        if stage in PARTS:
            raise ValueError("train, val and test are written together by write_splits")
        df = _as_text(df) if stringify else df
        if not self.exists(stage):
            first = f"{self.root}/{stage}/v{(self._versions(stage) or [1])[-1]}"
            self._store_schema(first, df.schema)
            df.limit(0).write.mode("append").parquet(first)
        else:
            # Files of one table must agree, or no file of it can be read.
            known = [(field.name, field.dataType.simpleString()) for field in self._schema(stage).fields]
            if known != df.dtypes:
                raise ValueError(f"the columns of {stage} differ: {known} and {df.dtypes}")
        target = f"{self._current(stage)}/part-{part or uuid.uuid4().hex}"
        df.write.mode("overwrite").parquet(target)
        return self.spark.read.schema(df.schema).parquet(target).count()

    def write_splits(self, df: DataFrame) -> None:
        """Write the train, val and test stages in one pass over ``df``."""
        self._write("splits", df, partition="split")
        self._drop_older("splits")
        self.clear_downstream("splits")

    def write_sample(self, df: DataFrame) -> int:
        rows = self.replace("sampled", df)
        self.clear_downstream("sampled")
        return rows

    def write_labels(self, df: DataFrame) -> int:
        rows = self.replace("labeled", df)
        self.clear_downstream("labeled")
        return rows

    def promote(self, error_column: str | None = None) -> int:
        """Copy the labelled rows that pass review to the reviewed stage."""
        rows = self.replace("reviewed", promote(self.read("labeled"), error_column))
        self.clear_downstream("reviewed")
        return rows

    def drop(self, *stages: str) -> None:
        gone = set(stages)
        if gone >= set(PARTS):
            self._delete(f"{self.root}/splits")
            gone -= set(PARTS)
        for stage in gone:
            if stage in PARTS:
                if self.exists(stage):
                    self._store(f"{self._current('splits')}/_dropped_{stage}")
            else:
                self._delete(f"{self.root}/{self._table(stage)}")
            if stage == "predictions":  # what was scored before has to be scored again
                self._delete(f"{self.root}/streams/scoring")
                self._delete(f"{self.root}/finished")

    def clear_downstream(self, step: str) -> None:
        """Drop every stage after ``step``; unknown steps drop nothing."""
        self.drop(*DOWNSTREAM.get(step, ()))

    def clear(self, scope: str = "derived") -> None:
        if scope not in SCOPES:
            raise ValueError(f"no such scope: {scope}")
        if scope in ("derived", "all"):
            self.drop(*STAGES[1:])
        if scope in ("models", "all"):
            self._delete(f"{self.root}/models")
        if scope in ("history", "all"):
            self._delete(f"{self.root}/streams")
        if scope in ("raw", "all"):
            for name in ("raw", "import_batches", "streams/import"):
                self._delete(f"{self.root}/{name}")

    # --- imports ------------------------------------------------------------

    def columns(self) -> list[str]:
        """Data columns of the raw records, in published order."""
        published = self._last_import()
        return published["columns"] if published else []

    def published_schema(self) -> DataFrame:
        """The published columns with their 1-based index, as of the newest import."""
        published = self._last_import() or {"columns": [], "created_at": ""}
        return schema_table(self.spark, published["columns"], published["created_at"])

    def next_id(self, without_part: str | None = None) -> int:
        """The id after the largest one in use, if asked without one appended part."""
        if not self.exists("raw"):
            return 1
        return self.read("raw", without_part).agg(F.coalesce(F.max(RECORD_ID), F.lit(0)) + 1).first()[0]

    def add_import(self, imported: Imported, part: str | None = None) -> int:
        """Append imported rows and their ledger, widening the raw table if needed.

        Everything shows at once, when the ledger is written.  A ``part`` given
        again replaces the import of that name.
        """
        part = part or uuid.uuid4().hex
        for name in self._unfinished():
            self._delete(f"{self._current('raw')}/{name}")
        for batch in [batch for batch in self._imports() if batch.part == part]:
            self._delete(f"{self.root}/import_batches/{batch.name}")
            self._delete(f"{self.root}/raw/v{batch.version}/part-{batch.name}")
        rows, current = imported.rows, self._current("raw")
        schema = rows.schema
        if current:
            known = self._schema("raw")
            added = [T.StructField(f.name, f.dataType, True, {"added": True}) for f in schema.fields if f.name not in known.names]
            schema = T.StructType(known.fields + added)
            rows = rows.select(*[quote(name) for name in schema.names])
        versions = self._versions("raw")
        version = int(current.rsplit("/v", 1)[1]) if current else (versions[-1] if versions else 0) + 1
        numbers = [batch.number for batch in self._imports()]
        batch = Batch(max(numbers, default=0) + 1, version, part)
        target = f"{self.root}/raw/v{version}/part-{batch.name}"
        rows.write.mode("overwrite").parquet(target)
        count = self.spark.read.schema(rows.schema).parquet(target).count()
        self.clear_downstream("raw")
        self._finish(batch, imported, schema)
        return count

    def _finish(self, batch: Batch, imported: Imported, schema: T.StructType) -> None:
        """Write what the import publishes, then its ledger, whose completion makes the import count."""
        folder = f"{self.root}/import_batches/{batch.name}"
        now = datetime.now(timezone.utc).isoformat()
        published = {"columns": imported.columns, "schema": json.loads(schema.json()), "created_at": now}
        self._store(f"{folder}/_import", json.dumps(published))
        imported.ledger.coalesce(1).write.mode("append").parquet(folder)

    def import_csv(
        self,
        paths: list[str],
        options: ImportOptions = ImportOptions(),
        skip_known: bool = False,
        part: str | None = None,
    ) -> int:
        """Import CSV files after the rows there are; returns the number of rows added.

        With ``skip_known`` files are hashed first, and one whose bytes were
        imported before, or come under an earlier name, is not parsed; the
        ledger lists it as skipped.
        """
        reference, start = self.columns(), self.next_id(without_part=part)
        if not skip_known:
            return self.add_import(import_files(csv_source(self.spark, paths), reference, options, start), part)
        found = new_files(self.spark, paths, self._ledger(without_part=part))
        source = csv_source(self.spark, found.paths)
        imported = import_files(replace(source, hashes=found.hashes), reference, options, start)
        return self.add_import(replace(imported, ledger=imported.ledger.unionByName(found.skipped)), part)

    def _ledger(self, without_part: str | None = None) -> DataFrame:
        folders = [f"{self.root}/import_batches/{batch.name}" for batch in self._imports() if batch.part != without_part]
        if not folders:
            return self.spark.createDataFrame([], LEDGER)
        return self.spark.read.schema(LEDGER).parquet(*folders)

    def import_history(self, limit: int = 20) -> DataFrame:
        return newest_imports(self._ledger(), limit)

    def dataset_stats(self) -> DataFrame:
        """One row: row_count, column_count, raw_data_ready."""
        columns = F.lit(len(self.columns())).cast("long").alias("column_count")
        rows = self.read("raw") if self.exists("raw") else self.spark.range(0)
        rows = rows.agg(F.count(F.lit(1)).alias("row_count"))
        return rows.select("row_count", columns, (F.col("row_count") > 0).alias("raw_data_ready"))


def _texts(df: DataFrame) -> list[Column]:
    """Every column as text with NULL as empty text; the record id stays a number."""
    return [by_name(c) if c == RECORD_ID else none_to_empty(by_name(c)).alias(c) for c in df.columns]


def _as_text(df: DataFrame) -> DataFrame:
    return df.select(*_texts(df))


def union_records(*tables: DataFrame) -> DataFrame:
    """Rows of all tables over the union of their columns, in order of appearance."""
    result = tables[0]
    for other in tables[1:]:
        result = result.unionByName(other, allowMissingColumns=True)
    return result


def _marked(df: DataFrame) -> DataFrame:
    """Put a byte order mark before the header, so that spreadsheets read UTF-8.

    A first name that has to be quoted stays as it is: the mark would be inside.
    """
    first, *others = df.columns
    if any(character in first for character in ',"\r\n'):
        return df
    return df.select(by_name(first).alias("\ufeff" + first), *[quote(name) for name in others])


def write_csv(df: DataFrame, path: str) -> None:
    """CSV files with a header, quotes doubled inside quoted cells."""
    _marked(df).write.mode("overwrite").options(**CSV_OPTIONS).csv(path)


def export_csv(df: DataFrame, path: str, sheet_rows: int = SHEET_ROWS, id_col: str | None = None) -> None:
    """CSV files no longer than a spreadsheet sheet, header included, NULL as empty.

    With ``id_col``, a unique integer or text id, sheets follow the id: folder
    ``sheet=k`` holds the k-th ``sheet_rows - 1`` rows in one file, and only the last sheet
    may be shorter.  Rows without an id come after all others, in files of the last sheet.
    """
    size = sheet_rows - 1
    options = CSV_OPTIONS | {"maxRecordsPerFile": size}
    if id_col is None:
        _marked(_as_text(df)).write.mode("overwrite").options(**options).csv(path)
        return
    firsts = sheet_starts(df, size, id_col)
    names = _marked(df).columns
    sheet = next(name for name in ("sheet", "sheet_number", "sheet_of_export") if name not in names)
    texts = [column.alias(name) for column, name in zip(_texts(df), names)]
    placed = df.select(_sheet_number(by_name(id_col), firsts).alias(sheet), by_name(id_col).alias("__order"), *texts)
    dealt = placed.repartition(max(1, len(firsts)), sheet).sortWithinPartitions(sheet, F.asc_nulls_last("__order"))
    dealt.drop("__order").write.mode("overwrite").options(**options).partitionBy(sheet).csv(path)


def sheet_starts(df: DataFrame, size: int, id_col: str) -> list:
    """The first id of every sheet of ``size`` rows in id order; only ids are shuffled, and the driver sees one per sheet."""
    ids, seen = measure(df.select(by_name(id_col).alias("id")).filter("id is not null"), "ids")
    ranked = global_rank(ids, [F.col("id")], "rank", seen["rows"])
    return [row["id"] for row in ranked.filter((F.col("rank") - 1) % size == 0).orderBy("rank").collect()]


def _sheet_number(ids: Column, firsts: list) -> Column:
    """The number of the sheet, from 1, whose first id is the last one not above each id; the last sheet without an id."""
    if not firsts:
        return F.lit(1).cast("long")

    @F.pandas_udf("long")
    def number(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        cuts = np.array(firsts, dtype=object if isinstance(firsts[0], str) else None)
        for batch in batches:
            yield pd.Series(np.searchsorted(cuts, batch.to_numpy(), side="right"))

    return number(F.coalesce(ids, F.lit(firsts[-1])))
