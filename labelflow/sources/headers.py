"""Header cells as arrays: cleaning, comparison and hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from labelflow.functions.text import none_to_empty, strip

# What the comparison of a file's header with the reference says.
EMPTY, MATCHED, MISSING, EXTRA, REORDERED = "empty_header", "matched", "missing_columns", "extra_columns", "reordered"


def normalize_headers(cells: Column) -> Column:
    """Trimmed header cells; a name used before gets the next free suffix _2, _3, ...

    Empty cells stay, so that positions keep pointing at the file's columns.
    """
    def add(done: Column, name: Column) -> Column:
        numbered = F.transform(
            F.sequence(F.lit(2), F.size(done) + 2), lambda n: F.concat(name, F.lit("_"), n.cast("string"))
        )
        free = F.filter(numbered, lambda candidate: ~F.array_contains(done, candidate))
        fresh = (name == "") | ~F.array_contains(done, name)
        return F.concat(done, F.array(F.when(fresh, name).otherwise(F.get(free, F.lit(0)))))

    clean = F.transform(cells, lambda cell: strip(none_to_empty(cell)))
    return F.aggregate(clean, F.array().cast("array<string>"), add)


def named(headers: Column) -> Column:
    return F.filter(headers, lambda name: name != "")


def header_hash(headers: Column) -> Column:
    return F.sha2(F.array_join(headers, "\n"), 256)


def missing_columns(headers: Column, reference: Column) -> Column:
    return F.array_except(reference, headers)


def extra_columns(headers: Column, reference: Column) -> Column:
    return F.array_except(headers, reference)


def header_status(headers: Column, reference: Column) -> Column:
    return (
        F.when(F.size(headers) == 0, EMPTY)
        .when(headers == reference, MATCHED)
        .when(F.size(missing_columns(headers, reference)) > 0, MISSING)
        .when(F.size(extra_columns(headers, reference)) > 0, EXTRA)
        .otherwise(REORDERED)
    )
