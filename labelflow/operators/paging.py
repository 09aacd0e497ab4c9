"""Pages of a table in id order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelflow.functions.columns import by_name
from labelflow.operators.ordering import id_at_rank, text_at_rank
from labelflow.operators.sampling import RECORD_ID


# Rows up to which a page is the top of one pass over the table.
SHALLOW = 10_000


def page(df: DataFrame, offset: int, limit: int, id_col: str = RECORD_ID, shallow: int = SHALLOW) -> DataFrame:
    """``limit`` rows after the first ``offset``, in id order; rows without an id are on no page.

    Rows that repeat an id follow the order of their other columns, so that each row is
    on one page.  A page that ends within ``shallow`` rows is a top-k over one pass.  For a
    deeper one an integer or text id gives a range of ids, so the scan prunes
    row groups and no rows before the page are sorted.  Other ids use a top-k.
    """
    offset, limit = max(0, offset), max(0, limit)
    inside = by_name(id_col).isNotNull()
    kind = df.schema[id_col].dataType
    order = [by_name(id_col), *(by_name(f.name) for f in df.schema if f.name != id_col and _sortable(f.dataType))]
    skip = 0
    at_rank = id_at_rank if isinstance(kind, T.IntegralType) else text_at_rank if kind == T.StringType() else None
    if offset + limit <= shallow or at_rank is None:
        return df.filter(inside).orderBy(*order).offset(offset).limit(limit)
    if limit == 0:
        return df.limit(0)
    if offset:
        first = at_rank(df, id_col, offset + 1)
        if first is None:
            return df.limit(0)
        inside = by_name(id_col) >= first
        # Rows of the first id that end the page before.
        skip = offset - df.filter(by_name(id_col) < first).count()
    last = at_rank(df, id_col, offset + limit)
    if last is not None:
        inside = inside & (by_name(id_col) <= last)
    rows = df.filter(inside).orderBy(*order)
    return (rows.offset(skip) if skip else rows).limit(limit)


def _sortable(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return all(_sortable(f.dataType) for f in kind)
    if isinstance(kind, T.ArrayType):
        return _sortable(kind.elementType)
    return not isinstance(kind, (T.MapType, T.VariantType, T.CalendarIntervalType))


def head(df: DataFrame, limit: int) -> DataFrame:
    return df.limit(max(0, limit))


def max_page(rows: int, size: int) -> int:
    """Number of pages; an empty table has one."""
    return max(1, -(-rows // size))
