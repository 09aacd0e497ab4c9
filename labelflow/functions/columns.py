"""Columns by name, whatever characters the name holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def by_name(name: str) -> Column:
    return F.col(quote(name))


def columns_except(df: DataFrame, *names: str) -> list[str]:
    """Quoted names of the columns that an operator passes through."""
    return [quote(name) for name in df.columns if name not in names]
