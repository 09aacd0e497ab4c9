"""Label values as booleans, 0/1 classes and display text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelflow.functions.columns import by_name
from labelflow.functions.text import none_to_empty, strip

# Words read as the positive and the negative class.
POSITIVE_WORDS = ["true", "1", "yes", "y", "是", "属于", "相关", "正样本"]
NEGATIVE_WORDS = ["false", "0", "no", "n", "否", "不属于", "不相关", "负样本"]
# Display text of the two classes.
POSITIVE_LABEL = "正样本"
NEGATIVE_LABEL = "负样本"


def normalize_label(col: Column) -> Column:
    return strip(none_to_empty(col))


def _kind(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def binary_label(df: DataFrame, name: str, strict: bool = False) -> Column:
    """The column as class 0 or 1.

    A value that names no class gives NULL, or fails the query with ``strict``.
    """
    col, kind = by_name(name), _kind(df, name)
    if isinstance(kind, T.BooleanType):
        value = col.cast("int")
    elif isinstance(kind, T.NumericType):
        value = F.when((col >= 1) & (col < 2), 1).when(col.isNotNull(), 0)
    else:
        word = F.lower(strip(col))
        value = F.when(word.isin(POSITIVE_WORDS), 1).when(word.isin(NEGATIVE_WORDS), 0)
    if strict:
        unknown = F.concat(F.lit("not a label of either class: "), none_to_empty(col))
        value = F.coalesce(value, F.raise_error(unknown).cast("int"))
    return value


def truth(df: DataFrame, name: str) -> Column:
    """The column as a boolean that is never NULL."""
    col, kind = by_name(name), _kind(df, name)
    if isinstance(kind, T.BooleanType):
        value = col
    elif isinstance(kind, T.NumericType):
        value = col != 0
    elif isinstance(kind, T.StringType):
        value = F.lower(strip(col)).isin(POSITIVE_WORDS)
    else:
        return F.lit(False)
    return F.coalesce(value, F.lit(False))


def class_text(label: Column) -> Column:
    return F.when(label == 1, POSITIVE_LABEL).otherwise(NEGATIVE_LABEL)
