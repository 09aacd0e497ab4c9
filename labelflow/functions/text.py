"""Text helpers on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Placeholders shown for a missing stratum and a missing label.
MISSING_STRATUM = "未填写"
MISSING_LABEL = "未标注"
# Characters that file names and sheet titles must not contain.
FILE_NAME_ILLEGAL = '/\\:*?"<>|'
SHEET_TITLE_ILLEGAL = "[]:*?/\\"
SHEET_TITLE_LENGTH = 31
# Fixed value: text shown for a number that cannot be read.
NO_RATIO = "-"

# The white space characters of Unicode.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# Decimal numbers as text; Spark's own cast would also take "0.5d" and "0x1p-1".
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
_SPECIAL = r"^[+-]?(?i:inf|infinity|nan)$"


def strip(col: Column) -> Column:
    """Remove Unicode white space on both ends (plain ``trim`` only takes spaces)."""
    return F.btrim(col.cast("string"), F.lit(WHITE_SPACE))


def none_to_empty(col: Column) -> Column:
    return F.coalesce(col.cast("string"), F.lit(""))


def is_missing(col: Column, trim: bool = False) -> Column:
    """NULL or empty text; with ``trim`` also text of white space only."""
    text = col.cast("string")
    return text.isNull() | ((strip(text) if trim else text) == "")


def fold_missing(col: Column, placeholder: str, trim: bool = False) -> Column:
    text = none_to_empty(col)
    text = strip(text) if trim else text
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(placeholder))


def to_number(col: Column) -> Column:
    """Text to double; NULL for anything that is not a plain number."""
    text = strip(col)
    readable = text.rlike(_NUMBER) | text.rlike(_SPECIAL)
    return F.when(readable, text.try_cast("double"))


def format_ratio(col: Column) -> Column:
    """Four decimals, or a dash when the value is not a number."""
    number = to_number(col)
    sign = F.when(number < 0, "-").otherwise("")
    return (
        F.when(number.isNull(), NO_RATIO)
        .when(F.isnan(number), "nan")
        .when(F.abs(number) == float("inf"), F.concat(sign, F.lit("inf")))
        .otherwise(F.format_string("%.4f", number))
    )


def parse_keywords(col: Column) -> Column:
    """Keyword list from text parted by commas, wide commas or line breaks."""
    parts = F.transform(F.split(col, r"[,，\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"), strip)
    return F.array_distinct(F.filter(parts, lambda word: word != ""))


def safe_file_name(col: Column) -> Column:
    return F.translate(col, FILE_NAME_ILLEGAL, "_" * len(FILE_NAME_ILLEGAL))


def safe_sheet_title(col: Column, index: int = 1) -> Column:
    """Sheet title of at most 31 characters, numbered from the second sheet."""
    suffix = f"_{index}" if index > 1 else ""
    clean = F.translate(col, SHEET_TITLE_ILLEGAL, "_" * len(SHEET_TITLE_ILLEGAL))
    title = F.concat(F.substring(clean, 1, SHEET_TITLE_LENGTH - len(suffix)), F.lit(suffix))
    return F.when(title == "", F.lit(f"sheet{index}")).otherwise(title)


def user_prompt(text: Column) -> Column:
    """The message that hands one text to a judge."""
    # The lines around the text.
    return F.concat(F.lit("待判定文本：\n<<<开始>>>\n"), text, F.lit("\n<<<结束>>>\n"))
