"""Keyword predicates.

A few keywords are LIKE patterns, which stay inside the JVM.  Many are matched by one
automaton, which reads each text once whatever their number; words with wildcards then
only try their patterns on texts in which the automaton met a part of one.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from operator import and_, itemgetter, or_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelflow.functions.columns import by_name, quote
from labelflow.functions.text import none_to_empty

try:
    import ahocorasick
except ImportError:  # every keyword is a pattern then
    ahocorasick = None

# Keywords from which on an automaton reads the texts.
MANY = 32
# Of a place and a keyword's number, which the automaton gives for each hit.
NUMBER = itemgetter(1)


def keyword_filter(
    df: DataFrame,
    columns: list[str],
    keywords: list[str],
    keyword_mode: str = "any",
    field_mode: str = "any",
    literal: bool = False,
) -> Column:
    """Case-insensitive keyword predicate over several columns.

    ``keyword_mode="any"``: some keyword occurs in some column.
    ``"all"`` with ``field_mode="any"``: every keyword occurs in some column.
    ``"all"`` with ``field_mode="same_field"``: one column holds every keyword.
    ``%`` and ``_`` in a keyword are wildcards unless ``literal`` is set.
    """
    columns = [name.strip() for name in map(str, columns) if name.strip()]
    words = [word.strip() for word in map(str, keywords) if word.strip()]
    if not columns:
        raise ValueError("at least one filter column is needed")
    if not words:
        raise ValueError("at least one keyword is needed")
    for name in columns:
        if name not in df.columns:
            raise ValueError(f"no such column: {name}")
    if keyword_mode not in ("any", "all"):
        raise ValueError(f"unknown keyword mode: {keyword_mode}")
    if field_mode not in ("any", "same_field"):
        raise ValueError(f"unknown field mode: {field_mode}")

    if literal:
        plain, parts, wild = words, [], []
    else:
        wild = [word for word in words if "%" in word or "_" in word]
        plain = [word for word in words if word not in wild]
        parts = [max(re.split("[%_]", word), key=len) for word in wild]
    if ahocorasick is None or len(words) < MANY or not all(parts) or not all(map(_simple, plain + parts)):
        return _patterns(columns, words, keyword_mode, field_mode, literal)
    tried = _patterns(columns, wild, keyword_mode, field_mode, False) if wild else None
    if keyword_mode == "any":
        found = _met(columns, plain) if plain else F.lit(False)
        return found if tried is None else found | (_met(columns, parts) & tried)
    groups = [[name] for name in columns] if field_mode == "same_field" else [columns]
    if not wild:
        return _balanced(or_, [_met(group, plain, every=True) for group in groups])
    if len(groups) > 1:  # the column that holds the plain words has to hold the others too
        return _balanced(or_, [_met(group, plain + parts, every=True) & _patterns(group, wild, "all", "same_field", False) for group in groups])
    return _met(columns, plain + parts, every=True) & tried


def _patterns(columns: list[str], words: list[str], keyword_mode: str, field_mode: str, literal: bool) -> Column:
    """The predicate made of LIKE patterns."""
    patterns = [f"%{_escaped(word) if literal else _backslashes(word)}%" for word in words]

    def like(name: str, kind: str) -> Column:
        listed = ", ".join(_sql_text(pattern) for pattern in patterns)
        return F.expr(f"coalesce(cast({quote(name)} as string), '') ILIKE {kind} ({listed})")

    if keyword_mode == "any":
        return _balanced(or_, [like(name, "ANY") for name in columns])
    if field_mode == "same_field":
        return _balanced(or_, [like(name, "ALL") for name in columns])
    texts = [F.lower(none_to_empty(by_name(name))) for name in columns]
    lowered = [F.lower(F.lit(pattern)) for pattern in patterns]
    return _balanced(and_, [_balanced(or_, [F.like(text, pattern) for text in texts]) for pattern in lowered])


def _simple(word: str) -> bool:
    """Whether the lower case of a word is beyond doubt: ASCII letters, and characters without case."""
    return all(c.isascii() or c.lower() == c == c.upper() for c in word)


def _met(columns: list[str], words: list[str], every: bool = False) -> Column:
    """Whether some word (or every one) occurs in the columns taken together, by one pass of an automaton."""
    wanted = sorted({word.lower() for word in words})

    def holds(automaton, texts: tuple[str, ...]) -> bool:
        if not every:
            return any(next(automaton.iter(text), None) for text in texts)
        seen: set[int] = set()
        for text in texts:
            seen.update(map(NUMBER, automaton.iter(text)))
            if len(seen) == len(wanted):
                return True
        return False

    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        automaton = ahocorasick.Automaton()
        for number, word in enumerate(wanted):
            automaton.add_word(word, number)
        automaton.make_automaton()
        for batch in batches:
            yield pd.Series([holds(automaton, texts) for texts in zip(*batch)], dtype=bool)

    # The number of columns decides which of the two kinds of iterators Spark passes.
    if len(columns) == 1:

        @F.pandas_udf("boolean")
        def met(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            yield from run((batch,) for batch in batches)
    else:

        @F.pandas_udf("boolean")
        def met(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            yield from run(batches)

    return met(*[F.lower(none_to_empty(by_name(name))) for name in columns])


def _backslashes(word: str) -> str:
    return word.replace("\\", "\\\\")


def _escaped(word: str) -> str:
    """A pattern that fits exactly this word."""
    return _backslashes(word).replace("%", "\\%").replace("_", "\\_")


def _sql_text(text: str) -> str:
    """A string literal of the SQL parser."""
    return "'" + _backslashes(text).replace("'", "\\'") + "'"


def _balanced(operator: Callable[[Column, Column], Column], terms: list[Column]) -> Column:
    """Join terms as a tree whose depth grows with the logarithm of their number."""
    while len(terms) > 1:
        terms = [operator(*terms[k : k + 2]) if k + 1 < len(terms) else terms[k] for k in range(0, len(terms), 2)]
    return terms[0]


def count_matches(df: DataFrame, columns: list[str], keywords: list[str], **modes) -> DataFrame:
    """One row with the number of matching rows."""
    matching = df.filter(keyword_filter(df, columns, keywords, **modes))
    return matching.agg(F.count(F.lit(1)).alias("matches"))
