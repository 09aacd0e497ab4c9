"""Language of web pages by Bayesian fusion of text, markup and address evidence.

* Text: naive Bayes over hashed byte trigrams, counted over all labelled texts.
* Markup: how often each declared language goes with each language, from a first
  posterior over all pages.
* Address: priors per host, shrunk towards its domain, that towards the address
  suffix, that towards all pages.  All four levels are grouped sums of the first
  posterior; a page's own share is taken out before its prior is used.

Texts and pages are read once each; after that one narrow row per page is joined
with grouped sums.

Defined cases: null or empty html has no text evidence; no or an unknown ``lang``
attribute counts as undeclared; a null URL has an empty host, which is a host of its
own; rows keep null and repeated ids; without any labelled text there are no
languages and the result is null; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelflow import session
from labelflow.llm import counters
from labelflow.llm import text_hash as th

CELLS = 1 << 16
MAX_LANGUAGES = 256
TEXT_WEIGHT = 60.0
SMOOTHING = 0.5
STRENGTH = 5.0
MARKUP = r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->|<[^>]*>|&#?\w+;"


@dataclass
class TextModel:
    """Log probabilities of trigram cells, one row per language."""

    languages: list[str]
    logs: np.ndarray

    def scores(self, chunk: th.Chunk) -> np.ndarray:
        """Mean log likelihood per text times at most ``TEXT_WEIGHT`` trigrams."""
        cells, rows = trigrams(chunk)
        n = np.bincount(rows, minlength=chunk.rows)
        sums = np.stack([np.bincount(rows, weights=logs[cells], minlength=chunk.rows) for logs in self.logs], axis=1)
        return sums * np.where(n > 0, np.minimum(n, TEXT_WEIGHT) / np.maximum(n, 1), 0.0)[:, None]


def trigrams(chunk: th.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Cells of the byte trigrams inside each text; anything but letters reads as one blank."""
    folded = np.where(th.IS_LETTER, np.arange(256), 32).astype(np.uint64)
    folded[65:91] += np.uint64(32)
    data = folded[chunk.data]
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes = data[:-2] << np.uint64(16) | data[1:-1] << np.uint64(8) | data[2:]
    rows = chunk.rows_of(np.arange(len(codes)))
    inside = (np.arange(len(codes)) + 3 <= chunk.offsets[rows + 1]) & ~((data[:-2] == 32) & (data[1:-1] == 32))
    return (th.mix(codes[inside]) >> np.uint64(48)).astype(np.int64), rows[inside]


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> TextModel:
    """Count trigrams per language over all labelled texts."""
    found = docs.select(F.col(lang_col).alias("lang")).where("lang is not null").distinct().orderBy("lang").limit(MAX_LANGUAGES + 1).collect()
    languages = [r["lang"] for r in found]
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    number = {v: k for k, v in enumerate(languages)}
    if not languages:
        return TextModel([], np.zeros((0, CELLS)))

    def fill(batch: pa.RecordBatch, table: np.ndarray) -> None:
        codes = np.array([number[x] for x in batch.column(0).to_pylist()], np.int64)
        for chunk in th.chunks(batch.column(1)):
            cells, rows = trigrams(chunk)
            table += np.bincount(codes[chunk.start + rows] * CELLS + cells, minlength=len(table))

    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang is not null")
    counts = counters.count(rows, len(languages) * CELLS, fill).reshape(len(languages), CELLS) + SMOOTHING
    return TextModel(languages, np.log(counts / counts.sum(axis=1, keepdims=True)))


def _evidence(pages: DataFrame, model: TextModel) -> DataFrame:
    """One narrow row per page: id, host, domain, suffix, declared language and text log likelihoods."""
    # Plain values: a broadcast is read where this package may be missing.
    shared = pages.sparkSession.sparkContext.broadcast((model.languages, model.logs))
    names = _columns(model, "t")
    after = F.element_at(F.split(F.coalesce("url", F.lit("")), "://", 2), 2)
    host = F.lower(F.regexp_extract(F.coalesce(F.when(F.contains(F.coalesce("url", F.lit("")), F.lit("://")), after), F.lit("")), r"^(?:[^/?#@]*@)?([^/?#:]*)", 1))
    declared = F.lower(F.regexp_extract(F.coalesce("html", F.lit("")), r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]+)", 1))
    text = F.regexp_replace(F.coalesce("html", F.lit("")), MARKUP, " ")
    source = pages.select("page_id", host.alias("host"), F.when(declared.isin(model.languages), declared).otherwise("").alias("declared"), text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        likelihood = TextModel(*shared.value)
        for batch in batches:
            for chunk in th.chunks(batch.column(3)):
                part = batch.slice(chunk.start, chunk.rows)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *map(pa.array, likelihood.scores(chunk).T.copy())], ["page_id", "host", "declared", *names])

    rows = source.mapInArrow(run, "page_id long, host string, declared string" + "".join(f", {n} double" for n in names))
    domain = F.regexp_extract("host", r"[^.]+\.[^.]+$", 0)
    return session.materialize(rows.withColumns({"domain": F.when(domain == "", F.col("host")).otherwise(domain), "suffix": F.regexp_extract("host", r"[^.]*$", 0)}), "evidence")


def _columns(model: TextModel, prefix: str) -> list[str]:
    return [f"{prefix}{k}" for k in range(len(model.languages))]


def _softmax(logs: list[Column], names: list[str]) -> list[Column]:
    top = F.greatest(*logs) if len(logs) > 1 else logs[0]
    total = reduce(lambda a, b: a + b, [F.exp(x - top) for x in logs])
    return [(F.exp(x - top) / total).alias(n) for x, n in zip(logs, names)]


def identify(pages: DataFrame, model: TextModel) -> DataFrame:
    """``page_id``, ``lang``, its ``probability``, the ``text_lang`` and the ``declared`` language."""
    count = len(model.languages)
    if not count:
        return pages.select("page_id", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("probability"), F.lit(None).cast("string").alias("text_lang"), F.lit(None).cast("string").alias("declared"))
    rows = _evidence(pages, model)
    t, f = _columns(model, "t"), _columns(model, "f")

    # First posterior: text alone, uniform over languages.
    first = rows.select("*", *_softmax([F.col(c) for c in t], f))
    sums = lambda prefix: [F.sum(c).alias(f"{prefix}{k}") for k, c in enumerate(f)]
    # Declared languages are at most the known ones and none: a table of bounded size.
    markup = first.groupBy(F.col("declared").alias("said")).agg(*sums("m"))
    markup = session.materialize(markup, "markup")
    total = markup.agg(*[F.sum(f"m{k}") for k in range(count)]).first()
    everywhere = [F.lit(x or 0.0) for x in total]
    alone = first
    for level in ("suffix", "domain", "host"):
        grouped, seen = session.measure(alone.groupBy(level).agg(*sums(level[0])), level, bytes=F.sum(F.octet_length(level)))
        first = first.join(session.broadcast_if_small(grouped, seen), level)
    first = first.join(F.broadcast(markup), F.col("declared") == F.col("said"))

    own = [F.col(c) for c in f]
    prior = _shares([everywhere[k] - own[k] + 1.0 for k in range(count)])
    for level in ("s", "d", "h"):
        prior = _shares([F.greatest(F.col(f"{level}{k}") - own[k], F.lit(0.0)) + STRENGTH * prior[k] for k in range(count)])
        first = first.withColumns({f"prior_{level}{k}": p for k, p in enumerate(prior)})
        prior = [F.col(f"prior_{level}{k}") for k in range(count)]
    said = [(F.greatest(F.col(f"m{k}") - own[k], F.lit(0.0)) + SMOOTHING) / (F.greatest(everywhere[k] - own[k], F.lit(0.0)) + SMOOTHING * (count + 1)) for k in range(count)]
    fused = first.select("page_id", "declared", *f, *_softmax([F.col(t[k]) + F.log(said[k]) + F.log(prior[k]) for k in range(count)], _columns(model, "p")))
    languages = F.array(*[F.lit(x) for x in model.languages])
    best = lambda names: F.element_at(languages, F.array_position(F.array(*names), F.array_max(F.array(*names))).cast("int"))
    p = _columns(model, "p")
    return fused.select("page_id", best(p).alias("lang"), F.array_max(F.array(*p)).alias("probability"), best(f).alias("text_lang"), F.when(F.col("declared") != "", F.col("declared")).alias("declared"))


def _shares(values: list[Column]) -> list[Column]:
    total = reduce(lambda a, b: a + b, values)
    return [v / total for v in values]
