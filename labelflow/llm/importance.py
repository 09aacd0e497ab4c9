"""Importance resampling towards a target distribution of hashed n-grams.

1. Every text is a bag of hashed runs of 1 to 3 words.  Two tables of a fixed number of
   buckets count them over the corpus and over the target; their log ratio, in
   thousandths, is an array of whole numbers.  A text's weight is the sum of the array's
   cells at its features, computed with numpy over Arrow buffers.
2. Adding Gumbel noise drawn from the id turns "the highest scores" into a draw without
   replacement in proportion to the weights.
3. The drawn rows get exact ranks by parallel sorting by regular sampling: partitions
   are sorted where they are, equally spaced rows of these runs give splitters, each row's
   segment is read off them, and segment counts give the rank at which each segment
   starts.  Only segments that hold drawn ranks are exchanged; each is merged by itself.

The CRC of a run of words follows from the CRCs of its words: the first is moved on by
the bytes of the second, a table of 4 x 256 entries per length.

Defined cases: a null or empty text, or one without words, has no features and weight 0;
a null id has no score, does not count and is never drawn; rows that repeat an id are
judged one by one, and those of equal score and id take neighbouring ranks; an empty
table gives no rows; with no target text all counts of the target are 0.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from labelflow import session
from labelflow.functions.columns import by_name
from labelflow.llm import counters
from labelflow.llm import text_hash as th

BUCKETS = 10_000
CELLS = -(-BUCKETS // counters.SLICE) * counters.SLICE
# Fixed value: the reversed polynomial of CRC-32.
POLYNOMIAL = 0xEDB88320
# Longest word whose CRC is moved on by tables; longer ones are hashed as bytes.
TABLED = 64
SEGMENT_ROWS = 1_000_000
MAX_SEGMENTS = 4096
SAMPLES_PER_SEGMENT = 64
# Low bits of Spark's monotonic id: the position of a row inside its task.
ROW_BITS = (1 << 33) - 1


@dataclass(frozen=True)
class Draw:
    """``percent`` of the documents with ``min_words`` words are drawn."""

    percent: int = 5
    min_words: int = 20
    seed: int = 42


def _byte_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = (table >> 1) ^ (table & 1) * np.uint32(POLYNOMIAL)
    return table


BYTES = _byte_table()


def _move_tables() -> np.ndarray:
    """``[n, k, b]``: the state whose k-th byte is b, moved on by n zero bytes."""
    tables = np.zeros((TABLED + 1, 4, 256), np.uint32)
    tables[0] = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(TABLED):
        tables[n + 1] = BYTES[tables[n] & 255] ^ (tables[n] >> 8)
    return tables


MOVES = _move_tables().reshape(-1)


def moved(crc: np.ndarray, by: np.ndarray) -> np.ndarray:
    """CRC states after ``by`` zero bytes each."""
    base = by * 1024
    out = MOVES[base + (crc & 255)]
    for k in (1, 2, 3):
        out ^= MOVES[base + (256 * k) + ((crc >> np.uint32(8 * k)) & 255)]
    return out


def spaced(crc: np.ndarray) -> np.ndarray:
    """CRCs after one more space."""
    state = ~crc
    return ~(BYTES[(state ^ np.uint32(0x20)) & 255] ^ (state >> np.uint32(8)))


def word_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of each span of ``data`` (shorter ones by columns of bytes, long ones one by one)."""
    length = ends - starts
    out = np.zeros(len(starts), np.uint32)
    order = np.argsort(-np.minimum(length, TABLED + 1), kind="stable")
    order = order[int((length > TABLED).sum()) :]
    state, at, sizes = np.full(len(order), 0xFFFFFFFF, np.uint32), starts[order], length[order]
    active = np.searchsorted(-sizes, -np.arange(TABLED + 1), side="left")
    for k in range(int(sizes[0]) if len(sizes) else 0):
        n = active[k]  # words longer than k bytes
        part = state[:n]
        state[:n] = BYTES[(part ^ data[at[:n] + k]) & 255] ^ (part >> np.uint32(8))
    out[order] = ~state
    for i in np.flatnonzero(length > TABLED):
        out[i] = zlib.crc32(data[starts[i] : ends[i]])
    return out


def features(chunk: th.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all features of a run of texts, the text of each, and the number of words of each text."""
    data = chunk.data.copy()
    upper = (data >= ord("A")) & (data <= ord("Z"))
    data[upper] += 32
    inside = th.IS_LETTER[data]
    edge = np.zeros(len(inside) + 1, bool)
    edge[chunk.offsets] = True
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:-1]
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    rows, length = chunk.rows_of(starts), ends - starts
    words = word_crcs(data, starts, ends)
    found, of, opening = [words], [rows], words
    firsts = np.arange(len(rows))
    for n in (2, 3):
        count = max(0, len(rows) - n + 1)
        inner = np.flatnonzero(rows[:count] == rows[n - 1 :][:count])
        last = inner + n - 1
        opening = moved(spaced(opening[np.searchsorted(firsts, inner)]), np.minimum(length[last], TABLED)) ^ words[last]
        for i in np.flatnonzero(length[last] > TABLED):
            opening[i] = zlib.crc32(b" ".join(data[starts[w] : ends[w]].tobytes() for w in range(inner[i], last[i] + 1)))
        firsts = inner
        found.append(opening)
        of.append(rows[inner])
    return np.concatenate(found) % np.uint32(BUCKETS), np.concatenate(of), th.per_row(rows, chunk.rows)


def count(texts: DataFrame) -> np.ndarray:
    """Features of all texts (the only column) per bucket."""

    def fill(batch: pa.RecordBatch, table: np.ndarray) -> None:
        for chunk in th.chunks(batch.column(0)):
            table[:BUCKETS] += np.bincount(features(chunk)[0], minlength=BUCKETS)

    return counters.count(texts, CELLS, fill)[:BUCKETS]


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket the log ratio of its share in the target and in the corpus, in thousandths, rounded down."""
    s, t = corpus.astype(np.float64), target.astype(np.float64)
    ratio = ((t + 1) * (s.sum() + BUCKETS)) / ((s + 1) * (t.sum() + BUCKETS))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def scored(docs: DataFrame, gain: np.ndarray, draw: Draw = Draw()) -> DataFrame:
    """Per row of ``docs`` (``doc_id``, ``text``): number of features, weight, score, and whether it may be drawn."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)
    least = draw.min_words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in th.chunks(batch.column(1)):
                buckets, rows, words = features(chunk)
                counts = th.per_row(rows, chunk.rows)
                weight = th.per_row(rows, chunk.rows, shared.value[buckets])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.start, chunk.rows), *map(pa.array, (counts, weight, words >= least))], ["doc_id", "n_features", "weight", "enough"])

    weighed = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_features long, weight long, enough boolean")
    drawn = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{draw.seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((drawn + F.lit(0.5)) / F.lit(4294967296.0))))
    out = weighed.withColumn("score", F.col("weight") + noise)
    return out.withColumn("enough", F.col("enough") & F.col("doc_id").isNotNull())


def _order() -> list[Column]:
    return [F.desc("score"), F.asc("doc_id")]


def ranked(rows: DataFrame, wanted: int, size: int) -> DataFrame:
    """``rows`` (``score``, ``doc_id``; not null) with ``rank``: 1 to ``wanted`` from the highest score, ties by the smaller id, else null.

    ``size`` is the number of rows.
    """
    spark = rows.sparkSession
    runs = rows.sortWithinPartitions(*_order()).withColumn("__at", F.monotonically_increasing_id().bitwiseAND(F.lit(ROW_BITS)))
    runs = session.materialize(runs, "runs")
    segments = min(MAX_SEGMENTS, max(spark.sparkContext.defaultParallelism, -(-size // SEGMENT_ROWS)))
    stride = max(1, size // (segments * SAMPLES_PER_SEGMENT))
    # At most SAMPLES_PER_SEGMENT rows for each segment, and one for each run.
    samples = runs.where(F.col("__at") % stride == stride // 2).select("score", "doc_id").orderBy(*_order()).collect()
    chosen = [samples[k * len(samples) // segments] for k in range(1, segments)] if samples else []
    cuts = spark.sparkContext.broadcast((np.array([r["score"] for r in chosen], np.int64), np.array([r["doc_id"] for r in chosen], np.int64)))
    names = [c for c in runs.columns if c != "__at"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores, ids = cuts.value
        for batch in batches:
            score = np.concatenate([batch.column(names.index("score")).to_numpy(), scores])
            ident = np.concatenate([batch.column(names.index("doc_id")).to_numpy(), ids])
            # Sorted together, a row's segment is the number of splitters before it.
            mark = np.arange(len(score)) >= batch.num_rows
            order = np.lexsort((mark, ident, -score))
            segment = np.zeros(len(score), np.int32)
            segment[order] = np.cumsum(mark[order])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(segment[: batch.num_rows])], [*names, "segment"])

    placed = runs.select(*names).mapInArrow(place, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in runs.schema.fields if f.name != "__at") + ", segment int")
    counts = {r["segment"]: r["count"] for r in placed.groupBy("segment").count().collect()}
    starts, total = {}, 0
    for segment in sorted(counts):
        starts[segment], total = total, total + counts[segment]
    reached = [k for k, start in starts.items() if start < wanted]
    last = max(reached, default=-1)
    offsets = spark.createDataFrame([(k, starts[k]) for k in reached], "segment int, before long")
    merge = Window.partitionBy("segment").orderBy(*_order())
    inside = placed.where(F.col("segment") <= last).withColumn("__in", F.row_number().over(merge)).join(F.broadcast(offsets), "segment")
    rank = (F.col("before") + F.col("__in")).cast("long")
    drawn = inside.select(*names, F.when(rank <= wanted, rank).alias("rank"))
    return drawn.unionByName(placed.where(F.col("segment") > last).select(*names, F.lit(None).cast("long").alias("rank")))


def resample(docs: DataFrame, target: DataFrame, draw: Draw = Draw(), id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """All documents with ``n_features``, ``weight``, ``score`` and the ``rank`` of those drawn."""
    rows = docs.select(by_name(id_col).cast("long").alias("doc_id"), by_name(text_col).cast("string").alias("text"))
    gain = gains(count(rows.select("text")), count(target.select(by_name(target_col).cast("string").alias("text"))))
    known, seen = session.measure(scored(rows, gain, draw), "scored", enough=F.count_if("enough"))
    size = seen["enough"] or 0
    columns = ["doc_id", "n_features", "weight", "score"]
    drawn = ranked(known.where("enough").select(*columns), draw.percent * size // 100, size)
    return drawn.unionByName(known.where("not enough").select(*columns, F.lit(None).cast("long").alias("rank")))
