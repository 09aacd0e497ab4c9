"""Pack texts into sequences of fixed capacity by best fit under conflicts.

A bin never holds two pieces of one duplicate cluster, nor more than
``source_limit`` pieces of one source.  Pieces go longest first into the open bin
with the smallest residual that is compatible: residuals are kept as a bitmap whose
successor search gives the tightest fit, bins of equal residual are grouped by the
bitmap of sources that are full in them, and each bin has a bitmap of its clusters.
If the tightest bins conflict, the search goes on to the next residual.

Texts longer than a bin give full pieces, each a bin of its own, and a rest that is
packed.  Pieces are dealt to shards of about ``shard_pieces`` by the place they were
read from, not by a key, so no source or cluster can fill a shard; a bin never
crosses shards, so constraints hold everywhere.  Only ids and lengths are shuffled.

Defined cases: texts without words give no piece; a null source is a source of its
own, under the same limit; repeated rows are pieces of one cluster and land in
different bins; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelflow import session
from labelflow.functions.columns import by_name
from labelflow.llm import text_hash as th

SCHEMA = "doc_id long, piece int, source string, cluster long, start long, n_tokens int, bin_id long, bin_offset int"


@dataclass(frozen=True)
class Layout:
    """``capacity`` words per bin; each piece takes one more for the separator that ends it."""

    capacity: int = 2048
    source_limit: int = 3
    shard_pieces: int = 20_000


def lengths(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``source``, words, cluster (equal word sequences, A-Z folded) and place of each text that has words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId() << 40
        for batch in batches:
            for chunk in th.chunks(batch.column(2)):
                starts, ends = chunk.words()
                of = chunk.rows_of(starts)
                n = th.per_row(of, chunk.rows)
                first = np.concatenate([[0], np.cumsum(n)])
                within = np.arange(len(starts)) - first[of]
                marks = th.mix(th.span_hashes(chunk.sums(th.FOLDED_VALUES), starts, ends) ^ th.mix(within.astype(np.uint64)))
                running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(marks, dtype=np.uint64)])
                cluster = (running[first[1:]] - running[first[:-1]]).view(np.int64)
                places = place + np.arange(chunk.rows)
                place += chunk.rows
                ids, source = (batch.column(k).slice(chunk.start, chunk.rows) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([ids, source, pa.array(n), pa.array(cluster), pa.array(places)], ["doc_id", "source", "n", "cluster", "place"])

    rows = docs.select("doc_id", "source", "text").mapInArrow(run, "doc_id long, source string, n long, cluster long, place long")
    return session.materialize(rows.where("n > 0"), "lengths")


class Bins:
    """Open bins of one shard."""

    def __init__(self, layout: Layout):
        self.capacity, self.limit = layout.capacity, layout.source_limit
        self.occupied = 0  # bit r: some bin has residual r
        self.groups: list[dict[int, dict[int, None]]] = [{} for _ in range(self.capacity + 1)]
        self.residual: list[int] = []
        self.full: list[int] = []
        self.clusters: list[int] = []
        self.counts: list[dict[int, int]] = []
        self.last: tuple | None = None
        self.cursor = 0

    def _search(self, size: int, source: int, cluster: int, begin: int) -> tuple[int | None, int]:
        """The tightest compatible bin whose residual is at least ``begin``, and that residual."""
        mask = self.occupied >> begin
        at = begin
        while mask:
            step = (mask & -mask).bit_length() - 1
            at, mask = at + step, mask >> step
            for full, bins in self.groups[at].items():
                if not full >> source & 1:
                    for b in bins:
                        if not self.clusters[b] & cluster:
                            return b, at
            at, mask = at + 1, mask >> 1
        return None, self.capacity + 1

    def _drop(self, b: int) -> None:
        r, f = self.residual[b], self.full[b]
        group = self.groups[r][f]
        del group[b]
        if not group:
            del self.groups[r][f]
            if not self.groups[r]:
                self.occupied &= ~(1 << r)

    def add(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """Place a piece (``cluster`` is its bit, 0 if it is alone): bin and offset."""
        # Equal pieces come one after the other.  What refused the last one refuses
        # this one too: bins it went into hold its cluster or count its source.
        same = self.last == (size, source, cluster) and cluster
        b, self.cursor = self._search(size, source, cluster, max(size, self.cursor) if same else size)
        self.last = (size, source, cluster)
        if b is None:
            b = len(self.residual)
            self.residual.append(self.capacity)
            self.full.append(0)
            self.clusters.append(0)
            self.counts.append({})
        else:
            self._drop(b)
        offset = self.capacity - self.residual[b]
        self.residual[b] -= size
        self.clusters[b] |= cluster
        self.counts[b][source] = held = self.counts[b].get(source, 0) + 1
        if held >= self.limit:
            self.full[b] |= 1 << source
        r = self.residual[b]
        self.groups[r].setdefault(self.full[b], {})[b] = None
        self.occupied |= 1 << r
        return b, offset


def pack_shard(rows: pa.Table, layout: Layout) -> pa.Table:
    """Place the pieces of one shard, longest first."""
    order = [("n_tokens", "descending"), *((c, "ascending") for c in ("cluster", "source", "doc_id", "place", "piece"))]
    rows = rows.sort_by(order)
    source = pc.dictionary_encode(rows["source"].combine_chunks(), null_encoding="encode").indices.to_numpy()
    values, codes = np.unique(rows["cluster"].to_numpy(), return_inverse=True)
    several = np.bincount(codes, minlength=len(values)) > 1
    bit = np.cumsum(several) - 1
    bins = Bins(layout)
    sizes = rows["n_tokens"].to_numpy()
    placed = [bins.add(int(n) + 1, int(s), 1 << int(bit[c]) if several[c] else 0) for n, s, c in zip(sizes, source, codes)]
    base = rows["shard"][0].as_py() << 24
    return rows.append_column("bin_id", pa.array([base + b for b, _ in placed], pa.int64())).append_column("bin_offset", pa.array([o for _, o in placed], pa.int32()))


def pack(docs: DataFrame, layout: Layout = Layout(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per piece: document, first word, length, bin and offset in it."""
    docs = docs.select(by_name(id_col).cast("long").alias("doc_id"), by_name(source_col).cast("string").alias("source"), by_name(text_col).cast("string").alias("text"))
    rows = lengths(docs)
    room = layout.capacity - 1
    numbered = rows.withColumn("piece", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / room).cast("int"))))
    start = F.col("piece").cast("long") * room
    pieces = numbered.select("doc_id", "piece", "source", "cluster", start.alias("start"), F.least(F.lit(room), F.col("n") - start).cast("int").alias("n_tokens"), "place")
    total = pieces.agg(F.count(F.lit(1))).first()[0]
    shards = max(1, -(-total // layout.shard_pieces))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("place", "piece"), F.lit(shards)).cast("int"))
    columns = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(rows: pa.Table) -> pa.Table:
        return pack_shard(rows, layout).select(columns)

    return dealt.groupBy("shard").applyInArrow(run, SCHEMA)
