"""Near-duplicate vectors within a label: binary codes, multi-index tables, exact rerank.

1. Equal vectors of a label form a class; one vector per class goes on and classes
   keep their sizes, so a group of copies never makes pairs.
2. Iterative quantisation learns rotations of the unit vectors that make their signs
   a balanced code (centred, then alternating signs and an orthogonal fit).  The fit
   uses at most ``FIT_ROWS`` vectors drawn by hash; every vector is coded.
3. Each hash table holds a substring of the code, and vectors that agree in it meet in
   one bucket.  How many tables a substring length needs is read off the fit sample:
   its vectors are turned by exactly the threshold's angle, and tables are added until
   ``RECALL`` of these pairs meet, so vectors with a common direction get more tables
   or shorter substrings.  Substrings get longer with the label, as the number of
   vectors per bucket has to stay bounded.
4. A bucket's vectors are compared by the original vectors in double precision, in
   blocks of at most ``BLOCK``.  A pair counts in the first table where it meets.  A
   block gives each vector's number of links and one link to a smaller group of them,
   so a group of k near vectors makes about k rows and no pairs.

Defined cases: vectors that are null, empty, zero, or hold a null or non-finite
component, and vectors without a label, link with nothing and keep their row; vectors
of different lengths do not link; rows that repeat an id count as one vector each and
share a component; a null id gets a null component; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelflow import session
from labelflow.llm.components import components

# Code bits, as whole words of 64.
BITS = 256
WORDS = BITS // 64
FIT_ROWS = 20_000
ROUNDS = 40
SEED = 5
RECALL = 0.99
TRIALS = 2_000
MAX_TABLES = 48
MAX_KEY_BITS = 28
# Vectors that a bucket holds on average, if they are spread evenly.
BUCKET = 32
BLOCK = 1024


def _orthogonal(size: int, number: int) -> np.ndarray:
    return np.linalg.qr(np.random.Generator(np.random.PCG64(SEED + number)).standard_normal((size, size)))[0]


def fit_rotation(vectors: np.ndarray, number: int = 0) -> np.ndarray:
    """Iterative quantisation: the rotation that brings the vectors closest to their own signs."""
    rotation = _orthogonal(vectors.shape[1], number)
    for _ in range(ROUNDS if len(vectors) else 0):
        signs = np.where(vectors @ rotation >= 0, 1.0, -1.0)
        u, _, v = np.linalg.svd(signs.T @ vectors)
        rotation = (u @ v).T
    return rotation


def fit(sample: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centre and rotations (side by side, ``BITS`` columns) learnt from unit vectors of one length."""
    size = sample.shape[1]
    centre = sample.mean(axis=0)
    blocks = -(-BITS // size)
    return centre, np.hstack([fit_rotation(sample - centre, k) for k in range(blocks)])[:, :BITS]


def code_bits(unit: np.ndarray, model: tuple[np.ndarray, np.ndarray] | None) -> np.ndarray:
    """Code bits of unit vectors; without a model of their length, by random rotations."""
    if model is not None and len(model[0]) == unit.shape[1]:
        return (unit - model[0]) @ model[1] >= 0
    size = unit.shape[1]
    return unit @ np.hstack([_orthogonal(size, k) for k in range(-(-BITS // size))])[:, :BITS] >= 0


def positions() -> np.ndarray:
    """For each table the code bits of its substring; a shorter one is a part of it from the start."""
    random = np.random.Generator(np.random.PCG64(SEED))
    return np.stack([random.permutation(BITS)[:MAX_KEY_BITS] for _ in range(MAX_TABLES)])


def tables_needed(sample: np.ndarray, model: tuple[np.ndarray, np.ndarray] | None, threshold: float) -> np.ndarray:
    """For each substring length from 0 the fewest tables in which ``RECALL`` of the pairs just at the threshold meet (0: too many)."""
    random = np.random.Generator(np.random.PCG64(SEED))
    unit = sample[random.integers(0, len(sample), TRIALS)]
    aside = random.standard_normal(unit.shape)
    aside -= (aside * unit).sum(axis=1, keepdims=True) * unit
    length = np.linalg.norm(aside, axis=1, keepdims=True)
    angle = math.acos(min(1.0, threshold))
    turned = math.cos(angle) * unit + math.sin(angle) * aside / np.where(length > 0, length, 1.0)
    differ = code_bits(unit, model) ^ code_bits(turned, model)
    # met[t, k, n]: whether the substrings of n bits in table t are equal.
    apart = np.logical_or.accumulate(differ[:, positions()], axis=2)
    met = np.logical_or.accumulate(~apart, axis=1).mean(axis=0)
    reached = met >= RECALL
    needed = np.where(reached.any(axis=0), reached.argmax(axis=0) + 1, 0)
    return np.concatenate([[1], needed])


def substring(count: int, needed: np.ndarray) -> int:
    """Bits per substring for this many vectors of one label: as many as leave ``BUCKET`` vectors to a bucket, if tables suffice."""
    wanted = min(MAX_KEY_BITS, max(0, math.ceil(math.log2(max(count, 1) / BUCKET))))
    return next(b for b in range(wanted, -1, -1) if needed[b])


def _units(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and unit vectors of one batch, by vector length."""
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.diff(offsets)
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        block = values[offsets[:-1][at][:, None] + np.arange(size)]
        block = block / np.abs(block).max(axis=1, keepdims=True)
        yield at, block / np.linalg.norm(block, axis=1, keepdims=True)


def _mark() -> Column:
    return F.sha2(F.to_json(F.struct("embedding")), 256)


def _classes(rows: DataFrame) -> DataFrame:
    """Usable vectors, one per label and value: number of the class, smallest id, number of rows, vector."""
    vector = F.col("embedding")
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & vector.isNotNull() & (F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0)
    marked = rows.where(usable).withColumn("mark", _mark())
    grouped = marked.groupBy("label", "mark").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies"))
    grouped = session.materialize(grouped, "classes")
    vectors = marked.join(grouped.select("label", "mark", F.col("node").alias("vec_id"), F.col("copies")), ["label", "mark", "vec_id"])
    return session.materialize(vectors.select("label", "mark", F.col("vec_id").alias("node"), "copies", "embedding").dropDuplicates(["label", "mark"]).withColumn("class", F.monotonically_increasing_id()), "vectors")


def _coded(classes: DataFrame, threshold: float) -> DataFrame:
    """Classes with the words of their code, the bits per substring and the keys of all tables."""
    drawn = classes.select("embedding", F.size("embedding").alias("size"), F.xxhash64("node", F.lit(SEED)).alias("h"), "node", "mark")
    lengths = drawn.groupBy("size").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "size").limit(1).collect()
    model, needed = None, np.ones(1, np.int64)
    if lengths:
        found = drawn.where(F.col("size") == lengths[0]["size"]).orderBy("h", "node", "mark").limit(FIT_ROWS).select("embedding").toArrow()
        sample = np.concatenate([unit for batch in found.to_batches() for _, unit in _units(batch.column(0))])
        model = fit(sample)
        needed = tables_needed(sample, model, threshold)
    # Plain arrays: a broadcast is read where this package may be missing.
    shared = classes.sparkSession.sparkContext.broadcast((model, needed))
    sizes, seen = session.measure(classes.groupBy("label").agg(F.count(F.lit(1)).alias("members")), "labels", bytes=F.sum(F.octet_length(F.col("label").cast("string"))))
    rows = classes.join(session.broadcast_if_small(sizes, seen), "label").select("class", "members", F.col("embedding").cast("array<double>").alias("embedding"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, needed = shared.value
        places = positions()
        for batch in batches:
            bits = np.zeros((batch.num_rows, BITS), bool)
            for at, unit in _units(batch.column(2)) if batch.num_rows else ():
                bits[at] = code_bits(unit, model)
            words = np.packbits(bits, axis=1, bitorder="little").view(np.int64)
            members = batch.column(1).to_numpy()
            width, keys = np.zeros(len(members), np.int32), [np.zeros(0, np.int64)] * len(members)
            for count in np.unique(members):
                at = np.flatnonzero(members == count)
                width[at] = substring(int(count), needed)
                b = width[at[0]]
                values = bits[at][:, places[: needed[b], :b]] @ (1 << np.arange(b, dtype=np.int64))
                for k, row in zip(at, values):
                    keys[k] = row
            ends = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*keys, np.zeros(0, np.int64)]).astype(np.int64)))
            code = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * WORDS, pa.int32()), pa.array(words.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(width), code, lists], ["class", "width", "code", "keys"])

    coded = rows.mapInArrow(run, "class long, width int, code array<long>, keys array<long>")
    joined = coded.join(classes.select("class", "label", "copies", "embedding"), "class")
    return session.materialize(joined, "codes")


def _buckets(coded: DataFrame) -> DataFrame:
    """Every vector once per table and block pair of its bucket: a bucket of at most ``BLOCK`` vectors is one block pair."""
    bucket = ["label", "size", "table", "key"]
    rows = coded.select("class", "width", "code", "copies", "embedding", "label", F.size("embedding").alias("size"), F.posexplode("keys").alias("table", "key"))
    large = rows.select(*bucket).groupBy(*bucket).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks")).where("blocks > 1")
    large, seen = session.measure(large, "large", bytes=F.sum(F.octet_length(F.col("label").cast("string"))))
    if not seen["rows"]:
        zero = F.lit(0).cast("long")
        return rows.select("*", zero.alias("block"), zero.alias("first"), zero.alias("second"))
    rows = rows.join(session.broadcast_if_small(large, seen), bucket, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("class"), "blocks"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    rows = rows.withColumn("other", other)
    return rows.select("*", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second")).drop("blocks", "other")


def _labels(adjacent: np.ndarray) -> np.ndarray:
    """Smallest row number that each row reaches over a symmetric matrix of links."""
    label = np.arange(len(adjacent))
    while True:
        reached = np.minimum(label, np.where(adjacent, label, len(label)).min(axis=1, initial=len(label)))
        reached = reached[reached]
        if (reached == label).all():
            return label
        label = reached


class _Group:
    """Vectors of one bucket (or of two of its blocks) of one length."""

    def __init__(self, part: pa.RecordBatch, threshold: float, masks: np.ndarray):
        self.ids, self.copies, self.block = (part.column(k).to_numpy() for k in (0, 1, 2))
        table, width = part.column(3)[0].as_py(), part.column(4)[0].as_py()
        code = part.column(5).flatten().to_numpy().reshape(-1, WORDS)
        unit = next(_units(part.column(6)))[1]
        near = np.triu(unit @ unit.T >= threshold, 1)
        if self.block.min() != self.block.max():
            near &= self.block[:, None] != self.block
        a, b = np.nonzero(near)
        differ = code[a] ^ code[b]
        # A pair counts in the first table where its substrings agree.
        for mask in masks[width][:table]:
            earlier = ~(differ & mask).any(axis=1)
            near[a[earlier], b[earlier]] = False
        self.near = near | near.T

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Vectors with a link here: the class, the smallest one it reaches here, and the number of vectors linked."""
        linked = np.flatnonzero(self.near.any(axis=1))
        near = self.near[np.ix_(linked, linked)]
        ids = self.ids[linked]
        order = np.argsort(ids)
        near = near[np.ix_(order, order)]
        return ids[order], ids[order][_labels(near)], near.astype(np.int64) @ self.copies[linked][order]


def links(coded: DataFrame, threshold: float) -> DataFrame:
    """``class``, a class it is connected with (``root``) and the number of vectors linked (``others``), some rows per class."""
    keys = ["label", "size", "table", "key", "first", "second"]
    placed = _buckets(coded).repartition(*keys).sortWithinPartitions(*keys)
    fields = ["class", "copies", "block", "table", "width", "code", "embedding"]
    names = F.struct(*[F.col(k) for k in keys])
    placed = placed.select(*fields[:6], F.col("embedding").cast("array<double>").alias("embedding"), F.xxhash64(names).alias("group"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = positions()
        bits = np.zeros((MAX_KEY_BITS + 1, MAX_TABLES, BITS), bool)
        for width in range(1, MAX_KEY_BITS + 1):
            bits[width, np.arange(MAX_TABLES)[:, None], place[:, :width]] = True
        masks = np.packbits(bits, axis=2, bitorder="little").view(np.int64)
        held: list[pa.RecordBatch] = []

        def finish() -> Iterator[pa.RecordBatch]:
            part = pa.Table.from_batches(held).combine_chunks().to_batches()[0] if len(held) > 1 else held[0]
            if part.num_rows > 1:
                columns = _Group(part, threshold, masks).rows()
                if len(columns[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["class", "root", "others"])

        for batch in batches:
            group = batch.column(7).to_numpy()
            cuts = np.flatnonzero(group[1:] != group[:-1]) + 1
            for start, stop in zip([0, *cuts], [*cuts, len(group)] if len(group) else []):
                if held and held[-1].column(7)[0].as_py() != group[start]:
                    yield from finish()
                    held = []
                held.append(batch.slice(start, stop - start))
        if held:
            yield from finish()

    return session.materialize(placed.mapInArrow(run, "class long, root long, others long"), "links")


def dedup(vectors: DataFrame, threshold: float = 0.98) -> DataFrame:
    """One row per vector: links to other vectors, component, and whether it is the one kept."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")
    classes = _classes(rows)
    found = links(_coded(classes, threshold), threshold)
    others = found.groupBy("class").agg(F.sum("others").alias("others"))
    nodes = classes.select("class", "node")
    named = found.where("class != root").select("class", "root").distinct()
    edges = named.join(nodes, "class").withColumnRenamed("node", "a").join(nodes.select(F.col("class").alias("root"), F.col("node").alias("b")), "root").select("a", "b")
    marked = rows.select("vec_id", "label", _mark().alias("mark"))
    # An id with several vectors connects their classes.
    known = classes.select("label", "mark", "node", "class")
    several = marked.where("vec_id is not null").join(known, ["label", "mark"]).groupBy("vec_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a != b")
    repeated = several.select("vec_id").join(marked, "vec_id").join(known, ["label", "mark"]).select(F.col("vec_id").alias("a"), F.col("node").alias("b"))
    labels = components(session.materialize(edges.union(repeated), "edges")).withColumnRenamed("node", "node_")
    full = known.join(classes.select("class", "copies"), "class").join(others, "class", "left").join(labels, F.col("node") == F.col("node_"), "left")
    full = full.select("label", "mark", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component"))
    full = session.materialize(full, "named")
    joined = marked.join(full, ["label", "mark"], "left")
    # Without an id a vector is in no class.
    has = F.col("vec_id").isNotNull()
    component = F.when(has, F.coalesce("component", "vec_id"))
    return joined.select("vec_id", F.when(has, F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
