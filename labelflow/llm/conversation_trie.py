"""The trie of conversation prefixes: which conversations open with the same turns.

1. Every turn becomes a digest of its role and text in the scan; texts are never
   shuffled.  The narrow rows meet by conversation, in turn order, and a running digest
   names each prefix.  A task streams them: it holds one conversation's state only.
2. A count-min sketch counts the prefix digests.  An estimate of one proves that a
   prefix belongs to a single conversation; its node is complete where it stands and is
   emitted locally.
3. Only prefixes that may be shared are shuffled and grouped exactly.  A node carries
   its smallest member, and from the depth at which a conversation becomes smallest it
   stays so: the nodes it names are one chain.  A subtree's sums are the sums of its
   members' chains, so they need a join on conversations and no walk through the tree.
4. Members that end at a shared node are hashed in sorted order as a stream.

Conversations may open with another's turns: ``base`` names it and ``head`` says how
many of its first turns (at most ``MAX_HEAD``) replace the own ones.  A base has to be
its own base.

Defined cases: turns are ordered by number, null first, turns of one number by role and
then by the SHA-256 of their text; a null role or text is empty; repeated rows are turns
of their own; rows without a conversation id are in no conversation; a conversation
left without turns is a member of the root only; an empty table has no node, not even
the root; other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from labelflow import session
from labelflow.functions.columns import by_name
from labelflow.llm import count_min

MAX_HEAD = 64
NOTHING = hashlib.sha256(b"").hexdigest()
BATCH = 8192
PATHS = "conv_id long, depth long, d1 long, d2 long, p1 long, p2 long, bytes long, last boolean"


class _Paths:
    """Running digests of one conversation after the other, in the order (base, base first, conversation, turn)."""

    def __init__(self) -> None:
        self.base: int | None = None
        self.opening: list[tuple[tuple[int, int], int]] = []
        self.conv: int | None = None
        self.rows: list[tuple] = []

    def start(self, base: int, conv: int, head: int) -> None:
        self.end()
        if base != self.base:
            self.base, self.opening = base, []
        self.conv, self.own, self.at = conv, 0, (0, 0)
        self.skip = 0 if conv == base else head
        self.rows.append((conv, 0, 0, 0, None, None, 0))
        self.depth = 0
        for digest, size in self.opening[: self.skip]:
            self.add(digest, size)

    def turn(self, mark: bytes, size: int) -> None:
        self.own += 1
        if self.own <= self.skip:
            return
        digest = struct.unpack("<qq", hashlib.sha256(struct.pack("<qq", *self.at) + mark).digest()[:16])
        if self.conv == self.base and len(self.opening) < MAX_HEAD:
            self.opening.append((digest, size))
        self.add(digest, size)

    def add(self, digest: tuple[int, int], size: int) -> None:
        self.depth += 1
        self.rows.append((self.conv, self.depth, *digest, *self.at, size))
        self.at = digest

    def end(self) -> None:
        """The conversation is over: its last row is its end."""
        if self.conv is not None:
            self.rows[-1] = (*self.rows[-1], True)
        self.conv = None

    def take(self, everything: bool) -> Iterator[pa.RecordBatch]:
        """Finished rows; the last one waits, as it may be the conversation's end."""
        ready = len(self.rows) if everything else len(self.rows) - 1
        for start in range(0, ready, BATCH):
            columns = list(zip(*(row if len(row) == 8 else (*row, False) for row in self.rows[start : min(start + BATCH, ready)])))
            types = [pa.int64()] * 7 + [pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["conv_id", "depth", "d1", "d2", "p1", "p2", "bytes", "last"])
        self.rows = self.rows[max(ready, 0) :]


def paths(turns: DataFrame, base: Column, head: Column) -> DataFrame:
    """One row per conversation and depth from 0: digests of the prefix and its parent, bytes of the last text, whether the conversation ends."""
    role, text = (F.coalesce(by_name(c).cast("string"), F.lit("")) for c in ("role", "text"))
    marked = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text")).where("conv_id is not null")
    injective = F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", F.sha2("text", 256))
    marked = marked.select(base.cast("long").alias("base"), "conv_id", head.cast("int").alias("head"), "turn", "role", F.unhex(F.sha2("text", 256)).alias("text_mark"), F.unhex(F.sha2(injective, 256)).alias("mark"), F.octet_length("text").cast("long").alias("bytes"))
    placed = marked.repartition("base").sortWithinPartitions("base", F.col("conv_id") != F.col("base"), "conv_id", F.asc_nulls_first("turn"), "role", "text_mark")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = _Paths()
        for batch in batches:
            for b, conv, head, mark, size in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if conv != state.conv:
                    state.start(b, conv, head)
                state.turn(mark, size)
            yield from state.take(False)
        state.end()
        yield from state.take(True)

    return placed.select("base", "conv_id", "head", "mark", "bytes").mapInArrow(run, PATHS)


def screen(rows: DataFrame, sketch: np.ndarray) -> DataFrame:
    """``rows`` with ``alone`` and ``above``: whether the prefix, and its parent, are proven to belong to one conversation."""
    shared = rows.sparkSession.sparkContext.broadcast(sketch)
    fields = ["conv_id", "depth", "d1", "d2", "p1", "p2", "bytes", "last"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            depth, d1, d2 = (batch.column(k).to_numpy() for k in (1, 2, 3))
            p1, p2 = (batch.column(k).fill_null(0).to_numpy() for k in (4, 5))
            alone = (depth > 0) & (count_min.estimate(shared.value, d1, d2) == 1)
            above = (depth > 1) & (count_min.estimate(shared.value, p1, p2) == 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(alone), pa.array(above)], [*fields, "alone", "above"])

    return rows.select(*fields).mapInArrow(run, f"{PATHS}, alone boolean, above boolean")


def ends_hashes(ends: DataFrame) -> DataFrame:
    """Per node (``d1``, ``d2``): SHA-256 of its ``conv_id``s in ascending order, comma-joined, hashed as a stream."""
    placed = ends.select("d1", "d2", "conv_id").repartition("d1", "d2").sortWithinPartitions("d1", "d2", "conv_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, running = None, None
        for batch in batches:
            d1, d2, ids = (batch.column(k).to_numpy() for k in range(3))
            begins = np.flatnonzero(np.append(True, (d1[1:] != d1[:-1]) | (d2[1:] != d2[:-1]))) if len(d1) else []
            done = []
            for start, stop in zip(begins, [*begins[1:], len(d1)]):
                joined = ",".join(map(str, ids[start:stop].tolist()))
                if (d1[start], d2[start]) == key:
                    running.update(f",{joined}".encode())
                    continue
                if key is not None:
                    done.append((*key, running.hexdigest()))
                key, running = (d1[start], d2[start]), hashlib.sha256(joined.encode())
            yield _hashes(done)
        if key is not None:
            yield _hashes([(*key, running.hexdigest())])

    return placed.mapInArrow(run, "d1 long, d2 long, ends_sha256 string")


def _hashes(done: list[tuple]) -> pa.RecordBatch:
    columns = zip(*done) if done else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string()))], ["d1", "d2", "ends_sha256"])


def trie(turns: DataFrame, base: Column | None = None, head: Column | None = None) -> DataFrame:
    """One row per node of the trie over ``turns`` (``conv_id``, ``turn``, ``role``, ``text``).

    ``conv_id`` is the smallest member, ``n_convs`` the members, ``n_children`` and
    ``n_leaves`` nodes below, ``saved_tokens`` the bytes that members of the subtree share
    beyond the first of them, ``ends_sha256`` the hash of the members that end here.
    """
    whole = F.col("conv_id")
    rows, seen = session.measure(paths(turns, whole if base is None else base, F.lit(0) if head is None else head), "paths")
    sketch = count_min.build(rows.where("depth > 0").select("d1", "d2"), seen["rows"])
    screened = session.materialize(screen(rows, sketch), "screened")
    node = ["d1", "d2"]
    possible, tails = screened.where("not alone"), screened.where("alone")

    counted = possible.groupBy(*node).agg(F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.count(F.lit(1)).alias("n_convs"), F.max("bytes").alias("bytes"), F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.max("above").alias("above"))
    counted = session.materialize(counted, "nodes")
    # Every child is one row here: a node that was grouped, or the top of a tail.
    children = counted.where("depth > 0 and not above").select("p1", "p2").union(tails.where("not above").select("p1", "p2"))
    children = children.groupBy(F.col("p1").alias("d1"), F.col("p2").alias("d2")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = counted.join(children, node, "left").fillna(0, ["n_children"])
    below = Window.partitionBy("conv_id").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    nodes = nodes.withColumn("own", (F.col("n_convs") - 1) * F.col("bytes")).withColumn("chain", F.sum("own").over(below))
    nodes, size = session.measure(nodes, "counted")

    # What each conversation's chain adds to the nodes it passes.
    named = nodes.groupBy("conv_id").agg(F.min("depth").alias("top"), F.sum("own").alias("total"), F.max((F.col("n_children") == 0).cast("int")).alias("leaf"))
    tailed = tails.where("last").select("conv_id", F.lit(None).cast("long").alias("top"), F.lit(0).cast("long").alias("total"), F.lit(1).alias("leaf"))
    chains = named.union(tailed).groupBy("conv_id").agg(F.min("top").alias("top"), F.sum("total").alias("total"), F.max("leaf").alias("leaf")).where("total > 0 or leaf > 0")
    chains, chained = session.measure(chains, "chains")
    passed = possible.select("conv_id", "depth", *node).join(session.broadcast_if_small(chains, chained), "conv_id")
    passed = passed.groupBy(*node).agg(F.sum(F.when(F.col("depth") < F.col("top"), F.col("total")).otherwise(0)).alias("other"), F.sum("leaf").alias("n_leaves"))
    ends = ends_hashes(possible.where("last"))

    smallest = nodes.where("depth = 0").agg(F.min("conv_id")).first()[0]
    full = nodes.join(passed, node, "left").join(ends, node, "left")
    saved = F.col("chain") + F.coalesce("other", F.lit(0))
    shared = full.select("conv_id", "depth", "p1", "p2", "above", "n_convs", "n_children", F.coalesce("n_leaves", F.lit(0)).alias("n_leaves"), saved.alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"))
    ended = F.when(F.col("last"), F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(NOTHING)
    one = F.lit(1).cast("long")
    single = tails.select("conv_id", "depth", "p1", "p2", "above", one.alias("n_convs"), (~F.col("last")).cast("long").alias("n_children"), one.alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), ended.alias("ends_sha256"))

    # A parent below a proven prefix is the same conversation's; the root's member is known; others are looked up.
    near = F.col("above") | (F.col("depth") <= 1)
    parent = F.when(F.col("depth") == 1, F.lit(smallest)).when(F.col("above"), F.col("conv_id"))
    out = [c for c in shared.columns if c not in ("p1", "p2", "above")]
    both = shared.union(single)
    local = both.where(near).select(*out, parent.cast("long").alias("parent_conv_id"))
    up = lambda a, b: F.concat(F.hex(a), F.lit("."), F.hex(b)).alias("up")
    parents = nodes.where("n_children > 0").select(up("d1", "d2"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    looked = session.join_groups(both.where(~near).withColumn("up", up("p1", "p2")), parents.withColumnRenamed("n_children", "weight_"), "up", size, "weight_")
    return local.unionByName(looked.select(*out, "parent_conv_id"))
