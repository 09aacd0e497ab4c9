"""Documents whose sets of word n-grams have a Jaccard similarity of at least a threshold.

1. Every text becomes the set of its distinct n-grams as 64-bit hashes.  Texts with
   equal sets form a class; only one text per class goes on.
2. All n-grams are counted in a fixed number of hashed cells (8 MB in all).  The
   order (cell count, hash) is one global rare-first order; n-grams of passages that
   many texts share come last, so they stay out of the prefixes.
3. Prefix filter: two sets that reach the threshold share an n-gram of their
   prefixes.  Prefix n-grams are joined under the length filter, the positional
   filter and the suffix filter, and each pair that is left is verified once, on
   whole texts.  The suffix filter bounds the sets' difference from below: each set has
   a bitmap with one parity per hash range, and every n-gram that only one of the two
   sets holds changes one bit at most.
4. Groups of many similar texts share prefix n-grams, so pairs are asked for in
   rounds.  A round compares the texts that share an n-gram with one centre only;
   texts already linked through others need no further pair.  When few pairs remain
   between different components, or a round no longer halves them, all of them are
   joined.  No link between different components is lost, and a group of k texts costs
   about k pairs a round.

Defined cases: null or empty texts, and texts of white space, have no n-grams and
link with nothing; fewer words than n make one n-gram of the whole sequence; rows
that repeat an id count as one document that has all their texts; a null id gets a
null component; an empty table gives no rows.
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
from labelflow.functions.columns import by_name
from labelflow.llm import counters
from labelflow.llm import text_hash as th
from labelflow.llm.components import components, sized

CELLS = 1 << 20
BITS = 1024
# Pairs per shared prefix n-gram up to which all remaining pairs are joined.
PAIRS_PER_POSTING = 4


@dataclass(frozen=True)
class Jaccard:
    words: int = 5
    percent: int = 80

    def overlap(self, a: Column, b: Column) -> Column:
        """Fewest shared n-grams of two sets of these sizes that reach the threshold."""
        return F.ceil((a + b) * self.percent / (100 + self.percent))

    def near(self, a: Column, b: Column, bits_a: Column, bits_b: Column) -> Column:
        """Length filter and suffix filter: whether sets of these sizes and bitmaps may reach the threshold."""
        length = F.least(a, b) * 100 >= F.greatest(a, b) * self.percent
        apart = reduce(lambda x, y: x + y, [F.bit_count(F.get(bits_a, F.lit(k)).bitwiseXOR(F.get(bits_b, F.lit(k)))) for k in range(BITS // 64)])
        return length & (apart <= a + b - 2 * self.overlap(a, b))

    def probe(self, n: np.ndarray) -> np.ndarray:
        """Prefix length of a set against shorter ones."""
        return n - -(-n * self.percent // 100) + 1

    def index(self, n: Column) -> Column:
        """Prefix length of a set against ones at least as long."""
        return n - F.ceil(n * (2 * self.percent) / (100 + self.percent)) + 1


def sets(chunk: th.Chunk, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of each text: hashes and rows, sorted by row and hash."""
    starts, ends = chunk.words()
    words, of = th.span_hashes(chunk.sums(th.FOLDED_VALUES), starts, ends), chunk.rows_of(starts)
    grams, at = th.windows(words, of, n)
    rows = of[at]
    counts = th.per_row(of, chunk.rows)
    for k in range(1, n):  # short texts: one n-gram of k words
        short = counts == k
        if short.any():
            keep = short[of]
            less, place = th.windows(words[keep], of[keep], k)
            grams = np.concatenate([grams, th.mix(less + np.uint64(k))])
            rows = np.concatenate([rows, of[keep][place]])
    order = np.lexsort((grams, rows))
    grams, rows = grams[order], rows[order]
    first = np.ones(len(grams), bool)
    first[1:] = (grams[1:] != grams[:-1]) | (rows[1:] != rows[:-1])
    return grams[first], rows[first]


def count_cells(docs: DataFrame, rule: Jaccard) -> np.ndarray:
    """How many (text, n-gram) pairs fall into each cell, over all texts."""
    words = rule.words

    def fill(batch: pa.RecordBatch, table: np.ndarray) -> None:
        for chunk in th.chunks(batch.column(0)):
            grams, _ = sets(chunk, words)
            table += np.bincount((grams % np.uint64(CELLS)).astype(np.int64), minlength=CELLS)

    return counters.count(docs.select("text"), CELLS, fill)


def signatures(docs: DataFrame, rule: Jaccard) -> DataFrame:
    """Per text: set size, fingerprint of the set, parities per hash range, and the prefix, rarest first."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(np.minimum(count_cells(docs, rule), 0xFFFFFFFF).astype(np.uint32))
    schema = "doc_id long, n int, f1 long, f2 long, bits array<long>, prefix array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for batch in batches:
            ids = batch.column(0)
            for chunk in th.chunks(batch.column(1)):
                grams, rows = sets(chunk, rule.words)
                n = th.per_row(rows, chunk.rows)
                bounds = np.zeros(chunk.rows + 1, np.int64)
                np.cumsum(n, out=bounds[1:])
                marks = []
                for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
                    running = np.zeros(len(grams) + 1, np.uint64)
                    np.cumsum(th.mix(grams + np.uint64(salt)), out=running[1:])
                    marks.append((running[bounds[1:]] - running[bounds[:-1]]).view(np.int64))
                held = np.bincount(rows * BITS + (grams // np.uint64((1 << 64) // BITS)).astype(np.int64), minlength=chunk.rows * BITS)
                bits = np.packbits((held & 1).astype(np.uint8)).view(np.int64)
                order = np.lexsort((grams, counts[(grams % np.uint64(len(counts))).astype(np.int64)], rows))
                length = np.where(n > 0, rule.probe(n), 0)
                inside = np.arange(len(grams)) - bounds[rows] < length[rows]
                prefix = grams[order][inside].view(np.int64)
                ends = np.zeros(chunk.rows + 1, np.int32)
                np.cumsum(length, out=ends[1:])
                columns = [
                    ids.slice(chunk.start, chunk.rows),
                    pa.array(n, pa.int32()),
                    *map(pa.array, marks),
                    pa.ListArray.from_arrays(pa.array(np.arange(chunk.rows + 1, dtype=np.int32) * (BITS // 64)), pa.array(bits)),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(prefix)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "f1", "f2", "bits", "prefix"])

    return session.materialize(docs.select("doc_id", "text").mapInArrow(run, schema), "signatures")


def verify(pairs: DataFrame, seen: dict, docs: DataFrame, rule: Jaccard) -> DataFrame:
    """The ``(a, b)`` of ``pairs`` (of measured size) whose whole sets reach the threshold."""
    needed, size = session.measure(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "needed")
    texts = session.materialize(docs.join(session.broadcast_if_small(needed, size), "doc_id"), "texts")
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("left"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("right"))
    words, percent = rule.words, rule.percent

    def keyed(chunk: th.Chunk, first: int) -> tuple[np.ndarray, np.ndarray]:
        grams, rows = sets(chunk, words)
        return th.mix(grams ^ th.mix((rows + first).astype(np.uint64) + np.uint64(1))), rows + first

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            for start in range(0, rows, 256):
                part = batch.slice(start, 256)
                sides = []
                for k in (2, 3):
                    keys, of = zip(*(keyed(c, c.start) for c in th.chunks(part.column(k))))
                    sides.append((np.concatenate(keys), np.concatenate(of)))
                (x, xs), (y, ys) = sides
                _, at, _ = np.intersect1d(x, y, assume_unique=True, return_indices=True)
                both = th.per_row(xs[at], part.num_rows)
                union = th.per_row(xs, part.num_rows) + th.per_row(ys, part.num_rows) - both
                keep = pa.array((both > 0) & (100 * both >= percent * union))
                yield part.select(["a", "b"]).filter(keep)

    joined = session.broadcast_if_small(pairs, seen).join(left, "a").join(right, "b").select("a", "b", "left", "right")
    return joined.mapInArrow(run, "a long, b long")


class _Search:
    """Rounds of candidate pairs between documents of different components."""

    def __init__(self, docs: DataFrame, postings: DataFrame, size: int, meta: DataFrame, rule: Jaccard):
        self.docs, self.rule, self.meta, self.postings, self.size = docs, rule, meta, postings, size
        self.tested: DataFrame | None = None
        # Links of the last test, and everything that earlier ones joined, as stars.
        self.fresh: DataFrame | None = None
        self.stars: DataFrame | None = None

    def links(self) -> DataFrame:
        """Links with the same components as all links found."""
        return self.fresh if self.stars is None else self.stars.select("node", "component").union(self.fresh)

    def labels(self) -> DataFrame:
        if self.fresh is not None:
            self.stars = session.materialize(components(self.links().toDF("a", "b")), "stars")
            self.fresh = self.stars.limit(0).toDF("a", "b")
        return self.stars

    def test(self, pairs: DataFrame) -> None:
        """Filter and verify pairs (``a`` < ``b``) that were not tested before."""
        if self.tested is not None:
            pairs = pairs.join(self.tested, ["a", "b"], "left_anti")
        pairs, seen = session.measure(pairs, "met")
        meta = self.sets_of(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")), 2 * seen["rows"])
        a = meta.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("bits").alias("pa"))
        b = meta.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("pb"))
        near = pairs.join(a, "a").join(b, "b").where(self.rule.near(F.col("na"), F.col("nb"), F.col("pa"), F.col("pb")))
        # An id with several texts meets another once per pair of texts.
        self.verify(near.select("a", "b").distinct())

    def sets_of(self, ids: DataFrame, rows: int) -> DataFrame:
        """Sizes and bitmaps of all texts of some documents, given in (at most) ``rows`` rows; broadcast if their measured size allows."""
        used, seen = session.measure(sized(ids.distinct(), rows), "used")
        meta, seen = session.measure(self.meta.join(session.broadcast_if_small(used, seen), "doc_id"), "meta")
        return session.broadcast_if_small(meta, seen | {"bytes": seen["rows"] * BITS // 8})

    def verify(self, pairs: DataFrame) -> None:
        pairs, seen = session.measure(pairs, "pairs")
        self.tested = pairs if self.tested is None else self.tested.union(pairs)
        found = session.materialize(verify(pairs, seen, self.docs, self.rule), "links")
        self.fresh = found if self.fresh is None else self.fresh.union(found)

    def star(self) -> None:
        """First round: every document against the smallest and the largest id of each n-gram it shares."""
        ends = [self.postings.select(F.col(c).alias("c"), "doc_id") for c in ("low", "high")]
        self.test(sized(_ordered(ends[0].union(ends[1])), 2 * self.size))

    def open_postings(self) -> tuple[DataFrame, dict]:
        """Postings of the n-grams that still touch several components, with a bound on the pairs between them."""
        labels, seen = session.measure(self.labels().withColumnRenamed("node", "doc_id"), "labels")
        labelled = self.postings.select("token", "doc_id", "n", "pos").join(session.broadcast_if_small(labels, seen), "doc_id", "left")
        labelled = session.materialize(labelled.withColumn("component", F.coalesce("component", "doc_id")), "labelled")
        sizes = labelled.groupBy("token", "component").agg(F.count(F.lit(1)).alias("k")).groupBy("token").agg(F.count(F.lit(1)).alias("groups"), F.sum("k").alias("all"), F.sum(F.col("k") * F.col("k")).alias("squares"))
        pairs = (F.col("all") * F.col("all") - F.col("squares")) / 2
        several, seen = session.measure(sized(sizes, self.size).where("groups > 1").select("token", pairs.alias("pairs")), "several", pairs=F.sum("pairs"))
        rows, counted = session.measure(labelled.join(session.broadcast_if_small(several.select("token"), seen), "token"), "open")
        return rows, {"rows": counted["rows"], "pairs": seen["pairs"] or 0}

    def star_round(self, rows: DataFrame, number: int) -> None:
        """Every document of an n-gram against one of its documents, drawn anew in each round."""
        drawn = rows.groupBy("token").agg(F.min(F.struct(F.xxhash64("doc_id", F.lit(number)).alias("h"), F.col("doc_id").alias("c"), F.col("component").alias("cc"))).alias("centre"))
        drawn, seen = session.measure(drawn, "drawn")
        pairs = rows.join(session.broadcast_if_small(drawn, seen), "token").where(F.col("component") != F.col("centre.cc")).select(F.col("centre.c").alias("c"), "doc_id")
        self.test(sized(_ordered(pairs), self.size))

    def all_pairs(self, rows: DataFrame) -> None:
        """All pairs between components that the prefix, length and positional filters leave."""
        rows = rows.join(self.sets_of(rows.select("doc_id"), self.size).select("doc_id", "n", "bits"), ["doc_id", "n"])
        x = rows.where(F.col("pos") < self.rule.index(F.col("n"))).select("token", *[F.col(c).alias(f"{c}_x") for c in ("doc_id", "n", "pos", "component", "bits")])
        y = rows.select("token", *[F.col(c).alias(f"{c}_y") for c in ("doc_id", "n", "pos", "component", "bits")])
        n_x, n_y = F.col("n_x"), F.col("n_y")
        shorter = (n_x < n_y) | ((n_x == n_y) & (F.col("doc_id_x") < F.col("doc_id_y")))
        # On the first n-gram that two sets share, nothing before it counts.
        rest = F.least(n_x - F.col("pos_x"), n_y - F.col("pos_y"))
        wanted = (F.col("component_x") != F.col("component_y")) & shorter & (rest >= self.rule.overlap(n_x, n_y))
        met = x.join(y, "token").where(wanted & self.rule.near(n_x, n_y, F.col("bits_x"), F.col("bits_y")))
        pairs = _ordered(met.select(F.col("doc_id_x").alias("c"), F.col("doc_id_y").alias("doc_id")))
        self.verify(pairs if self.tested is None else pairs.join(self.tested, ["a", "b"], "left_anti"))


def _ordered(pairs: DataFrame) -> DataFrame:
    """Distinct pairs of different documents with the smaller id first."""
    return pairs.where("c != doc_id").select(F.least("c", "doc_id").alias("a"), F.greatest("c", "doc_id").alias("b")).distinct()


def cluster(docs: DataFrame, rule: Jaccard = Jaccard(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, ``n_shingles`` and ``component_id``, the smallest id reachable by links."""
    docs = docs.select(by_name(id_col).cast("long").alias("doc_id"), by_name(text_col).cast("string").alias("text"))
    signed = signatures(docs, rule)
    filled = signed.where("n > 0 and doc_id is not null")
    key = ["f1", "f2", "n"]
    classes = session.materialize(filled.groupBy(*key).agg(F.min("doc_id").alias("kept")), "classes")
    chosen = filled.join(classes.withColumnRenamed("kept", "doc_id"), [*key, "doc_id"])
    meta = session.materialize(chosen.select("doc_id", "n", "bits").distinct(), "sizes")
    rows = chosen.select("doc_id", "n", F.posexplode("prefix").alias("pos", "token"))
    ends = session.materialize(rows.groupBy("token").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low != high"), "shared")
    postings, seen = session.measure(rows.join(ends, "token"), "postings")

    search = _Search(docs.where("doc_id is not null"), postings, seen["rows"], meta, rule)
    search.star()
    before, rounds = None, 0
    while True:
        left, seen = search.open_postings()
        few = seen["pairs"] <= PAIRS_PER_POSTING * seen["rows"]
        if few or before is not None and 2 * seen["pairs"] > before:
            break
        before, rounds = seen["pairs"], rounds + 1
        search.star_round(left, rounds)
    if seen["rows"]:
        search.all_pairs(left)

    # Texts of one document may fall into several classes: they link through its id.
    same = filled.join(classes, key).where("doc_id != kept").select(F.col("kept").alias("a"), F.col("doc_id").alias("b"))
    repeated = filled.groupBy("doc_id").agg(F.countDistinct(*key).alias("texts")).where("texts > 1").select(F.col("doc_id").alias("b"))
    links = search.links().toDF("a", "b").union(same.join(repeated, "b").select("a", "b"))
    labels = components(links).withColumnsRenamed({"node": "kept"})
    named = classes.join(labels, "kept", "left").select(*key, F.coalesce("component", "kept").alias("component"))
    joined = signed.join(named, key, "left")
    return joined.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
