"""A chain of linear models for toxicity categories.

Categories are predicted one after the other; a later model also sees the logits of
the earlier categories.  In training these come from out-of-fold predictions, so a
later model never learns from logits of rows that the earlier model was fitted on.
The threshold of the deciding category is the best F1 of its out-of-fold
predictions among cuts of at least 0.7 precision.

Features are hashed letter runs (A-Z folded) and their first 4 to 7 bytes, each with
the logarithm of its rate per hundred words, and the logarithm of the text's length.
Models are fitted on at most ``MAX_LABELLED`` labelled rows with at most
``MAX_ENTRIES`` features in all, drawn by hash.  Tasks pack the sample into bytes, six per
feature, which are broadcast; each fit is one task.  Scoring reads every whole text in
one pass without a shuffle.

Defined cases: a null or empty text has no features and gets the models' base rate;
labels that are null, or without a document, are not used; a document with several
labels is in a category if any of them says so; an id with several texts is trained on
the smallest; a drawn text that alone exceeds the room left for features is passed over;
with no row, or with a single class, for a category its probability is constant;
repeated rows are scored one by one; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelflow import session
from labelflow.llm import counters
from labelflow.llm import text_hash as th

BITS = 18
PREFIXES = (4, 5, 6, 7)
FOLDS = 3
EPOCHS = 12
STEPS = 400
BATCH = 64
RATE = 0.3
DECAY = 1e-5
MIN_TEXTS = 5
MAX_LABELLED = 10_000
MAX_ENTRIES = 16_000_000
PACKED_TEXTS = 500
PRECISION = 0.7
SEED = 7

@dataclass(frozen=True)
class Category:
    """A category and the SQL condition on the label columns that marks it."""

    name: str
    condition: str


@dataclass
class Features:
    """Sparse features of some texts: their rows, ids and values, and each text's number of words."""

    rows: np.ndarray
    ids: np.ndarray
    values: np.ndarray
    words: np.ndarray


@dataclass
class Chain:
    names: list[str]
    weights: np.ndarray
    bias: np.ndarray
    # Per category: the weight of the length, then of each earlier category.
    dense: list[np.ndarray]
    decide: int
    threshold: float

    def probabilities(self, texts: Features) -> np.ndarray:
        out = np.zeros((len(self.names), len(texts.words)))
        seen = [_length(texts.words)]
        for k in range(len(self.names)):
            logit = np.bincount(texts.rows, weights=self.weights[k][texts.ids] * texts.values, minlength=len(texts.words)) + self.bias[k]
            out[k] = _sigmoid(logit + self.dense[k] @ np.stack(seen))
            seen.append(_squashed(out[k]))
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _squashed(p: np.ndarray) -> np.ndarray:
    """Log odds within -4 and 4: how an earlier category enters a later model."""
    p = np.clip(p, 1e-9, 1 - 1e-9)
    return np.clip(np.log(p / (1 - p)), -4, 4)


def _length(words: np.ndarray) -> np.ndarray:
    return (np.log1p(words) - 5) / 2


def features(chunk: th.Chunk) -> Features:
    """Distinct hashed features of each text, in order of texts."""
    inside = th.IS_LETTER[chunk.data]
    edge = np.zeros(len(inside) + 1, bool)
    edge[chunk.offsets] = True
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:-1]
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    sums = chunk.sums(th.FOLDED_VALUES)
    rows, hashes = [chunk.rows_of(starts)], [th.span_hashes(sums, starts, ends)]
    for k in PREFIXES:
        longer = ends - starts > k
        rows.append(rows[0][longer])
        hashes.append(th.mix(th.span_hashes(sums, starts[longer], starts[longer] + k) + np.uint64(k)))
    key = np.concatenate(rows) << BITS | (np.concatenate(hashes) >> np.uint64(64 - BITS)).astype(np.int64)
    words = th.per_row(rows[0], chunk.rows)
    key, times = np.unique(key, return_counts=True)
    of = key >> BITS
    return Features(of, key & ((1 << BITS) - 1), np.log1p(100 * times / words[of]), words)


def _constant(y: np.ndarray) -> float:
    """Log odds of the base rate where nothing can be learnt."""
    rate = np.clip(y.mean() if len(y) else 0.0, 1e-3, 1 - 1e-3)
    return float(np.log(rate / (1 - rate)))


@dataclass
class Sample:
    """Labelled texts as arrays: text r's features are ``ids`` and ``values`` from ``starts[r]`` to ``stops[r]``."""

    starts: np.ndarray
    stops: np.ndarray
    ids: np.ndarray
    values: np.ndarray

    @staticmethod
    def unpack(order: np.ndarray, sizes: np.ndarray, ids: list[bytes], values: list[bytes]) -> Sample:
        """From packed chunks; ``order`` is the place of each text in them, ``sizes`` its number of features."""
        placed = np.zeros(len(order) + 1, np.int64)
        placed[order + 1] = sizes
        ends = np.cumsum(placed)
        return Sample(ends[order], ends[order + 1], np.frombuffer(b"".join(ids), np.int32), np.frombuffer(b"".join(values), np.float16).astype(np.float32))

    def logits(self, rows: np.ndarray, w: np.ndarray) -> np.ndarray:
        out = np.zeros(len(rows))
        for k, r in enumerate(rows):
            part = slice(self.starts[r], self.stops[r])
            out[k] = w[self.ids[part]] @ self.values[part]
        return out

    def fit(self, rows: np.ndarray, dense: np.ndarray, y: np.ndarray, size: int) -> tuple[np.ndarray, float, np.ndarray]:
        """Logistic regression on some rows and ``size`` features by AdaGrad over mini-batches."""
        w, bias, v = np.zeros(size), 0.0, np.zeros(dense.shape[1])
        if not len(rows) or y.min() == y.max():
            return w, _constant(y), v
        bias = float(np.log(y.mean() / (1 - y.mean())))
        seen, seen_bias, seen_v = np.full(size, 1e-2), 1e-2, np.full(dense.shape[1], 1e-2)
        random = np.random.Generator(np.random.PCG64(SEED))
        for _ in range(max(EPOCHS, STEPS * BATCH // len(rows))):
            order = random.permutation(len(rows))
            for begin in range(0, len(rows), BATCH):
                part = order[begin : begin + BATCH]
                spans = [slice(self.starts[r], self.stops[r]) for r in rows[part]]
                at = np.concatenate([self.ids[s] for s in spans])
                x = np.concatenate([self.values[s] for s in spans])
                of = np.repeat(np.arange(len(part)), [s.stop - s.start for s in spans])
                logit = np.bincount(of, weights=w[at] * x, minlength=len(part)) + bias + dense[part] @ v
                error = (_sigmoid(logit) - y[part]) / len(part)
                gradient = np.bincount(at, weights=error[of] * x, minlength=size)
                touched = np.zeros(size, bool)
                touched[at] = True
                gradient = gradient + DECAY * np.where(touched, w, 0.0)
                seen += gradient**2
                w -= RATE * gradient / np.sqrt(seen)
                total = error.sum()
                seen_bias += total**2
                bias -= RATE * total / np.sqrt(seen_bias)
                slope = dense[part].T @ error
                seen_v += slope**2
                v -= RATE * slope / np.sqrt(seen_v)
        return w, bias, v


def labelled_features(docs: DataFrame, labels: DataFrame, categories: list[Category]) -> DataFrame:
    """Features and category marks of at most ``MAX_LABELLED`` labelled documents, drawn by hash, one row each.

    The bounded draw is broadcast to the texts, so no other text is shuffled.
    """
    ys = [f"y{k}" for k in range(len(categories))]
    marks = [F.expr(c.condition).cast("double").alias(y) for y, c in zip(ys, categories)]
    rows = labels.select(F.col("doc_id").alias("label_id"), *marks).dropna().groupBy("label_id").agg(*[F.max(y).alias(y) for y in ys])
    drawn = rows.orderBy(F.xxhash64("label_id", F.lit(SEED)), "label_id").limit(MAX_LABELLED)
    joined = docs.select("doc_id", "text").join(F.broadcast(drawn), F.col("doc_id") == F.col("label_id"))
    single = joined.groupBy("doc_id", *ys).agg(F.min("text").alias("text")).select("doc_id", "text", *ys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in th.chunks(batch.column(1)):
                found = features(chunk)
                ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(found.rows, minlength=chunk.rows))]), pa.int32())
                part = [batch.column(c).slice(chunk.start, chunk.rows) for c in (0, *range(2, 2 + len(ys)))]
                lists = [pa.ListArray.from_arrays(ends, values) for values in (pa.array(found.ids, pa.int32()), pa.array(found.values, pa.float32()))]
                yield pa.RecordBatch.from_arrays([*part, pa.array(found.words), *lists], ["doc_id", *ys, "words", "ids", "values"])

    schema = "doc_id long, " + ", ".join(f"{y} double" for y in ys) + ", words long, ids array<int>, values array<float>"
    return single.mapInArrow(run, schema)


def _packed(sample: DataFrame, known: np.ndarray) -> DataFrame:
    """Chunks of texts as bytes: ids (renumbered) and values of the known features, and how many each text has."""
    short = (np.cumsum(known) - 1).astype(np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, PACKED_TEXTS):
                batch = whole.slice(start, PACKED_TEXTS)
                lengths = np.diff(batch.column(1).offsets.to_numpy())
                ids, values = (batch.column(k).flatten().to_numpy() for k in (1, 2))
                used = known[ids]
                sizes = np.bincount(np.repeat(np.arange(len(lengths)), lengths)[used], minlength=len(lengths))
                packed = [short[ids[used]].tobytes(), values[used].astype(np.float16).tobytes()]
                lists = [pa.array([batch.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([sizes.tolist()], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*lists, *(pa.array([p], pa.binary()) for p in packed)], ["texts", "sizes", "ids", "values"])

    return sample.select("doc_id", "ids", "values").mapInArrow(run, "texts array<long>, sizes array<long>, ids binary, values binary")


def draw_sample(docs: DataFrame, labels: DataFrame, categories: list[Category]) -> tuple[dict[str, np.ndarray], np.ndarray, tuple]:
    """Folds, numbers of words and marks of the texts by id; the features in use; the packed features."""
    rows = session.materialize(labelled_features(docs, labels, categories), "labelled")
    place, ys = F.xxhash64("doc_id", F.lit(SEED)), [f"y{k}" for k in range(len(categories))]
    fold = F.pmod(F.xxhash64("doc_id", F.lit(SEED + 1)), F.lit(FOLDS)).cast("int").alias("fold")
    seen = rows.select("doc_id", fold, "words", F.size("ids").alias("size"), *ys).orderBy(place, "doc_id").collect()
    kept, room = [], MAX_ENTRIES
    for r in seen:
        if r["size"] <= room:
            kept.append(r)
            room -= r["size"]
    kept.sort(key=lambda r: r["doc_id"])
    texts = {"folds": np.array([r["fold"] for r in kept], np.int64), "words": np.array([r["words"] for r in kept], np.int64), "y": np.array([[r[y] for r in kept] for y in ys])}
    if len(kept) < len(seen):
        rows = rows.join(F.broadcast(docs.sparkSession.createDataFrame([(r["doc_id"],) for r in kept], "doc_id long")), "doc_id")

    def fill(batch: pa.RecordBatch, table: np.ndarray) -> None:
        table += np.bincount(batch.column(0).flatten().to_numpy(), minlength=1 << BITS)

    known = counters.count(rows.select("ids"), 1 << BITS, fill) >= MIN_TEXTS
    chunks = _packed(rows, known).collect()
    ids = np.array([i for c in chunks for i in c["texts"]], np.int64)
    order = np.argsort(ids, kind="stable")
    sizes = np.array([n for c in chunks for n in c["sizes"]], np.int64)[order]
    return texts, np.flatnonzero(known), (order, sizes, [bytes(c["ids"]) for c in chunks], [bytes(c["values"]) for c in chunks])


def train(docs: DataFrame, labels: DataFrame, categories: list[Category], decide: str) -> Chain:
    """Fit the chain; ``decide`` names the category whose probability rejects a document."""
    spark = docs.sparkSession
    texts, used, packed = draw_sample(docs, labels, categories)
    # Plain arrays: a broadcast is read where this package may be missing.
    shared = spark.sparkContext.broadcast(packed)
    del packed
    chain = Chain([c.name for c in categories], np.zeros((len(categories), 1 << BITS), np.float32), np.zeros(len(categories)), [], 0, 0.5)
    chain.decide = chain.names.index(decide)
    dense, folds, size = [_length(texts["words"])], texts["folds"], len(used)
    for k in range(len(categories)):

        def fit(batches: Iterator[pa.RecordBatch], y: np.ndarray = texts["y"][k], dense: np.ndarray = np.stack(dense, axis=1)) -> Iterator[pa.RecordBatch]:
            """Fits on all folds but one, with predictions for that one, or on all rows."""
            sample = Sample.unpack(*shared.value)
            for batch in batches:
                for number in batch.column(0).to_pylist():
                    rows, out = np.flatnonzero(folds != number), np.flatnonzero(folds == number)
                    w, bias, v = sample.fit(rows, dense[rows], y[rows], size)
                    p = _sigmoid(sample.logits(out, w) + bias + dense[out] @ v)
                    columns = [pa.array([number], pa.int64()), pa.array([w.astype(np.float32).tobytes() if number == FOLDS else b""]), pa.array([bias]), pa.array([v.tolist()], pa.list_(pa.float64())), pa.array([p.tolist()], pa.list_(pa.float64()))]
                    yield pa.RecordBatch.from_arrays(columns, ["fit", "w", "bias", "v", "p"])

        # One task a fit; four rows: the model, and one probability per row of the bounded sample.
        fits = spark.range(0, FOLDS + 1, 1, FOLDS + 1).mapInArrow(fit, "fit long, w binary, bias double, v array<double>, p array<double>").collect()
        out_of_fold = np.zeros(len(folds))
        for r in fits:
            if r["fit"] == FOLDS:
                chain.weights[k][used] = np.frombuffer(bytes(r["w"]), np.float32)
                chain.bias[k] = r["bias"]
                chain.dense.append(np.array(r["v"]))
            else:
                out_of_fold[folds == r["fit"]] = r["p"]
        dense.append(_squashed(out_of_fold))
        if k == chain.decide:
            chain.threshold = best_threshold(out_of_fold, texts["y"][k])
    shared.destroy()
    return chain


def best_threshold(p: np.ndarray, y: np.ndarray, precision: float = PRECISION) -> float:
    """The cut with the best F1 among those of enough precision, in the middle of the gap below it.

    Of equal cuts, the one with the widest gap.  If no cut is precise enough (a
    few labels only), probabilities are taken as they are.
    """
    if not len(y) or y.min() == y.max():
        return 0.5
    order = np.argsort(-p, kind="stable")
    p, y = p[order], y[order]
    hits, taken = np.cumsum(y), np.arange(1, len(y) + 1)
    below = np.append(p[1:], 0.0)
    possible = p > below
    precise = possible & (hits >= precision * taken)
    if not precise.any():
        return 0.5
    value = np.where(precise, 2 * hits / (taken + y.sum()), -1.0)
    best = np.flatnonzero(value >= value.max() - 1e-12)
    k = best[np.argmax(p[best] - below[best])]
    return float((p[k] + below[k]) / 2)


def score(docs: DataFrame, chain: Chain, text_col: str = "text") -> DataFrame:
    """``docs`` with ``p_<category>`` for each category and ``rejected``, in place of columns of these names."""
    added = [*(f"p_{n}" for n in chain.names), "rejected"]
    kept = [k for k, c in enumerate(docs.columns) if c not in added]

    def columns(part: pa.RecordBatch, p: np.ndarray, rejected: np.ndarray) -> list[pa.Array]:
        return [*(part.column(k) for k in kept), *map(pa.array, p), pa.array(rejected)]

    fields = [*(docs.schema.fields[k] for k in kept), *(T.StructField(n, T.BooleanType() if n == "rejected" else T.DoubleType()) for n in added)]
    return _judged(docs, chain, text_col, columns, fields)


def keep(docs: DataFrame, chain: Chain, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the chain does not reject, and those without a word, with the columns of ``docs``."""
    at = docs.columns.index(text_col)

    def columns(part: pa.RecordBatch, p: np.ndarray, rejected: np.ndarray) -> list[pa.Array]:
        # Without words only the base rate speaks.
        for chunk in th.chunks(part.column(at)):
            worded = th.per_row(chunk.rows_of(chunk.words()[0]), chunk.rows) > 0
            rejected[chunk.start : chunk.start + chunk.rows] &= worded
        return part.filter(pa.array(~rejected)).columns

    return _judged(docs, chain, text_col, columns, docs.schema.fields)


def _judged(docs: DataFrame, chain: Chain, text_col: str, columns: Callable, fields: list[T.StructField]) -> DataFrame:
    # Plain arrays: a broadcast is read where this package may be missing.
    shared = docs.sparkSession.sparkContext.broadcast(tuple(vars(chain).values()))
    at = docs.columns.index(text_col)
    # Plain names inside, so that any name may stand outside.
    source = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    names = [f"c{k}" for k in range(len(fields))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Chain(*shared.value)
        for batch in batches:
            for chunk in th.chunks(batch.column(at)):
                p = model.probabilities(features(chunk))
                part = batch.slice(chunk.start, chunk.rows)
                yield pa.RecordBatch.from_arrays(columns(part, p, p[model.decide] >= model.threshold), names)

    schema = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, fields)])
    return source.mapInArrow(run, schema).toDF(*[f.name for f in fields])
