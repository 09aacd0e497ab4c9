"""Training by epochs: distributed mini-batch steps, a checkpoint per epoch, the best one kept.

A text is a bag of hashed words, made inside the JVM; only word numbers reach Python.
In an epoch every task starts from the same weights and takes mini-batch steps over its
own rows; the tasks' changes are averaged by their numbers of rows, slice by slice, and
give the weights of the next epoch.  Each epoch's weights are written before the next
begins, so a run that fails goes on from there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelflow.operators.classifier import TOKENS, TrainResult, evaluate, evaluation_details, split_samples
from labelflow.operators.metrics import binary_metrics
from labelflow.operators.sampling import RECORD_ID
from labelflow.session import materialize, scratch_path

SLICE = 1 << 14
# Rows that a task steps over, where there are as many.
TASK_ROWS = 4_000
SEED = 17
STATE = "epoch int, f1 double, loss double, weights binary, squares binary, bias double, bias_square double"


@dataclass(frozen=True)
class EpochConfig:
    """``rate`` is the step of a weight before its gradients shrink it; ``decay`` pulls weights to 0 in every step."""

    text_column: str = "摘要"
    label_column: str = "标签"
    id_column: str = RECORD_ID
    features: int = 1 << 18
    epochs: int = 8
    batch: int = 16
    rate: float = 0.5
    decay: float = 1e-6


def word_numbers(text: Column, features: int) -> Column:
    """Hashed words of a text, repeats included."""
    words = F.regexp_extract_all(F.lower(text), F.lit(TOKENS), F.lit(0))
    return F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(features)).cast("int"))


def _rows(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, word and value of each distinct word of each text; a text's values have length 1 together."""
    ends = lists.offsets.to_numpy()
    words = lists.values.to_numpy()[ends[0] : ends[-1]].astype(np.int64)
    rows = np.repeat(np.arange(len(lists)), np.diff(ends))
    order = np.lexsort((words, rows))
    rows, words = rows[order], words[order]
    first = np.append(True, (rows[1:] != rows[:-1]) | (words[1:] != words[:-1]))[: len(rows)]
    starts = np.flatnonzero(first)
    values = np.log1p(np.diff(np.append(starts, len(rows))))
    rows, words = rows[starts], words[starts]
    norms = np.sqrt(np.bincount(rows, weights=values**2, minlength=len(lists)))
    return rows, words, values / norms[rows]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class LinearModel:
    """Weights of the words of a text; stands where a fitted pipeline stands in scoring and evaluation."""

    weights: np.ndarray
    bias: float

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``__probability`` of both classes to a table with ``__text``."""
        shared = df.sparkSession.sparkContext.broadcast((self.weights, self.bias))

        @F.arrow_udf("double")
        def positive(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            weights, bias = shared.value
            for lists in batches:
                rows, words, values = _rows(lists)
                yield pa.array(_sigmoid(np.bincount(rows, weights=weights[words] * values, minlength=len(lists)) + bias))

        p = positive(word_numbers(F.col("__text"), len(self.weights)))
        both = df.withColumn("__positive", p)
        return both.withColumn("__probability", array_to_vector(F.array(1 - F.col("__positive"), F.col("__positive")))).drop("__positive")

    def save(self, spark: SparkSession, path: str) -> None:
        row = [(bytearray(self.weights.astype(np.float32).tobytes()), float(self.bias))]
        spark.createDataFrame(row, "weights binary, bias double").coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> LinearModel:
        row = spark.read.parquet(path).first()
        return LinearModel(np.frombuffer(bytes(row["weights"]), np.float32), row["bias"])


@dataclass
class _State:
    """Weights, sums of their squared gradients, and the same of the bias."""

    weights: np.ndarray
    squares: np.ndarray
    bias: float = 0.0
    bias_square: float = 1e-2

    def step(self, rows: np.ndarray, words: np.ndarray, values: np.ndarray, y: np.ndarray, config: EpochConfig) -> None:
        logit = np.bincount(rows, weights=self.weights[words] * values, minlength=len(y)) + self.bias
        error = (_sigmoid(logit) - y) / len(y)
        used, place = np.unique(words, return_inverse=True)
        gradient = np.bincount(place, weights=error[rows] * values, minlength=len(used)) + config.decay * self.weights[used]
        self.squares[used] += gradient**2
        self.weights[used] -= config.rate * gradient / np.sqrt(self.squares[used])
        self.bias_square += error.sum() ** 2
        self.bias -= config.rate * error.sum() / np.sqrt(self.bias_square)


def _epoch(rows: DataFrame, start: _State, config: EpochConfig) -> _State:
    """One pass over the rows (``label``, ``words``) from the same weights in every task."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast((start.weights, start.squares, start.bias, start.bias_square))
    schema = "slice int, rows long, weights binary, squares binary"
    columns = [c.split()[0] for c in schema.split(", ")]

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, squares, bias, bias_square = shared.value
        state, seen = _State(weights.copy(), squares.copy(), bias, bias_square), 0
        task = pa.array([TaskContext.get().partitionId()], pa.int32())
        for batch in batches:
            y = batch.column(0).to_numpy().astype(np.float64)
            of, words, values = _rows(batch.column(1))
            cuts = np.searchsorted(of, np.arange(0, len(y) + config.batch, config.batch))
            for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
                first = k * config.batch
                state.step(of[a:b] - first, words[a:b], values[a:b], y[first : first + config.batch], config)
            seen += len(y)
        if seen:
            moved = [seen * (state.weights - weights), seen * (state.squares - squares)]
            for k in range(0, len(weights), SLICE):
                parts = [m[k : k + SLICE] for m in moved]
                # Slices that did not move still say how many rows stand behind it: slice -1.
                if parts[1].any():
                    yield _slice(k // SLICE, 0, *parts).append_column("task", task)
            yield _slice(-1, seen, np.array([seen * (state.bias - bias)]), np.array([seen * (state.bias_square - bias_square)])).append_column("task", task)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for k, seen, *parts in zip(*(column.to_pylist() for column in batch.columns)):
                found = [seen, *(np.frombuffer(part) for part in parts)]
                sums[k] = [a + b for a, b in zip(sums[k], found)] if k in sums else found
        for k, found in sums.items():
            yield _slice(k, *found)

    parts = spark.sparkContext.defaultParallelism
    moves = rows.select("label", "words").mapInArrow(steps, schema + ", task int")
    # Added in the order of the tasks, so that equal runs round alike.
    moves = moves.repartition(parts, "slice").sortWithinPartitions("slice", "task").select(columns)
    summed = moves.mapInArrow(add, schema).collect()
    shared.unpersist()
    found = {r["slice"]: (r["rows"], np.frombuffer(bytes(r["weights"])), np.frombuffer(bytes(r["squares"]))) for r in summed}
    total, bias, bias_square = found.pop(-1)
    out = _State(start.weights.copy(), start.squares.copy(), start.bias + bias[0] / total, start.bias_square + bias_square[0] / total)
    for k, (_, weights, squares) in found.items():
        out.weights[k * SLICE : k * SLICE + len(weights)] += weights / total
        out.squares[k * SLICE : k * SLICE + len(squares)] += squares / total
    return out


def _slice(number: int, seen: int, weights: np.ndarray, squares: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array([number], pa.int32()), pa.array([seen], pa.int64()), pa.array([weights.tobytes()]), pa.array([squares.tobytes()])]
    return pa.RecordBatch.from_arrays(columns, ["slice", "rows", "weights", "squares"])


def _checkpoints(spark: SparkSession, path: str) -> list[dict]:
    """Finished epochs below ``path``, first to last, without their weights."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/*/_SUCCESS")
    system = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    folders = [status.getPath().getParent().toString() for status in system.globStatus(folder) or []]
    if not folders:
        return []
    rows = spark.read.schema(STATE).parquet(*folders).select("epoch", "f1", "loss").orderBy("epoch").collect()
    return [row.asDict() for row in rows]


def _store(spark: SparkSession, path: str, epoch: int, f1: float, loss: float, state: _State) -> None:
    row = (epoch, f1, loss, bytearray(state.weights.tobytes()), bytearray(state.squares.tobytes()), float(state.bias), float(state.bias_square))
    spark.createDataFrame([row], STATE).coalesce(1).write.mode("overwrite").parquet(f"{path}/epoch-{epoch:04d}")


def _load(spark: SparkSession, path: str, epoch: int) -> _State:
    row = spark.read.schema(STATE).parquet(f"{path}/epoch-{epoch:04d}").first()
    weights, squares = (np.frombuffer(bytes(row[c])).copy() for c in ("weights", "squares"))
    return _State(weights, squares, row["bias"], row["bias_square"])


def train_by_epochs(splits: DataFrame, config: EpochConfig = EpochConfig(), checkpoints: str | None = None) -> TrainResult:
    """Fit on ``split = 'train'`` and keep the epoch with the best validation F1, of equals the one with the least loss.

    Every epoch is written to ``checkpoints`` (a scratch folder if none is given);
    epochs found there are not trained again.  ``candidates`` of the result
    lists each epoch, from 1, with its validation F1.
    """
    spark = splits.sparkSession
    path = checkpoints or scratch_path(spark, "epochs")
    samples = materialize(split_samples(splits, config), "samples")
    fitted = samples.filter(F.col("split").isin("train", "val"))
    prepared = fitted.select("split", F.col("label").cast("int").alias("label"), F.xxhash64("index", F.lit(SEED)).alias("place"), word_numbers(F.col("text"), config.features).alias("words"))
    prepared = materialize(prepared, "prepared")
    rows, held = (prepared.filter(F.col("split") == part) for part in ("train", "val"))
    # A task with few rows moves the weights little: the tasks' changes are averaged.
    # Rows are dealt by a hash of their id and follow it, in an order without meaning: how Spark
    # cuts the input, and the order in which files are read, do not touch the weights.
    rows = rows.repartition(max(1, rows.count() // TASK_ROWS), "place").sortWithinPartitions("place", "label", "words")
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    classes = {row["label"]: row["count"] for row in rows.groupBy("label").count().collect()}
    if sum(classes.values()) < 2:
        raise ValueError("training needs at least two samples")
    if set(classes) != {0, 1}:
        raise ValueError("the training part needs both classes")

    done = _checkpoints(spark, path)
    state = _load(spark, path, done[-1]["epoch"]) if done else _State(np.zeros(config.features), np.full(config.features, 1e-2))
    tried = [(row["epoch"], row["f1"], row["loss"]) for row in done]
    for epoch in range(len(done) + 1, config.epochs + 1):
        state = _epoch(rows, state, config)
        found = binary_metrics(_predicted(held, state), loss="loss").first()
        _store(spark, path, epoch, found["f1"], found["loss"], state)
        tried.append((epoch, found["f1"], found["loss"]))
    rows.unpersist()
    best = max(tried, key=lambda t: (t[1], -t[2]))[0]
    chosen = state if best == tried[-1][0] else _load(spark, path, best)
    model = LinearModel(chosen.weights.astype(np.float32), float(chosen.bias))
    details = evaluation_details(samples, model, extra=("split",))
    return TrainResult(model, evaluate(details, by="split"), details, [t[:2] for t in tried], config)


def _predicted(rows: DataFrame, state: _State) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast((state.weights, state.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        for batch in batches:
            of, words, values = _rows(batch.column(1))
            logit = np.bincount(of, weights=weights[words] * values, minlength=batch.num_rows) + bias
            of_truth = _sigmoid(np.where(batch.column(0).to_numpy() == 1, logit, -logit))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array((logit > 0).astype(np.int32)), pa.array(-np.log(of_truth))], ["label", "prediction", "loss"])

    return rows.select("label", "words").mapInArrow(run, "label int, prediction int, loss double")
