"""Binary text classifier on Spark ML: train, score, evaluate."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field
from datetime import datetime, timezone

import pandas as pd
from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelflow.functions.columns import by_name, columns_except
from labelflow.functions.labels import binary_label, class_text
from labelflow.functions.text import is_missing, none_to_empty, strip
from labelflow.operators.metrics import binary_metrics
from labelflow.operators.sampling import RECORD_ID
from labelflow.session import materialize

# Words, with each Chinese character a word of its own.
TOKENS = r"\p{IsHan}|[\p{L}\p{N}&&[^\p{IsHan}]]+"
# Names of the columns a scoring job adds.
LABEL_TEXT, POSITIVE_PROBABILITY, CONFIDENCE = "预测标签", "正样本概率", "预测置信度"


@dataclass(frozen=True)
class TrainConfig:
    text_column: str = "摘要"
    label_column: str = "标签"
    id_column: str = RECORD_ID
    features: int = 1 << 18
    max_iterations: int = 50
    regularizations: tuple[float, ...] = (0.01, 0.1, 0.001)
    metadata: dict = field(default_factory=dict)


@dataclass(frozen=True)
class TrainResult:
    model: PipelineModel
    metrics: DataFrame
    details: DataFrame
    candidates: list[tuple[float, float]]
    config: TrainConfig


def training_samples(
    df: DataFrame,
    text: str,
    label: str,
    id_col: str = RECORD_ID,
    strict: bool = True,
    extra: tuple[str, ...] = (),
) -> DataFrame:
    """Rows with text and a label as ``(*extra, index, text, label)``, label 0 or 1.

    A label that names no class fails the query, or drops the row if not ``strict``.
    """
    words = strip(none_to_empty(by_name(text)))
    kept = df.filter((words != "") & ~is_missing(by_name(label)))
    samples = kept.select(
        *extra,
        by_name(id_col).alias("index"),
        words.alias("text"),
        binary_label(df, label, strict).alias("label"),
    )
    return samples if strict else samples.filter(F.col("label").isNotNull())


def split_samples(splits: DataFrame, config: TrainConfig) -> DataFrame:
    return training_samples(splits, config.text_column, config.label_column, config.id_column, extra=("split",))


def score(df: DataFrame, model: PipelineModel, text: str) -> DataFrame:
    """Add the class text, the positive probability and the confidence to every row."""
    scored = _predict(df.withColumn("__text", strip(none_to_empty(by_name(text)))), model)
    return scored.select(
        *columns_except(df, LABEL_TEXT, POSITIVE_PROBABILITY, CONFIDENCE),
        class_text(F.col("predicted_label")).alias(LABEL_TEXT),
        F.col("positive_probability").alias(POSITIVE_PROBABILITY),
        F.col("confidence").alias(CONFIDENCE),
    )


def score_with(df: DataFrame, predict: Callable[[list[str]], list[float]], text: str) -> DataFrame:
    """Like ``score`` with any function from texts to positive probabilities.

    The function is called in tasks on Arrow batches of the text column only.
    """
    @F.pandas_udf("double")
    def probability(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(predict(texts.tolist()), index=texts.index, dtype="float64")

    positive = probability.asNondeterministic()(strip(none_to_empty(by_name(text))))
    scored, p = df.withColumn("__positive", positive), F.col("__positive")
    return scored.select(
        *columns_except(df, LABEL_TEXT, POSITIVE_PROBABILITY, CONFIDENCE),
        class_text((p > 0.5).cast("int")).alias(LABEL_TEXT),
        p.alias(POSITIVE_PROBABILITY),
        F.greatest(p, 1 - p).alias(CONFIDENCE),
    )


def _predict(df: DataFrame, model: PipelineModel) -> DataFrame:
    probability = vector_to_array(F.col("__probability"))
    scored = model.transform(df).withColumn("__p", probability)
    predicted = F.when(F.col("__p")[1] > F.col("__p")[0], 1).otherwise(0)
    return (
        scored.withColumn("predicted_label", predicted)
        .withColumn("positive_probability", F.col("__p")[1])
        .withColumn("confidence", F.greatest(F.col("__p")[0], F.col("__p")[1]))
    )


def evaluation_details(samples: DataFrame, model: PipelineModel, extra: tuple[str, ...] = ()) -> DataFrame:
    """Per sample: true and predicted label, probabilities, correctness and log loss."""
    scored = _predict(samples.withColumn("__text", F.col("text")), model)
    of_truth = F.when(F.col("label") == 1, F.col("__p")[1]).otherwise(F.col("__p")[0])
    return scored.select(
        *extra,
        "index",
        "text",
        F.col("label").alias("true_label"),
        "predicted_label",
        "positive_probability",
        "confidence",
        (F.col("predicted_label") == F.col("label")).alias("is_correct"),
        (-F.log(F.greatest(of_truth, F.lit(1e-15)))).alias("loss"),
    )


def evaluate(details: DataFrame, by: str | None = None) -> DataFrame:
    return binary_metrics(details, "predicted_label", "true_label", by=by, loss="loss")


def train_classifier(splits: DataFrame, config: TrainConfig = TrainConfig()) -> TrainResult:
    """Fit on ``split = 'train'`` and keep the candidate with the best validation F1.

    ``splits`` is a labelled table with a ``split`` column.  Candidates differ
    in regularization and are tried in order; a later one must be strictly
    better.  Metrics and details cover all three parts.
    """
    # Written once: every pass below reads samples, not the plan behind them.
    samples = materialize(split_samples(splits, config), "samples")
    train = samples.filter(F.col("split") == "train")
    classes = {row["label"]: row["count"] for row in train.groupBy("label").count().collect()}
    if sum(classes.values()) < 2:
        raise ValueError("training needs at least two samples")
    if set(classes) != {0, 1}:
        raise ValueError("the training part needs both classes")

    features = Pipeline(
        stages=[
            RegexTokenizer(inputCol="__text", outputCol="__tokens", pattern=TOKENS, gaps=False),
            HashingTF(inputCol="__tokens", outputCol="__tf", numFeatures=config.features),
            IDF(inputCol="__tf", outputCol="__features"),
        ]
    ).fit(train.withColumn("__text", F.col("text")))
    fitted_on = samples.filter(F.col("split").isin("train", "val")).withColumn("__text", F.col("text"))
    prepared = features.transform(fitted_on).select("split", "label", "__features")
    prepared = prepared.persist(StorageLevel.MEMORY_AND_DISK)
    fit_rows, val_rows = (prepared.filter(F.col("split") == part) for part in ("train", "val"))
    best, best_f1, tried = None, -1.0, []
    for regularization in config.regularizations:
        learner = LogisticRegression(
            featuresCol="__features",
            labelCol="label",
            probabilityCol="__probability",
            rawPredictionCol="__raw",
            predictionCol="__prediction",
            regParam=regularization,
            maxIter=config.max_iterations,
        )
        fitted = learner.fit(fit_rows)
        scored = fitted.transform(val_rows).select("label", F.col("__prediction").cast("int").alias("prediction"))
        f1 = binary_metrics(scored).first()["f1"]
        tried.append((regularization, f1))
        if f1 > best_f1:
            best, best_f1 = fitted, f1
    prepared.unpersist()
    model = PipelineModel(stages=[*features.stages, best])
    details = evaluation_details(samples, model, extra=("split",))
    return TrainResult(model, evaluate(details, by="split"), details, tried, config)


def save_result(result: TrainResult, path: str) -> None:
    """Write the model (a pipeline, or one that saves itself), its metrics and details, and a record of the run."""
    spark = result.metrics.sparkSession
    if isinstance(result.model, PipelineModel):
        result.model.write().overwrite().save(f"{path}/model")
    else:
        result.model.save(spark, f"{path}/model")
    result.details.write.mode("overwrite").parquet(f"{path}/details")
    saved = spark.read.parquet(f"{path}/details")
    evaluate(saved, by="split").coalesce(1).write.mode("overwrite").parquet(f"{path}/metrics")
    record = {"config": asdict(result.config), "candidates": result.candidates}
    stamp = datetime.now(timezone.utc).isoformat()
    text = json.dumps(record, ensure_ascii=False)
    row = spark.range(1).select(F.lit(stamp).alias("created_at"), F.lit(text).alias("record"))
    row.coalesce(1).write.mode("overwrite").parquet(f"{path}/run")


def reevaluate(splits: DataFrame, path: str, config: TrainConfig) -> DataFrame:
    """Score the current splits with a saved model and replace its results."""
    model = PipelineModel.load(f"{path}/model")
    samples = split_samples(splits, config)
    details = evaluation_details(samples, model, extra=("split",))
    details.write.mode("overwrite").parquet(f"{path}/details")
    saved = splits.sparkSession.read.parquet(f"{path}/details")
    evaluate(saved, by="split").coalesce(1).write.mode("overwrite").parquet(f"{path}/metrics")
    return splits.sparkSession.read.parquet(f"{path}/metrics")


def newest_runs(spark: SparkSession, root: str, limit: int = 20) -> DataFrame:
    """Saved training runs below ``root``, newest first."""
    runs = spark.read.schema("created_at string, record string").parquet(f"{root}/*/run")
    folder = F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)/run/[^/]+$", 1)
    return runs.select(folder.alias("run"), "created_at", "record").orderBy(F.desc("created_at"), "run").limit(limit)
