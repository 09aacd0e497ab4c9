"""A training-data pipeline over ``documents``, made of the corpus operators.

Every stage but the last returns the columns it was given.  Rows that a stage cannot
judge (null or word-free text, null id) stay.  Repeated rows stay together: they share an id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelflow import session
from labelflow.functions.columns import columns_except
from labelflow.llm import mixing, ngram_join, packing, secret_scan, toxicity
from labelflow.llm.queries import TOXICITY


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not reject."""
    chain = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), TOXICITY, "toxic")
    return toxicity.keep(docs, chain)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies."""
    groups = ngram_join.cluster(docs)
    extra, seen = session.measure(groups.where("doc_id != component_id").select("doc_id").distinct(), "extra")
    return docs.join(session.broadcast_if_small(extra, seen), "doc_id", "left_anti").select(*columns_except(docs))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with found secrets masked and lengths brought up to date."""
    ledger = session.scratch_path(spark, "ledger")
    secret_scan.update_ledger(docs.select(F.col("doc_id").alias("path"), "text"), ledger)
    clean = secret_scan.redact(docs, ledger)
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars")).select(*columns_except(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources reach their target weights."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their bins."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", one_of_each_group),
    ("secret_scan", mask_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]
# The classifier, the block permutations and the bins are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages in order, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = session.materialize(stage(spark, docs, sf_dir), name)
    return docs
