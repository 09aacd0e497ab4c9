"""One query per operator, each over its whole table, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelflow import session
from labelflow.llm import conversation_trie, embedding_dedup, importance, language_id, mixing, ngram_join, packing, quality_rules, secret_scan, top_k, toxicity, url_filters, warc

SITE_RULES = [
    url_filters.Rule("net/", "site", "block"),
    url_filters.Rule("example.net/en/", "site", "allow"),
    url_filters.Rule("example.com/de/", "site", "block"),
    url_filters.Rule("org/fr/", "site", "allow"),
]
PATTERN_RULES = [
    url_filters.Rule("-pills.", "pattern", "block"),
    url_filters.Rule(".casino.", "pattern", "block"),
    url_filters.Rule("/casino/", "pattern", "block"),
    url_filters.Rule("/poker/", "pattern", "block"),
    url_filters.Rule("/ads/*.html", "pattern", "block"),
    url_filters.Rule(".adult.", "pattern", "block"),
    url_filters.Rule("/adult/", "pattern", "block"),
    url_filters.Rule("/wp-login.php", "pattern", "block"),
    url_filters.Rule("/cart/checkout/", "pattern", "block"),
    url_filters.Rule("?sessionid=", "pattern", "block"),
    url_filters.Rule("/health/adult/", "pattern", "allow"),
]

MIX = mixing.Target(entropy=0.9, sharpen=True)

TOXICITY = [
    toxicity.Category("low_quality", "quality = 0"),
    toxicity.Category("toxic", "toxic = 1"),
    toxicity.Category("toxic_low_quality", "toxic = 1 and quality = 0"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.measure(table(spark, sf_dir, "documents"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.dedup(table(spark, sf_dir, "embeddings"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = session.scratch_path(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), archives)
    index = warc.build_index(spark, archives, session.scratch_path(spark, "warc-index"))
    return warc.read(index, payloads=False).drop("payload", "url")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    chain = toxicity.train(docs, table(spark, sf_dir, "labels"), TOXICITY, "toxic")
    scored = toxicity.score(docs.select("doc_id", "text"), chain).drop("text")
    return scored.withColumnRenamed("rejected", "toxic").withColumn("kept", ~F.col("toxic"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "pages"), language_id.train(table(spark, sf_dir, "documents")))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.tokens(F.col("text")).alias("n_tokens"))
    counted = session.materialize(docs, "counted")
    target = MIX
    mixed = mixing.realise(counted, mixing.plan(counted, target), target)
    return mixed.select("doc_id", "source", "n_tokens", F.col("__mix.__copy").alias("copy"), F.col("__mix.turn").alias("turn"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = url_filters.rules_table(spark, SITE_RULES + PATTERN_RULES)
    return url_filters.judge(table(spark, sf_dir, "pages"), rules)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = table(spark, sf_dir, "documents").selectExpr("doc_id as path", "text")
    return secret_scan.digest(secret_scan.scan(versions, session.scratch_path(spark, "ledger")))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.cluster(table(spark, sf_dir, "documents"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv_id = F.col("conv_id")
    head = F.crc32(conv_id.cast("string").cast("binary")) % 9
    return conversation_trie.trie(table(spark, sf_dir, "conversations"), conv_id - conv_id % 5, head)


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    functions = [
        op1_quality_rules,
        op2_embedding_dedup,
        op3_warc,
        op4_toxicity,
        op5_language_id,
        op6_mixing,
        op7_url_filters,
        op8_secret_scan,
        op9_packing,
        op10_ngram_join,
        op11_conversation_trie,
        op12_importance_resampling,
        op13_exact_top_k,
    ]
    return {f.__name__: f for f in functions}
