"""The pipeline's stages one by one, each against a restatement on its own input."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
import corpus_pipeline as p
from labelflow import session
from labelflow.llm import secret_scan
from tests.llm.test_ngram_join import brute

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    """Input of each stage and output of the last."""
    docs = [spark.read.parquet(f"{SF_DIR}/documents.parquet")]
    for name, stage in p.STAGES:
        docs.append(session.materialize(stage(spark, docs[-1], SF_DIR), name))
    return docs


def test_stages_and_columns(steps):
    assert [name for name, _ in p.STAGES] == ["toxicity", "ngram_join", "secret_scan", "mixing", "packing"]
    for docs in steps[1:-1]:
        assert docs.dtypes == steps[0].dtypes


def test_toxic_documents_go(spark, steps):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in steps[1].collect()}
    assert sum(t and i in kept for i, t in labels.items()) <= 0.1 * sum(labels.values())
    assert sum(not t and i not in kept for i, t in labels.items()) <= 0.05 * len(labels)


def test_one_document_of_each_group_stays(steps):
    groups = brute([(r["doc_id"], r["text"]) for r in steps[1].collect()])
    assert sorted(r["doc_id"] for r in steps[2].collect()) == sorted(set(groups.values()))


def test_secrets_are_masked_and_nothing_else_changes(steps):
    before = {r["doc_id"]: r for r in steps[2].collect()}
    after = {r["doc_id"]: r for r in steps[3].collect()}
    assert set(before) == set(after)
    changed = [i for i in before if before[i]["text"] != after[i]["text"]]
    assert changed and all("[SECRET]" in after[i]["text"] for i in changed)
    assert all(after[i]["n_chars"] == len(after[i]["text"]) for i in after)
    assert steps[3].where(F.col("text").rlike(secret_scan.BASE[2].pattern)).count() == 0


def test_mix_is_of_whole_documents(steps):
    before = {tuple(r) for r in steps[3].collect()}
    after = Counter(tuple(r) for r in steps[4].collect())
    assert set(after) <= before and max(after.values()) <= 5


def test_every_word_is_packed(steps):
    words = sum(len((r["text"] or "").translate({0xA0: "x"}).split()) for r in steps[4].collect())
    assert steps[5].agg(F.sum("n_tokens")).first()[0] == words


def test_run_gives_the_last_stage(spark, steps):
    assert contract.queries()["pipeline"](spark, SF_DIR).count() == steps[5].count()


def test_odd_rows_pass_through(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").withColumn("a.b", F.lit(1)).withColumn("blob", F.lit("x"))
    odd = spark.createDataFrame([(None, None, None, None, None, 1, "y"), (5001, "", "en", "s", 0, 1, "y"), (5002, None, None, None, 3, 1, "y"), (5003, "w " * 30_000, "en", "s", 60_000, 1, "y"), (5003, "w " * 30_000, "en", "s", 60_000, 1, "y")], docs.schema)
    for rows in (docs.union(odd), odd, docs.limit(0)):
        for name, stage in p.STAGES:
            rows = session.materialize(stage(spark, rows, SF_DIR), name)
        rows.collect()
