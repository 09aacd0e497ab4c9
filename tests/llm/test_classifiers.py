"""Toxicity chain and language identification: held-out accuracy and edge cases."""

import random

import numpy as np
import pytest

from labelflow.llm import language_id, queries, toxicity

SF_DIR = "/root/testdata/sf0.01"


def corpus(spark, rows=900):
    """Short texts; half of the toxic ones have known words, the others a known word beginning."""
    rng = random.Random(2)
    docs, labels = [], []
    for k in range(rows):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(20, 200))]
        toxic = k % 5 == 0
        for _ in range(4 if toxic else 0):
            words[rng.randrange(len(words))] = rng.choice(["Zidiot,", "zscum"]) if k % 2 else "zvile" + rng.choice("abcdefgh") + rng.choice("abcdefgh")
        docs.append((k, " ".join(words)))
        labels.append((k, int(k % 3 > 0), int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_chain_on_held_out_rows(spark):
    docs, labels = corpus(spark)
    chain = toxicity.train(docs, labels.where("doc_id < 600"), queries.TOXICITY, "toxic")
    assert chain.names == ["low_quality", "toxic", "toxic_low_quality"]
    assert [len(v) for v in chain.dense] == [1, 2, 3] and chain.dense[2][1:].all()
    scored = toxicity.score(docs, chain).join(labels, "doc_id").where("doc_id >= 600").collect()
    assert np.mean([r["rejected"] == (r["toxic"] == 1) for r in scored]) > 0.98


def test_given_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    chain = toxicity.train(docs, labels.where("doc_id % 4 != 0"), queries.TOXICITY, "toxic")
    held = toxicity.score(docs.join(labels.where("doc_id % 4 = 0"), "doc_id"), chain).select("toxic", "rejected").collect()
    hits = sum(r["rejected"] for r in held if r["toxic"] == 1)
    # About one toxic text in twenty of this table is junk that holds no toxic word.
    assert hits >= 0.88 * sum(r["toxic"] for r in held)
    assert sum(r["rejected"] for r in held if r["toxic"] == 0) <= 0.005 * len(held)


def test_score_keeps_rows_and_columns(spark):
    docs, labels = corpus(spark, 200)
    chain = toxicity.train(docs, labels, queries.TOXICITY, "toxic")
    odd = spark.createDataFrame([(1, "zscum zscum zvileab", "x", 9), (None, None, None, 9), (1, "", "y", 9), (1, "abc " * 200_000, "y", 9)], "`a.b` long, text string, c string, rejected int")
    scored = toxicity.score(odd, chain)
    assert scored.columns == ["a.b", "text", "c", "p_low_quality", "p_toxic", "p_toxic_low_quality", "rejected"]
    assert scored.count() == 4
    kept = toxicity.keep(odd, chain)
    assert kept.columns == odd.columns
    assert sorted(len(r["text"] or "") for r in kept.collect()) == sorted(len(r["text"] or "") for r in scored.where("not rejected").collect())
    assert scored.where("text like 'zscum%' and rejected").count() == 1
    assert toxicity.score(docs.limit(0), chain).collect() == []


@pytest.mark.parametrize("rows", [[], [(1, None, None)], [(1, 1, 0), (2, 0, 0), (99, 1, 1)], [(1, 1, 1)]])
def test_few_or_one_sided_labels(spark, rows):
    docs, _ = corpus(spark, 20)
    chain = toxicity.train(docs, spark.createDataFrame(rows, "doc_id long, quality int, toxic int"), queries.TOXICITY, "toxic")
    assert toxicity.score(docs, chain).count() == 20


def test_threshold_lies_between_the_classes():
    assert toxicity.best_threshold(np.array([0.9, 0.8, 0.2, 0.1]), np.array([1.0, 1, 0, 0])) == pytest.approx(0.5)
    assert toxicity.best_threshold(np.array([0.3, 0.3, 0.1]), np.array([1.0, 1, 0])) == pytest.approx(0.2)
    assert toxicity.best_threshold(np.array([0.3, 0.3]), np.array([1.0, 0])) == 0.5


def test_languages_of_given_pages(spark):
    model = language_id.train(spark.read.parquet(f"{SF_DIR}/documents.parquet"))
    pages = spark.read.parquet(f"{SF_DIR}/pages.parquet")
    rows = language_id.identify(pages, model).join(pages, "page_id").selectExpr("lang", "text_lang", "regexp_extract(url, '/(en|de|fr|es)/', 1) as truth").collect()
    assert np.mean([r["lang"] == r["truth"] for r in rows]) > 0.98
    assert np.mean([r["text_lang"] == r["truth"] for r in rows]) > 0.9


def test_markup_and_host_decide_without_text(spark):
    docs = spark.createDataFrame([("alpha beta gamma delta " * 20, "aa"), ("omega sigma kappa zeta " * 20, "bb"), ("x", None), (None, "aa")], "text string, lang string")
    model = language_id.train(docs)
    page = lambda lang, text: f'<html lang="{lang}"><body><p>{text}</p></body></html>'
    rows = [(k, f"http://h{k % 2}.example.org/", page("aa" if k % 2 else "BB-x", "alpha beta gamma " * 5 if k % 2 else "omega sigma kappa " * 5)) for k in range(40)]
    rows += [(100, "http://h1.example.org/z", None), (101, "http://h0.example.org/z", ""), (102, None, page("aa", "")), (103, "http://new.example.com/", page("bb", "")), (None, None, None), (104, "http://h1.example.org/", page("bb", "alpha beta gamma " * 9)), (105, "x", "<script>omega omega</script>alpha beta gamma delta")]
    got = {r["page_id"]: r for r in language_id.identify(spark.createDataFrame(rows, "page_id long, url string, html string"), model).collect()}
    assert len(got) == len(rows)
    assert [got[k]["lang"] for k in (0, 1, 100, 101, 102, 103, 104, 105)] == ["bb", "aa", "aa", "bb", "aa", "bb", "aa", "aa"]
    assert got[0]["declared"] == "bb" and got[100]["declared"] is None
    assert all(0.5 <= r["probability"] <= 1 for k, r in got.items() if k is not None)


def test_no_languages_and_no_pages(spark):
    none = language_id.train(spark.createDataFrame([("x", None)], "text string, lang string"))
    pages = spark.createDataFrame([(1, "http://a/", "<p>x</p>")], "page_id long, url string, html string")
    assert [r["lang"] for r in language_id.identify(pages, none).collect()] == [None]
    model = language_id.train(spark.createDataFrame([("abc", "aa")], "text string, lang string"))
    assert [r["lang"] for r in language_id.identify(pages, model).collect()] == ["aa"]
    assert language_id.identify(pages.limit(0), model).collect() == []


def test_rows_without_words_are_kept_whatever_their_score(spark):
    always = toxicity.Chain(["toxic"], np.zeros((1, 1 << toxicity.BITS)), np.zeros(1), [np.zeros(1)], 0, 0.0)
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "some words"), (5, "!"), (None, None), (6, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] or 0 for r in toxicity.keep(docs, always).collect()) == [0, 1, 2, 3]
