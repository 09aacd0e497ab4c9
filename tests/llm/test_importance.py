"""Importance weights and exact ranks against a plain restatement."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from labelflow.llm import importance as im
from labelflow.llm import text_hash as th
from labelflow.llm.queries import op12_importance_resampling

SF_DIR = "/root/testdata/sf0.001"


def bag(text):
    folded = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)
    grams = [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
    return len(words), Counter(zlib.crc32(g.encode()) % 10000 for g in grams)


def brute(docs, target):
    bags = [bag(text) for _, text in docs]
    s, t = (sum((b for _, b in x), Counter()) for x in (bags, [bag(text) for text in target]))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log(((t[b] + 1) * (s_all + 10000)) / ((s[b] + 1) * (t_all + 10000)))) for b in s}
    rows = []
    for (i, _), (words, features) in zip(docs, bags):
        weight, score = sum(n * gain[b] for b, n in features.items()), None
        if i is not None:
            h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([i, sum(features.values()), weight, score, None, words >= 20 and i is not None])
    enough = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], r[0]))
    for k, row in enumerate(enough[: 5 * len(enough) // 100], start=1):
        row[4] = k
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def result(df):
    assert df.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    return sorted(map(tuple, df.collect()), key=repr)


def test_given_documents(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    assert result(op12_importance_resampling(spark, SF_DIR)) == brute(docs, target)


def test_features_of_odd_texts():
    source = random.Random(1)
    texts = [None, "", "...", "a", "A b", "a b c", " ".join(c * n for c, n in zip("xyzwv", (63, 64, 65, 500, 1))), "é" * 40 + " b"]
    texts += ["".join(source.choice("abzAZ09 é中  \n.,-[`{~\x7f\x00") for _ in range(source.randint(0, 200))) for _ in range(500)]
    for chunk in th.chunks(pa.array(texts)):
        buckets, rows, words = im.features(chunk)
        for k in range(chunk.rows):
            assert (words[k], Counter(buckets[rows == k].tolist())) == bag(texts[chunk.start + k])


def test_odd_rows(spark):
    common = "the cat sat on the mat and the dog lay under the old tree in the wide green park by the river"
    docs = [(k, f"{common} {k % 3}") for k in range(200)] + [(7, f"{common} other"), (7, f"{common} 1"), (None, common), (None, None)]
    docs += [(300, None), (301, ""), (302, "few words"), (303, "w" * 100_000), (304, f"{common} " * 5000)]
    target = ["the dog lay under the tree", None, ""]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"score": F.lit("x"), "rank": F.lit(0), "a.b": F.lit(1)})
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    assert result(im.resample(df, wanted)) == brute(docs, target)
    assert result(im.resample(df, wanted.limit(0))) == brute(docs, [])
    assert im.resample(df.limit(0), wanted).collect() == []


@pytest.mark.parametrize("rows, spread, segment", [(3000, 10_000, 100), (3000, 3, 50), (3000, 1, 1000), (7, 5, 2), (0, 1, 10)])
def test_ranks_of_ties_and_hot_scores(spark, monkeypatch, rows, spread, segment):
    monkeypatch.setattr(im, "SEGMENT_ROWS", segment)
    source = np.random.default_rng(rows + spread)
    data = [(int(source.integers(0, rows * 2)), int(source.integers(-spread, spread))) for _ in range(rows)]
    df = spark.createDataFrame(data, "doc_id long, score long").repartition(5)
    for wanted in (0, rows // 20, rows):
        got = im.ranked(df, wanted, rows).collect()
        order = sorted(data, key=lambda r: (-r[1], r[0]))[:wanted]
        assert sorted((r["doc_id"], r["score"]) for r in got) == sorted(data)
        assert [(r["doc_id"], r["score"]) for r in sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])] == order
        assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, wanted + 1))
