"""Budgets, permutations and bins against plain restatements."""

import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from labelflow.llm import mixing, packing

SF_DIR = "/root/testdata/sf0.001"


def documents(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


def skewed(spark, rows=3000):
    source = F.when(F.col("id") % 3 == 0, "big").otherwise(F.concat(F.lit("s"), (F.col("id") % 7).cast("string")))
    return spark.range(rows).select(F.col("id").alias("doc_id"), source.alias("source"), (F.col("id") % 50 + 1).alias("n_tokens"))


def weights_by_search(tokens, target):
    """Bisect the exponent in plain floats."""
    total = sum(tokens.values())
    p = {s: t / total for s, t in tokens.items()}

    def at(a):
        z = sum(v**a for v in p.values())
        return {s: v**a / z for s, v in p.items()}

    def meets(a):
        w = at(a)
        entropy = -sum(v * math.log(v) for v in w.values())
        return entropy <= target.entropy * math.log(len(w)) + 1e-12 and max(w[s] * target.budget / p[s] for s in p) <= target.repeats + 1e-12

    low, high = 0.0, 1.0
    if meets(0.0):
        return at(0.0)
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (low, middle) if meets(middle) else (middle, high)
    return at(high)


@pytest.mark.parametrize("target", [mixing.Target(entropy=0.95, repeats=4.0), mixing.Target(entropy=1.0, repeats=1.3, budget=0.7), mixing.Target(entropy=1.0, repeats=9.0, budget=2.5, block_docs=10)])
def test_weights_and_budgets(spark, target):
    docs = skewed(spark)
    rows = docs.collect()
    tokens = Counter()
    for r in rows:
        tokens[r["source"]] += r["n_tokens"]
    wanted = weights_by_search(tokens, target)
    plan = {r["source"]: r for r in mixing.plan(docs, target).collect()}
    assert set(plan) == set(wanted)
    total = sum(tokens.values())
    mixed = mixing.realise(docs, spark.createDataFrame(list(plan.values()), mixing.plan(docs, target).schema), target).collect()
    seen, copies = Counter(), Counter()
    for r in mixed:
        seen[r["source"]] += r["n_tokens"]
        copies[r["doc_id"]] += 1
    for s, w in wanted.items():
        assert plan[s]["weight"] == pytest.approx(w, abs=1e-5)
        assert plan[s]["budget"] - 50 < seen[s] <= plan[s]["budget"] <= w * target.budget * total + 1
    # Passes differ by one at most within a source.
    by_source = defaultdict(set)
    for r in rows:
        by_source[r["source"]].add(copies[r["doc_id"]])
    assert all(max(c) - min(c) <= 1 for c in by_source.values())
    again = mixing.realise(docs.repartition(5), mixing.plan(docs.repartition(3), target), target).collect()
    assert Counter(map(str, again)) == Counter(map(str, mixed))


def test_last_pass_is_a_prefix_of_the_permutation(spark):
    target = mixing.Target(entropy=1.0, repeats=9.0, budget=0.4, block_docs=20)
    docs = skewed(spark, 600)
    plan = mixing.plan(docs, target)
    mixed = {r["doc_id"] for r in mixing.realise(docs, plan, target).collect()}
    w = plan.alias("w")
    block = mixing._block(F.col("doc_id"), F.col("blocks"), target.seed)
    order = docs.join(w, "source").select("source", "doc_id", "n_tokens", "budget", mixing._turn(F.col("source"), F.col("passes"), block, target.seed).alias("turn"), mixing._place(F.col("doc_id"), target.seed).alias("place")).collect()
    by_source = defaultdict(list)
    for r in order:
        by_source[r["source"]].append(r)
    for rows in by_source.values():
        rows.sort(key=lambda r: (r["turn"], r["place"]))
        inside = [r["doc_id"] in mixed for r in rows]
        count = sum(inside)
        assert inside == [True] * count + [False] * (len(rows) - count)
        used = sum(r["n_tokens"] for r in rows[:count])
        assert used <= rows[0]["budget"] and (count == len(rows) or used + rows[count]["n_tokens"] > rows[0]["budget"])


def test_a_flat_corpus_comes_out_whole(spark):
    docs = documents(spark).select("doc_id", "source", mixing.tokens(F.col("text")).alias("n_tokens"))
    # Sources of one document, none of them of the same size.
    single = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id").cast("string")).alias("source"), (F.col("id") * 7 % 300 + 900).alias("n_tokens"))
    for rows in (docs, single):
        plan = mixing.plan(rows, mixing.Target())
        assert plan.where("budget != tokens").count() == 0 and plan.first()["exponent"] == 1.0
        mixed = Counter(r["doc_id"] for r in mixing.realise(rows, plan, mixing.Target()).collect())
        assert mixed == Counter(r["doc_id"] for r in rows.collect())


def test_budgets_round_down_but_for_the_error_of_doubles(spark):
    cases = [(99.99999999999, 100, 100), (200.00000000001, 100, 200), (199.4, 100, 199), (99.9, 100, 99), (39.99999999999, 100, 40), (0.0, 0, 0), (3e12 - 0.01, 10**12, 3 * 10**12)]
    df = spark.createDataFrame(cases, "wanted double, tokens long, budget long")
    assert [r["b"] for r in df.select(mixing._budget(F.col("wanted"), F.col("tokens")).alias("b")).collect()] == [c[2] for c in cases]


def test_mixing_edge_cases(spark):
    schema = "doc_id long, text string, source string, turn int"
    rows = [(1, "a b", None, 0), (2, None, "empty", 0), (3, "", "empty", 0), (None, "c d", "x", 0), (4, "e f g", "x", 0), (4, "e f g", "x", 0), (5, " ".join("w" * 1 for _ in range(1)), "y", 0)]
    got = mixing.mix(spark.createDataFrame(rows, schema), mixing.Target(entropy=None, repeats=None, budget=3.0)).collect()
    assert got[0].__fields__ == ["doc_id", "text", "source", "turn"]
    assert Counter(r["source"] for r in got)["empty"] == 2
    assert {r["source"] for r in got} == {None, "empty", "x", "y"}
    assert mixing.mix(spark.createDataFrame([], schema)).collect() == []
    only = spark.createDataFrame([(1, None, "a", 0), (2, "", None, 0)], schema)
    assert mixing.mix(only).count() == 2


def check_bins(pieces, layout):
    bins = defaultdict(list)
    for p in pieces:
        bins[p["bin_id"]].append(p)
    for rows in bins.values():
        rows.sort(key=lambda p: p["bin_offset"])
        end = 0
        for p in rows:
            assert p["bin_offset"] == end
            end += p["n_tokens"] + 1
        assert end <= layout.capacity
        assert max(Counter(p["cluster"] for p in rows).values()) == 1
        assert max(Counter(p["source"] for p in rows).values()) <= layout.source_limit
    return bins


def test_packing_keeps_every_word_and_every_limit(spark):
    layout = packing.Layout(capacity=512, shard_pieces=100)
    docs = documents(spark)
    pieces = packing.pack(docs, layout).collect()
    bins = check_bins(pieces, layout)
    words = {r["doc_id"]: len((r["text"] or "").split()) for r in docs.select("doc_id", F.translate("text", "  ", "xx").alias("text")).collect()}
    spans = defaultdict(list)
    for p in pieces:
        spans[p["doc_id"]].append((p["start"], p["n_tokens"]))
    for doc, parts in spans.items():
        parts.sort()
        assert [s for s, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))]
    assert {k: sum(n for _, n in v) for k, v in spans.items()} == {k: n for k, n in words.items() if n}
    assert sum(p["n_tokens"] + 1 for p in pieces) > 0.9 * 512 * len(bins)


class Plain:
    """Best fit by looking at every open bin."""

    def __init__(self, layout):
        self.layout, self.bins = layout, []

    def residual(self, size, source, cluster):
        fits = [b["left"] for b in self.bins if b["left"] >= size and not b["clusters"] & cluster and b["sources"][source] < self.layout.source_limit]
        return min(fits) if fits else None


@pytest.mark.parametrize("seed", range(4))
def test_each_piece_goes_to_the_tightest_compatible_bin(seed):
    import random

    rng = random.Random(seed)
    layout = packing.Layout(capacity=60, source_limit=2)
    bins, plain = packing.Bins(layout), Plain(layout)
    pieces = sorted(((rng.randint(3, 60), rng.choice([0, 0, 0, 1, 2, 3]), 1 << rng.randint(0, 5) if rng.random() < 0.6 else 0) for _ in range(600)), reverse=True)
    for size, source, cluster in pieces:
        wanted = plain.residual(size, source, cluster)
        b, offset = bins.add(size, source, cluster)
        if wanted is None:
            assert b == len(plain.bins) and offset == 0
            plain.bins.append({"left": layout.capacity, "clusters": 0, "sources": Counter()})
        else:
            assert plain.bins[b]["left"] == wanted and offset == layout.capacity - wanted
        own = plain.bins[b]
        assert not own["clusters"] & cluster and own["sources"][source] < layout.source_limit
        own["left"] -= size
        own["clusters"] |= cluster
        own["sources"][source] += 1


def test_packing_edge_cases(spark):
    schema = "doc_id long, text string, source string, bin_id int"
    layout = packing.Layout(capacity=10)
    rows = [(1, None, "a", 0), (2, " \n", "a", 0), (None, "x y", None, 0), (None, "x y", None, 0), (3, "X  y", "b", 0), (4, "w " * 25, "a", 0), (5, "one", "a", 0), (9007199254740993, "two", "a", 0)]
    pieces = packing.pack(spark.createDataFrame(rows, schema), layout).collect()
    check_bins(pieces, layout)
    assert sorted((p["doc_id"] or 0, p["piece"], p["n_tokens"]) for p in pieces) == [(0, 0, 2), (0, 0, 2), (3, 0, 2), (4, 0, 9), (4, 1, 9), (4, 2, 7), (5, 0, 1), (9007199254740993, 0, 1)]
    copies = {p["bin_id"] for p in pieces if p["n_tokens"] == 2}
    assert len(copies) == 3
    assert packing.pack(spark.createDataFrame([], schema)).collect() == []
