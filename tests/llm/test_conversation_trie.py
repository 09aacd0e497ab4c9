"""The trie of rebuilt conversations against a restatement with plain prefixes."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelflow.llm import conversation_trie as ct
from labelflow.llm import count_min
from labelflow.llm.queries import op11_conversation_trie

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rebuilt(rows, spliced=True):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append((turn is not None, turn or 0, role, hashlib.sha256(text.encode()).hexdigest(), text))
    own = {c: [(t[2], t[4]) for t in sorted(turns)] for c, turns in own.items()}
    if not spliced:
        return own
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def brute(convs):
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in sorted(convs.items()):
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children = defaultdict(list)
    for prefix in members:
        if prefix:
            children[prefix[:-1]].append(prefix)
    leaves, saved = {}, {}
    for prefix in sorted(members, key=len, reverse=True):
        below = children[prefix]
        leaves[prefix] = sum(leaves[b] for b in below) if below else 1
        size = len(prefix[-1][1].encode()) if prefix else 0
        saved[prefix] = (len(members[prefix]) - 1) * size + sum(saved[b] for b in below)
    out = []
    for prefix, who in members.items():
        parent = members[prefix[:-1]][0] if prefix else None
        joined = hashlib.sha256(",".join(map(str, ends.get(prefix, []))).encode()).hexdigest()
        out.append((who[0], len(prefix), parent, len(who), len(children[prefix]), leaves[prefix], saved[prefix], joined))
    return sorted(out, key=repr)


def result(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def spliced(spark, rows):
    conv = F.col("conv_id")
    return result(ct.trie(spark.createDataFrame(rows, SCHEMA), conv - conv % 5, F.crc32(conv.cast("string").cast("binary")) % 9))


def test_given_conversations(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").collect()]
    wanted = brute(rebuilt(rows))
    assert result(op11_conversation_trie(spark, "/root/testdata/sf0.001")) == wanted
    assert any(n[3] > 1 and n[1] > 0 for n in wanted)


def test_random_conversations(spark):
    random = np.random.default_rng(3)
    rows = []
    for conv in random.permutation(400):
        for turn in range(int(random.integers(1, 14))):
            # Few texts, so that prefixes meet, end inside each other, and repeat.
            text = "né" * int(random.integers(1, 3)) if random.random() < 0.9 else None
            rows.append((int(conv) - 20, turn, "user" if turn % 2 else None, text))
    assert spliced(spark, rows) == brute(rebuilt(rows))
    assert result(ct.trie(spark.createDataFrame(rows, SCHEMA))) == brute(rebuilt(rows, False))


def test_odd_rows(spark):
    rows = [
        (None, 0, "user", "no conversation"),
        (5, None, None, None),
        (5, None, "", "x"),
        (5, 1, "user", "b"),
        (5, 1, "user", "a"),
        (5, 1, "user", "a"),
        (6, 0, "user", "only"),
        (7, 3, "a", "1:b"),
        (8, 3, "a1:", "b"),
        (12, 0, "user", "base is absent"),
        (-3, 0, "user", "below zero"),
        (-5, 0, "user", "long " * 50_000),
        (-7, 1, "user", "long " * 50_000),
    ]
    assert spliced(spark, rows) == brute(rebuilt(rows))
    assert result(ct.trie(spark.createDataFrame(rows, SCHEMA))) == brute(rebuilt(rows, False))


def test_empty_and_extra_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert ct.trie(empty).collect() == []
    rows = [(1, 0, "u", "a"), (2, 0, "u", "a"), (2, 1, "v", "b")]
    more = spark.createDataFrame(rows, SCHEMA).withColumns({"depth": F.lit("x"), "d1": F.lit(1), "a.b": F.lit(2)})
    assert result(ct.trie(more)) == brute(rebuilt(rows, False))


def test_groups_of_copies_and_a_common_opening(spark):
    rows = [(c, t, "user", "same" if t == 0 else f"{t}" if c < 900 else f"{c}/{t}") for c in range(1500) for t in range(3)]
    assert result(ct.trie(spark.createDataFrame(rows, SCHEMA))) == brute(rebuilt(rows, False))


def test_a_sketch_that_proves_nothing_changes_nothing(spark, monkeypatch):
    rows = [(c, t, "user", f"{c % 7}/{t}" if t < 2 else f"{c}/{t}") for c in range(60) for t in range(5)]
    wanted, build = brute(rebuilt(rows, False)), count_min.build

    def nothing(digests, count):
        return np.full_like(build(digests, count), 2)

    def every_other_cell(digests, count):
        true = build(digests, count)
        return np.where(np.arange(len(true)) % 2, 2, true).astype(np.uint8)

    for blunt in (nothing, every_other_cell):
        monkeypatch.setattr(count_min, "build", blunt)
        assert result(ct.trie(spark.createDataFrame(rows, SCHEMA))) == wanted


@pytest.mark.parametrize("count", [10, 5000])
def test_estimates_are_never_too_low(spark, count):
    random = np.random.default_rng(1)
    some = random.integers(-(1 << 63), 1 << 62, (count, 2))
    rows = [tuple(map(int, r)) for r in np.concatenate([some, some[::3]])]
    table = count_min.build(spark.createDataFrame(rows, "a long, b long"), len(rows))
    seen = count_min.estimate(table, np.array([r[0] for r in rows]), np.array([r[1] for r in rows]))
    twice = set(map(tuple, some[::3].tolist()))
    assert all(e == 2 for r, e in zip(rows, seen) if r in twice)
    assert np.mean([e == 1 for r, e in zip(rows, seen) if r not in twice]) > 0.9
