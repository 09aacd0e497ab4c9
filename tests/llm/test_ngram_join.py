"""The set similarity join against all pairs, on the given documents and on edge cases."""

import re

from labelflow.llm import ngram_join
from labelflow.llm.components import components

SF_DIR = "/root/testdata/sf0.001"


def shingles(text, n=5):
    folded = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x20\x09-\x0D]+", folded)
    if not words:
        return set()
    return {tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))}


def brute(rows):
    """Component per id by comparing all pairs."""
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {i: root(i) for i in parent}


def found(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return ngram_join.cluster(df).collect()


def test_agrees_with_all_pairs_on_documents(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    wanted = brute(rows)
    assert len(set(wanted.values())) < len(wanted)
    got = ngram_join.cluster(docs).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == wanted
    assert {r["doc_id"]: r["n_shingles"] for r in got} == {i: len(shingles(t)) for i, t in rows}


def test_many_near_copies_and_chains(spark):
    words = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(60):  # copies with one word replaced, at different places
        changed = list(words)
        changed[k * 2] = f"x{k}"
        rows.append((1000 + k, " ".join(changed)))
    for k in range(30):  # a chain: neighbours are similar, the ends are not
        rows.append((2000 + k, " ".join(f"c{j}" for j in range(k * 5, k * 5 + 120))))
    shared = " ".join(f"p{k}" for k in range(30))
    for k in range(40):  # one passage in otherwise different texts
        rows.append((3000 + k, shared + " " + " ".join(f"q{k}_{j}" for j in range(40))))
    got = {r["doc_id"]: r["component_id"] for r in found(spark, rows)}
    assert got == brute(rows)
    assert got[1059] == 1000 and got[2029] == 2000 and got[3005] == 3005


def test_edge_cases(spark):
    rows = [
        (1, None), (2, ""), (3, " \t\n"), (4, "a b c"), (5, "A  b\nC"), (6, "a b"), (7, "a b c d e"), (8, "a b c d e"), (9, "a b c d e f"),
        (10, " "), (11, "É b c d e"), (12, "é b c d e"), (None, "a b c d e"), (None, None), (20, "x " * 3000), (21, "x x x x x"),
        (30, "k l m n o"), (30, "p q r s t"), (31, "k l m n o"), (32, "p q r s t"), (33, "p q r s t"), (33, "p q r s t"),
    ]
    got = found(spark, rows)
    assert len(got) == len(rows)
    named = {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None}
    assert named == {1: 1, 2: 2, 3: 3, 4: 4, 5: 4, 6: 6, 7: 7, 8: 7, 9: 9, 10: 10, 11: 11, 12: 12, 20: 20, 21: 20, 30: 30, 31: 30, 32: 30, 33: 30}
    assert {r["component_id"] for r in got if r["doc_id"] is None} == {None}
    assert found(spark, []) == []


def test_every_text_of_a_repeated_id_is_compared(spark):
    rows = []
    for k in range(6):  # texts of one id and of equal size, each a near copy of another document
        words = [f"t{k}_{j}" for j in range(100)]
        rows += [(1, " ".join(words)), (10 + k, " ".join([*words[:-1], "other"]))]
    # Only texts of different documents remain to be compared after the first round.
    for k in range(6):
        words = [f"u{k}_{j}" for j in range(100)]
        rows += [(1000, " ".join(words)), *((500 + 10 * k + m, " ".join([*words[:m], "x", *words[m + 1 :]])) for m in (0, 30, 99))]
    got = found(spark, rows)
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(i, 1 if i < 100 else 500) for i, _ in rows}


def test_components_of_long_paths_and_stars(spark):
    edges = [(k, k + 1) for k in range(200)] + [(1000, k) for k in range(1001, 1400)] + [(5, 5), (3000, 2999)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{k: 0 for k in range(201)}, **{k: 1000 for k in range(1000, 1400)}, 2999: 2999, 3000: 2999}


def test_a_template_below_the_threshold_makes_no_pairs(spark, monkeypatch):
    """Texts of 170 common words and 30 of their own share every common n-gram, and none of them is met pair by pair."""
    met = []
    verify = ngram_join._Search.verify

    def counted(self, pairs):
        met.append(pairs.count())
        return verify(self, pairs)

    monkeypatch.setattr(ngram_join._Search, "verify", counted)
    common = [f"t{k}" for k in range(170)]
    for count in (100, 400):
        rows = [(d, " ".join(common + [f"own{d}x{k}" for k in range(30)])) for d in range(count)]
        rows += [(1000 + d, rows[d][1] + " one more") for d in range(10)]
        met.clear()
        got = {r["doc_id"]: r["component_id"] for r in found(spark, rows)}
        assert got == {d: d % 1000 for d, _ in rows}
        assert sum(met) <= 4 * count
