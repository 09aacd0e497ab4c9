"""Vector links against all pairs."""

import math

import numpy as np
import pytest

from labelflow.llm import embedding_dedup as ed


def brute(rows, threshold=0.98):
    def usable(v, label):
        return label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    good = [(i, np.array(v, float), label) for i, v, label in rows if usable(v, label)]
    links = {i: 0 for i, _, _ in rows}
    parent = {i: i for i, _, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a, la) in enumerate(good):
        for j, b, lb in good[:k]:
            if la == lb and len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= threshold:
                links[i] += 1
                links[j] += 1
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {i: (links[i], root(i), root(i) == i) for i in parent}


def found(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    return {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in ed.dedup(df).collect()}


def test_planted_links(spark):
    random = np.random.default_rng(1)
    rows = []
    for group in range(40):
        centre = random.standard_normal(64)
        for _ in range(6):
            noise = random.standard_normal(64)
            noise *= np.linalg.norm(centre) / np.linalg.norm(noise)
            rows.append((len(rows), [float(np.float32(x)) for x in centre + random.uniform(0, 0.22) * noise], int(group % 3)))
    rows += [(1000 + k, [float(np.float32(x)) for x in random.standard_normal(64)], 0) for k in range(200)]
    rows += [(2000 + k, rows[0][1], rows[0][2]) for k in range(5)]
    wanted, got = brute(rows), found(spark, rows)
    total, reached = sum(v[0] for v in wanted.values()), sum(v[0] for v in got.values())
    assert all(got[k][0] <= wanted[k][0] for k in wanted)
    assert reached >= 0.97 * total > 0


def test_given_vectors(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert found(spark, rows) == brute(rows)


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 0), (2, [], 0), (3, [0.0, 0.0], 0), (4, [1.0, None], 0), (5, [1.0, nan], 0), (6, [inf, 1.0], 0), (7, [1.0, 2.0], None), (8, [1.0, 2.0], 0), (9, [2.0, 4.0], 0), (10, [1.0, 2.0], 0), (11, [1.0, 2.0], 1), (12, [1.0, 2.0, 3.0], 0), (13, [-1.0, -2.0], 0), (14, [1e-30, 2e-30], 0)]
    wanted = brute(rows)
    assert found(spark, rows) == wanted
    assert wanted[8] == (3, 8, True) and wanted[14][1] == 8
    assert found(spark, []) == {}
    df = spark.createDataFrame([(None, [1.0, 2.0], 0), (1, [1.0, 2.0], 0)], "vec_id long, embedding array<float>, label int")
    assert sorted(map(tuple, ed.dedup(df).collect()), key=str) == [(1, 0, 1, True), (None, 0, None, False)]


def test_rotation_is_orthogonal_and_balances_codes():
    random = np.random.default_rng(3)
    x = random.standard_normal((500, 16)) @ random.standard_normal((16, 16))
    x -= x.mean(axis=0)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    r = ed.fit_rotation(x)
    assert np.allclose(r @ r.T, np.eye(16))

    def loss(rotation):
        y = x @ rotation
        return np.abs(y - np.where(y >= 0, 1, -1)).sum()

    assert loss(r) < loss(ed._orthogonal(16, 0))


def spread(random, count, mean, pairs, size=64):
    """Unit vectors with a mean cosine, and partners at a cosine of 0.981 for some of them."""
    direction = np.zeros(size)
    direction[0] = 1
    x = random.standard_normal((count, size))
    x[:, 0] = 0
    x = math.sqrt(mean) * direction + math.sqrt(1 - mean) * x / np.linalg.norm(x, axis=1, keepdims=True)
    aside = random.standard_normal((pairs, size))
    aside -= (aside * x[:pairs]).sum(axis=1, keepdims=True) * x[:pairs]
    partner = 0.981 * x[:pairs] + math.sqrt(1 - 0.981**2) * aside / np.linalg.norm(aside, axis=1, keepdims=True)
    return x, partner


@pytest.mark.parametrize("mean", [0.0, 0.5, 0.8, 0.9])
@pytest.mark.parametrize("members", [3_000, 10**6, 10**7])
def test_tables_reach_the_recall_at_any_size(mean, members):
    random = np.random.default_rng(7)
    x, partner = spread(random, 20_000, mean, 4000)
    model = ed.fit(x)
    needed = ed.tables_needed(x, model, 0.98)
    width = ed.substring(members, needed)
    differ = ed.code_bits(x[:4000], model) ^ ed.code_bits(partner, model)
    met = (~differ[:, ed.positions()[: needed[width], :width]].any(axis=2)).any(axis=1)
    assert met.mean() >= 0.97
    assert needed[width] <= 100


@pytest.mark.parametrize("mean", [0.0, 0.9])
def test_links_of_vectors_with_a_common_direction(spark, mean):
    x, partner = spread(np.random.default_rng(8), 3000, mean, 1500)
    rows = [(k, [float(np.float32(c)) for c in v], 0) for k, v in enumerate(np.concatenate([x, partner]))]
    got = found(spark, rows)
    unit = np.array([v for _, v, _ in rows])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    wanted = (unit @ unit.T >= 0.98).sum(axis=1) - 1
    assert all(got[k][0] <= wanted[k] for k in got)
    assert sum(v[0] for v in got.values()) >= 0.97 * wanted.sum()


def test_ids_with_several_vectors(spark):
    random = np.random.default_rng(9)
    centre = random.standard_normal(64)
    near = lambda: [float(np.float32(c)) for c in centre + 0.02 * random.standard_normal(64)]
    other = [float(np.float32(c)) for c in random.standard_normal(64)]
    rows = [(5, near(), 0), (6, near(), 0), (7, near(), 0), (5, near(), 1), (8, near(), 1), (9, other, 0), (9, other, 1), (10, other, 1), (6, near(), 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in ed.dedup(df).collect())
    assert got == [(5, 1, 5), (5, 3, 5), (6, 3, 5), (6, 3, 5), (7, 3, 5), (8, 1, 5), (9, 0, 9), (9, 1, 9), (10, 1, 9)]


@pytest.mark.parametrize("block", [7, 64])
def test_buckets_beyond_a_block(spark, monkeypatch, block):
    monkeypatch.setattr(ed, "BLOCK", block)
    random = np.random.default_rng(10)
    centres = random.standard_normal((3, 64))
    rows = [(k, [float(np.float32(c)) for c in centres[k % 3] + 0.1 * random.standard_normal(64)], k % 2) for k in range(300)]
    got, wanted = found(spark, rows), brute(rows)
    assert sum(v[0] for v in got.values()) >= 0.97 * sum(v[0] for v in wanted.values())
    assert all(got[k][0] <= wanted[k][0] for k in wanted)
    assert [got[k][1:] for k in sorted(got)] == [wanted[k][1:] for k in sorted(wanted)]
