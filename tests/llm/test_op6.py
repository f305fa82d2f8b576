import numpy as np
import pytest
from pyspark.sql import Row

from folioflow.llm import op6_hnsw as op


def brute(rows):
    n, ok = len(rows), []
    for _, e, label in rows:
        ok.append(label is not None and e is not None and len(e) > 0 and all(x is not None and np.isfinite(x) for x in e) and any(e))
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [0] * n
    for i in range(n):
        for j in range(n):
            if i != j and ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
                if a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= 0.93:
                    links[i] += 1
                    root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i in range(n):
        least[find(i)] = min(least.get(find(i), rows[i][0]), rows[i][0])
    return sorted((rows[i][0], links[i], least[find(i)], rows[i][0] == least[find(i)]) for i in range(n))


def made(n, seed, dims=16):
    rng = np.random.default_rng(seed)
    rows = []
    while len(rows) < n:
        v = rng.normal(size=dims)
        for _ in range(rng.integers(1, 6)):
            w = v + rng.choice([0.0, 0.05, 0.1]) * rng.normal(size=dims)
            rows.append((int(len(rows) * 7 % 1009), [float(np.float32(x)) for x in w * rng.choice([1.0, 3.0])], int(len(rows) % 3 == 0) if rng.random() < 0.95 else None))
    return rows[:n]


def run(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    return sorted(tuple(r) for r in op.near_duplicates(df).select("vec_id", "n_links", "component_id", "kept").collect())


@pytest.mark.parametrize("shard", [20, 5000])
def test_against_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(op, "SHARD", shard)
    rows = made(260, 1)
    assert run(spark, rows) == brute(rows)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [1.0, None], 1), (5, [nan, 1.0], 1), (6, [inf, 1.0], 1), (7, [1.0, 0.0], None), (8, [1.0, 0.0], 1), (9, [2.0, 0.0], 1),
        (10, [1.0, 0.0], 2), (11, [1.0, 0.0, 0.0], 1), (12, [1.0, 0.0], 1), (12, [1.0, 0.0], 1), (13, [-1.0, 0.0], 1), (14, [1e-30, 1e-38], 1), (15, [3e38, 1e38], 1),
    ]
    assert run(spark, rows) == brute(rows)


def test_clash_and_empty(spark):
    df = spark.createDataFrame([Row(vec_id=1, embedding=[1.0], label=1, key="x", n=2, kept="no"), Row(vec_id=2, embedding=[2.0], label=1, key="x", n=2, kept="no")])
    assert sorted(tuple(r) for r in op.near_duplicates(df).collect()) == [(1, 1, 1, True), (2, 1, 1, False)]
    assert op.near_duplicates(df.where("false")).collect() == []


def test_hot_vector_and_crowded_cluster(spark):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=32)
    rows = [(i, centre.tolist(), 1) for i in range(300)] + [(300 + i, (centre + 0.05 * rng.normal(size=32)).tolist(), 1) for i in range(250)] + [(600 + i, rng.normal(size=32).tolist(), 1) for i in range(100)]
    got = {r[0]: r for r in run(spark, rows)}
    assert all(got[i][1] == 549 and got[i][2] == 0 for i in range(550)) and all(got[600 + i][1] == 0 for i in range(100))


def test_recall_of_the_graph():
    rng = np.random.default_rng(0)
    base = rng.normal(size=(1500, 64))
    near = base[:500] + 0.02 * rng.normal(size=(500, 64))
    v = np.vstack([base, near])
    v /= np.linalg.norm(v, axis=1)[:, None]
    shard = op.Shard(np.arange(2000), np.ones(2000, int), v, 0.93)
    assert shard.audit(v[::8], list(range(0, 2000, 8))) >= 0.98
    found = sum(len(shard.links_of(v[i], i)) for i in range(2000))
    true = int(((v @ v.T) >= 0.93).sum()) - 2000
    assert found >= 0.98 * true
    # queries from outside
    q = v[:300] + 0.01 * rng.normal(size=(300, 64))
    q /= np.linalg.norm(q, axis=1)[:, None]
    true = int(((v @ q.T) >= 0.93).sum())
    assert sum(len(shard.links_of(x, None)) for x in q) >= 0.9 * true
