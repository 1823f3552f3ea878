import numpy as np
import pytest

from turnstone.llm import topk

SCHEMA = "vec_id bigint, embedding array<float>"


def brute(ids, x, k):
    x = x.astype(np.float32).astype(np.float64)
    s = np.round(x @ x.T, 6) + 0.0
    out = {}
    for i in range(len(ids)):
        order = sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-s[i, j], ids[j]))[:k]
        out[ids[i]] = [(ids[j], s[i, j]) for j in order]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r["product"]))
    return out


def near(got, want):
    """Equal, but for ties that rounding breaks one way or the other."""
    assert got.keys() == want.keys()
    for q in want:
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]], atol=2e-6)


@pytest.mark.parametrize("kind", ["unit", "lengths", "clusters", "zeros"])
def test_equals_brute_force(spark, kind):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 16))
    if kind == "unit":
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    if kind == "lengths":
        x *= rng.lognormal(0, 1.5, (400, 1))
    if kind == "clusters":
        x = np.eye(16)[rng.integers(0, 16, 400)] * 5 + 0.05 * x
    if kind == "zeros":
        x[::7] = 0
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], SCHEMA)
    near(found(topk.top_k(docs, k=7, bucket=64)), brute(list(range(400)), x, 7))


def test_coordinate_pruning_keeps_all_results():
    rng = np.random.default_rng(4)
    x = np.eye(12)[rng.integers(0, 12, 300)] + 0.1 * rng.normal(size=(300, 12))
    x = x[np.argsort(-np.linalg.norm(x, axis=1))]
    xl = np.linalg.norm(x, axis=1)
    q = x[:50]
    s = q @ x.T
    theta = np.sort(s, 1)[:, -5]
    a, b = topk.candidates(q, np.linalg.norm(q, axis=1), theta, x, xl)
    local = theta / np.linalg.norm(q, axis=1) / xl[0]
    assert (local >= topk.COORDINATE).any() and (local < topk.COORDINATE).any()
    assert {(i, j) for i, j in zip(*np.nonzero(s >= theta[:, None]))} <= set(zip(a.tolist(), b.tolist()))
    assert len(a) < 0.7 * s.size


def test_edges(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, []), (5, [1.0, None]), (6, [1.0, 2.0, 3.0]), (7, [float("nan"), 1.0]), (None, [1.0, 1.0]), (8, [0.0, 0.0])]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS bucket", "2 AS product")
    got = found(topk.top_k(docs, k=5))
    assert got == {1: [(2, 1.0), (8, 0.0)], 2: [(1, 1.0), (8, 0.0)], 8: [(1, 0.0), (2, 0.0)]}
    assert topk.top_k(docs.where("false")).count() == 0
    assert topk.top_k(docs.where("vec_id = 2")).count() == 0


def test_grids_of_cells(spark, monkeypatch):
    """More cells than one, and more buckets than cells, whatever their size."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(500, 8)) * rng.lognormal(0, 1, (500, 1))
    x[100:140] = x[100]  # ties
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], SCHEMA).repartition(3)
    want = brute(list(range(500)), x, 6)
    for cell in (40, 10**6):
        monkeypatch.setattr(topk, "CELL", cell)
        near(found(topk.top_k(docs, k=6, bucket=32)), want)
    clash = docs.selectExpr("*", "1 AS `a.b`", "2 AS cell", "3 AS kind")
    near(found(topk.top_k(clash, k=6, bucket=1000)), want)
