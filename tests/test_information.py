"""Independent components and kNN mutual information against NumPy and brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import information, vectors


def test_independent_components_undo_a_mixing(spark):
    rng = np.random.default_rng(1)
    sources = np.stack([rng.uniform(-1, 1, 3000), rng.laplace(size=3000), np.sign(rng.normal(size=3000)) + rng.normal(size=3000) / 9], 1)
    x = sources @ np.array([[1.0, 2.0, 0.5], [-1.0, 1.0, 1.0], [0.3, -0.7, 2.0]]) + [5, -3, 1]
    df = spark.createDataFrame([(r.tolist(),) for r in x] + [(None,), ([],)], "v array<double>").repartition(5)
    mean, unmix = vectors.independent_components(df, "v", 3)
    found = (x - mean) @ unmix.T
    assert np.allclose(found.mean(0), 0, atol=1e-9) and np.allclose(np.cov(found.T, bias=True), np.eye(3), atol=1e-9)
    match = np.abs(np.corrcoef(found.T, sources.T)[:3, 3:])
    assert sorted(match.argmax(1)) == [0, 1, 2] and (match.max(1) > 0.99).all()
    # The fixed point is one of a plain loop, too: the next step does not turn the directions.
    g = np.tanh(found)
    new = g.T @ found / len(x) - np.diag((1 - g * g).mean(0))
    u, _, v = np.linalg.svd(new)
    assert np.allclose(np.abs(np.diag(u @ v)), 1, atol=1e-4)


def test_independent_components_of_dependent_and_missing_vectors(spark):
    df = spark.createDataFrame([([float(k), 2.0 * k],) for k in range(20)], "v array<double>")
    assert vectors.independent_components(df, "v", 2)[1].shape == (1, 2)
    assert vectors.independent_components(df.limit(1), "v", 2)[1].shape == (0, 0)


def psi(m):
    return -0.5772156649015329 + sum(1 / j for j in range(1, m))


def brute_information(rows, k):
    rows = [r for r in rows if all(v is not None and math.isfinite(v) for v in r)]
    n = len(rows)
    if n <= k:
        return n, None
    x = np.array(rows, float)
    spread = x.std(0)
    x = (x - x.min(0)) / np.where(spread > 0, spread, 1)
    total = 0.0
    for i in range(n):
        gaps = np.abs(x - x[i])
        reach = np.sort(np.delete(gaps.max(1), i))[k - 1] * (1 - 1e-9)
        total += sum(psi(int((gaps[:, a] <= reach).sum())) for a in (0, 1))
    return n, max(0.0, psi(n) + psi(k) - total / n)


@pytest.mark.parametrize(("kind", "tile"), [("normal", 256), ("normal", 4), ("lattice", 8), ("lumps", 4), ("flat", 256)])
def test_information_is_that_of_brute_force(spark, monkeypatch, kind, tile):
    monkeypatch.setattr(information, "TILE", tile)
    monkeypatch.setattr(information, "CHUNK", 16)
    rng = random.Random(tile)
    rows = []
    for _ in range(150):
        a = rng.gauss(0, 1)
        rows.append({
            "normal": (a, a + rng.gauss(0, 0.5)), "lattice": (float(rng.randrange(9)), float(rng.randrange(7))), "flat": (a, 2.0),
            "lumps": (rng.choice([0, 1000]) + a / 100, rng.choice([0, 5]) + a / 100 + rng.random()),
        }[kind])
    rows += rows[:20] + [(None, 1.0), (1.0, float("nan")), (float("inf"), 2.0)]
    got = information.knn_information(spark.createDataFrame(rows, "a double, b double"), "a", "b", 3).first()
    n, want = brute_information(rows, 3)
    assert got["n"] == n and math.isclose(got["information"], want, abs_tol=1e-9)


def test_information_of_few_rows(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 1.0)], "a double, b double")
    assert tuple(information.knn_information(df, "a", "b", 3).first()) == (2, None)
    assert tuple(information.knn_information(df.limit(0), "a", "b", 3).first()) == (0, None)
    assert spark.range(1, 40).select(F.max(F.abs(information.digamma(F.col("id").cast("double")) - F.lit(psi(1)))).alias("x")).first()["x"] > 3
    for m in (1, 2, 7, 300):
        assert math.isclose(spark.range(1).select(information.digamma(F.lit(float(m))).alias("x")).first()["x"], psi(m), abs_tol=1e-11)


def test_points_are_moved_once_and_look_beyond_their_region(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=900).round(2), rng.normal(size=900).round(1)
    x[:200], y[100:250] = 1.25, 0.5
    df = spark.createDataFrame(list(zip(x.tolist(), y.tolist(), strict=True)), "a double, b double")
    whole = tuple(information.knn_information(df, "a", "b", 3).first())
    for name, size in (("TILE", 60), ("BLOCK", 16), ("STRETCH", 90), ("CHUNK", 50)):
        monkeypatch.setattr(information, name, size)
    rows = df.groupBy("a", "b").count().select(F.monotonically_increasing_id().alias("_id"), F.col("a").alias("_x"), F.col("b").alias("_y"), F.col("count").alias("_w")).localCheckpoint()
    got = {(r["_x"], r["_y"]): r["_d"] for r in information.kth_distances(rows, 3).collect()}
    gaps = np.sort(np.maximum(np.abs(x[:, None] - x), np.abs(y[:, None] - y)), axis=1)[:, 3]
    assert got == dict(zip(zip(x.tolist(), y.tolist(), strict=True), gaps.tolist(), strict=True))
    cut = tuple(information.knn_information(df, "a", "b", 3).first())
    assert cut[0] == whole[0] and math.isclose(cut[1], whole[1], rel_tol=1e-9)
