"""Density clusters, hierarchies and components against brute force."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import clustering, graphs


def brute_dbscan(rows, eps, least, distance):
    near = {i: [j for j, y in rows if j != i and distance(x, y) <= eps] for i, x in rows}
    core = {i for i in near if len(near[i]) >= least}
    label = {i: i for i in core}
    changed = True
    while changed:
        changed = False
        for i in core:
            low = min([label[i], *[label[j] for j in near[i] if j in core]])
            changed |= low < label[i]
            label[i] = low
    out = []
    for i, _ in rows:
        reach = [label[j] for j in near[i] if j in core]
        kind = "core" if i in core else "border" if reach else "noise"
        out.append((i, len(near[i]), kind, label[i] if i in core else min(reach, default=None)))
    return sorted(out)


def euclidean(x, y):
    return float(np.sqrt(((np.array(x) - np.array(y)) ** 2).sum()))


def cosine(x, y):
    return 1 - float(np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y))


@pytest.mark.parametrize(("metric", "chunk"), [("euclidean", 2048), ("euclidean", 7), ("cosine", 2048)])
def test_density_clusters(spark, monkeypatch, metric, chunk):
    monkeypatch.setattr(clustering, "CHUNK", chunk)
    rng = random.Random(chunk)
    centres = [(0.0, 0.0, 5.0), (4.0, 4.0, 1.0), (9.0, 0.0, 3.0)]
    points = [[c + rng.gauss(0, 0.7) for c in rng.choice(centres)] for _ in range(110)]
    points += [[float(rng.randrange(4)), 20.0, 1.0] for _ in range(30)] + [points[0]] * 6
    rows = list(enumerate(points))
    eps, f = (1.0, euclidean) if metric == "euclidean" else (0.004, cosine)
    df = spark.createDataFrame(rows, "k long, v array<double>").withColumn("_x", F.lit("clash"))
    got = sorted(map(tuple, clustering.dbscan(df, "k", "v", eps, 4, metric).collect()))
    assert got == brute_dbscan(rows, eps, 4, f)
    assert {kind for _, _, kind, _ in got} == {"core", "border", "noise"}


def shuffled(spark):
    return spark._jsparkSession.sparkContext().statusStore().executorSummary("driver").totalShuffleWrite()


def test_density_clusters_shuffle_grows_with_rows(spark):
    """All vectors are in each other's cells: their copies are as many as cells, not as rows."""
    rng, took = np.random.default_rng(5), []
    for n in (12_000, 48_000):
        x = rng.normal(size=(n, 16))
        x /= np.linalg.norm(x, axis=1)[:, None]
        df = spark.createDataFrame(list(enumerate(x.tolist())), "k long, v array<double>").cache()
        df.count()
        before = shuffled(spark)
        clustering.dbscan(df, "k", "v", 0.5, 3).write.format("noop").mode("overwrite").save()
        took.append(shuffled(spark) - before)
    assert 0 < took[1] < 5 * took[0]


@pytest.mark.parametrize(("shift", "step"), [(0.0, 5), (0.0, 1024), (1e7, 5)])
@pytest.mark.parametrize("same", [True, False])
def test_near_pairs_on_the_edge(monkeypatch, shift, step, same):
    monkeypatch.setattr(clustering, "STEP", step)
    rng = np.random.default_rng(3)
    x, y = (rng.integers(0, 9, (n, 3)) / 4 + shift for n in (40, 33))
    y = x if same else y
    got = [(int(a), int(b)) for i, j in clustering._near_pairs(x, y, 1.25, same) for a, b in zip(i, j)]
    want = [(a, b) for a in range(len(x)) for b in range(a if same else 0, len(y)) if euclidean(x[a], y[b]) <= 1.25]
    assert sorted(got) == want and any(euclidean(x[a], y[b]) == 1.25 for a, b in want)


@pytest.mark.parametrize("least", [1, 3, 40])
def test_links_of_a_block_are_few_and_tell_all(least):
    """Every pair is near; what is told is a forest where rows are sure, and nothing is left out where they are not."""
    n = 30
    pairs = [(np.array([i]), np.array([j])) for i in range(n) for j in range(i, n)]
    near, a, b, c, d = clustering._linked(np.ones(n, np.int64), np.ones(n, np.int64), iter(pairs), least, True)
    assert near.tolist() == [n - 1] * n and (len(a), len(c)) == ((n - 1, 0) if least < n else (0, n * (n - 1) // 2))


def test_density_clusters_of_odd_rows(spark):
    rows = [(1, None), (2, []), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [1.0]), (6, [0.0, 0.0]), (7, [0.0, 0.0]), (8, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "k long, v array<double>")
    got = {r["k"]: tuple(r)[1:] for r in clustering.dbscan(df, "k", "v", 1.0, 2).collect()}
    assert all(got[k] == (0, "noise", None) for k in (1, 2, 3, 4, 5)) and all(got[k] == (2, "core", 6) for k in (6, 7, 8))
    assert clustering.dbscan(df.filter("k > 100"), "k", "v", 1.0, 2).collect() == []


def brute_linkage(d, items, method):
    clusters, out = {i: [i] for i in items}, []
    value = {"complete": max, "single": min, "average": lambda x: sum(x) / len(x)}[method]
    while len(clusters) > 1:
        pairs = [(value([d[p, q] for p in clusters[a] for q in clusters[b]]), a, b) for a, b in itertools.combinations(sorted(clusters), 2)]
        height, a, b = min(pairs)
        clusters[a] = clusters[a] + clusters.pop(b)
        out.append((a, b, round(height, 9), len(clusters[a])))
    return sorted(out)


@pytest.mark.parametrize("method", ["complete", "single", "average"])
def test_merges_are_those_of_the_closest_pairs(spark, method):
    rng = random.Random(len(method))
    points = {k: (rng.random(), rng.random()) for k in range(9)}
    d = {(a, b): euclidean(points[a], points[b]) for a in points for b in points if a != b}
    merges = clustering.linkage(spark.createDataFrame([(a, b, x) for (a, b), x in d.items()], "a long, b long, d double"), method)
    assert sorted((r["first"], r["second"], round(r["height"], 9), r["size"]) for r in merges.collect()) == brute_linkage(d, list(points), method)


def test_cut_of_a_hierarchy(spark):
    items = spark.createDataFrame([(k, float(x)) for k, x in enumerate([0, 1, 10, 12, 50, 51])], "k long, x double")
    merges = clustering.linkage(clustering.distance_table(items, "k", lambda a, b: F.abs(a["x"] - b["x"])))
    assert {tuple(r) for r in clustering.cut(items, "k", merges, 3).collect()} == {(0, 0), (1, 0), (2, 2), (3, 2), (4, 4), (5, 4)}
    assert {r["cluster"] for r in clustering.cut(items, "k", merges, 6).collect()} == set(range(6))
    assert clustering.linkage(clustering.distance_table(items.limit(1), "k", lambda a, b: F.abs(a["x"] - b["x"]))).collect() == []
    with pytest.raises(ValueError):
        clustering.distance_table(spark.range(clustering.ITEMS + 1), "id", lambda a, b: F.lit(0.0))


def test_components(spark):
    rng = random.Random(3)
    edges = [(k, k + 1) for k in range(100, 160)] + [(900, k) for k in range(200, 260)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)] + [(7, 7)]
    label = {n: n for e in edges for n in e if e[0] != e[1]}
    for _ in range(100):
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    assert {tuple(r) for r in graphs.components(spark.createDataFrame(edges, "src long, dst long")).collect()} == set(label.items())
