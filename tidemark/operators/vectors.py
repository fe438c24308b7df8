"""Distances, clustering and projections of vectors (array columns)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import div


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def centred(a: Column) -> Column:
    mean = _sum(F.transform(a, lambda x: x.cast("double"))) / F.size(a)
    return F.transform(a, lambda x: x.cast("double") - mean)


def distance(a: Column, b: Column, metric: str = "euclidean") -> Column:
    """euclidean, manhattan, chebyshev, cosine or correlation (1 less the similarity; 1 for a zero vector)."""
    gaps = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    if metric == "euclidean":
        return F.sqrt(_sum(F.transform(gaps, lambda g: g * g)))
    if metric == "manhattan":
        return _sum(F.transform(gaps, lambda g: F.abs(g)))
    if metric == "chebyshev":
        return F.array_max(F.transform(gaps, lambda g: F.abs(g)))
    if metric == "cosine":
        return 1 - div(dot(a, b), norm(a) * norm(b), 0.0)
    if metric == "correlation":
        x, y = centred(a), centred(b)
        return 1 - div(dot(x, y), norm(x) * norm(y), 0.0)
    raise ValueError(f"unknown metric {metric!r}")


def centroids(df: DataFrame, group: str, vec: str) -> DataFrame:
    """(group, n, centroid): means by position, aggregated before the shuffle."""
    long = df.select(group, F.posexplode(vec).alias("_i", "_x"))
    means = long.groupBy(group, "_i").agg(F.avg("_x").alias("_m"), F.count(F.lit(1)).alias("n"))
    return means.groupBy(group).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("_i", "_m"))), lambda s: s["_m"]).alias("centroid"))


def inertia(df: DataFrame, centres: DataFrame, group: str, vec: str) -> DataFrame:
    """(group, inertia): summed squared distances to the group's centroid. Centres are one row for each group."""
    both = df.join(centres.select(group, "centroid"), group)
    return both.groupBy(group).agg(F.sum(F.pow(distance(F.col(vec), F.col("centroid")), F.lit(2.0))).alias("inertia"))


def nearest_centre(df: DataFrame, centres: np.ndarray, vec: str, metric: str = "euclidean") -> DataFrame:
    """`cluster` and `distance` of each row's nearest centre; ties go to the first. `centres` is a k x d array, k and d being parameters."""
    options = [F.struct(distance(F.col(vec), F.array(*[F.lit(float(x)) for x in c]), metric).alias("distance"), F.lit(k).alias("cluster")) for k, c in enumerate(centres)]
    return df.withColumn("_best", F.array_min(F.array(*options))).select(*df.columns, "_best.cluster", "_best.distance")


def k_means(df: DataFrame, vec: str, k: int, rounds: int = 20, metric: str = "euclidean", seed: int = 7, id_col: str = "vec_id", tolerance: float = 1e-6) -> tuple[DataFrame, np.ndarray]:
    """Lloyd's rounds from spread first centres: (rows with cluster and distance, centres). Only k centres come to the driver."""
    clean = df.filter(F.col(vec).isNotNull() & (F.size(vec) > 0)).cache()
    first = clean.orderBy(F.xxhash64(F.lit(seed), id_col), id_col).limit(1).collect()
    centres = np.array([first[0][vec]], float) if first else np.empty((0, 0))
    while len(centres) and len(centres) < k:
        # The next centre is drawn with probability by squared distance: the largest of an exponential race.
        far = nearest_centre(clean, centres, vec, metric).filter(F.col("distance") > 0)
        u = (F.pmod(F.xxhash64(F.lit(seed + len(centres)), id_col), F.lit(1 << 30)) + 1) / float((1 << 30) + 1)
        picked = far.orderBy(-F.ln(u) / (F.col("distance") * F.col("distance")), id_col).limit(1).collect()
        if not picked:
            break
        centres = np.vstack([centres, np.array(picked[0][vec], float)])
    for _ in range(rounds if len(centres) else 0):
        means = centroids(nearest_centre(clean, centres, vec, metric), "cluster", vec).collect()
        new = centres.copy()
        for r in means:
            new[r["cluster"]] = r["centroid"]
        moved = float(np.abs(new - centres).max())
        centres = new
        if moved <= tolerance:
            break
    clean.unpersist()
    return nearest_centre(clean, centres, vec, metric), centres


def covariance(df: DataFrame, vec: str) -> tuple[np.ndarray, np.ndarray, int]:
    """(mean, covariance with n - 1, n) of a vector column: partial sums of outer products on the map side, d x d numbers each."""
    def partial(batches):
        import pyarrow as pa

        total, outer, n = None, None, 0
        for batch in batches:
            rows = [x for x in batch.column(0).to_pylist() if x]
            if rows:
                x = np.asarray(rows, float)
                total = x.sum(0) if total is None else total + x.sum(0)
                outer = x.T @ x if outer is None else outer + x.T @ x
                n += len(x)
        if n:
            yield pa.RecordBatch.from_pydict({"n": [n], "total": [total.tolist()], "outer": [outer.ravel().tolist()]})

    parts = df.select(F.col(vec).cast("array<double>")).mapInArrow(partial, "n long, total array<double>, outer array<double>")
    long = parts.select(F.lit("n").alias("what"), F.lit(0).alias("i"), F.col("n").cast("double").alias("x")).unionByName(parts.select(F.lit("total").alias("what"), F.posexplode("total").alias("i", "x"))).unionByName(parts.select(F.lit("outer").alias("what"), F.posexplode("outer").alias("i", "x")))
    sums = {(r["what"], r["i"]): r["x"] for r in long.groupBy("what", "i").agg(F.sum("x").alias("x")).collect()}
    n = int(sums.get(("n", 0), 0))
    if n < 2:
        return np.empty(0), np.empty((0, 0)), n
    d = sum(1 for what, _ in sums if what == "total")
    mean = np.array([sums["total", i] for i in range(d)]) / n
    outer = np.array([sums["outer", i] for i in range(d * d)]).reshape(d, d)
    return mean, (outer - n * np.outer(mean, mean)) / (n - 1), n


def principal_components(df: DataFrame, vec: str, k: int | None = None, share: float = 0.95) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, components, explained shares): the k largest, or as many as explain `share`. Each component's largest entry is positive."""
    mean, cov, n = covariance(df, vec)
    if n < 2:
        return mean, np.empty((0, 0)), np.empty(0)
    values, vectors = np.linalg.eigh(cov)
    values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1].T
    explained = values / max(values.sum(), 1e-300)
    keep = k or int(np.searchsorted(np.cumsum(explained), share - 1e-12) + 1)
    vectors = vectors * np.sign(vectors[np.arange(len(vectors)), np.abs(vectors).argmax(1)])[:, None]
    return mean, vectors[:keep], explained[:keep]


def projected(df: DataFrame, vec: str, mean: np.ndarray, components: np.ndarray, name: str = "projected") -> DataFrame:
    """`name`: the vector less the mean, times each component; in column expressions, without Python."""
    moved = F.zip_with(F.col(vec), F.array(*[F.lit(float(m)) for m in mean]), lambda x, m: x.cast("double") - m)
    return df.withColumn("_moved", moved).withColumn(name, F.array(*[dot(F.col("_moved"), F.array(*[F.lit(float(x)) for x in c])) for c in components])).drop("_moved")


def random_projection(df: DataFrame, vec: str, dim: int, k: int, seed: int = 7, name: str = "projected") -> DataFrame:
    """Gaussian directions of unit length; data is not centred."""
    rows = np.random.default_rng(seed).normal(size=(k, dim))
    return projected(df, vec, np.zeros(dim), rows / np.linalg.norm(rows, axis=1, keepdims=True), name)


def inertia_by_k(df: DataFrame, vec: str, ks=(2, 3, 4, 5), rounds: int = 5, metric: str = "euclidean") -> DataFrame:
    """(k, inertia, chosen): summed squared distances for each number of clusters; chosen is the first whose relative drop is below 0.3 of the mean drop, else the last."""
    found = []
    for k in ks:
        rows, _ = k_means(df, vec, k, rounds, metric)
        found.append((k, rows.agg(F.sum(F.col("distance") * F.col("distance"))).first()[0] or 0.0))
    drops = [(a[1] - b[1]) / a[1] if a[1] else 0.0 for a, b in zip(found, found[1:], strict=False)]
    mean = sum(drops) / max(1, len(drops))
    best = next((found[i][0] for i, x in enumerate(drops) if x < 0.3 * mean), found[-1][0])
    return df.sparkSession.createDataFrame([(k, float(x), k == best) for k, x in found], "k int, inertia double, chosen boolean")


def independent_components(df: DataFrame, vec: str, k: int, rounds: int = 100, tolerance: float = 1e-6, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(mean, unmixing rows): `projected` by them gives k independent components of unit variance, by FastICA with tanh.

    Whitening comes from the covariance, by its k largest eigenvalues (fewer if others are none). Each round is one aggregation: tasks sum
    tanh(w z) z and its derivative over their rows, and only k x k numbers each come together; then the directions are
    made orthogonal to each other. Rounds end when no direction turns by more than `tolerance`. Each row's largest
    entry is positive; rows are ordered by their largest entry's place, then by size. Null and empty vectors do not count.
    """
    mean, cov, n = covariance(df, vec)
    if n < 2:
        return mean, np.empty((0, 0))
    values, vectors = np.linalg.eigh(cov * (n - 1) / n)
    keep = [i for i in np.argsort(-values)[:k] if values[i] > 1e-10 * max(values.max(), 1e-300)]
    whiten = (vectors[:, keep] / np.sqrt(values[keep])).T
    # The sign of an eigenvector is not determined; fixed signs make the start, and so the result, the same everywhere.
    whiten *= np.sign(whiten[np.arange(len(keep)), np.abs(whiten).argmax(1)])[:, None]
    size = len(keep)

    def orthogonal(w: np.ndarray) -> np.ndarray:
        u, _, v = np.linalg.svd(w)
        return u @ v

    w = orthogonal(np.random.default_rng(seed).normal(size=(size, size)))
    rows = df.filter(F.col(vec).isNotNull() & (F.size(vec) > 0)).select(F.col(vec).cast("array<double>").alias("x"))

    def step(w: np.ndarray):
        def partial(batches):
            import pyarrow as pa

            outer, slope, count = np.zeros((size, size)), np.zeros(size), 0
            for batch in batches:
                if batch.num_rows:
                    x = np.asarray(batch.column(0).flatten().to_numpy(zero_copy_only=False), float).reshape(batch.num_rows, -1)
                    z = (x - mean) @ whiten.T
                    g = np.tanh(z @ w.T)
                    outer, slope, count = outer + g.T @ z, slope + (1 - g * g).sum(0), count + len(x)
            if count:
                numbers = np.concatenate([outer.ravel(), slope])
                yield pa.RecordBatch.from_pydict({"i": list(range(len(numbers))), "x": numbers.tolist()})

        return partial

    for _ in range(rounds if size else 0):
        sums = np.zeros(size * size + size)
        for r in rows.mapInArrow(step(w), "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).collect():
            sums[r["i"]] = r["x"]
        new = orthogonal(sums[: size * size].reshape(size, size) / n - (sums[size * size :] / n)[:, None] * w)
        turned = float(np.abs(np.abs((new * w).sum(1)) - 1).max())
        w = new
        if turned < tolerance:
            break
    unmix = w @ whiten
    top = np.abs(unmix).argmax(1)
    unmix = unmix * np.sign(unmix[np.arange(size), top])[:, None]
    return mean, unmix[np.lexsort((-unmix[np.arange(size), top], top))]
