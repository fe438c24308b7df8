"""Models and searches whose data stays in Spark: least squares, averages of models, isolation forests, walk-forward search."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import windows as W
from ..functions.scalars import div
from .splits import numbered, walk_forward


def least_squares(df: DataFrame, features: list[str], target: str, ridge: float = 1e-9) -> np.ndarray:
    """Coefficients, the intercept first: one aggregation of products, of which (features + 1) squared numbers come to the driver."""
    columns = [F.lit(1.0), *[F.col(c).cast("double") for c in features]]
    y = F.col(target).cast("double")
    known = df.dropna("any", subset=[*features, target])
    n = len(columns)
    sums = known.agg(*[F.sum(columns[i] * columns[j]).alias(f"x{i}_{j}") for i in range(n) for j in range(i, n)], *[F.sum(c * y).alias(f"y{i}") for i, c in enumerate(columns)]).first()
    if sums["x0_0"] is None:
        return np.zeros(n)
    xx = np.array([[sums[f"x{min(i, j)}_{max(i, j)}"] for j in range(n)] for i in range(n)])
    return np.linalg.solve(xx + ridge * np.eye(n), np.array([sums[f"y{i}"] for i in range(n)]))


def linear(coefficients: Sequence[float], features: list[str]) -> Column:
    """The prediction of `least_squares` as a column."""
    return sum((F.col(c) * float(b) for c, b in zip(features, coefficients[1:], strict=True)), F.lit(float(coefficients[0])))


def voted(probabilities: list[str], weights: list[float] | None = None) -> Column:
    """The weighted mean of the models that have a value; null if none has."""
    w = weights or [1.0] * len(probabilities)
    known = [F.when(F.col(c).isNotNull(), F.lit(k)).otherwise(0.0) for c, k in zip(probabilities, w, strict=True)]
    return div(sum((F.coalesce(F.col(c), F.lit(0.0)) * k for c, k in zip(probabilities, w, strict=True)), F.lit(0.0)), sum(known, F.lit(0.0)))


def shuffled(df: DataFrame, column: str, key: list[str], seed: int = 7, buckets: int = 64) -> DataFrame:
    """`df` with the column's values moved between rows: within buckets by a hash of the key, each row gets the next one's in hash order."""
    h = F.xxhash64(F.lit(seed), *key)
    w = Window.partitionBy("_b").orderBy("_h", *key)
    rows = df.withColumns({"_h": h, "_b": F.pmod(F.xxhash64(F.lit(seed + 1), *key), F.lit(buckets))})
    moved = F.coalesce(F.lead(column).over(w), F.first(column).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return rows.withColumn(column, moved).drop("_h", "_b")


def permutation_importance(df: DataFrame, model: Column, target: str, features: list[str], key: list[str], seed: int = 7) -> DataFrame:
    """(feature, importance): by how much the mean squared error grows when the feature's values are shuffled."""
    def error(rows: DataFrame, name: str) -> DataFrame:
        return rows.agg(F.avg(F.pow(F.col(target) - model, F.lit(2.0))).alias("error")).select(F.lit(name).alias("feature"), "error", F.lit(1).alias("_one"))

    base = error(df, "").select(F.col("error").alias("_base"), "_one")
    out = error(shuffled(df, features[0], key, seed), features[0])
    for c in features[1:]:
        out = out.unionByName(error(shuffled(df, c, key, seed), c))
    return out.join(F.broadcast(base), "_one").select("feature", (F.col("error") - F.col("_base")).alias("importance"))  # one row


def walk_forward_search(df: DataFrame, candidates: dict[str, Column], folds: Sequence[tuple[int, int, int, int, int]] | Callable[[DataFrame], DataFrame], keys=W.SERIES, order=("ts",)) -> DataFrame:
    """Per fold, the candidate with the largest mean score on its training rows, and the candidate's mean on its test rows.

    `folds` are places of rows, or a function that deals rows to `fold` and `part`, such as by splits.rolling_walk_forward.
    `candidates` are a score for each row by name of parameters; ties go to the smaller name. All folds and candidates are one aggregation.
    """
    scored = df.withColumns({f"_c{k}": c for k, c in enumerate(candidates.values())})
    scored = scored.select(*keys, *order, *[f"_c{k}" for k in range(len(candidates))])
    rows = folds(scored) if callable(folds) else walk_forward(scored, folds, keys, order)
    means = rows.groupBy("fold", "part").agg(*[F.avg(f"_c{k}").alias(f"_c{k}") for k in range(len(candidates))])
    long = means.select("fold", "part", F.explode(F.array(*[F.struct(F.lit(n).alias("candidate"), F.col(f"_c{k}").alias("score")) for k, n in enumerate(candidates)])).alias("_s")).select("fold", "part", "_s.*")
    train, test = (long.filter(F.col("part") == p).select("fold", "candidate", F.col("score").alias(f"{p}_score")) for p in ("train", "test"))
    best = train.withColumn("_rank", F.row_number().over(Window.partitionBy("fold").orderBy(F.desc_nulls_last("train_score"), "candidate"))).filter("_rank = 1").drop("_rank")
    return best.join(test, ["fold", "candidate"], "left")


def walk_forward_fit(df: DataFrame, features: list[str], target: str, train: int, test: int, step: int | None = None, keys=W.SERIES, order=("ts",), ridge: float = 1e-9) -> DataFrame:
    """(keys, fold, n_train, n_test, coefficients, train_rmse, test_rmse): least squares on every fold's training rows, and how it does on its test rows.

    Folds are `train` rows and the `test` rows after them, moved on by `step` (by default `test`) as long as they are
    whole. Products of the features and the target are summed once for each block of rows and then along the series;
    a fold's sums are the difference of two of these rows, however many folds share a row. Fits are solved fold by
    fold in tasks; the errors come from the same sums. Rows with a null count for the place of folds only. The
    intercept comes first. A fold with fewer training rows than coefficients has null coefficients and errors.
    """
    step = step or test
    block = math.gcd(train, test, step)
    names, size = [*features, target], len(features) + 2
    rows = numbered(df.select(*keys, *order, *[F.col(c).cast("double").alias(c) for c in names]), keys, order)
    known = F.lit(True)
    for c in names:
        known = known & F.col(c).isNotNull()
    z = [F.when(known, x) for x in (F.lit(1.0), *map(F.col, names))]
    products = [F.coalesce(F.sum(z[i] * z[j]), F.lit(0.0)) for i in range(size) for j in range(i, size)]
    places = [f"_p{k}" for k in range(len(products))]
    sums = rows.groupBy(*keys, F.floor(F.col("row") / block).alias("_k")).agg(F.max("rows").alias("_rows"), *[p.alias(n) for p, n in zip(products, places, strict=True)])
    so_far = Window.partitionBy(*keys).orderBy("_k").rowsBetween(Window.unboundedPreceding, 0)
    # After block k - 1 stand the sums before block k: where a fold starts, where its test rows start, or where they end.
    ends = sums.select(*keys, "_rows", (F.col("_k") + 1).alias("_k"), F.array(*[F.sum(n).over(so_far) for n in places]).alias("_sums"))
    start = ends.groupBy(*keys).agg(F.max("_rows").alias("_rows")).select(*keys, "_rows", F.lit(0).cast("long").alias("_k"), F.array_repeat(F.lit(0.0), len(places)).alias("_sums"))
    roles = F.explode(F.array(*[F.struct(F.lit(r).alias("role"), ((F.col("_k") - shift) / (step // block)).alias("fold")) for r, shift in enumerate((0, train // block, (train + test) // block))]))
    met = ends.unionByName(start).select(*keys, "_rows", "_sums", roles.alias("_r")).select(*keys, "_rows", "_sums", "_r.*")
    whole = (F.col("fold") >= 0) & (F.col("fold") == F.floor("fold")) & (F.col("fold") * step + train + test <= F.col("_rows"))
    folds = met.filter(whole).groupBy(*keys, F.col("fold").cast("int").alias("fold")).agg(*[F.max(F.when(F.col("role") == r, F.col("_sums"))).alias(f"_s{r}") for r in range(3)])
    upper = np.triu_indices(size)
    head = [*keys, "fold"]

    def solved(batches):
        for batch in batches:
            out = []
            for parts in zip(*(batch.column(f"_s{r}").to_pylist() for r in range(3)), strict=True):
                full = []
                for a, b in zip(parts, parts[1:], strict=False):
                    m = np.zeros((size, size))
                    m[upper] = np.array(b) - np.array(a)
                    full.append(m + np.triu(m, 1).T)
                n = [int(round(m[0, 0])) for m in full]
                if n[0] < size - 1:
                    out.append((*n, None, None, None))
                    continue
                beta = np.linalg.solve(full[0][:-1, :-1] + ridge * np.eye(size - 1), full[0][:-1, -1])
                gap = np.append(beta, -1.0)
                out.append((*n, beta.tolist(), *[math.sqrt(max(0.0, gap @ m @ gap) / k) if k else None for m, k in zip(full, n, strict=True)]))
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.float64(), pa.float64())
            made = [pa.array([o[c] for o in out], kind) for c, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in head], *made], [*head, "n_train", "n_test", "coefficients", "train_rmse", "test_rmse"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in folds.select(*head).schema.fields)
    return folds.mapInArrow(solved, f"{fields}, n_train long, n_test long, coefficients array<double>, train_rmse double, test_rmse double")


def _tree(x: np.ndarray, depth: int, rng: np.random.Generator) -> tuple | float:
    """(feature, cut, left, right), or the adjusted depth left at a leaf."""
    n = len(x)
    if depth == 0 or n <= 1:
        return _average_path(n)
    spread = np.flatnonzero(x.max(0) > x.min(0))
    if not len(spread):
        return _average_path(n)
    f = int(rng.choice(spread))
    cut = float(rng.uniform(x[:, f].min(), x[:, f].max()))
    left = x[:, f] < cut
    return f, cut, _tree(x[left], depth - 1, rng), _tree(x[~left], depth - 1, rng)


def _average_path(n: int) -> float:
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def isolation_forest(df: DataFrame, features: list[str], key: list[str], trees: int = 32, sample: int = 256, seed: int = 7, name: str = "anomaly") -> DataFrame:
    """`name`: 0 to 1, higher for rows that random cuts separate sooner; null where a feature is null.

    Each tree is grown on about `sample` rows, which a hash of the key chooses, so the driver sees trees * sample rows
    whatever the table holds; every row is scored, in Arrow batches.
    """
    known = df.dropna("any", subset=features)
    total = known.count()
    share = min(1.0, trees * sample / total) if total else 0.0
    picked = known.filter(F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(1 << 30)) < share * (1 << 30)).select(*[F.col(c).cast("double") for c in features]).collect()
    x, rng = np.array(picked, float).reshape(-1, len(features)), np.random.default_rng(seed)
    parts = [x[rng.permutation(len(x))[:sample]] for _ in range(trees)] if len(x) else []
    size = len(parts[0]) if parts else 0
    forest = [_tree(p, max(1, math.ceil(math.log2(max(2, size)))), rng) for p in parts]
    scale = _average_path(max(2, size))

    @F.arrow_udf("double")
    def score(rows: pa.Array) -> pa.Array:
        v = np.asarray(rows.flatten().to_numpy(zero_copy_only=False), float).reshape(len(rows), len(features))
        depth = np.zeros(len(v))

        def walk(tree, rows, at):
            if isinstance(tree, float):
                depth[rows] += at + tree
                return
            left = v[rows, tree[0]] < tree[1]
            walk(tree[2], rows[left], at + 1)
            walk(tree[3], rows[~left], at + 1)

        for tree in forest:
            walk(tree, np.arange(len(v)), 0)
        out = 2.0 ** (-depth / (scale * max(1, len(forest))))
        return pa.array(out, mask=np.isnan(v).any(1))

    return df.withColumn(name, score(F.array(*[F.col(c).cast("double") for c in features])))


def hypotheses(results: DataFrame, metric: str = "sharpe", weak: float = 0.0) -> DataFrame:
    """Rows (symbol, hypothesis) for symbols whose metrics are weak: weak_edge, deep_drawdown, few_trades or drifted, as columns of these say."""
    rules = F.array_compact(
        F.array(
            F.when(F.col(metric) <= weak, F.lit("weak_edge")), F.when(F.abs("max_drawdown") > 0.15, F.lit("deep_drawdown")), F.when(F.col("n") < 30, F.lit("few_trades")), F.when(F.col("drifted"), F.lit("drifted")),
        )
    )
    return results.select("symbol", F.explode(rules).alias("hypothesis"))
