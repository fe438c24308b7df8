"""Fitted scalings of columns. A fit is one row of an aggregation; it is joined to the rows by a constant, or kept as a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordered import quantiles, with_group
from ..functions.scalars import div
from ..functions.windows import pearson

METHODS = ("min_max", "z_score", "robust", "max_abs", "mean", "unit_vector", "log", "square_root")
QUARTILES = ("q25", "median", "q75")


def _finite(c: str) -> Column:
    x = F.col(c).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def fit(df: DataFrame, columns: list[str], method: str | None = None) -> DataFrame:
    """One row for each column: n, min, max, mean, std (sample), std_pop, median, q25, q75, max_abs and norm. Written as JSON it is the state of a scaler.

    With a `method`, only what that one reads is worked out: quartiles, the costly part, are null unless it is `robust`.
    """
    long = df.select(*[_finite(c).alias(c) for c in columns]).unpivot([], columns, "field", "x")
    moments = long.groupBy("field").agg(
        F.count("x").alias("n"), F.min("x").alias("min"), F.max("x").alias("max"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.stddev_pop("x").alias("std_pop"),
        F.max(F.abs("x")).alias("max_abs"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"),
    )
    if method not in (None, "robust"):
        return moments.withColumns({n: F.lit(None).cast("double") for n in QUARTILES})
    out = with_group(moments, quantiles(long, "x", [0.25, 0.5, 0.75], ("field",)), ("field",), few=True)
    return out.select("*", *[F.get("q", F.lit(k)).alias(n) for k, n in enumerate(QUARTILES)]).drop("q")


def _wide(state: DataFrame, columns: list[str]) -> DataFrame:
    """The state as one row with a struct for each column."""
    fields = [c for c in state.columns if c != "field"]
    return state.agg(*[F.first(F.when(F.col("field") == c, F.struct(*fields)), ignorenulls=True).alias(f"_s_{c}") for c in columns]).withColumn("_one", F.lit(1))


def _with_state(df: DataFrame, state: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumn("_one", F.lit(1)).join(F.broadcast(_wide(state, columns)), "_one", "left")  # one row


def _forward(x: Column, s: Column, method: str) -> Column:
    spread = {"z_score": s["std"], "robust": s["q75"] - s["q25"], "max_abs": s["max_abs"], "mean": s["mean"], "unit_vector": s["norm"]}
    if method == "min_max":
        return div(x - s["min"], s["max"] - s["min"], 0.5)
    if method == "log":
        return F.when(x > 0, F.ln(x)).when(x.isNotNull(), 0.0)
    if method == "square_root":
        return F.when(x >= 0, F.sqrt(x)).when(x.isNotNull(), 0.0)
    base = {"z_score": s["mean"], "robust": s["q25"]}.get(method, F.lit(0.0))
    width = F.when(F.coalesce(spread[method], F.lit(0.0)) != 0, spread[method]).otherwise(1.0)
    return (x - base) / width


def _backward(x: Column, s: Column, method: str) -> Column:
    spread = {"z_score": s["std"], "robust": s["q75"] - s["q25"], "max_abs": s["max_abs"], "mean": s["mean"], "unit_vector": s["norm"]}
    if method == "min_max":
        return x * (s["max"] - s["min"]) + s["min"]
    if method == "log":
        return F.exp(x)
    if method == "square_root":
        return x * x
    base = {"z_score": s["mean"], "robust": s["q25"]}.get(method, F.lit(0.0))
    width = F.when(F.coalesce(spread[method], F.lit(0.0)) != 0, spread[method]).otherwise(1.0)
    return x * width + base


def transform(df: DataFrame, state: DataFrame, columns: list[str], method: str) -> DataFrame:
    """min_max (0.5 for a constant), z_score (sample deviation), robust (from the lower quartile, by the quartile range), max_abs,
    mean (divides by it), unit_vector, log (0 for what is not positive) or square_root."""
    out = _with_state(df, state, columns)
    return out.withColumns({c: _forward(F.col(c), F.col(f"_s_{c}"), method) for c in columns}).drop("_one", *[f"_s_{c}" for c in columns])


def inverse(df: DataFrame, state: DataFrame, columns: list[str], method: str) -> DataFrame:
    """What `transform` came from, except where a log or root lost it."""
    out = _with_state(df, state, columns)
    return out.withColumns({c: _backward(F.col(c), F.col(f"_s_{c}"), method) for c in columns}).drop("_one", *[f"_s_{c}" for c in columns])


def scale(df: DataFrame, state: DataFrame, columns: list[str], method: str = "zscore") -> DataFrame:
    """The scaler of training features: zscore (population deviation), minmax, robust (median and quartile range) or none; no spread counts as 1."""
    if method == "none":
        return df
    out = _with_state(df, state, columns)

    def value(c: str) -> Column:
        s = F.col(f"_s_{c}")
        centre, width = {"zscore": (s["mean"], s["std_pop"]), "minmax": (s["min"], s["max"] - s["min"]), "robust": (s["median"], s["q75"] - s["q25"])}[method]
        return (F.col(c) - centre) / F.when(width > 1e-12, width).otherwise(1.0)

    return out.withColumns({c: value(c) for c in columns}).drop("_one", *[f"_s_{c}" for c in columns])


def scale_splits(df: DataFrame, columns: list[str], split: str = "split", method: str = "zscore") -> DataFrame:
    """Scales all rows by what the rows of the split `train` alone show."""
    return scale(df, fit(df.filter(F.col(split) == "train"), columns, method), columns, method)


def selected(df: DataFrame, columns: list[str], target: str, k: int, least_variance: float = 0.0) -> DataFrame:
    """(feature, variance, score, position) of the k columns with the largest absolute correlation with the target, of those that vary."""
    row = df.agg(*[F.var_pop(c).alias(f"v_{c}") for c in columns], *[pearson(c, target).alias(f"c_{c}") for c in columns])
    long = row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"v_{c}").alias("variance"), F.coalesce(F.abs(f"c_{c}"), F.lit(0.0)).alias("score")) for c in columns])).alias("_f")).select("_f.*")
    w = Window.orderBy(F.desc("score"), "feature")  # one row for each column
    return long.filter(F.col("variance") > least_variance).withColumn("position", F.row_number().over(w)).filter(F.col("position") <= k)


def binned_information(df: DataFrame, column: str, target: str, bins: int = 10) -> DataFrame:
    """Mutual information (nats) between the equal-width bins of a column and the values of a discrete target."""
    x = F.col(column)
    ends = df.agg(F.min(x).alias("_lo"), F.max(x).alias("_hi")).withColumn("_one", F.lit(1))
    spread = F.when(F.col("_hi") > F.col("_lo"), (x - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.0)
    known = df.filter(x.isNotNull() & F.col(target).isNotNull()).withColumn("_one", F.lit(1)).join(F.broadcast(ends), "_one")  # one row
    table = known.groupBy(F.least(F.lit(bins - 1), F.floor(spread * bins)).alias("_b"), F.col(target).alias("_t")).agg(F.count(F.lit(1)).alias("_n"))
    nb, nt, n = (F.sum("_n").over(Window.partitionBy(*k)) for k in (["_b"], ["_t"], [F.lit(1)]))
    parts = table.select("_n", nb.alias("_nb"), nt.alias("_nt"), n.alias("_all"))
    return parts.agg(F.sum(F.col("_n") / F.col("_all") * F.ln(F.col("_n") * F.col("_all") / (F.col("_nb") * F.col("_nt")))).alias("information"))
