"""Cleaning of candles: duplicates, missing values and outliers, series by series."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions import windows as W
from ..functions.ordered import quantiles, with_group
from ..functions.scalars import div

FILLS = ("drop", "zero", "mean", "median", "forward", "backward", "linear")
OUTLIERS = ("drop", "clip", "winsorize", "median")
SIDE, LEAST_ROWS = 10, 5


def _whole() -> Window:
    return Window.partitionBy(*W.SERIES)


def drop_duplicates(df: DataFrame, keys=(*W.SERIES, "ts"), order=("event_id",)) -> DataFrame:
    """The first row of each key by `order`; by aggregation, so equal rows meet already where they are read."""
    return df.groupBy(*keys).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("_row")).select("_row.*")


def missing_counts(df: DataFrame, fields: list[str]) -> DataFrame:
    """Per field: rows, missing ones (null or NaN) and their share."""
    total = df.agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_if(F.col(c).isNull() | F.isnan(c)).alias(c) for c in fields])
    long = total.select("n_rows", F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("missing")) for c in fields])).alias("_f"))
    return long.select("_f.field", "n_rows", "_f.missing", div(F.col("_f.missing"), F.col("n_rows"), 0.0).alias("rate"))


def fill_missing(df: DataFrame, fields: list[str], method: str = "linear", most: float | None = None) -> DataFrame:
    """Replaces null and NaN fields. Rows of which more than the share `most` is missing are dropped first.

    drop, zero, mean, median (of the series), forward (the last filled value), backward (the next given one),
    linear (by row number between given neighbours, cubic likewise; the nearer one at the ends). What is left gets the mean, then 0.
    """
    out = df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in fields})
    if most is not None:
        out = out.filter(sum([F.col(c).isNull().cast("int") for c in fields], F.lit(0)) <= most * len(fields))
    if method == "drop":
        return out.dropna("any", subset=fields)
    means = {c: F.coalesce(F.avg(c).over(_whole()), F.lit(0.0)) for c in fields}
    if method == "zero":
        return out.fillna(0.0, subset=fields)
    if method == "mean":
        return out.withColumns({c: F.coalesce(F.col(c), means[c]) for c in fields})
    if method == "median":
        helped = out
        for c in fields:
            helped = with_group(helped, quantiles(out, c, [0.5], W.SERIES).select(*W.SERIES, F.get("q", F.lit(0)).alias(f"_m_{c}")), W.SERIES)
        return helped.withColumns({c: F.coalesce(F.col(c), F.col(f"_m_{c}"), F.lit(0.0)) for c in fields}).select(*out.columns)
    if method == "forward":
        return out.withColumns({c: F.coalesce(W.forward_fill(c), means[c]) for c in fields})
    if method == "backward":
        return out.withColumns({c: F.coalesce(W.backward_fill(c), means[c]) for c in fields})
    if method not in ("linear", "cubic"):
        raise ValueError(f"unknown method {method!r}")
    out = out.withColumn("_i", F.row_number().over(W.series()))
    ahead = W.series().rowsBetween(0, Window.unboundedFollowing)
    place = {c: F.when(F.col(c).isNotNull(), F.struct("_i", F.col(c).alias("v"))) for c in fields}
    out = out.withColumns({f"_p_{c}": F.last(place[c], ignorenulls=True).over(W.so_far()) for c in fields} | {f"_n_{c}": F.first(place[c], ignorenulls=True).over(ahead) for c in fields} | {f"_m_{c}": means[c] for c in fields})

    def value(c: str) -> Column:
        p, n = F.col(f"_p_{c}"), F.col(f"_n_{c}")
        between = p["v"] + (n["v"] - p["v"]) * (F.col("_i") - p["_i"]) / (n["_i"] - p["_i"])
        return F.coalesce(F.col(c), F.when(p.isNotNull() & n.isNotNull(), between), p["v"], n["v"], F.col(f"_m_{c}"))

    return out.withColumns({c: value(c) for c in fields}).drop("_i", *[f"_{k}_{c}" for c in fields for k in "pnm"])


def rolling_zscore(field: str, side: int = SIDE) -> Column:
    """Against the mean and sample deviation of the rows around, cut off at the ends; 0 without deviation."""
    w = W.series().rowsBetween(-side, side)
    return F.when(F.col(field).isNotNull(), div(F.col(field) - F.avg(field).over(w), F.coalesce(F.stddev_samp(field).over(w), F.lit(0.0)), 0.0))


def _nearest_rank(field: str, p: float, side: int) -> Column:
    """sorted[int(n * p)] of the rows around; of the whole series where those are too few."""
    def pick(values: Column) -> Column:
        return F.get(F.array_sort(values), F.least(F.floor(F.size(values) * p).cast("int"), F.size(values) - 1))

    around = F.collect_list(field).over(W.series().rowsBetween(-side, side))
    return F.when(F.size(around) >= LEAST_ROWS, pick(around))


def handle_outliers(df: DataFrame, fields: list[str], method: str = "clip", threshold: float = 3.0, side: int = SIDE) -> DataFrame:
    """Rows whose rolling z-score is beyond the threshold: dropped, clipped to it, set to the 5th or 95th percentile around, or to the median around."""
    w = W.series().rowsBetween(-side, side)
    z = {f"_z_{c}": rolling_zscore(c, side) for c in fields}
    stats = {f"_m_{c}": F.avg(c).over(w) for c in fields} | {f"_s_{c}": F.stddev_samp(c).over(w) for c in fields}
    if method == "winsorize":
        stats |= {f"_lo_{c}": _nearest_rank(c, 0.05, side) for c in fields} | {f"_hi_{c}": _nearest_rank(c, 0.95, side) for c in fields}
    if method == "median":
        stats |= {f"_med_{c}": F.percentile(c, 0.5).over(w) for c in fields}
    staged = df.withColumns(z | stats)

    def outlier(c: str) -> Column:
        return F.coalesce(F.abs(f"_z_{c}") > threshold, F.lit(False))

    helpers = [*z, *stats]
    if method == "drop":
        any_out = F.lit(False)
        for c in fields:
            any_out = any_out | outlier(c)
        return staged.filter(~any_out).drop(*helpers)
    new = {
        "clip": lambda c: F.col(f"_m_{c}") + F.signum(f"_z_{c}") * threshold * F.col(f"_s_{c}"),
        "winsorize": lambda c: F.least(F.greatest(F.col(c), F.coalesce(f"_lo_{c}", F.col(c))), F.coalesce(f"_hi_{c}", F.col(c))),
        "median": lambda c: F.col(f"_med_{c}"),
    }[method]
    return staged.withColumns({c: F.when(outlier(c), new(c)).otherwise(F.col(c)) for c in fields}).drop(*helpers)


def valid_candle() -> Column:
    """Positive prices, a high not below the low and a volume that is not negative; what is missing is not invalid."""
    good = (F.col("high") >= F.col("low")) & (F.col("volume") >= 0)
    for c in ("open", "high", "low", "close"):
        good = good & (F.col(c) > 0)
    return F.coalesce(good, F.lit(True))


def cleaned(df: DataFrame, fields: list[str], order: tuple[str, ...], fill: str = "linear", outliers: str = "clip", threshold: float = 3.0, keys=(*W.SERIES, "ts")) -> tuple[DataFrame, Callable[[], dict[str, int]]]:
    """Candles without invalid rows and repeated times (the first by `order` stays), gaps filled and outliers handled, and a function that gives the counters.

    The counters are metrics that ride along in the one pass over the rows, for each step what it met: rows, invalid, duplicates,
    missing and outliers of `fields`, kept. They are there once an action has read the cleaned rows to their end;
    the function waits for the first one. A table that is read by two actions is counted by the first. Parts that are
    worked out again after an executor is lost may count twice.
    """
    taken, unique, met, left = (Observation(f"{n}-{uuid.uuid4().hex}") for n in ("taken", "unique", "met", "left"))
    rows = df.observe(taken, F.count(F.lit(1)).alias("rows"), F.count_if(~valid_candle()).alias("invalid"))
    rows = drop_duplicates(rows.filter(valid_candle()), keys, order)
    gaps = sum((F.count_if(F.col(c).isNull() | F.isnan(c)) for c in fields), F.lit(0))
    rows = fill_missing(rows.observe(unique, F.count(F.lit(1)).alias("unique"), gaps.alias("missing")), fields, fill)
    flags = {f"_out_{c}": F.coalesce(F.abs(rolling_zscore(c)) > threshold, F.lit(False)) for c in fields}
    seen = rows.withColumns(flags).observe(met, sum((F.count_if(f) for f in flags), F.lit(0)).alias("outliers"))
    out = handle_outliers(seen, fields, outliers, threshold).drop(*flags).observe(left, F.count(F.lit(1)).alias("kept"))

    def counters() -> dict[str, int]:
        found = taken.get | unique.get | met.get | left.get
        return {"rows": found["rows"], "invalid": found["invalid"], "duplicates": found["rows"] - found["invalid"] - found["unique"], **{k: found[k] for k in ("missing", "outliers", "kept")}}

    return out, counters
