"""Labels that look ahead: each is null where the series ends before its horizon."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import windows as W
from ..functions.scalars import div

METHODS = ("binary", "multiclass", "future_return", "future_high", "future_low", "future_volatility", "risk_reward", "stop_distance", "target_distance", "triple_barrier")


def future_return(h: int) -> Column:
    ahead = F.lead("close", h).over(W.series())
    return div(ahead - F.col("close"), F.col("close"))


def _ahead(column: str, h: int, agg) -> Column:
    return W.full(h, column, agg, W.following(h))


def binary(h: int, threshold: float = 0.0) -> Column:
    r = future_return(h)
    return F.when(r.isNotNull(), (r > threshold).cast("double"))


def multiclass(h: int, down: float = -0.002, up: float = 0.002) -> Column:
    """0 down, 1 flat, 2 up."""
    r = future_return(h)
    return F.when(r < down, 0.0).when(r > up, 2.0).when(r.isNotNull(), 1.0)


def future_high(h: int) -> Column:
    return div(_ahead("high", h, F.max), F.col("close")) - 1


def future_low(h: int) -> Column:
    return div(_ahead("low", h, F.min), F.col("close")) - 1


def future_volatility(df: DataFrame, h: int, name: str) -> DataFrame:
    """Population deviation of the next h one-bar returns."""
    step = div(F.col("close") - W.lag("close"), W.lag("close"))
    return df.withColumn("_step", step).withColumn(name, W.full(h, "_step", F.stddev_pop, W.following(h))).drop("_step")


def risk_reward(h: int) -> Column:
    """The largest gain over the largest loss within the horizon; null without a loss."""
    gain = F.greatest(_ahead("high", h, F.max) - F.col("close"), F.lit(0.0))
    loss = F.greatest(F.col("close") - _ahead("low", h, F.min), F.lit(0.0))
    return F.when(_ahead("low", h, F.min).isNotNull(), div(gain, loss))


def stop_distance(h: int) -> Column:
    low = _ahead("low", h, F.min)
    return F.when(low.isNotNull(), F.greatest(div(F.col("close") - low, F.col("close")), F.lit(0.0)))


def target_distance(h: int) -> Column:
    high = _ahead("high", h, F.max)
    return F.when(high.isNotNull(), F.greatest(div(high - F.col("close"), F.col("close")), F.lit(0.0)))


def triple_barrier(df: DataFrame, h: int, name: str, size: str, target: float = 2.0, stop: float = 1.0) -> DataFrame:
    """1 if a bar of the next h reaches close + target * size first, -1 if close - stop * size is; the stop counts first within a bar.

    Without either, the sign of the return at the horizon. Null where `size` is null or the horizon is not whole.
    """
    bars = F.collect_list(F.struct("high", "low")).over(W.following(h))
    staged = df.withColumns({"_bars": bars, "_last": F.lead("close", h).over(W.series()), "_top": F.col("close") + target * F.col(size), "_bottom": F.col("close") - stop * F.col(size)})
    hits = F.transform("_bars", lambda b: F.when(b["low"] <= F.col("_bottom"), -1.0).when(b["high"] >= F.col("_top"), 1.0))
    first = F.get(F.filter(hits, lambda x: x.isNotNull()), F.lit(0))
    known = (F.size("_bars") == h) & F.col(size).isNotNull()
    return staged.withColumn(name, F.when(known, F.coalesce(first, F.signum(F.col("_last") - F.col("close"))))).drop("_bars", "_last", "_top", "_bottom")


def direction_of(value: Column) -> Column:
    """1 or -1 from BUY, SELL, LONG, SHORT, UP, DOWN or a number; 0 for anything else, null for null."""
    text, number = F.upper(F.trim(value.cast("string"))), F.try_to_number(value.cast("string"), F.lit("S999999999.999999"))
    named = F.when(text.isin("BUY", "LONG", "UP"), 1.0).when(text.isin("SELL", "SHORT", "DOWN"), -1.0)
    return F.when(value.isNotNull(), F.coalesce(named, F.signum(number.cast("double")), F.lit(0.0)))


def meta_label(h: int, prediction: Column, probability: Column, least: float = 0.55) -> Column:
    """1 if the primary prediction is sure enough and its direction is that of the future return, else 0."""
    r = future_return(h)
    right = (F.signum(r) == prediction) & (prediction != 0) & (probability >= least)
    return F.when(r.isNotNull(), F.coalesce(right, F.lit(False)).cast("double"))


def generate(candles: DataFrame, methods=("binary", "multiclass", "future_return", "triple_barrier"), horizons=(1, 3, 5, 10, 20), size: str | None = None) -> DataFrame:
    """Columns label_<method>_<horizon> for every method and horizon; `size` is the column that barriers are measured in."""
    plain = {"binary": binary, "multiclass": multiclass, "future_return": future_return, "future_high": future_high, "future_low": future_low, "risk_reward": risk_reward, "stop_distance": stop_distance, "target_distance": target_distance}
    out = candles
    for method in methods:
        for h in horizons:
            name = f"label_{method}_{h}"
            if method == "future_volatility":
                out = future_volatility(out, h, name)
            elif method == "triple_barrier":
                out = triple_barrier(out, h, name, size)
            else:
                out = out.withColumn(name, plain[method](h))
    return out
