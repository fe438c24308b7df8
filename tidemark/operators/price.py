"""Price, return and candle features: each function adds columns to candles (symbol, timeframe, ts, open, high, low, close, volume)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import windows as W
from ..functions.scalars import div


def flag(c):
    """1.0 or 0.0, null being 0.0."""
    return F.coalesce(c, F.lit(False)).cast("double")


def warm_flag(c):
    """1.0 or 0.0; null while it is not known."""
    return c.cast("double")


def price_features(candles: DataFrame) -> DataFrame:
    """Mid prices, range, body, close position (0.5 in a flat bar), gap to the last close."""
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    before = W.lag("close")
    return candles.withColumns(
        {
            "price_hl2": (h + l) / 2, "price_hlc3": (h + l + c) / 3, "price_ohlc4": (o + h + l + c) / 4,
            "price_range": h - l, "price_range_pct": div(h - l, c), "price_body": c - o, "price_body_pct": div(c - o, o),
            "price_close_position": div(c - l, h - l, 0.5), "price_gap": o - before, "price_gap_pct": div(o - before, before),
            "price_typical_volume": (h + l + c) / 3 * F.col("volume"),
        }
    )


def return_features(candles: DataFrame, windows=(5, 20)) -> DataFrame:
    """One-bar returns, and per window: return, log return, realised and Parkinson volatility, mean return."""
    first = candles.withColumns(
        {
            "return_1": W.returns("close"), "log_return_1": W.log_returns("close"),
            "return_open_close": div(F.col("close") - F.col("open"), F.col("open")), "return_high_low": div(F.col("high") - F.col("low"), F.col("low")),
        }
    )
    squared = F.when((F.col("high") > 0) & (F.col("low") > 0), F.pow(F.ln(F.col("high") / F.col("low")), F.lit(2.0)))
    # The first return has no base, so it does not count in means.
    counted = F.when(W.lag("close").isNotNull(), F.col("return_1"))
    first = first.withColumns({"_hl": squared, "_r": counted})
    for n in windows:
        first = first.withColumns(
            {
                f"return_{n}": W.returns("close", n), f"log_return_{n}": W.log_returns("close", n),
                f"realized_volatility_{n}": W.std("log_return_1", n) * math.sqrt(n), f"return_mean_{n}": W.mean("_r", n),
                f"parkinson_volatility_{n}": F.sqrt(W.mean("_hl", n) / (4 * math.log(2))),
            }
        )
    return first.drop("_hl", "_r")


def candle_features(candles: DataFrame) -> DataFrame:
    """Bodies, wicks, their ratios and places, direction flags, gaps and true gaps, spread."""
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    size, body = h - l, F.abs(c - o)
    upper, lower = h - F.greatest(o, c), F.least(o, c) - l
    before = W.lag("close")
    spread = F.coalesce(F.col("spread"), F.lit(0.0)) if "spread" in candles.columns else F.lit(0.0)
    return candles.withColumns(
        {
            "candle_body": body, "candle_signed_body": c - o, "candle_body_pct": div(c - o, o), "candle_range": size, "candle_range_pct": div(size, c),
            "candle_upper_wick": upper, "candle_lower_wick": lower, "candle_upper_wick_ratio": div(upper, size), "candle_lower_wick_ratio": div(lower, size),
            "candle_body_ratio": div(body, size), "candle_close_location": div(c - l, size, 0.5), "candle_open_location": div(o - l, size, 0.5),
            "candle_is_bullish": flag(c > o), "candle_is_bearish": flag(c < o), "candle_is_neutral": flag(c == o), "candle_is_doji": flag(div(body, size, 0.0) <= 0.1),
            "candle_gap": o - before, "candle_gap_pct": div(o - before, before), "candle_gap_up": flag(o > before), "candle_gap_down": flag(o < before),
            "candle_true_gap_up": flag(l > W.lag("high")), "candle_true_gap_down": flag(h < W.lag("low")),
            "candle_spread": spread, "candle_spread_pct": div(spread, c),
        }
    )


def candle_vector(candles: DataFrame) -> DataFrame:
    """`vector`: direction, body, upper and lower wick as shares of the range, and the close's place in it."""
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    size = h - l
    return candles.withColumn(
        "vector",
        F.array(F.signum(c - o), div(F.abs(c - o), size, 0.0), div(h - F.greatest(o, c), size, 0.0), div(F.least(o, c) - l, size, 0.0), div(c - l, size, 0.5)),
    )


def basic_features(candles: DataFrame, n: int = 20) -> DataFrame:
    """The smaller feature set: volume ratio, window VWAP, momentum and moments with partial windows (two rows at least).

    Moments take the sample deviation; returns and momentum are 0 where there is no base.
    """
    w = W.last(n)
    mean, std, rows = F.avg("close").over(w), F.stddev_samp("close").over(w), F.count("close").over(w)
    held = F.collect_list("close").over(w)
    staged = candles.withColumns({"_mean": mean, "_std": std, "_n": rows, "_held": held})

    def moment(k: int):
        return F.aggregate("_held", F.lit(0.0), lambda s, x: s + F.pow((x - F.col("_mean")) / F.col("_std"), F.lit(float(k)))) / F.col("_n")

    fits = (F.col("_n") >= 2) & (F.col("_std") > 0)
    flat = {f"flat_return_{k}": F.coalesce(W.returns("close", k), F.lit(0.0)) for k in (1, 5, 20)}
    return staged.withColumns(
        {
            "window_mean": F.col("_mean"), "window_std": F.when(F.col("_n") >= 2, F.col("_std")).otherwise(0.0),
            "window_skew": F.when(fits, moment(3)).otherwise(0.0), "window_kurtosis": F.when(fits, moment(4) - 3).otherwise(0.0),
            "window_volume_ratio": div(F.col("volume"), F.avg("volume").over(w), 1.0),
            "window_vwap": div(F.sum(F.col("close") * F.col("volume")).over(w), F.sum("volume").over(w)),
            "flat_momentum": F.coalesce(F.col("close") - W.lag("close", n), F.lit(0.0)), **flat,
        }
    ).drop("_mean", "_std", "_n", "_held")


def finite_columns(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Infinities and NaN of double columns become null."""
    names = columns or [f.name for f in df.schema.fields if f.dataType.simpleString() in ("double", "float")]
    return df.withColumns({c: F.when(~F.isnan(c) & (F.abs(F.col(c)) != float("inf")), F.col(c)) for c in names})


def fill(df: DataFrame, columns: list[str], method: str = "ffill") -> DataFrame:
    """none, drop (rows with a null), zero, mean (of the series), ffill (then bfill, then 0) or bfill (then ffill, then 0)."""
    if method == "none":
        return df
    if method == "drop":
        return df.dropna("any", subset=columns)
    if method == "zero":
        return df.fillna(0.0, subset=columns)
    if method == "mean":
        from pyspark.sql import Window

        return df.withColumns({c: F.coalesce(F.col(c), F.avg(c).over(Window.partitionBy(*W.SERIES)), F.lit(0.0)) for c in columns})
    if method not in ("ffill", "bfill"):
        raise ValueError(f"unknown fill method {method!r}")
    pair = (W.forward_fill, W.backward_fill) if method == "ffill" else (W.backward_fill, W.forward_fill)
    return df.withColumns({c: F.coalesce(pair[0](c), pair[1](c), F.lit(0.0)) for c in columns})
