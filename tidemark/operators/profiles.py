"""Statistical profiles of candles and of pattern outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import windows as W
from ..functions.ordered import quantiles, with_group
from ..functions.scalars import clip, div, profile_session_of


def volatility_profile(candles: DataFrame) -> DataFrame:
    """Per series, of true range / close: mean, median, sample deviation, extremes and interpolated quartiles."""
    x = candles.select(*W.SERIES, div(W.true_range(), F.col("close"), 0.0).alias("x"))
    moments = x.groupBy(*W.SERIES).agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"))
    both = with_group(moments, quantiles(x, "x", [0.25, 0.5, 0.75], W.SERIES), W.SERIES)
    p25, median, p75 = (F.get("q", F.lit(k)) for k in range(3))
    return both.select(*W.SERIES, "n", "mean", median.alias("median"), "std", "min", "max", p25.alias("p25"), p75.alias("p75"))


def session_profile(candles: DataFrame) -> DataFrame:
    """Per series and session: bars and mean volatility, volume, range and body."""
    h, l, c = F.col("high"), F.col("low"), F.col("close")
    return candles.groupBy(*W.SERIES, profile_session_of(F.hour("ts")).alias("session")).agg(
        F.count(F.lit(1)).alias("bars"), F.avg(F.when(c > 0, (h - l) / c).otherwise(0.0)).alias("volatility"), F.avg("volume").alias("volume"), F.avg(h - l).alias("range"), F.avg(F.abs(c - F.col("open"))).alias("body"),
    )


def monthly_profile(candles: DataFrame) -> DataFrame:
    """Per series and month: bars with a return, their mean, and its direction, ten times the mean within [-1, 1]."""
    r = candles.select(*W.SERIES, F.month("ts").alias("month"), div(F.col("close") - W.lag("close"), W.lag("close")).alias("r"))
    out = r.filter(F.col("r").isNotNull()).groupBy(*W.SERIES, "month").agg(F.count("r").alias("n"), F.avg("r").alias("avg_return"))
    return out.withColumn("direction_bias", clip(10 * F.col("avg_return"), -1.0, 1.0))


def pattern_profile(outcomes: DataFrame) -> DataFrame:
    """Per pattern, of outcomes (pattern, success, result, bars): success rate, mean win and loss, holding, confidence, expectancy."""
    win, lose = F.when(F.col("success"), F.col("result")), F.when(~F.col("success"), F.col("result"))
    out = outcomes.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("success").cast("double")).alias("success_rate"), F.coalesce(F.avg(win), F.lit(0.0)).alias("avg_win"), F.coalesce(F.avg(lose), F.lit(0.0)).alias("avg_loss"), F.avg("bars").alias("avg_hold"))
    rate = F.col("success_rate")
    return out.withColumns(
        {
            "confidence": F.least(F.lit(1.0), F.col("n") / 100 * rate), "expectancy": rate * F.col("avg_win") + (1 - rate) * F.col("avg_loss"),
            "win_loss_ratio": div(F.col("avg_win"), F.abs("avg_loss"), 0.0),
        }
    )


def outcomes_of(found: DataFrame, candles: DataFrame, horizon: int = 5) -> DataFrame:
    """What followed detections: the return after `horizon` bars in the pattern's direction, and whether it was positive."""
    ahead = candles.select(*W.SERIES, "ts", div(F.lead("close", horizon).over(W.series()) - F.col("close"), F.col("close")).alias("_r"))
    side = F.when(F.col("direction") == "bearish", -1.0).otherwise(1.0)
    both = found.join(ahead, [*W.SERIES, "ts"]).filter(F.col("_r").isNotNull())
    return both.select("pattern", *W.SERIES, "ts", (side * F.col("_r") > 0).alias("success"), (side * F.col("_r")).alias("result"), F.lit(horizon).alias("bars"))


def required_grid(candles: DataFrame, symbols: DataFrame, timeframes: list[str], least: int = 1) -> DataFrame:
    """Every wanted symbol and timeframe with its bars and whether they are enough."""
    grid = symbols.select("symbol").distinct().withColumn("timeframe", F.explode(F.array(*map(F.lit, timeframes))))
    have = candles.groupBy("symbol", "timeframe").agg(F.count(F.lit(1)).alias("bars"))
    return grid.join(have, ["symbol", "timeframe"], "left").fillna(0, subset=["bars"]).withColumn("enough", F.col("bars") >= least)
