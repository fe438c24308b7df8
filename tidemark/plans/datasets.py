"""Whole plans made of the operators: features, labels and splits to a training table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import asof, cleaning, indicators, labels, patterns, price, quality, recursive, resample, scaling, splits

GROUPS = {
    "price": price.price_features, "returns": price.return_features, "candle": price.candle_features, "patterns": patterns.pattern_flags, "averages": indicators.moving_averages,
    "momentum": indicators.momentum, "channels": indicators.channels, "volatility": indicators.volatility, "ichimoku": indicators.ichimoku, "volume": indicators.volume_flow, "structure": indicators.structure,
    "regime": indicators.regime, "gauge": indicators.volatility_gauge, "calendar": indicators.calendar, "sessions": indicators.sessions, "micro": indicators.microstructure,
    "rsi": recursive.rsi, "macd": recursive.macd, "adx": recursive.adx, "atr": recursive.atr, "keltner": recursive.keltner, "supertrend": recursive.supertrend,
}


def features(candles: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """Candles with the columns of the groups named, all of them if none is. Groups share one shuffle by series."""
    return reduce(DataFrame.transform, [GROUPS[g] for g in groups or GROUPS], candles)


def higher_timeframe(candles: DataFrame, timeframe: str, periods=(10,)) -> DataFrame:
    """Candles with close, return and average distance of a longer timeframe, as of the last bar of it that has ended."""
    bars = resample.by_calendar(candles, timeframe)
    known = indicators.moving_averages(price.return_features(bars, ()), periods, ())
    wanted = ["close", "return_1", *[f"sma_distance_{n}" for n in periods]]
    # A bar's close is known at its end, so it is dated there.
    from ..schema import TIMEFRAMES

    ended = known.select("symbol", F.timestamp_add("SECOND", F.lit(TIMEFRAMES[timeframe]), F.col("ts")).alias("ts"), *wanted)
    return asof.asof_join(candles, ended, ["symbol"], columns=wanted, prefix=f"{timeframe.lower()}_").drop(f"{timeframe.lower()}_ts")


def training_table(candles: DataFrame, groups: list[str], horizon: int = 5, scale: str = "zscore", train: float = 0.7, validation: float = 0.15, embargo: int = 5) -> DataFrame:
    """Clean candles to features, label_future_return and split; rows with a null feature or label are left out, features scaled by the training rows."""
    good = quality.issues(candles, "basic").filter(F.size("issues") == 0).drop("issues")
    made = features(cleaning.fill_missing(good, ["open", "high", "low", "close"], "forward"), groups)
    new = [c for c in made.columns if c not in candles.columns and dict(made.dtypes)[c] == "double"]
    rows = made.withColumn("label", labels.future_return(horizon)).dropna("any", subset=[*new, "label"])
    parted = splits.chronological(rows, train, validation, embargo)
    return scaling.scale_splits(parted, new, method=scale).select("symbol", "timeframe", "ts", "split", *new, "label")
