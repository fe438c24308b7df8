"""Bars of other sizes: by calendar, by number of bars, and by traded volume."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import windows as W
from ..functions.scalars import div
from ..schema import TIMEFRAMES, seconds_between
from .recursive import volume_group

OHLC = ("open", "high", "low", "close")


def _bars(grouped, method: str, order: str = "ts") -> DataFrame:
    """Aggregates of one group: `ohlc`, `weighted` (open and close weighted by volume), `mean` or `first`."""
    volume = F.sum("volume").alias("volume")
    if method == "ohlc":
        prices = [F.min_by("open", order), F.max("high"), F.min("low"), F.max_by("close", order)]
    elif method == "weighted":
        total = F.sum("volume")
        prices = [div(F.sum(F.col("open") * F.col("volume")), total), F.max("high"), F.min("low"), div(F.sum(F.col("close") * F.col("volume")), total)]
    elif method == "mean":
        prices = [F.avg(c) for c in OHLC]
    elif method == "first":
        prices, volume = [F.min_by(c, order) for c in OHLC], F.min_by("volume", order).alias("volume")
    else:
        raise ValueError(f"unknown method {method!r}")
    return grouped.agg(*[p.alias(c) for p, c in zip(prices, OHLC, strict=True)], volume, F.min(order).alias("_first"), F.count(F.lit(1)).alias("bars"))


def by_calendar(candles: DataFrame, timeframe: str, method: str = "ohlc") -> DataFrame:
    """Bars on a fixed grid from the epoch; empty ones do not appear. One partial aggregation and one shuffle by bar."""
    size = TIMEFRAMES[timeframe]
    start = F.timestamp_seconds(F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / size) * size).cast(candles.schema["ts"].dataType)
    out = _bars(candles.groupBy("symbol", F.lit(timeframe).alias("timeframe"), start.alias("_bar")), method)
    return out.drop("_first").withColumnRenamed("_bar", "ts")


def by_count(candles: DataFrame, source: str, target: str, method: str = "ohlc") -> DataFrame:
    """Every target / source bars in a row make one, whatever gaps lie between them; it has the first one's time.

    A target that is not longer than the source leaves the candles as they are.
    """
    n = TIMEFRAMES[target] // TIMEFRAMES[source]
    if TIMEFRAMES[target] <= TIMEFRAMES[source]:
        return candles.withColumn("bars", F.lit(1).cast("long"))
    numbered = candles.withColumn("_group", F.floor((F.row_number().over(W.series()) - 1) / n))
    out = _bars(numbered.groupBy("symbol", "_group"), method)
    return out.select("symbol", F.lit(target).alias("timeframe"), F.col("_first").alias("ts"), *OHLC, "volume", "bars")


def by_volume(candles: DataFrame, threshold: float) -> DataFrame:
    """Bars that close when their volume reaches the threshold; prices are means; a remainder at the end is a bar too."""
    out = _bars(volume_group(candles, threshold).groupBy(*W.SERIES, "volume_group"), "mean")
    return out.withColumnRenamed("_first", "ts").withColumn("volume_group", F.col("volume_group").cast("long"))


def detected_timeframe(candles: DataFrame, keys=("symbol",), sample: int = 100, tolerance: float = 0.3) -> DataFrame:
    """Per series the timeframe nearest to the mean positive gap of its first `sample` gaps; null if none is within the tolerance."""
    w = Window.partitionBy(*keys).orderBy("ts")
    gaps = candles.select(*keys, "ts").withColumns({"_gap": seconds_between(F.lag("ts").over(w), F.col("ts")), "_i": F.row_number().over(w)})
    mean = gaps.filter((F.col("_i") <= sample + 1) & (F.col("_gap") > 0)).groupBy(*keys).agg(F.avg("_gap").alias("mean_gap"))
    best = F.array_min(F.array(*[F.struct((F.abs(F.col("mean_gap") - s) / s).alias("off"), F.lit(n).alias("name")) for n, s in TIMEFRAMES.items()]))
    return mean.withColumn("_best", best).select(*keys, "mean_gap", F.when(F.col("_best.off") <= tolerance, F.col("_best.name")).alias("timeframe"))


def interpolated(candles: DataFrame, source: str, target: str, method: str = "linear") -> DataFrame:
    """Shorter bars between neighbouring ones: closes `linear` in time, or held by `forward` or `backward`. Extends each gap, not past the last bar."""
    step, size = TIMEFRAMES[target], TIMEFRAMES[source]
    rows = candles.select(*W.SERIES, "ts", "close").withColumns({"_next": F.lead("close").over(W.series()), "_until": F.lead("ts").over(W.series())})
    n = F.when(F.col("_until").isNull(), 1).otherwise(F.greatest(F.lit(1), F.floor(seconds_between(F.col("ts"), F.col("_until")) / step)))
    spread = rows.withColumn("_n", n.cast("int")).withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    share = F.col("_k") / F.col("_n")
    value = {"linear": F.col("close") + (F.coalesce("_next", "close") - F.col("close")) * share, "forward": F.col("close"), "backward": F.when(F.col("_k") == 0, F.col("close")).otherwise(F.col("_next"))}[method]
    return spread.select("symbol", F.lit(target).alias("timeframe"), F.timestamp_add("SECOND", F.col("_k") * step, F.col("ts")).alias("ts"), value.alias("close"), (F.lit(size) / step).alias("per_source"))


def ticks_to_bars(ticks: DataFrame, size: Column | str, price: str = "last", order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """Bars of ticks (symbol, ts, price) by any grouping column of `ticks`."""
    at = F.struct(*order)
    return ticks.groupBy("symbol", size).agg(F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"), F.count(F.lit(1)).alias("ticks"))
