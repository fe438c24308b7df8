"""Joins across sources: instruments by canonical symbol, close comparison, and merges of two or more tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import div
from .asof import asof_join, interpolated_join

STRATEGIES = {"inner": "inner", "left": "left", "right": "right", "outer": "full", "cross": "cross"}
#: What alignments are called: `forward` takes the row before, which is carried forward; `backward` the row after.
ALIGNMENTS = {"nearest": "nearest", "forward": "backward", "backward": "forward", "exact": "exact"}


def instruments(markets: DataFrame, brokers: DataFrame, least: int = 2) -> DataFrame:
    """Per canonical symbol: its class, number of brokers and their markets (sorted), of those that `least` brokers have."""
    both = markets.join(brokers.select("broker_id", F.col("name").alias("broker")), "broker_id", "left")
    grouped = both.groupBy("canonical_symbol").agg(
        F.min(F.coalesce("asset_class", F.lit("UNKNOWN"))).alias("asset_class"), F.count_distinct("broker_id").alias("n_brokers"),
        F.array_sort(F.collect_set(F.concat_ws(":", F.coalesce("broker", F.lit("")), "symbol"))).alias("markets"),
    )
    return grouped.filter(F.col("n_brokers") >= least)


def compare_closes(candles: DataFrame, a: str, b: str, broker: str = "broker", keys=("symbol", "timeframe", "ts")) -> DataFrame:
    """Closes of the same bar at two brokers, with diff and diff_bps against their middle."""
    left = candles.filter(F.col(broker) == a).select(*keys, F.col("close").alias("close_a"))
    right = candles.filter(F.col(broker) == b).select(*keys, F.col("close").alias("close_b"))
    both = left.join(right, list(keys)).withColumn("diff", F.col("close_a") - F.col("close_b"))
    return both.withColumn("diff_bps", div(F.col("diff") * 10_000, (F.col("close_a") + F.col("close_b")) / 2))


def merge(left: DataFrame, right: DataFrame, key: str, strategy: str = "inner", suffix: str = "_right") -> DataFrame:
    """Joins on one key, null meeting null; columns of `right` that `left` has too get the suffix, the key is that of either side.

    `cross` pairs every row with every row, whatever the keys, and keeps the left one: for tables of a few rows, such as settings.
    """
    names = {c: f"{c}{suffix}" if c in left.columns else c for c in right.columns if c != key}
    other = right.select(F.col(key).alias("_key"), *[F.col(c).alias(n) for c, n in names.items()])
    if strategy == "cross":
        return left.crossJoin(other.drop("_key"))
    both = left.join(other, F.col(key).eqNullSafe(F.col("_key")), STRATEGIES[strategy])
    return both.select(F.coalesce(F.col(key), F.col("_key")).alias(key), *[c for c in left.columns if c != key], *names.values())


def merge_aligned(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str], align: str = "nearest", strategy: str = "left", ts: str = "ts", tolerance: int | None = None) -> DataFrame:
    """Aligns `right` to the times of `left` (nearest, forward, backward, exact or interpolate), then keeps all rows or, with inner, matched ones."""
    if align == "interpolate":
        out = interpolated_join(left, right, keys, columns, ts)
    else:
        out = asof_join(left, right, keys, ts, ALIGNMENTS[align], tolerance, columns=columns)
    return out if strategy == "left" else out.dropna("all", subset=[f"right_{c}" for c in columns])


def merge_all(tables: dict[str, DataFrame], key: str, strategy: str = "inner") -> DataFrame:
    """Joins all tables on one key; every other column gets its table's name in front."""
    named = [df.select(key, *[F.col(c).alias(f"{name}_{c}") for c in df.columns if c != key]) for name, df in tables.items()]
    return reduce(lambda a, b: merge(a, b, key, strategy), named)


def key_overlap(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: keys of each side, shared ones, those of one side only, and rows whose key is there already."""
    counts = [df.groupBy(key).agg(F.count(F.lit(1)).alias(n)).withColumnRenamed(key, f"_{n}") for df, n in ((left, "l"), (right, "r"))]
    both = counts[0].join(counts[1], F.col("_l").eqNullSafe(F.col("_r")), "full")
    has_l, has_r = F.col("l").isNotNull(), F.col("r").isNotNull()
    return both.agg(
        F.count_if(has_l).alias("left_keys"), F.count_if(has_r).alias("right_keys"), F.count_if(has_l & has_r).alias("shared_keys"),
        F.count_if(has_l & ~has_r).alias("left_only"), F.count_if(~has_l & has_r).alias("right_only"),
        F.coalesce(F.sum(F.col("l") - 1), F.lit(0)).alias("left_duplicates"), F.coalesce(F.sum(F.col("r") - 1), F.lit(0)).alias("right_duplicates"),
    )


def inventory(candles: DataFrame, kind: Column) -> DataFrame:
    """Bars, first and last time by class, symbol and timeframe."""
    return candles.groupBy(kind.alias("asset_class"), "symbol", "timeframe").agg(F.count(F.lit(1)).alias("bars"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def features_with_labels(features: DataFrame, labels: DataFrame, columns: list[str], horizon_end: Column | None = None, keys=("symbol", "timeframe", "ts")) -> DataFrame:
    """Joins features and labels on series and time and keeps rows whose `columns` are all there."""
    both = features.join(labels, list(keys)).dropna("any", subset=columns)
    return both if horizon_end is None else both.filter(horizon_end)


def pending(queue: DataFrame, requests: DataFrame, keys=("symbol", "timeframe")) -> DataFrame:
    """`queue` with the requests that are not in it; of equal requests, the one with the smallest priority number."""
    first = requests.groupBy(*keys).agg(F.min("priority").alias("priority"))
    return queue.select(*keys, "priority").unionByName(first.join(queue.select(*keys).distinct(), list(keys), "left_anti"))
