"""Tables of the data model, the timeframe dimension, and candles from ticks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: The columns of the tables, as schemas for createDataFrame and readers.
TABLES = {
    "brokers": (
        "broker_id long, broker_uuid string, name string, broker_type string, server string, host string, port long, description string, "
        "login string, password_encrypted string, status string, metadata string, created_at timestamp, updated_at timestamp"
    ),
    "currencies": (
        "currency_id long, currency_uuid string, code string, name string, currency_type string, symbol string, iso_number long, decimals long, "
        "description string, status string, metadata string, created_at timestamp, updated_at timestamp"
    ),
    "timeframes": (
        "timeframe_id long, timeframe_uuid string, name string, seconds long, sort_order long, description string, category string, status string, "
        "metadata string, created_at timestamp, updated_at timestamp"
    ),
    "markets": (
        "market_id long, broker_id long, symbol string, canonical_symbol string, market_type string, description string, base_currency string, quote_currency string, "
        "pip_size double, point double, digits long, contract_size double, name string, category string, active long, spread double, "
        "trade_mode long, status string, metadata string, created_at timestamp, updated_at timestamp"
    ),
    "symbol_aliases": (
        "alias_id long, alias string, canonical_symbol string, asset_class string, description string, status string, metadata string, created_at timestamp, "
        "updated_at timestamp"
    ),
    "candles": (
        "candle_id long, candle_uuid string, symbol string, timeframe string, timestamp timestamp, open double, high double, low double, "
        "close double, volume double, market_id long, broker_id long, spread double, tick_volume long, status string, metadata string, "
        "created_at timestamp, updated_at timestamp"
    ),
    "ticks": (
        "tick_id long, tick_uuid string, symbol string, timestamp timestamp, bid double, ask double, last double, volume double, "
        "flags long, market_id long, broker_id long, status string, metadata string, created_at timestamp, updated_at timestamp"
    ),
    "sync_status": (
        "market_id long, timeframe string, status string, last_synced timestamp, last_candle_time timestamp, candles_count long, error_message string"
    ),
}
#: Columns that tell rows of a table apart.
KEYS = {
    "brokers": ["name"], "currencies": ["code"], "timeframes": ["name"], "markets": ["broker_id", "symbol"], "symbol_aliases": ["alias"],
    "candles": ["broker_id", "symbol", "timeframe", "timestamp"], "ticks": ["broker_id", "symbol", "timestamp", "bid", "ask"], "sync_status": ["market_id", "timeframe"],
}

#: Timeframes and their seconds, from short to long. A month is thirty days.
TIMEFRAMES = {"M1": 60, "M5": 300, "M15": 900, "M30": 1800, "H1": 3600, "H4": 14400, "D1": 86400, "W1": 604800, "MN1": 2592000}


def timeframes(spark: SparkSession) -> DataFrame:
    """(name, seconds, sort_order): nine rows."""
    return spark.createDataFrame([(n, s, k) for k, (n, s) in enumerate(TIMEFRAMES.items(), 1)], "name string, seconds long, sort_order long")


def seconds_of(timeframe: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in TIMEFRAMES.items() for x in pair]), timeframe).cast("long")


def seconds_between(a: Column, b: Column) -> Column:
    """Whole seconds from a to b, whatever kind of timestamp they are."""
    return F.timestamp_diff("SECOND", a, b)


def finite(c: Column) -> Column:
    """Null for NaN and infinities: missing values are null throughout."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def candles(ticks: DataFrame, unit: str = "hour", timeframe: str = "H1", price: str = "last", order: tuple[str, ...] = ("ts",), volume: str | None = None) -> DataFrame:
    """Calendar bars of `ticks` (symbol, ts, price): one partial aggregation per task and one shuffle by bar."""
    at = F.struct(*order)
    return ticks.groupBy("symbol", F.lit(timeframe).alias("timeframe"), F.date_trunc(unit, "ts").cast(ticks.schema["ts"].dataType).alias("bar")).agg(
        F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"),
        (F.count(F.lit(1)).cast("double") if volume is None else F.sum(volume)).alias("volume"),
    ).withColumnRenamed("bar", "ts")
