"""Reading candles and ticks from files and writing tables."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import parse_time
from ..functions.symbols import asset_class, canonical

#: Names that a column of candles or ticks may have in a file, by the name that it has here.
SYNONYMS = {
    "symbol": "symbol ticker instrument", "timeframe": "timeframe tf period interval", "ts": "ts timestamp time datetime date", "open": "open o", "high": "high h", "low": "low l",
    "close": "close c last", "volume": "volume vol v tick_volume tickvol", "spread": "spread", "bid": "bid", "ask": "ask", "broker": "broker broker_name source",
}
NUMBERS = ("open", "high", "low", "close", "volume", "spread", "bid", "ask")
FILE_NAME = r"([^/]+?)_([A-Z]+[0-9]+)\.[A-Za-z]+$"


def _bare(name: str) -> str:
    return name.strip().strip("<>").lower().replace(" ", "_")


def normalized(raw: DataFrame, wanted: tuple[str, ...], keep: tuple[str, ...] = ()) -> DataFrame:
    """Columns `wanted`, found by their synonyms and cast; one that is missing is null, a missing volume 0. Separate date and time columns are joined."""
    have = {_bare(c): c for c in raw.columns}

    def found(name: str) -> str | None:
        return next((have[s] for s in SYNONYMS[name].split() if s in have), None)

    def column(name: str) -> Column:
        source = found(name)
        if name == "ts":
            if "date" in have and "time" in have:
                return parse_time(F.concat_ws(" ", F.col(f"`{have['date']}`").cast("string"), F.col(f"`{have['time']}`").cast("string")))
            if source is None:
                return F.lit(None).cast("timestamp")
            return F.col(f"`{source}`").cast("timestamp") if isinstance(raw.schema[source].dataType, (T.TimestampType, T.TimestampNTZType)) else parse_time(F.col(f"`{source}`").cast("string"))
        if source is None:
            return F.lit(0.0 if name == "volume" else None).cast("double" if name in NUMBERS else "string")
        c = F.col(f"`{source}`")
        if name in NUMBERS:
            number = c.try_cast("double")
            return F.coalesce(number, F.lit(0.0)) if name == "volume" else number
        return c.cast("string")

    return raw.select(*[column(n).alias(n) for n in wanted], *keep)


def candle_files(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """Candles of all CSV files below `path`: symbol and timeframe from columns, or from a name like EURUSD_M15.csv; `canonical` beside them.

    Rows without a time or a close are left out.
    """
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").option("header", "true").option("sep", delimiter).option("enforceSchema", "false").csv(path)
    named = raw.withColumns({"_symbol": F.nullif(F.regexp_extract("_metadata.file_path", FILE_NAME, 1), F.lit("")), "_timeframe": F.nullif(F.regexp_extract("_metadata.file_path", FILE_NAME, 2), F.lit(""))})
    rows = normalized(named, ("symbol", "timeframe", "ts", "open", "high", "low", "close", "volume", "spread"), keep=("_symbol", "_timeframe"))
    rows = rows.withColumns({"symbol": F.coalesce("symbol", "_symbol"), "timeframe": F.coalesce("timeframe", "_timeframe")}).drop("_symbol", "_timeframe")
    return rows.filter(F.col("ts").isNotNull() & F.col("close").isNotNull()).withColumn("canonical", canonical(F.col("symbol")))


def tick_files(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """Ticks (symbol, ts, bid, ask, last, volume) of all CSV files below `path`, the symbol from a column or from a name like EURUSD_T1.csv.

    Rows without a time, or without any price, are left out; without a last price, the middle of bid and ask is taken.
    """
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").option("header", "true").option("sep", delimiter).option("enforceSchema", "false").csv(path)
    named = raw.withColumn("_symbol", F.nullif(F.regexp_extract("_metadata.file_path", FILE_NAME, 1), F.lit("")))
    rows = normalized(named, ("symbol", "ts", "bid", "ask", "close", "volume"), keep=("_symbol",))
    last = F.coalesce("close", (F.col("bid") + F.col("ask")) / 2, "bid", "ask")
    return rows.select(F.coalesce("symbol", "_symbol").alias("symbol"), "ts", "bid", "ask", last.alias("last"), "volume").filter(F.col("ts").isNotNull() & F.col("last").isNotNull())


def symbols(candles: DataFrame, pairs_only: bool = False) -> DataFrame:
    """Distinct symbols with their canonical name and class; only currency pairs if asked."""
    out = candles.select("symbol").distinct().withColumns({"canonical": canonical(F.col("symbol")), "asset_class": asset_class(canonical(F.col("symbol")))})
    return out.filter(F.col("asset_class") == "FOREX") if pairs_only else out


def available(candles: DataFrame) -> DataFrame:
    """First and last time of each series."""
    return candles.groupBy("symbol", "timeframe").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def book_volumes(candles: DataFrame, metadata: str = "metadata") -> DataFrame:
    """bid_volume and ask_volume, from columns of these names or from the JSON text `metadata`."""
    def column(name: str) -> Column:
        own = F.col(name) if name in candles.columns else F.lit(None).cast("double")
        other = F.get_json_object(metadata, f"$.{name}").try_cast("double") if metadata in candles.columns else F.lit(None).cast("double")
        return F.coalesce(own, other)

    return candles.withColumns({c: column(c) for c in ("bid_volume", "ask_volume")})


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    """Parquet, by partition; with partitions, an overwrite replaces only those that `df` has. Rows are dealt by partition first, so each has few files."""
    dealt = df.repartition(*partition_by) if partition_by else df
    writer = dealt.write.mode(mode).option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def only_new(source: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `source` later than the last stored time of their series; all rows of a series that is not stored. The bound is one row a series."""
    last = stored.groupBy(*keys).agg(F.max("ts").alias("_last"))
    both = source.join(last, keys, "left")
    return both.filter(F.col("_last").isNull() | (F.col("ts") > F.col("_last"))).drop("_last")


def sync_status(stored: DataFrame, keys: list[str]) -> DataFrame:
    """Per series: last time, rows, and status."""
    return stored.groupBy(*keys).agg(F.max("ts").alias("last_candle_time"), F.count(F.lit(1)).alias("candles_count")).withColumn("status", F.lit("complete"))


def save_state(state: DataFrame, path: str) -> None:
    """A fitted state (one row for each column) as JSON."""
    state.coalesce(1).write.mode("overwrite").json(path)


def load_state(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def sources_from(spark: SparkSession, config: str) -> dict[str, DataFrame]:
    """Named candle sources of a JSON configuration: {"name": {"kind": "csv" | "parquet", "path": ..., "delimiter": ...}}."""
    out = {}
    for name, entry in json.loads(config).items():
        if entry["kind"] == "csv":
            out[name] = candle_files(spark, entry["path"], entry.get("delimiter", ","))
        elif entry["kind"] == "parquet":
            out[name] = spark.read.parquet(entry["path"])
        else:
            raise ValueError(f"unknown kind of source {entry['kind']!r}")
    return out


def report_json(df: DataFrame) -> DataFrame:
    """Each row as a JSON text: what a dashboard reads."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))
