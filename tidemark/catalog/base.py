"""How queries are registered: a Spark function, the columns that it returns, and SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import TIMEFRAMES, candles

Query = Callable[[SparkSession, str], DataFrame]
#: Moves values off the middle between two sixth decimals, which prices of two decimals often have as their mean.
OFF_HALF = 1.7e-9
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: Common table expressions of the data model over the given tables.
TICKS_SQL = "ticks AS (SELECT event_id, event_type AS symbol, ts, value AS last, user_id % 2 AS side FROM events)"
CANDLES_SQL = TICKS_SQL + """,
candles AS (SELECT symbol, 'H1' AS timeframe, date_trunc('hour', ts) AS ts, first(last ORDER BY ts, event_id) AS open, max(last) AS high, min(last) AS low,
  last(last ORDER BY ts, event_id) AS close, count(*)::DOUBLE AS volume FROM ticks GROUP BY symbol, date_trunc('hour', ts))"""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("symbol"), "ts", F.col("value").alias("last"), (F.col("user_id") % 2).alias("side"))


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candles(ticks(spark, sf_dir), order=("ts", "event_id"))


def query(name: str, sql: str | None = None, keys: str = "", values: str = "", times: str = ""):
    """Registers a query. `keys` come as they are, `times` as text to the second, `values` as doubles of six decimals."""

    def register(f: Query) -> Query:
        k, v, t = keys.split(), values.split(), times.split()

        def shown(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            if not (k or v or t):
                return df
            return df.select(*k, *[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in t], *[(F.round(F.col(c).cast("double") + OFF_HALF, 6) + 0.0).alias(c) for c in v])

        QUERIES[name] = shown
        if sql:
            columns = [*k, *[f"strftime({c}, '%Y-%m-%d %H:%M:%S') AS {c}" for c in t], *[f"round({c}::DOUBLE + {OFF_HALF}, 6) + 0.0 AS {c}" for c in v]]
            ORACLE_SQL[name] = f"SELECT {', '.join(columns)} FROM ({sql})" if columns else sql
        return shown

    return register


TIMEFRAMES_SQL = "tf AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', {s}, {k})" for k, (n, s) in enumerate(TIMEFRAMES.items(), 1)) + ") t(name, seconds, sort_order))"

#: Pieces of SQL over series of candles.
SERIES_SQL = "PARTITION BY symbol, timeframe ORDER BY ts"


def over(n: int) -> str:
    """A window of the last n rows."""
    return f"({SERIES_SQL} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def full_sql(agg: str, x: str, n: int) -> str:
    return f"CASE WHEN count({x}) OVER {over(n)} = {n} THEN {agg}({x}) OVER {over(n)} END"


def lag_sql(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) OVER ({SERIES_SQL})"


def with_candles(body: str, more: str = "") -> str:
    return f"WITH {CANDLES_SQL}{', ' + more if more else ''} {body}"


def trades_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as trades: result r, by return flag, in the order of shipping."""
    t = read(spark, sf_dir, "lineitem")
    return t.select("l_returnflag", "l_shipdate", "l_orderkey", "l_linenumber", (F.col("l_extendedprice") * (F.col("l_discount") - 0.05)).alias("r"))


TRADES_SQL = "trades AS (SELECT l_returnflag, l_shipdate, l_orderkey, l_linenumber, l_extendedprice * (l_discount - 0.05) AS r FROM lineitem)"


def predictions_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels and documents as predictions: y is the quality, s a score from the length of the text, p its class."""
    d, labels = read(spark, sf_dir, "documents").select("doc_id", "n_chars"), read(spark, sf_dir, "labels")
    s = F.least(F.lit(1.0), F.floor(F.col("n_chars") / 40.0) / 100.0)
    return labels.join(d, "doc_id").select("doc_id", F.col("quality").alias("y"), s.alias("s"), (s >= 0.5).cast("int").alias("p"))


PREDICTIONS_SQL = "pred AS (SELECT doc_id, quality AS y, least(1.0, floor(n_chars / 40.0) / 100.0) AS s, (least(1.0, floor(n_chars / 40.0) / 100.0) >= 0.5)::INT AS p FROM labels JOIN documents USING (doc_id))"
