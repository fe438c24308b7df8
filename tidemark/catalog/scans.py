"""Queries of scans, filters, changes and lookups."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.symbols import CURRENCIES, identity, normalized, valid_symbol
from ..operators import repository as R
from ..operators import resample
from ..schema import timeframes
from .base import TIMEFRAMES_SQL, hourly, query, read, ticks, with_candles

@query("candles_hourly", with_candles("SELECT symbol, ts, open, high, low, close, volume FROM candles"), "symbol", "open high low close volume", "ts")
def candles_hourly(spark, d):
    return hourly(spark, d)


@query("filter_dnf", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE (o_orderstatus = 'F' AND o_totalprice > 300000) OR (o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_totalprice BETWEEN 1000 AND 50000) OR (o_orderpriority LIKE '5%' AND o_custkey IS NULL)", "o_orderkey o_orderstatus", "o_totalprice")
def filter_dnf(spark, d):
    groups = [
        [("o_orderstatus", "=", "F"), ("o_totalprice", ">", 300000)],
        [("o_orderpriority", "IN", ["1-URGENT", "2-HIGH"]), ("o_totalprice", "BETWEEN", (1000, 50000))],
        [("o_orderpriority", "LIKE", "5%"), ("o_custkey", "IS NULL")],
    ]
    return read(spark, d, "orders").filter(R.any_of(groups))


@query("range_scan", "SELECT event_id, event_type AS symbol, value FROM events WHERE event_type = 'click' AND ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-06'", "event_id symbol", "value")
def range_scan(spark, d):
    return R.in_range(ticks(spark, d), symbol="click", start="2024-01-05", end="2024-01-06").withColumnRenamed("last", "value")


@query("latest_per_symbol", with_candles("SELECT symbol, ts, close FROM candles QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1"), "symbol", "close", "ts")
def latest_per_symbol(spark, d):
    return R.latest(hourly(spark, d))


@query("latest_n", with_candles("SELECT symbol, ts, close FROM candles QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 5"), "symbol", "close", "ts")
def latest_n(spark, d):
    return R.latest(hourly(spark, d), 5)


@query("latest_of_symbols", with_candles("SELECT w.wanted, c.ts, c.close FROM (VALUES ('CLICK'), ('VIEW'), ('NOWHERE')) w(wanted) LEFT JOIN (SELECT * FROM candles QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1) c ON upper(c.symbol) = w.wanted"), "wanted", "close", "ts")
def latest_of_symbols(spark, d):
    return R.latest_of(hourly(spark, d), spark.createDataFrame([("click",), ("View",), ("nowhere",)], "symbol string"), "H1")


@query("range_ohlc", "SELECT event_type AS symbol, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low, last(value ORDER BY ts, event_id) AS close, count(*)::DOUBLE AS volume FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-10' GROUP BY event_type", "symbol", "open high low close volume")
def range_ohlc(spark, d):
    rows = R.in_range(ticks(spark, d), start="2024-01-03", end="2024-01-10")
    return resample.ticks_to_bars(rows.withColumn("whole", F.lit(1)), "whole", order=("ts", "event_id")).withColumnRenamed("ticks", "volume")


@query("range_bar", with_candles("SELECT symbol, first(open ORDER BY ts) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY ts) AS close, sum(volume) AS volume, count(*) AS bars FROM candles GROUP BY symbol"), "symbol bars", "open high low close volume")
def range_bar(spark, d):
    return R.range_bar(hourly(spark, d))


@query("series_coverage", with_candles("SELECT symbol, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS bars, date_diff('second', min(ts), max(ts)) // 3600 + 1 AS expected, count(*) < date_diff('second', min(ts), max(ts)) // 3600 + 1 AS has_gap FROM candles GROUP BY symbol"), "symbol bars expected has_gap", times="first_ts last_ts")
def series_coverage(spark, d):
    return R.coverage(hourly(spark, d))


@query("missing_ranges", with_candles("SELECT symbol, b + INTERVAL 1 HOUR AS gap_start, ts AS gap_end, date_diff('second', b, ts) // 3600 - 1 AS missing FROM (SELECT symbol, ts, lag(ts) OVER (PARTITION BY symbol ORDER BY ts) AS b FROM candles) WHERE date_diff('second', b, ts) > 3600"), "symbol missing", times="gap_start gap_end")
def missing_ranges(spark, d):
    return R.missing_ranges(hourly(spark, d))


@query("upsert_last_wins", "SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT c_custkey, c_acctbal + 2 FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT -c_custkey, c_acctbal FROM customer WHERE c_custkey % 3 = 0 AND c_custkey <> 0", "c_custkey", "c_acctbal")
def upsert_last_wins(spark, d):
    old = read(spark, d, "customer").select("c_custkey", "c_acctbal", F.lit(0).alias("version"))
    third = old.filter("c_custkey % 3 = 0")
    new = third.withColumns({"version": F.lit(1), "c_acctbal": F.col("c_acctbal") + 1}).unionByName(third.withColumns({"version": F.lit(2), "c_acctbal": F.col("c_acctbal") + 2})).unionByName(third.withColumn("c_custkey", -F.col("c_custkey")))
    return R.upsert(old, new, ["c_custkey"], ["version"])


@query("insert_ignore", "SELECT c_custkey, c_acctbal FROM customer UNION ALL SELECT -c_custkey, c_acctbal FROM customer WHERE c_custkey % 3 = 0 AND c_custkey <> 0", "c_custkey", "c_acctbal")
def insert_ignore(spark, d):
    old = read(spark, d, "customer").select("c_custkey", "c_acctbal")
    third = old.filter("c_custkey % 3 = 0")
    new = third.withColumn("c_acctbal", F.lit(0.0)).unionByName(third.withColumn("c_custkey", -F.col("c_custkey"))).unionByName(third.selectExpr("-c_custkey AS c_custkey", "c_acctbal + 5 AS c_acctbal"))
    return R.insert_new(old, new, ["c_custkey"], ["c_acctbal"])


@query("update_where", "SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 0 ELSE s_acctbal END AS s_acctbal FROM supplier", "s_suppkey", "s_acctbal")
def update_where(spark, d):
    return R.update_where(read(spark, d, "supplier"), F.col("s_acctbal") < 0, {"s_acctbal": F.lit(0.0)})


@query("delete_where", "SELECT s_suppkey FROM supplier WHERE NOT (s_acctbal < 0)", "s_suppkey")
def delete_where(spark, d):
    return R.delete_where(read(spark, d, "supplier"), F.col("s_acctbal") < 0)


@query("delete_keys", with_candles("SELECT symbol, ts FROM candles WHERE date_part('hour', ts) <> 3"), "symbol", times="ts")
def delete_keys(spark, d):
    rows = hourly(spark, d)
    return R.delete_keys(rows, rows.filter(F.hour("ts") == 3), ["symbol", "ts"])


@query("replace_series", with_candles("SELECT symbol, ts, close FROM candles WHERE symbol <> 'click' UNION ALL SELECT symbol, ts, close * 2 FROM candles WHERE symbol = 'click' AND date_part('hour', ts) < 12"), "symbol", "close", "ts")
def replace_series(spark, d):
    rows = hourly(spark, d)
    return R.replace_series(rows, rows.filter((F.col("symbol") == "click") & (F.hour("ts") < 12)).withColumn("close", F.col("close") * 2))


@query("valid_candles", with_candles("SELECT symbol, count(*) AS n, count(*) FILTER (least(open, high, low, close) > 0) AS valid FROM candles GROUP BY symbol"), "symbol n valid")
def valid_candles(spark, d):
    return hourly(spark, d).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.count_if(R.valid_candle()).alias("valid"))


@query("counts_by_status", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus", "o_orderstatus n")
def counts_by_status(spark, d):
    return R.counts_by(read(spark, d, "orders"), "o_orderstatus")


_CODES = [(c, "fiat") for c in "USD EUR GBP JPY AUD NZD SEK NOK".split()] + [("BTC", "crypto"), ("ETH", "crypto")]
_MAJORS = "USD EUR GBP JPY AUD NZD".split()
_CODES_SQL = "c AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _CODES) + ") t(code, kind)), m AS (SELECT code FROM c WHERE code IN (" + ", ".join(f"'{x}'" for x in _MAJORS) + "))"


@query("currency_pairs", f"WITH {_CODES_SQL} SELECT a.code AS base, b.code AS quote FROM m a, m b WHERE a.code <> b.code UNION ALL SELECT a.code, b.code FROM c a, c b WHERE a.kind = 'crypto' AND b.kind = 'fiat'", "base quote")
def currency_pairs(spark, d):
    return R.currency_pairs(spark.createDataFrame(_CODES, "code string, kind string"), _MAJORS)


@query("minor_currencies", f"WITH {_CODES_SQL} SELECT code FROM c WHERE kind = 'fiat' AND code NOT IN (SELECT code FROM m)", "code")
def minor_currencies(spark, d):
    return R.minor_currencies(spark.createDataFrame(_CODES, "code string, kind string"), _MAJORS)


@query("timeframe_ladder", f"WITH {TIMEFRAMES_SQL}, ladder AS (SELECT name, sort_order, lag(name) OVER w AS lower, lead(name) OVER w AS higher, coalesce(lead(seconds) OVER w // seconds, 0)::BIGINT AS per_higher FROM tf WINDOW w AS (ORDER BY sort_order)) SELECT c_custkey, name, lower, higher, per_higher FROM customer JOIN ladder ON sort_order = c_custkey % 9 + 1", "c_custkey name lower higher per_higher")
def timeframe_ladder(spark, d):
    """The timeframe of each customer's series with its neighbours; the ladder has nine rows."""
    mine = read(spark, d, "customer").select("c_custkey", (F.col("c_custkey") % 9 + 1).alias("sort_order"))
    return mine.join(F.broadcast(R.timeframe_ladder(timeframes(spark))), "sort_order")


@query("paper_trade_stats", "SELECT t.n_trades, t.avg_pnl, t.total_pnl, t.worst_pnl, p.n_predictions, p.accuracy FROM (SELECT count(*) AS n_trades, avg(l_extendedprice * (l_discount - 0.05)) AS avg_pnl, sum(l_extendedprice * (l_discount - 0.05)) AS total_pnl, min(l_extendedprice * (l_discount - 0.05)) AS worst_pnl FROM lineitem WHERE l_returnflag <> 'N') t, (SELECT count(*) AS n_predictions, avg(CASE WHEN sign(value - 50) = sign(user_id % 3 - 1) THEN 1.0 ELSE 0.0 END) AS accuracy FROM events WHERE event_type <> 'view') p", "n_trades n_predictions", "avg_pnl total_pnl worst_pnl accuracy")
def paper_trade_stats(spark, d):
    t = read(spark, d, "lineitem").select((F.col("l_extendedprice") * (F.col("l_discount") - 0.05)).alias("pnl"), (F.col("l_returnflag") != "N").alias("closed"))
    p = read(spark, d, "events").select((F.col("value") - 50).alias("predicted"), (F.col("user_id") % 3 - 1).alias("actual"), (F.col("event_type") != "view").alias("resolved"))
    return R.paper_trades(t, p)


@query("champion_models", "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' AND c_nationkey = 3 THEN c_custkey = (SELECT min(c_custkey) FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 3) ELSE c_acctbal > 5000 END AS is_champion FROM customer", "c_custkey is_champion")
def champion_models(spark, d):
    models = read(spark, d, "customer").select("c_custkey", F.col("c_custkey").alias("model_id"), F.col("c_mktsegment").alias("symbol"), F.col("c_nationkey").alias("timeframe"), (F.col("c_acctbal") > 5000).alias("is_champion"))
    first = models.filter((F.col("symbol") == "BUILDING") & (F.col("timeframe") == 3)).agg(F.min("model_id")).first()[0]
    return R.champion(models, first, "BUILDING", 3)


_MOST_TRADED, _FORMS = CURRENCIES[:8], ("{}{}", "{}{}.a", "{}{}m", "{}/{}", "{}_{}.cash")
_QUOTE = "(c_nationkey + 1 + c_custkey % 7) % 8"


def _element(values, at: str) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), F.expr(f"cast({at} + 1 AS int)"))


@query("canonical_symbols", f"SELECT c_custkey, base || quote AS canonical, base, quote, 'FOREX' AS asset_class FROM (SELECT c_custkey, {list(_MOST_TRADED)}[c_nationkey % 8 + 1] AS base, {list(_MOST_TRADED)}[{_QUOTE} + 1] AS quote FROM customer)", "c_custkey canonical base quote asset_class")
def canonical_symbols(spark, d):
    """Pairs of currencies of each customer, as brokers write them: with suffixes and separators, every third one in lower case."""
    base, quote = _element(_MOST_TRADED, "c_nationkey % 8"), _element(_MOST_TRADED, _QUOTE)
    forms = F.array(*[F.format_string(f.replace("{}", "%s"), base, quote) for f in _FORMS])
    written = F.element_at(forms, F.expr("cast(c_custkey % 5 + 1 AS int)"))
    name = F.when(F.col("c_custkey") % 3 == 0, F.lower(written)).otherwise(written)
    return read(spark, d, "customer").select("c_custkey", identity(name).alias("_i")).select("c_custkey", "_i.*")


@query("symbol_checks", "SELECT p_partkey, regexp_replace(regexp_replace(p_brand, '\\.(cash|pro|mini|ecn|raw|[a-z])$', ''), '_(swapfree|islamic|demo|live|test|practice|real|sim)$', '') AS plain, regexp_matches(p_brand, '^[A-Z0-9]{2,12}([._][A-Z0-9]{2,6})?$') AS valid FROM part", "p_partkey plain valid")
def symbol_checks(spark, d):
    return read(spark, d, "part").select("p_partkey", normalized(F.col("p_brand")).alias("plain"), valid_symbol(F.col("p_brand")).alias("valid"))
