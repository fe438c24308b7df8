"""Queries of validation, positions, limits, files and longer timeframes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cleaning, correlation, joins, models, risk, validation
from ..plans import datasets
from ..sources import files
from .analysis import _RETURNS, _folder
from .base import TICKS_SQL, hourly, lag_sql, query, read, ticks, with_candles

C = with_candles
_R = f"rt AS (SELECT * FROM (SELECT symbol, ts, close / {lag_sql('close')} - 1 AS r FROM candles) WHERE r IS NOT NULL)"


def _returns(spark, d):
    from ..functions import windows as W

    return hourly(spark, d).withColumn("r", F.col("close") / W.lag("close") - 1).filter("r IS NOT NULL")


@query("performance_objectives", C("SELECT symbol, exp(sum(ln(1 + r))) - 1 AS total_return, avg(r) AS mean_return, sqrt(252.0) * avg(r) / stddev_samp(r) AS sharpe, min(e / greatest(1, p) - 1) AS max_drawdown, 252 * avg(r) / abs(min(e / greatest(1, p) - 1)) AS calmar FROM (SELECT *, max(e) OVER (PARTITION BY symbol ORDER BY ts) AS p FROM (SELECT *, exp(sum(ln(1 + r)) OVER (PARTITION BY symbol ORDER BY ts)) AS e FROM rt)) GROUP BY symbol", _R), "symbol", "total_return mean_return sharpe max_drawdown calmar")
def performance_objectives(spark, d):
    return validation.objectives(_returns(spark, d))


@query("sharpe_regimes", C("SELECT symbol, k AS n, a AS early_sharpe, b AS late_sharpe, a > 0.2 AND b < a * 0.35 AS collapsed FROM (SELECT symbol, k, sqrt(k) * avg(r) FILTER (i <= k) / stddev_samp(r) FILTER (i <= k) AS a, sqrt(k) * avg(r) FILTER (i > n - k) / stddev_samp(r) FILTER (i > n - k) AS b FROM (SELECT *, greatest(10, least(252, greatest(10, n // 3)))::INT AS k FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i, count(*) OVER (PARTITION BY symbol) AS n FROM rt)) GROUP BY symbol, k)", _R), "symbol n collapsed", "early_sharpe late_sharpe")
def sharpe_regimes(spark, d):
    return validation.regimes(hourly(spark, d), "close").withColumnRenamed("window", "n")


@query("overfit_models", "SELECT c_custkey, c_acctbal / 10000 - c_nationkey / 50 AS gap, c_acctbal / 10000 - c_nationkey / 50 > 0.15 AND c_acctbal / 10000 >= 0.6 AS overfit, least(1, greatest(0, pow(0.5, greatest(c_nationkey / 4.0, 0) / 2))) AS edge FROM customer", "c_custkey overfit", "gap edge")
def overfit_models(spark, d):
    rows = read(spark, d, "customer").withColumn("_o", validation.overfit(F.col("c_acctbal") / 10000, F.col("c_nationkey") / 50))
    return rows.select("c_custkey", "_o.*", validation.edge_left(F.col("c_nationkey") / 4.0).alias("edge"))


@query("validation_gate", "SELECT c_custkey, reason = 'all_stages_passed' AS passed, reason FROM (SELECT c_custkey, CASE WHEN NOT c_acctbal >= 2000 THEN 'train_failed' WHEN c_nationkey < 5 THEN 'validation_failed' WHEN length(c_mktsegment) < 9 THEN 'out_of_sample_failed' ELSE 'all_stages_passed' END AS reason FROM customer)", "c_custkey passed reason")
def validation_gate(spark, d):
    rows = read(spark, d, "customer")
    stages = [("train", F.col("c_acctbal"), 2000.0), ("validation", F.col("c_nationkey"), 5.0), ("out_of_sample", F.length("c_mktsegment"), 9.0)]
    return rows.select("c_custkey", validation.gate(stages).alias("_g")).select("c_custkey", "_g.*")


_TFS = ["H4", "M15", "H1", "D1", "W1"]


@query("baselines", "SELECT symbol, timeframe, value FROM (SELECT upper(p_brand) AS symbol, ['H4', 'M15', 'H1', 'D1', 'W1'][p_size % 5 + 1] AS timeframe, avg(p_retailprice) AS value FROM part WHERE p_size % 7 <> 0 GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY CASE timeframe WHEN 'H4' THEN -1 WHEN 'D1' THEN 0 WHEN 'H1' THEN 1 WHEN 'M15' THEN 3 ELSE 9 END) = 1", "symbol timeframe", "value")
def baselines(spark, d):
    timeframe = F.element_at(F.array(*map(F.lit, _TFS)), (F.col("p_size") % 5 + 1).cast("int"))
    error = F.when(F.col("p_size") % 7 == 0, "failed")
    rows = read(spark, d, "part").groupBy(F.col("p_brand").alias("symbol"), timeframe.alias("timeframe"), error.alias("error")).agg(F.avg("p_retailprice").alias("value"))
    return validation.baselines(rows, "H4")


_FILLS = "f AS (SELECT event_type AS symbol, ts, event_id, CASE WHEN user_id % 2 = 0 THEN 1 ELSE -1 END AS side, value AS price FROM events)"
_POSITIONS = f"WITH {_FILLS}, n AS (SELECT *, sum(side) OVER (PARTITION BY symbol ORDER BY ts, event_id) AS net FROM f), o AS (SELECT *, abs(net) > abs(net - side) AS opens, CASE WHEN abs(net) > abs(net - side) THEN side ELSE -side END AS of_side FROM n), k AS (SELECT *, row_number() OVER (PARTITION BY symbol, of_side, opens ORDER BY ts, event_id) AS k FROM o) SELECT a.symbol, a.event_id, a.side, a.price AS entry, b.price AS exit, b.event_id AS event_id_closed, (b.price - a.price) * a.side * 2 AS pnl FROM k a LEFT JOIN k b ON NOT b.opens AND a.symbol = b.symbol AND a.of_side = b.of_side AND a.k = b.k WHERE a.opens"


def _positions(spark, d):
    fills = ticks(spark, d).select("symbol", "ts", "event_id", F.when(F.col("side") == 0, 1).otherwise(-1).alias("side"), F.col("last").alias("price"), F.lit(2.0).alias("size"))
    return validation.positions(fills, order=("ts", "event_id"))


@query("positions_of_fills", _POSITIONS, "symbol event_id side", "event_id_closed entry exit pnl")
def positions_of_fills(spark, d):
    return _positions(spark, d)


@query("open_positions", f"SELECT symbol, count(*) AS open, sum(side * 2) AS exposure FROM ({_POSITIONS}) WHERE exit IS NULL GROUP BY symbol", "symbol open", "exposure")
def open_positions(spark, d):
    return validation.held_at_end(_positions(spark, d), ("symbol",))


_LOTS = f"WITH {TICKS_SQL}, f AS (SELECT symbol, ts, event_id, CASE WHEN side = 0 THEN 1 ELSE -1 END AS side, last AS price, 1.0 + event_id % 4 AS size FROM ticks), c AS (SELECT *, sum(size) OVER w AS e FROM f WINDOW w AS (PARTITION BY symbol, side ORDER BY ts, event_id)), p AS (SELECT symbol, ts, event_id, side, price, e - size AS s, e FROM c), b AS (FROM p WHERE side = 1), a AS (FROM p WHERE side = -1), j AS (SELECT coalesce(b.symbol, a.symbol) AS symbol, (b.ts, b.event_id) < (a.ts, a.event_id) AS first, least(b.e, a.e) - greatest(b.s, a.s) AS size, b.event_id AS be, b.price AS bp, a.event_id AS ae, a.price AS ap FROM b JOIN a ON b.symbol = a.symbol AND b.s < a.e AND a.s < b.e), m AS (SELECT symbol, CASE WHEN first THEN be ELSE ae END AS event_id, CASE WHEN first THEN 1 ELSE -1 END AS side, size, CASE WHEN first THEN bp ELSE ap END AS entry, CASE WHEN first THEN ap ELSE bp END AS exit, CASE WHEN first THEN ae ELSE be END AS event_id_closed FROM j UNION ALL SELECT p.symbol, event_id, p.side, e - greatest(s, coalesce(o, 0)), price, NULL, NULL FROM p LEFT JOIN (SELECT symbol, side, max(e) AS o FROM p GROUP BY ALL) q ON q.symbol = p.symbol AND q.side = -p.side WHERE e > coalesce(o, 0)) SELECT *, (exit - entry) * side * size AS pnl FROM m"


def _lots(spark, d):
    size = (1 + F.col("event_id") % 4).cast("double")
    fills = ticks(spark, d).select("symbol", "ts", "event_id", F.when(F.col("side") == 0, 1).otherwise(-1).alias("side"), F.col("last").alias("price"), size.alias("size"))
    return validation.lots(fills, order=("ts", "event_id"))


@query("lots_of_fills", _LOTS, "symbol event_id side", "size event_id_closed entry exit pnl")
def lots_of_fills(spark, d):
    """Every matched part of fills of one to four units, and what stays open."""
    return _lots(spark, d)


@query("lots_by_symbol", f"SELECT symbol, count(*) AS lots, sum(size) AS size, sum(pnl) AS pnl, sum(side * size) FILTER (exit IS NULL) AS exposure FROM ({_LOTS}) GROUP BY symbol", "symbol lots", "size pnl exposure")
def lots_by_symbol(spark, d):
    """Realised results and what is left open of each symbol."""
    exposure = F.sum(F.when(F.col("exit").isNull(), F.col("side") * F.col("size"))).alias("exposure")
    return _lots(spark, d).groupBy("symbol").agg(F.count(F.lit(1)).alias("lots"), F.sum("size").alias("size"), F.sum("pnl").alias("pnl"), exposure)


_PAIRS = "SELECT p.symbol AS a, q.symbol AS b, count(*) AS n, corr(p.x, q.x) AS r FROM rr p JOIN rr q ON p.pos = q.pos AND p.symbol < q.symbol GROUP BY p.symbol, q.symbol"


@query("correlation_concentration", C(f"SELECT (SELECT count(DISTINCT symbol) FROM candles WHERE symbol <> 'view') AS symbols, max(abs(r)) AS largest, count(*) FILTER (abs(r) >= 0.02) AS pairs, count(*) FILTER (abs(r) >= 0.02) > 0 AS overconcentrated FROM ({_PAIRS}) WHERE a <> 'view' AND b <> 'view'", _RETURNS), "symbols pairs overconcentrated", "largest")
def correlation_concentration(spark, d):
    rows = hourly(spark, d)
    return validation.concentration(correlation.matrix(correlation.returns_by_position(rows)), rows.filter("symbol <> 'view'"), 0.02)


@query("correlation_significance", C(f"SELECT *, least(1, least(1, abs(r) + CASE WHEN significant THEN 0.15 ELSE 0 END) + 0.05 * least(1, n / 60)) AS confidence FROM (SELECT a, b, n, r, r * sqrt((n - 2) / (1 - r * r)) AS t, abs(r * sqrt((n - 2) / (1 - r * r))) >= 1.959964 * (1 + 1.0 / ((n - 2) * 0.81)) AS significant FROM ({_PAIRS}))", _RETURNS), "a b n significant", "r t confidence")
def correlation_significance(spark, d):
    return validation.with_significance(correlation.matrix(correlation.returns_by_position(hourly(spark, d))))


@query("merge_cross", "SELECT r.r_regionkey AS key, r.r_name, n.n_name FROM region r, nation n", "key r_name n_name")
def merge_cross(spark, d):
    left = read(spark, d, "region").select(F.col("r_regionkey").alias("key"), "r_name")
    right = read(spark, d, "nation").select(F.col("n_nationkey").alias("key"), "n_name")
    return joins.merge(left, right, "key", "cross")


@query("limits_broken", "SELECT c_custkey, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'circuit_breaker' WHEN abs(c_acctbal / 40000) >= 0.2 THEN 'max_drawdown' WHEN c_acctbal / 10000 <= -0.05 THEN 'daily_loss' WHEN c_nationkey % 7 >= 5 THEN 'open_trades' WHEN abs(c_nationkey / 30) >= 0.6 THEN 'correlation' WHEN c_custkey % 10 / 100.0 >= 0.06 THEN 'portfolio_risk' END AS broken FROM customer", "c_custkey broken")
def limits_broken(spark, d):
    c = {k: F.col(f"c_{k}") for k in ("custkey", "acctbal", "nationkey", "mktsegment")}
    state = {"halted": c["mktsegment"] == "MACHINERY", "drawdown": c["acctbal"] / 40000, "daily_pnl": c["acctbal"] / 10000, "open_trades": c["nationkey"] % 7, "correlation": c["nationkey"] / 30, "risk": c["custkey"] % 10 / 100.0}
    return read(spark, d, "customer").select("c_custkey", risk.limit_broken(state, correlation=0.6).alias("broken"))


@query("readiness", "SELECT c_custkey, array_to_string(list_filter([CASE WHEN c_custkey % 60 >= 30 AND c_acctbal / 10000 < 0.52 THEN 'accuracy' END, CASE WHEN c_nationkey < 5 THEN 'days' END, CASE WHEN abs(c_acctbal / 50000) > 0.15 THEN 'drawdown' END, CASE WHEN c_nationkey / 10 < 1.2 THEN 'profit_factor' END, CASE WHEN c_acctbal / 5000 < 0.5 THEN 'sharpe' END, CASE WHEN c_custkey % 60 < 30 THEN 'trades' END], lambda x: x IS NOT NULL), ',') AS failed FROM customer", "c_custkey failed")
def readiness(spark, d):
    n, b, k = F.col("c_nationkey"), F.col("c_acctbal"), F.col("c_custkey")
    found = risk.readiness({"trades": k % 60, "days": n * 6, "sharpe": b / 5000, "drawdown": b / 50000, "profit_factor": n / 10, "accuracy": b / 10000})
    return read(spark, d, "customer").select("c_custkey", F.concat_ws(",", found).alias("failed"))


@query("hypotheses", "SELECT c_custkey AS symbol, unnest(list_filter([CASE WHEN c_acctbal <= 0 THEN 'weak_edge' END, CASE WHEN abs(c_acctbal / 50000) > 0.15 THEN 'deep_drawdown' END, CASE WHEN c_nationkey < 30 AND c_nationkey % 2 = 0 THEN 'few_trades' END, CASE WHEN c_mktsegment = 'BUILDING' THEN 'drifted' END], lambda x: x IS NOT NULL)) AS hypothesis FROM customer", "symbol hypothesis")
def hypotheses(spark, d):
    rows = read(spark, d, "customer").select(F.col("c_custkey").alias("symbol"), F.col("c_acctbal").alias("sharpe"), (F.col("c_acctbal") / 50000).alias("max_drawdown"), F.when(F.col("c_nationkey") % 2 == 0, F.col("c_nationkey")).otherwise(30).alias("n"), (F.col("c_mktsegment") == "BUILDING").alias("drifted"))
    return models.hypotheses(rows)


@query("higher_timeframe", C(f"SELECT a.symbol, a.ts, b.close AS d1_close, b.r AS d1_return_1 FROM candles a ASOF LEFT JOIN (SELECT symbol, day + INTERVAL 1 DAY AS ts, close, coalesce(close / lag(close) OVER (PARTITION BY symbol ORDER BY day) - 1, 0) AS r FROM (SELECT symbol, date_trunc('day', ts) AS day, last(close ORDER BY ts) AS close FROM candles GROUP BY 1, 2)) b ON a.symbol = b.symbol AND a.ts >= b.ts"), "symbol", "d1_close d1_return_1", "ts")
def higher_timeframe(spark, d):
    return datasets.higher_timeframe(hourly(spark, d), "D1")


@query("candle_files", C("SELECT symbol, ts, open, high, low, close, volume FROM candles"), "symbol", "open high low close volume", "ts")
def candle_files(spark, d):
    """Candles written as CSV with other column names and read back by their synonyms."""
    at = _folder(spark)
    rows = hourly(spark, d).select(F.col("symbol").alias("Ticker"), F.col("timeframe").alias("TF"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("<TIME STAMP>"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("DateTime"), *[F.col(c).alias(c[0].upper()) for c in ("open", "high", "low", "close")], F.col("volume").alias("Tick Volume"))
    rows.write.option("header", "true").csv(f"{at}/candles")
    return files.candle_files(spark, f"{at}/candles")


@query("tick_files", "SELECT event_type AS symbol, ts, value + 1 AS last, count(*) AS n FROM events WHERE event_id % 3 <> 0 GROUP BY 1, 2, 3", "symbol n", "last", "ts")
def tick_files(spark, d):
    """Ticks written as CSV with bid and ask, and read back; those without a price are left out."""
    at, priced = _folder(spark), F.col("event_id") % 3 != 0
    rows = ticks(spark, d).select(F.col("symbol").alias("Instrument"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("Time"), F.when(priced, F.col("last")).alias("Bid"), F.when(priced, F.col("last") + 2).alias("Ask"))
    rows.write.option("header", "true").csv(f"{at}/ticks")
    return files.tick_files(spark, f"{at}/ticks").groupBy("symbol", "ts", "last").agg(F.count(F.lit(1)).alias("n"))


@query("only_new_candles", C("SELECT symbol, ts, close FROM candles WHERE symbol = 'view' OR ts > (SELECT max(ts) FROM candles x WHERE hour(ts) < 12 AND x.symbol = candles.symbol AND date_trunc('day', ts) < TIMESTAMP '2024-01-10')"), "symbol", "close", "ts")
def only_new_candles(spark, d):
    rows = hourly(spark, d)
    stored = rows.filter((F.hour("ts") < 12) & (F.col("ts") < F.lit("2024-01-10").cast("timestamp")) & (F.col("symbol") != "view"))
    return files.only_new(rows, stored, ["symbol"])


_ROUGH = "SELECT symbol, timeframe, ts, open, CASE WHEN symbol = 'view' AND hour(ts) = 5 THEN low - 1 ELSE high END AS high, low, CASE WHEN hour(ts) % 11 <> 3 THEN close END AS close, volume, 0 AS copy FROM candles UNION ALL SELECT symbol, timeframe, ts, open, high, low, close + 1, volume, 1 FROM candles WHERE hour(ts) % 6 = 0"
_VALID = "coalesce(open > 0 AND high > 0 AND low > 0 AND close > 0 AND high >= low AND volume >= 0, true)"
_CLEAN = f"rough AS ({_ROUGH}), uniq AS (SELECT * FROM rough WHERE {_VALID} QUALIFY row_number() OVER (PARTITION BY symbol, timeframe, ts ORDER BY copy) = 1), filled AS (SELECT * REPLACE (coalesce(last_value(close IGNORE NULLS) OVER (PARTITION BY symbol, timeframe ORDER BY ts), avg(close) OVER (PARTITION BY symbol, timeframe)) AS close) FROM uniq), z AS (SELECT *, avg(close) OVER w AS m, stddev_samp(close) OVER w AS s FROM filled WINDOW w AS (PARTITION BY symbol, timeframe ORDER BY ts ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING)), o AS (SELECT *, coalesce(abs((close - m) / nullif(s, 0)) > 2, false) AS beyond FROM z)"


def _rough(spark, d):
    """Candles with repeated times, missing closes and highs below their lows."""
    rows = hourly(spark, d)
    hour = F.hour("ts")
    broken = rows.withColumns({"high": F.when((F.col("symbol") == "view") & (hour == 5), F.col("low") - 1).otherwise(F.col("high")), "close": F.when(hour % 11 != 3, F.col("close")), "copy": F.lit(0)})
    return broken.unionByName(rows.filter(hour % 6 == 0).withColumns({"close": F.col("close") + 1, "copy": F.lit(1)}))


@query("cleaned_candles", C("SELECT symbol, ts, copy, CASE WHEN beyond THEN m + sign(close - m) * 2 * s ELSE close END AS close, high FROM o", _CLEAN), "symbol copy", "close high", "ts")
def cleaned_candles(spark, d):
    return cleaning.cleaned(_rough(spark, d), ["close"], ("copy",), "forward", "clip", 2.0)[0]


@query("cleaning_counters", C(f"SELECT (SELECT count(*) FROM rough) AS rows, (SELECT count(*) FROM rough WHERE NOT {_VALID}) AS invalid, (SELECT count(*) FROM rough WHERE {_VALID}) - (SELECT count(*) FROM uniq) AS duplicates, (SELECT count(*) FROM uniq WHERE close IS NULL) AS missing, (SELECT count(*) FROM o WHERE beyond) AS outliers, (SELECT count(*) FROM o) AS kept", _CLEAN), "rows invalid duplicates missing outliers kept")
def cleaning_counters(spark, d):
    """What the pass over the candles met at each step."""
    rows, counters = cleaning.cleaned(_rough(spark, d), ["close"], ("copy",), "forward", "clip", 2.0)
    rows.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([counters()], "rows long, invalid long, duplicates long, missing long, outliers long, kept long")
