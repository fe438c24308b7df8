"""Queries of discovery, models and searches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import windows as W
from ..functions.symbols import CURRENCIES
from ..operators import discovery, models, splits, vectors
from .base import SERIES_SQL, full_sql, hourly, query, read, with_candles

C = with_candles
_MARKETS = "FOREX CRYPTO INDEX COMMODITY STOCK FUTURES".split()
#: Symbols and paths that speak for markets, and how loudly.
_SHAPES = [("EURUSD", "FOREX", 0.6), ("BTCUSD", "CRYPTO", 0.5), ("US30", "INDEX", 0.5), ("US30", "FUTURES", 0.3), ("GOLD", "COMMODITY", 0.5), ("AAPL", "STOCK", 0.4), ("/ES", "FUTURES", 0.6), ("ABCDEFGH", "STOCK", 0.0)]
_PATHS = [("Forex/Majors", "FOREX", 0.4), ("Crypto", "CRYPTO", 0.5), ("Indices", "INDEX", 0.5), ("Metals", "COMMODITY", 0.5), ("Stocks/US", "STOCK", 0.5), ("Futures", "FUTURES", 0.4), ("", "STOCK", 0.0)]


def _values(rows) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows) + ")"


def _names(rows) -> list[str]:
    return list(dict.fromkeys(r[0] for r in rows))


def _element(values, at: str):
    return F.element_at(F.array(*map(F.lit, values)), F.expr(f"cast({at} + 1 AS int)"))


_LOUDEST = f"""WITH c AS (SELECT c_custkey, {_names(_SHAPES)}[c_custkey % 7 + 1] AS symbol, {_names(_PATHS)}[c_nationkey % 7 + 1] AS path FROM customer),
votes AS (SELECT c_custkey, market, w FROM c JOIN {_values(_SHAPES)} s(symbol, market, w) USING (symbol) UNION ALL SELECT c_custkey, market, w FROM c JOIN {_values(_PATHS)} p(path, market, w) USING (path)),
best AS (SELECT c_custkey, market, sum(w) AS confidence FROM votes GROUP BY c_custkey, market QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY confidence DESC, list_position({_MARKETS}, market)) = 1)
SELECT c_custkey, CASE WHEN confidence >= 0.5 THEN market ELSE 'UNKNOWN' END AS market_type, CASE WHEN confidence >= 0.5 THEN least(confidence, 1) ELSE 0 END AS confidence FROM best"""


@query("market_types", _LOUDEST, "c_custkey market_type", "confidence")
def market_types(spark, d):
    mine = discovery.market_type(_element(_names(_SHAPES), "c_custkey % 7"), _element(_names(_PATHS), "c_nationkey % 7"))
    return read(spark, d, "customer").select("c_custkey", mine.alias("_m")).select("c_custkey", "_m.*")


_CODES = [*CURRENCIES[:8], "ZAR", "TRY", "MXN"]
_QUOTE = "(c_nationkey % 8 + 1 + c_custkey % 10) % 11"


@query("currency_pair_kinds", f"SELECT *, CASE WHEN quote IN ('ZAR', 'TRY', 'MXN') THEN 'exotic' WHEN 'USD' IN (base, quote) THEN 'major' ELSE 'cross' END AS kind FROM (SELECT c_custkey, {_CODES}[c_nationkey % 8 + 1] AS base, {_CODES}[{_QUOTE} + 1] AS quote FROM customer)", "c_custkey base quote kind")
def currency_pair_kinds(spark, d):
    name = F.concat(_element(_CODES, "c_nationkey % 8"), F.lit("/"), _element(_CODES, _QUOTE))
    return read(spark, d, "customer").select("c_custkey", discovery.currency_pair(name).alias("_p")).select("c_custkey", "_p.*")


_IN = "CASE WHEN isodow(ts) >= 6 THEN s = 'weekend' WHEN s = 'asian' THEN h <= 9 WHEN s = 'european' THEN h BETWEEN 7 AND 16 WHEN s = 'us' THEN h BETWEEN 13 AND 22 WHEN s = 'pacific' THEN h >= 22 OR h <= 6 ELSE false END"
_SESSIONS = f"s AS (SELECT symbol, date_trunc('day', ts) AS day, s AS session, count(*) AS bars, min(ts) AS first_ts, max(ts) AS last_ts, max(high) AS high FROM (SELECT *, hour(ts) + minute(ts) / 60.0 AS h FROM candles), (SELECT unnest(['asian', 'european', 'us', 'pacific', 'weekend']) AS s) WHERE {_IN} GROUP BY ALL)"


@query("trading_sessions", C("SELECT * FROM s", _SESSIONS), "symbol session bars", "high", "day first_ts last_ts")
def trading_sessions(spark, d):
    return discovery.trading_sessions(hourly(spark, d))


@query("session_overlaps", C("SELECT a.symbol, a.day, a.session AS session_a, b.session AS session_b, greatest(a.first_ts, b.first_ts) AS from_ts, least(a.last_ts, b.last_ts) AS to_ts FROM s a JOIN s b ON a.symbol = b.symbol AND a.day = b.day AND a.session < b.session AND a.first_ts <= b.last_ts AND b.first_ts <= a.last_ts", _SESSIONS), "symbol session_a session_b", times="day from_ts to_ts")
def session_overlaps(spark, d):
    return discovery.overlaps(discovery.trading_sessions(hourly(spark, d)))


@query("linear_model", "SELECT l_orderkey, l_linenumber, round((SELECT regr_intercept(l_extendedprice, l_quantity) FROM lineitem) + (SELECT regr_slope(l_extendedprice, l_quantity) FROM lineitem) * x.l_quantity, 3) AS prediction FROM lineitem x", "l_orderkey l_linenumber", "prediction")
def linear_model(spark, d):
    rows = read(spark, d, "lineitem")
    b = models.least_squares(rows, ["l_quantity"], "l_extendedprice")
    return rows.select("l_orderkey", "l_linenumber", F.round(models.linear(b, ["l_quantity"]), 3).alias("prediction"))


@query("voting", "SELECT p_partkey, (coalesce(CASE WHEN p_size > 10 THEN p_size / 50.0 END, 0) + p_retailprice / 3000.0) / (CASE WHEN p_size > 10 THEN 2 ELSE 1 END) AS vote FROM part", "p_partkey", "vote")
def voting(spark, d):
    rows = read(spark, d, "part").select("p_partkey", F.when(F.col("p_size") > 10, F.col("p_size") / 50.0).alias("a"), (F.col("p_retailprice") / 3000.0).alias("b"))
    return rows.withColumn("vote", models.voted(["a", "b"]))


@query("permutation_importance")
def permutation_importance(spark, d):
    rows = read(spark, d, "lineitem")
    b = models.least_squares(rows, ["l_quantity", "l_tax"], "l_extendedprice")
    return models.permutation_importance(rows, models.linear(b, ["l_quantity", "l_tax"]), "l_extendedprice", ["l_quantity", "l_tax"], ["l_orderkey", "l_linenumber"])


def _folds(train: int, test: int) -> str:
    """All whole folds of each series, of `test` rows after `train` rows."""
    return f"SELECT fold, CASE WHEN i < fold * {test} + {train} THEN 'train' ELSE 'test' END AS part, sign(close - a) * nx AS fast, sign(close - b) * nx AS slow FROM (SELECT *, unnest(range(greatest(0, (n - {train}) // {test})))::INT AS fold FROM r) WHERE i >= fold * {test} AND i < fold * {test} + {train + test}"


def _search_sql(train: int, test: int) -> str:
    rows = f"r AS (SELECT *, row_number() OVER ({SERIES_SQL}) - 1 AS i, count(*) OVER (PARTITION BY symbol, timeframe) AS n, lead(close) OVER ({SERIES_SQL}) / close - 1 AS nx, {full_sql('avg', 'close', 5)} AS a, {full_sql('avg', 'close', 20)} AS b FROM candles)"
    means = "m AS (SELECT fold, part, 'fast' AS candidate, avg(fast) AS score FROM f GROUP BY ALL UNION ALL SELECT fold, part, 'slow', avg(slow) FROM f GROUP BY ALL)"
    best = "SELECT * FROM m WHERE part = 'train' QUALIFY row_number() OVER (PARTITION BY fold ORDER BY score DESC NULLS LAST, candidate) = 1"
    return C(f"SELECT t.fold, t.candidate, t.score AS train_score, u.score AS test_score FROM ({best}) t LEFT JOIN m u ON u.part = 'test' AND u.fold = t.fold AND u.candidate = t.candidate", f"{rows}, f AS ({_folds(train, test)}), {means}")


def _search(spark, d):
    rows = hourly(spark, d).withColumns({"nx": F.lead("close").over(W.series()) / F.col("close") - 1, "a": W.mean("close", 5), "b": W.mean("close", 20)})
    candidates = {"fast": F.signum(F.col("close") - F.col("a")) * F.col("nx"), "slow": F.signum(F.col("close") - F.col("b")) * F.col("nx")}
    return rows, candidates


@query("walk_forward_search", _search_sql(300, 60), "fold candidate", "train_score test_score")
def walk_forward_search(spark, d):
    """Longer training, shorter tests and more folds than walk_forward_search_whole has."""
    rows, candidates = _search(spark, d)
    return models.walk_forward_search(rows, candidates, lambda df: splits.rolling_walk_forward(df, 300, 60))


@query("walk_forward_search_whole", _search_sql(200, 100), "fold candidate", "train_score test_score")
def walk_forward_search_whole(spark, d):
    rows, candidates = _search(spark, d)
    return models.walk_forward_search(rows, candidates, lambda df: splits.rolling_walk_forward(df, 200, 100))


_FIT = f"SELECT symbol, fold, count(*) FILTER (tr AND k) AS n_train, count(*) FILTER (NOT tr AND k) AS n_test, any_value(b0) AS intercept, any_value(b1) AS slope, sqrt(avg((close - b0 - b1 * x) ** 2) FILTER (NOT tr)) AS test_rmse FROM (SELECT *, regr_slope(close, x) FILTER (tr) OVER g AS b1, regr_intercept(close, x) FILTER (tr) OVER g AS b0 FROM (SELECT symbol, fold, close, x, x IS NOT NULL AS k, i < fold * 60 + 300 AS tr FROM (SELECT *, unnest(range(greatest(0, (n - 300) // 60)))::INT AS fold FROM r) WHERE i >= fold * 60 AND i < fold * 60 + 360) WINDOW g AS (PARTITION BY symbol, fold)) GROUP BY symbol, fold"


@query("walk_forward_fit", C(_FIT, f"r AS (SELECT *, row_number() OVER ({SERIES_SQL}) - 1 AS i, count(*) OVER (PARTITION BY symbol, timeframe) AS n, {full_sql('avg', 'close', 5)} AS x FROM candles)"), "symbol fold n_train n_test", "intercept slope test_rmse")
def walk_forward_fit(spark, d):
    """The close by its mean of five, fitted on each of all folds of 300 and 60 rows."""
    fits = models.walk_forward_fit(hourly(spark, d).withColumn("x", W.mean("close", 5)), ["x"], "close", 300, 60)
    return fits.withColumns({"intercept": F.get("coefficients", F.lit(0)), "slope": F.get("coefficients", F.lit(1))})


@query("isolation_forest")
def isolation_forest(spark, d):
    rows = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount")
    return models.isolation_forest(rows, ["l_quantity", "l_extendedprice", "l_discount"], ["l_orderkey", "l_linenumber"])


@query("cluster_numbers")
def cluster_numbers(spark, d):
    return vectors.inertia_by_k(read(spark, d, "embeddings"), "embedding", (2, 3, 4))
