"""Queries of rolling primitives, price features, patterns and indicators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import windows as W
from ..operators import correlation, indicators, labels, patterns, price, profiles, recursive
from .base import SERIES_SQL, full_sql, hourly, lag_sql, over, query, with_candles

C = with_candles


def _div(a: str, b: str, default: str = "NULL") -> str:
    return f"CASE WHEN ({b}) <> 0 THEN ({a}) / ({b}) ELSE {default} END"


@query("rolling_primitives", C(f"SELECT symbol, ts, {full_sql('avg', 'close', 20)} AS mean_20, {full_sql('stddev_pop', 'close', 20)} AS std_20, {full_sql('min', 'low', 20)} AS min_20, {full_sql('max', 'high', 20)} AS max_20, {full_sql('sum', 'volume', 20)} AS sum_20 FROM candles"), "symbol", "mean_20 std_20 min_20 max_20 sum_20", "ts")
def rolling_primitives(spark, d):
    return hourly(spark, d).withColumns({"mean_20": W.mean("close", 20), "std_20": W.std("close", 20), "min_20": W.lowest("low", 20), "max_20": W.highest("high", 20), "sum_20": W.total("volume", 20)})


@query("returns", C(f"SELECT symbol, ts, {_div(f'close - {lag_sql("close", 3)}', lag_sql('close', 3), '0.0')} AS r3, CASE WHEN close > 0 AND {lag_sql('close')} > 0 THEN ln(close / {lag_sql('close')}) END AS lr, greatest(high - low, abs(high - coalesce({lag_sql('close')}, close)), abs(low - coalesce({lag_sql('close')}, close))) AS tr FROM candles"), "symbol", "r3 lr tr", "ts")
def returns(spark, d):
    before = W.lag("close", 3)
    return hourly(spark, d).withColumns({"r3": F.when(before != 0, (F.col("close") - before) / before).otherwise(0.0), "lr": W.log_returns("close"), "tr": W.true_range()})


@query("percent_rank", C(f"SELECT symbol, ts, CASE WHEN len(l) = 30 THEN len(list_filter(l, lambda x: x <= close)) / 30.0 END AS pr FROM (SELECT symbol, ts, close, list(close) OVER {over(30)} AS l FROM candles)"), "symbol", "pr", "ts")
def percent_rank(spark, d):
    return hourly(spark, d).withColumn("pr", W.percent_rank("close", 30))


@query("forward_backward_fill", C(f"SELECT symbol, ts, last_value(x IGNORE NULLS) OVER ({SERIES_SQL} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ff, first_value(x IGNORE NULLS) OVER ({SERIES_SQL} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS bf FROM (SELECT *, CASE WHEN volume >= 3 THEN close END AS x FROM candles)"), "symbol", "ff bf", "ts")
def forward_backward_fill(spark, d):
    return hourly(spark, d).withColumn("x", F.when(F.col("volume") >= 3, F.col("close"))).withColumns({"ff": W.forward_fill("x"), "bf": W.backward_fill("x")})


@query("rolling_correlation", C(f"SELECT symbol, ts, CASE WHEN count(*) OVER {over(20)} = 20 AND var_pop(close) OVER {over(20)} <> 0 AND var_pop(volume) OVER {over(20)} <> 0 THEN corr(close, volume) OVER {over(20)} END AS c, CASE WHEN count(*) OVER {over(20)} = 20 AND var_pop(volume) OVER {over(20)} <> 0 THEN covar_pop(close, volume) OVER {over(20)} / var_pop(volume) OVER {over(20)} END AS b FROM candles"), "symbol", "c b", "ts")
def rolling_correlation(spark, d):
    return hourly(spark, d).withColumns({"c": W.correlation("close", "volume", 20), "b": W.beta("close", "volume", 20)})


@query("price_features", C(f"SELECT symbol, ts, (high + low) / 2 AS price_hl2, (high + low + close) / 3 AS price_hlc3, (open + high + low + close) / 4 AS price_ohlc4, {_div('high - low', 'close')} AS price_range_pct, {_div('close - low', 'high - low', '0.5')} AS price_close_position, open - {lag_sql('close')} AS price_gap FROM candles"), "symbol", "price_hl2 price_hlc3 price_ohlc4 price_range_pct price_close_position price_gap", "ts")
def price_features(spark, d):
    return price.price_features(hourly(spark, d))


@query(
    "return_features",
    C(f"SELECT symbol, ts, sqrt(20.0) * {full_sql('stddev_pop', 'lr', 20)} AS realized_volatility_20, {full_sql('avg', 'r', 20)} AS return_mean_20, sqrt({full_sql('avg', 'hl', 20)} / (4 * ln(2))) AS parkinson_volatility_20 FROM (SELECT *, CASE WHEN close > 0 AND {lag_sql('close')} > 0 THEN ln(close / {lag_sql('close')}) END AS lr, CASE WHEN {lag_sql('close')} IS NOT NULL THEN {_div(f'close - {lag_sql("close")}', lag_sql('close'), '0.0')} END AS r, CASE WHEN high > 0 AND low > 0 THEN ln(high / low) ** 2 END AS hl FROM candles)"),
    "symbol", "realized_volatility_20 return_mean_20 parkinson_volatility_20", "ts",
)
def return_features(spark, d):
    return price.return_features(hourly(spark, d), (20,))


@query(
    "candle_features",
    C(f"SELECT symbol, ts, abs(close - open) AS candle_body, high - greatest(open, close) AS candle_upper_wick, least(open, close) - low AS candle_lower_wick, {_div('abs(close - open)', 'high - low')} AS candle_body_ratio, ({_div('abs(close - open)', 'high - low', '0.0')} <= 0.1)::INT AS candle_is_doji, coalesce(low > {lag_sql('high')}, false)::INT AS candle_true_gap_up FROM candles"),
    "symbol", "candle_body candle_upper_wick candle_lower_wick candle_body_ratio candle_is_doji candle_true_gap_up", "ts",
)
def candle_features(spark, d):
    return price.candle_features(hourly(spark, d))


@query(
    "pattern_flags",
    C(f"SELECT symbol, ts, CASE WHEN close > open AND pc < po AND open <= pc AND close >= po THEN 1 WHEN close < open AND pc > po AND open >= pc AND close <= po THEN -1 ELSE 0 END AS pattern_engulfing, coalesce(high <= ph AND low >= pl, false)::INT AS pattern_inside, coalesce(high >= ph AND low <= pl, false)::INT AS pattern_outside, (len(hs) = 5 AND hs[3] = list_max(hs) AND len(list_filter(hs, lambda x: x = hs[3])) = 1)::INT AS pattern_fractal_high FROM (SELECT *, {lag_sql('open')} AS po, {lag_sql('close')} AS pc, {lag_sql('high')} AS ph, {lag_sql('low')} AS pl, list(high) OVER {over(5)} AS hs FROM candles)"),
    "symbol", "pattern_engulfing pattern_inside pattern_outside pattern_fractal_high", "ts",
)
def pattern_flags(spark, d):
    return patterns.pattern_flags(hourly(spark, d))


_PATTERN_SQL = C(
    """SELECT symbol, ts, pattern, direction, confidence FROM (
SELECT symbol, ts, 'doji' AS pattern, CASE WHEN i = 1 THEN 'neutral' WHEN close > pc THEN 'bullish' ELSE 'bearish' END AS direction, CASE WHEN i = 1 THEN 0.5 WHEN close > pc THEN 0.65 ELSE 0.55 END AS confidence FROM w WHERE high > low AND abs(close - open) / (high - low) < 0.1
UNION ALL SELECT symbol, ts, 'marubozu', CASE WHEN close > open THEN 'bullish' WHEN close < open THEN 'bearish' ELSE 'neutral' END, 0.8 FROM w WHERE high > low AND abs(close - open) / (high - low) > 0.8 AND (high - greatest(open, close)) / (high - low) < 0.05 AND (least(open, close) - low) / (high - low) < 0.05
UNION ALL SELECT symbol, ts, 'spinning_top', 'neutral', 0.5 FROM w WHERE high > low AND abs(close - open) / (high - low) > 0.3 AND abs(close - open) / (high - low) < 0.6
UNION ALL SELECT symbol, ts, 'engulfing', CASE WHEN close > open THEN 'bullish' ELSE 'bearish' END, CASE WHEN abs(close - open) > 1.5 * abs(pc - po) THEN 0.85 ELSE 0.7 END FROM w WHERE (pc < po AND close > open AND open < pc AND close > po) OR (pc > po AND close < open AND open > pc AND close < po)
UNION ALL SELECT symbol, ts, 'three_white_soldiers', 'bullish', 0.8 FROM w WHERE close > pc AND pc > pc2 AND (close - open) > 0.5 * (high - low) AND (pc - po) > 0.5 * (ph - pl) AND (pc2 - po2) > 0.5 * (ph2 - pl2) AND high > low AND ph > pl AND ph2 > pl2
UNION ALL SELECT symbol, ts, 'hammer', 'bullish', CASE WHEN i <= 5 THEN 0.6 WHEN move < -0.005 THEN 0.75 ELSE 0.55 END FROM w WHERE high > low AND abs(close - open) / (high - low) < 0.3 AND (least(open, close) - low) / (high - low) > 0.6 AND (high - greatest(open, close)) / (high - low) < 0.1
UNION ALL SELECT symbol, ts, 'shooting_star', 'bearish', CASE WHEN i <= 5 THEN 0.6 WHEN move > 0.005 THEN 0.75 ELSE 0.55 END FROM w WHERE high > low AND abs(close - open) / (high - low) < 0.3 AND (high - greatest(open, close)) / (high - low) > 0.6 AND (least(open, close) - low) / (high - low) < 0.1
UNION ALL SELECT symbol, ts, 'harami', CASE WHEN close > open THEN 'bullish' ELSE 'bearish' END, 0.65 FROM w WHERE greatest(open, close) < greatest(po, pc) AND least(open, close) > least(po, pc) AND ((pc < po AND close > open) OR (pc > po AND close < open))
UNION ALL SELECT symbol, ts, 'three_black_crows', 'bearish', 0.8 FROM w WHERE close < pc AND pc < pc2 AND (open - close) > 0.5 * (high - low) AND (po - pc) > 0.5 * (ph - pl) AND (po2 - pc2) > 0.5 * (ph2 - pl2) AND high > low AND ph > pl AND ph2 > pl2
UNION ALL SELECT symbol, ts, 'trend', CASE WHEN (slope > 0 AND slope > 1.5 * slope4) OR (slope < 0 AND slope < 1.5 * slope4) THEN 'continuation' WHEN slope > 0 THEN 'bullish' ELSE 'bearish' END, CASE WHEN (slope > 0 AND slope > 1.5 * slope4) OR (slope < 0 AND slope < 1.5 * slope4) THEN 0.7 ELSE 0.6 END FROM w WHERE i >= 5 AND abs(slope) > 0.5)""",
    f"n AS (SELECT *, row_number() OVER ({SERIES_SQL}) AS i FROM candles), w AS (SELECT *, {lag_sql('open')} AS po, {lag_sql('close')} AS pc, {lag_sql('high')} AS ph, {lag_sql('low')} AS pl, {lag_sql('open', 2)} AS po2, {lag_sql('close', 2)} AS pc2, {lag_sql('high', 2)} AS ph2, {lag_sql('low', 2)} AS pl2, regr_slope(close, i) OVER {over(5)} AS slope, {_div(f'{lag_sql("close")} - {lag_sql("close", 5)}', lag_sql('close', 5), '0.0')} AS move, regr_slope(close, i) OVER ({SERIES_SQL} ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS slope4 FROM n)",
)


@query("pattern_detections", _PATTERN_SQL, "symbol pattern direction", "confidence", "ts")
def pattern_detections(spark, d):
    return patterns.patterns.detect(hourly(spark, d))


@query("pattern_summary", f"SELECT pattern, direction, count(*) AS n, avg(confidence) AS confidence FROM ({_PATTERN_SQL}) GROUP BY pattern, direction", "pattern direction n", "confidence")
def pattern_summary(spark, d):
    return patterns.summary(pattern_detections(spark, d))


@query("patterns_latest", f"SELECT * FROM ({_PATTERN_SQL}) SEMI JOIN (SELECT event_type AS symbol, date_trunc('hour', max(ts)) AS ts FROM events GROUP BY event_type) USING (symbol, ts)", "symbol pattern direction", "confidence", "ts")
def patterns_latest(spark, d):
    return patterns.patterns.detect(hourly(spark, d), latest=True)


@query("moving_averages", C(f"SELECT symbol, ts, a AS sma_10, b AS sma_20, {_div('close - a', 'a')} AS sma_distance_10, CASE WHEN a IS NOT NULL THEN (close > a)::INT END AS sma_close_above_10, CASE WHEN pg IS NOT NULL AND a - b IS NOT NULL THEN (pg <= 0 AND a - b > 0)::INT END AS sma_cross_10_20_up, v AS vwap_20, cv AS vwap_cumulative FROM (SELECT *, lag(a - b) OVER ({SERIES_SQL}) AS pg FROM (SELECT symbol, timeframe, ts, close, {full_sql('avg', 'close', 10)} AS a, {full_sql('avg', 'close', 20)} AS b, CASE WHEN count(*) OVER {over(20)} = 20 THEN sum((high + low + close) / 3 * volume) OVER {over(20)} / sum(volume) OVER {over(20)} END AS v, sum((high + low + close) / 3 * volume) OVER ({SERIES_SQL}) / sum(volume) OVER ({SERIES_SQL}) AS cv FROM candles))"), "symbol", "sma_10 sma_20 sma_distance_10 sma_close_above_10 sma_cross_10_20_up vwap_20 vwap_cumulative", "ts")
def moving_averages(spark, d):
    return indicators.moving_averages(hourly(spark, d), (10, 20), (20,))


@query(
    "momentum",
    C(f"SELECT symbol, ts, {_div('tp - tpm', '0.015 * list_avg(list_transform(tps, lambda x: abs(x - tpm)))')} AS cci_20, 100 * {_div('close - c12', 'c12')} AS roc_12, close - c10 AS momentum_10, -100 * {_div('hh - close', 'hh - ll')} AS williams_r_14, k AS stochastic_k_14, {full_sql('avg', 'k', 3)} AS stochastic_d_3 FROM (SELECT *, 100 * {_div('close - ll', 'hh - ll')} AS k FROM (SELECT symbol, timeframe, ts, close, (high + low + close) / 3 AS tp, {full_sql('avg', '(high + low + close) / 3', 20)} AS tpm, list((high + low + close) / 3) OVER {over(20)} AS tps, {lag_sql('close', 12)} AS c12, {lag_sql('close', 10)} AS c10, {full_sql('max', 'high', 14)} AS hh, {full_sql('min', 'low', 14)} AS ll FROM candles))"),
    "symbol", "cci_20 roc_12 momentum_10 williams_r_14 stochastic_k_14 stochastic_d_3", "ts",
)
def momentum(spark, d):
    return indicators.momentum(hourly(spark, d))


@query("channels", C(f"SELECT symbol, ts, m AS bollinger_mid_20, m + 2 * s AS bollinger_upper_20, {_div('close - (m - 2 * s)', '4 * s')} AS bollinger_percent_b_20, hh AS donchian_high_20, {_div('close - ll', 'hh - ll')} AS donchian_position_20 FROM (SELECT *, {full_sql('avg', 'close', 20)} AS m, {full_sql('stddev_pop', 'close', 20)} AS s, {full_sql('max', 'high', 20)} AS hh, {full_sql('min', 'low', 20)} AS ll FROM candles)"), "symbol", "bollinger_mid_20 bollinger_upper_20 bollinger_percent_b_20 donchian_high_20 donchian_position_20", "ts")
def channels(spark, d):
    return indicators.channels(hourly(spark, d))


@query("ichimoku", C(f"SELECT symbol, ts, t AS ichimoku_tenkan, k AS ichimoku_kijun, {lag_sql('(t + k) / 2', 26)} AS ichimoku_senkou_a, {lag_sql('b', 26)} AS ichimoku_senkou_b, {lag_sql('close', 26)} AS ichimoku_chikou FROM (SELECT symbol, timeframe, ts, close, ({full_sql('max', 'high', 9)} + {full_sql('min', 'low', 9)}) / 2 AS t, ({full_sql('max', 'high', 26)} + {full_sql('min', 'low', 26)}) / 2 AS k, ({full_sql('max', 'high', 52)} + {full_sql('min', 'low', 52)}) / 2 AS b FROM candles)"), "symbol", "ichimoku_tenkan ichimoku_kijun ichimoku_senkou_a ichimoku_senkou_b ichimoku_chikou", "ts")
def ichimoku(spark, d):
    return indicators.ichimoku(hourly(spark, d))


@query(
    "volume_flow",
    C(f"SELECT symbol, ts, sum(coalesce(sign(close - pc), 0) * volume) OVER ({SERIES_SQL}) AS obv, CASE WHEN count(*) OVER {over(14)} < 14 THEN NULL WHEN sum(dn) OVER {over(14)} = 0 THEN CASE WHEN sum(up) OVER {over(14)} > 0 THEN 100 ELSE 50 END ELSE 100 - 100 / (1 + sum(up) OVER {over(14)} / sum(dn) OVER {over(14)}) END AS mfi_14, CASE WHEN count(*) OVER {over(20)} = 20 THEN sum(mv) OVER {over(20)} / sum(volume) OVER {over(20)} END AS cmf_20, {_div(f'volume - {full_sql("avg", "volume", 20)}', full_sql('stddev_pop', 'volume', 20))} AS volume_zscore_20 FROM (SELECT *, CASE WHEN tp > pt THEN tp * volume ELSE 0 END AS up, CASE WHEN tp < pt THEN tp * volume ELSE 0 END AS dn FROM (SELECT *, {lag_sql('close')} AS pc, (high + low + close) / 3 AS tp, {lag_sql('(high + low + close) / 3')} AS pt, {_div('(close - low) - (high - close)', 'high - low', '0.0')} * volume AS mv FROM candles))"),
    "symbol", "obv mfi_14 cmf_20 volume_zscore_20", "ts",
)
def volume_flow(spark, d):
    return indicators.volume_flow(hourly(spark, d))


@query(
    "structure",
    C(f"SELECT symbol, ts, s AS support, r AS resistance, coalesce(close > r, false)::INT AS break_resistance, coalesce(close < s, false)::INT AS break_support, CASE WHEN n = 10 THEN (high >= mx)::INT END AS swing_high, {_div('10 * sl', 'close')} AS trend_slope, {_div('abs(close - c10)', 'st')} AS efficiency FROM (SELECT symbol, timeframe, ts, close, high, {lag_sql('lo')} AS s, {lag_sql('hi')} AS r, n, mx, CASE WHEN n = 10 THEN regr_slope(close, i) OVER {over(10)} END AS sl, {lag_sql('close', 10)} AS c10, {full_sql('sum', 'step', 10)} AS st FROM (SELECT *, {full_sql('min', 'low', 20)} AS lo, {full_sql('max', 'high', 20)} AS hi, count(*) OVER {over(10)} AS n, max(high) OVER {over(10)} AS mx, row_number() OVER ({SERIES_SQL}) AS i, abs(close - {lag_sql('close')}) AS step FROM candles))"),
    "symbol", "support resistance break_resistance break_support swing_high trend_slope efficiency", "ts",
)
def structure(spark, d):
    return indicators.structure(hourly(spark, d))


@query(
    "regime",
    C(f"SELECT symbol, ts, vol AS regime_volatility_20, e AS regime_efficiency_20, CASE WHEN len(vs) = 20 THEN len(list_filter(vs, lambda x: x <= vol)) / 20.0 END AS regime_vol_percentile_20, coalesce(e < 0.25, false)::INT AS regime_range_20, CASE WHEN count(lr) OVER {over(20)} = 20 THEN var_samp(lr2) OVER {over(19)} / (2 * var_samp(lr) OVER {over(20)}) END AS regime_variance_ratio_20 FROM (SELECT *, list(vol) FILTER (vol IS NOT NULL) OVER {over(20)} AS vs FROM (SELECT *, {full_sql('stddev_pop', 'lr', 20)} AS vol, {_div('abs(close - c20)', full_sql('sum', 'step', 20))} AS e, lr + {lag_sql('lr')} AS lr2 FROM (SELECT symbol, timeframe, ts, close, CASE WHEN close > 0 AND {lag_sql('close')} > 0 THEN ln(close / {lag_sql('close')}) END AS lr, abs(close - {lag_sql('close')}) AS step, {lag_sql('close', 20)} AS c20 FROM candles)))"),
    "symbol", "regime_volatility_20 regime_efficiency_20 regime_vol_percentile_20 regime_range_20 regime_variance_ratio_20", "ts",
)
def regime(spark, d):
    return indicators.regime(hourly(spark, d))


@query("volatility_gauge", C(f"SELECT symbol, ts, rv AS gauge_realized, CASE WHEN len(vs) = 252 THEN len(list_filter(vs, lambda x: x <= rv)) / 252.0 END AS gauge_percentile, {full_sql('stddev_pop', 'rv', 20)} AS gauge_vol_of_vol FROM (SELECT *, list(rv) FILTER (rv IS NOT NULL) OVER {over(252)} AS vs FROM (SELECT *, sqrt(252.0) * {full_sql('stddev_pop', 'lr', 20)} AS rv FROM (SELECT symbol, timeframe, ts, CASE WHEN close > 0 AND {lag_sql('close')} > 0 THEN ln(close / {lag_sql('close')}) END AS lr FROM candles)))"), "symbol", "gauge_realized gauge_percentile gauge_vol_of_vol", "ts")
def volatility_gauge(spark, d):
    return indicators.volatility_gauge(hourly(spark, d))


_SESSION = "CASE WHEN hour(ts) < 7 THEN 'asia' WHEN hour(ts) < 12 THEN 'london' WHEN hour(ts) < 17 THEN 'london_ny_overlap' WHEN hour(ts) < 22 THEN 'new_york' ELSE 'off_hours' END"


@query("calendar", C(f"SELECT symbol, ts, {_SESSION} AS session, isodow(ts) - 1 AS weekday, (isodow(ts) >= 6)::INT AS is_weekend, sin(2 * pi() * hour(ts) / 24) AS hour_sin, cos(2 * pi() * (month(ts) - 1) / 12) AS month_cos FROM candles"), "symbol session", "weekday is_weekend hour_sin month_cos", "ts")
def calendar(spark, d):
    return indicators.calendar(hourly(spark, d))


@query("session_blocks", C(f"SELECT symbol, ts, blk AS session_block, {_div('close - o', 'o')} AS session_return, {_div('h - l', 'o')} AS session_range_pct FROM (SELECT *, first_value(open) OVER w AS o, max(high) OVER w AS h, min(low) OVER w AS l FROM (SELECT *, sum(chg) OVER ({SERIES_SQL}) AS blk FROM (SELECT *, coalesce(s <> lag(s) OVER ({SERIES_SQL}), false)::INT AS chg FROM (SELECT *, {_SESSION} AS s FROM candles))) WINDOW w AS (PARTITION BY symbol, timeframe, blk ORDER BY ts))"), "symbol", "session_block session_return session_range_pct", "ts")
def session_blocks(spark, d):
    return indicators.sessions(hourly(spark, d))


@query("microstructure", C(f"SELECT symbol, ts, clv AS micro_clv, coalesce(last_value(t IGNORE NULLS) OVER ({SERIES_SQL}), 0) AS micro_tick_sign, high - low AS micro_spread, {full_sql('avg', 'imb', 10)} AS micro_imbalance_sma_10 FROM (SELECT *, nullif(sign(close - {lag_sql('close')}), 0) AS t, (2 * clv - 1) * volume / greatest(volume, 1e-12) AS imb FROM (SELECT *, least(1, greatest(0, (close - low) / greatest(high - low, 1e-12))) AS clv FROM candles))"), "symbol", "micro_clv micro_tick_sign micro_spread micro_imbalance_sma_10", "ts")
def microstructure(spark, d):
    return indicators.microstructure(hourly(spark, d))


def _recursion(alpha: str, value: str, period: int, first: int = 1) -> str:
    """A smoothing as a recursive table e(symbol, i, y): seeded by the mean of rows first to first + period - 1."""
    last = first + period - 1
    return f"n AS (SELECT *, row_number() OVER ({SERIES_SQL}) AS i FROM v), e AS (SELECT symbol, {last}::BIGINT AS i, avg({value}) AS y FROM n WHERE i BETWEEN {first} AND {last} GROUP BY symbol HAVING count(*) = {period} UNION ALL SELECT n.symbol, n.i, {alpha} * n.{value} + (1 - {alpha}) * e.y FROM e JOIN n ON n.symbol = e.symbol AND n.i = e.i + 1)"


def _recursive_sql(body: str, v: str, alpha: str, value: str, period: int, first: int = 1) -> str:
    return f"WITH RECURSIVE {with_candles('', '')[5:].strip()}, v AS ({v}), {_recursion(alpha, value, period, first)} {body}"


@query("ema", _recursive_sql("SELECT n.symbol, n.ts, e.y AS ema_20 FROM n LEFT JOIN e ON n.symbol = e.symbol AND n.i = e.i", "SELECT * FROM candles", "(2.0 / 21)", "close", 20), "symbol", "ema_20", "ts")
def ema(spark, d):
    return recursive.ema(hourly(spark, d), "close", 20)


_TR = f"SELECT *, greatest(high - low, abs(high - coalesce({lag_sql('close')}, close)), abs(low - coalesce({lag_sql('close')}, close))) AS tr, greatest(close - {lag_sql('close')}, 0) AS gain FROM candles"


@query("atr", _recursive_sql("SELECT n.symbol, n.ts, e.y AS atr_14 FROM n LEFT JOIN e ON n.symbol = e.symbol AND n.i = e.i", _TR, "(2.0 / 15)", "tr", 14), "symbol", "atr_14", "ts")
def atr(spark, d):
    return recursive.atr(hourly(spark, d))


def _ema_sql(name: str, source: str, value: str, period: int, first: int = 1, alpha: str | None = None) -> str:
    """A smoothing of one column of rows numbered by i, as a recursive table name(symbol, i, y)."""
    last, a = first + period - 1, alpha or f"(2.0::DOUBLE / {period + 1})"
    return f"{name} AS (SELECT symbol, {last}::BIGINT AS i, avg({value}) AS y FROM ({source}) WHERE i BETWEEN {first} AND {last} GROUP BY symbol HAVING count(*) = {period} UNION ALL SELECT n.symbol, n.i, {a} * n.{value} + (1 - {a}) * e.y FROM {name} e JOIN ({source}) n ON n.symbol = e.symbol AND n.i = e.i + 1)"


def _recursive(body: str, tables: str) -> str:
    """SQL over b, the numbered candles with their true range, and recursive tables."""
    return with_candles(body, f"b AS (SELECT *, row_number() OVER ({SERIES_SQL}) AS i FROM ({_TR})), {tables}").replace("WITH ", "WITH RECURSIVE ", 1)


@query("rsi", with_candles("SELECT n.symbol, n.ts, CASE WHEN e.g = 0 AND e.l = 0 THEN 50 WHEN e.l = 0 THEN 100 ELSE 100 - 100 / (1 + e.g / e.l) END AS rsi_14 FROM n LEFT JOIN e ON n.symbol = e.symbol AND n.i = e.i", f"n AS (SELECT *, row_number() OVER ({SERIES_SQL}) AS i, greatest(close - {lag_sql('close')}, 0) AS gain, greatest({lag_sql('close')} - close, 0) AS loss FROM candles), e AS (SELECT symbol, 15::BIGINT AS i, avg(gain) AS g, avg(loss) AS l FROM n WHERE i BETWEEN 2 AND 15 GROUP BY symbol HAVING count(*) = 14 UNION ALL SELECT n.symbol, n.i, (e.g * 13 + n.gain) / 14, (e.l * 13 + n.loss) / 14 FROM e JOIN n ON n.symbol = e.symbol AND n.i = e.i + 1)").replace("WITH ", "WITH RECURSIVE ", 1), "symbol", "rsi_14", "ts")
def rsi(spark, d):
    return recursive.rsi(hourly(spark, d))


_MACD = f"{_ema_sql('f', 'SELECT * FROM b', 'close', 12)}, {_ema_sql('g', 'SELECT * FROM b', 'close', 26)}, l AS (SELECT b.symbol, b.i, f.y - g.y AS line FROM b JOIN f USING (symbol, i) JOIN g USING (symbol, i)), {_ema_sql('h', 'SELECT * FROM l', 'line', 9, 26)}"


@query("macd", _recursive(f"SELECT b.symbol, b.ts, l.line AS macd, h.y AS macd_signal, l.line - h.y AS macd_histogram FROM b LEFT JOIN l USING (symbol, i) LEFT JOIN h USING (symbol, i)", _MACD), "symbol", "macd macd_signal macd_histogram", "ts")
def macd(spark, d):
    return recursive.macd(hourly(spark, d))


_DM = f"m AS (SELECT *, CASE WHEN up > dn AND up > 0 THEN up ELSE 0.0 END AS plus, CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0.0 END AS minus FROM (SELECT *, high - lag(high) OVER ({SERIES_SQL}) AS up, lag(low) OVER ({SERIES_SQL}) - low AS dn FROM b))"
_ADX = f"{_DM}, {', '.join(_ema_sql(n, 'SELECT * FROM m', x, 14, 1, '(1.0 / 14)') for n, x in (('f', 'tr'), ('g', 'plus'), ('h', 'minus')))}, l AS (SELECT symbol, i, 100 * g.y / f.y AS p, 100 * h.y / f.y AS q FROM f JOIN g USING (symbol, i) JOIN h USING (symbol, i)), x AS (SELECT *, 100 * abs(p - q) / (p + q) AS dx FROM l), {_ema_sql('k', 'SELECT * FROM x', 'dx', 14, 14, '(1.0 / 14)')}"


@query("adx", _recursive("SELECT b.symbol, b.ts, l.p AS plus_di, l.q AS minus_di, k.y AS adx_14 FROM b LEFT JOIN l USING (symbol, i) LEFT JOIN k USING (symbol, i)", _ADX), "symbol", "plus_di minus_di adx_14", "ts")
def adx(spark, d):
    return recursive.adx(hourly(spark, d))


@query("keltner", _recursive("SELECT b.symbol, b.ts, f.y AS keltner_mid, f.y + 2 * g.y AS keltner_upper, f.y - 2 * g.y AS keltner_lower, 4 * g.y / f.y AS keltner_width, CASE WHEN g.y <> 0 THEN (b.close - (f.y - 2 * g.y)) / (4 * g.y) END AS keltner_position FROM b LEFT JOIN f USING (symbol, i) LEFT JOIN g USING (symbol, i)", f"{_ema_sql('f', 'SELECT * FROM b', 'close', 20)}, {_ema_sql('g', 'SELECT * FROM b', 'tr', 20)}"), "symbol", "keltner_mid keltner_upper keltner_lower keltner_width keltner_position", "ts")
def keltner(spark, d):
    return recursive.keltner(hourly(spark, d))


@query("supertrend")
def supertrend(spark, d):
    return recursive.supertrend(hourly(spark, d))


@query(
    "label_columns",
    C(f"SELECT symbol, ts, (r > 0)::INT AS label_binary_5, CASE WHEN r < -0.002 THEN 0 WHEN r > 0.002 THEN 2 WHEN r IS NOT NULL THEN 1 END AS label_multiclass_5, r AS label_future_return_5, CASE WHEN n = 5 THEN h / close - 1 END AS label_future_high_5, CASE WHEN n = 5 THEN l / close - 1 END AS label_future_low_5, CASE WHEN n = 5 AND greatest(close - l, 0) <> 0 THEN greatest(h - close, 0) / greatest(close - l, 0) END AS label_risk_reward_5, CASE WHEN n = 5 THEN sv END AS label_future_volatility_5 FROM (SELECT symbol, timeframe, ts, close, {_div(f'lead(close, 5) OVER ({SERIES_SQL}) - close', 'close')} AS r, count(*) OVER w AS n, max(high) OVER w AS h, min(low) OVER w AS l, stddev_pop(st) OVER w AS sv FROM (SELECT *, {_div(f'close - {lag_sql("close")}', lag_sql('close'))} AS st FROM candles) WINDOW w AS ({SERIES_SQL} ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING))"),
    "symbol", "label_binary_5 label_multiclass_5 label_future_return_5 label_future_high_5 label_future_low_5 label_risk_reward_5 label_future_volatility_5", "ts",
)
def label_columns(spark, d):
    return labels.generate(hourly(spark, d), ("binary", "multiclass", "future_return", "future_high", "future_low", "risk_reward", "future_volatility"), (5,))


@query("triple_barrier", C(f"SELECT symbol, ts, CASE WHEN len(b) = 5 AND s IS NOT NULL THEN coalesce(list_filter(list_transform(b, lambda x: CASE WHEN x.low <= close - s THEN -1.0 WHEN x.high >= close + 2 * s THEN 1.0 END), lambda y: y IS NOT NULL)[1], sign(c5 - close)) END AS label_triple_barrier_5 FROM (SELECT symbol, ts, close, list({{'high': high, 'low': low}}) OVER ({SERIES_SQL} ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS b, lead(close, 5) OVER ({SERIES_SQL}) AS c5, {full_sql('stddev_pop', 'close', 10)} AS s FROM candles)"), "symbol", "label_triple_barrier_5", "ts")
def triple_barrier(spark, d):
    return labels.generate(hourly(spark, d).withColumn("size", W.std("close", 10)), ("triple_barrier",), (5,), "size")


@query("volatility_profile", C(f"SELECT symbol, count(x) AS n, avg(x) AS mean, quantile_cont(x, 0.5) AS median, stddev_samp(x) AS std, min(x) AS min, max(x) AS max, quantile_cont(x, 0.25) AS p25, quantile_cont(x, 0.75) AS p75 FROM (SELECT symbol, {_div('tr', 'close', '0.0')} AS x FROM ({_TR})) GROUP BY symbol"), "symbol n", "mean median std min max p25 p75")
def volatility_profile(spark, d):
    return profiles.volatility_profile(hourly(spark, d))


@query("session_profile", C("SELECT symbol, CASE WHEN hour(ts) < 7 THEN 'asian' WHEN hour(ts) < 13 THEN 'european' WHEN hour(ts) < 22 THEN 'us' ELSE 'pacific' END AS session, count(*) AS bars, avg(CASE WHEN close > 0 THEN (high - low) / close ELSE 0 END) AS volatility, avg(volume) AS volume, avg(high - low) AS range, avg(abs(close - open)) AS body FROM candles GROUP BY ALL"), "symbol session bars", "volatility volume range body")
def session_profile(spark, d):
    return profiles.session_profile(hourly(spark, d))


@query("monthly_profile", C(f"SELECT symbol, month, count(r) AS n, avg(r) AS avg_return, least(1, greatest(-1, 10 * avg(r))) AS direction_bias FROM (SELECT symbol, month(ts) AS month, {_div(f'close - {lag_sql("close")}', lag_sql('close'))} AS r FROM candles) WHERE r IS NOT NULL GROUP BY symbol, month"), "symbol month n", "avg_return direction_bias")
def monthly_profile(spark, d):
    return profiles.monthly_profile(hourly(spark, d))


_AHEAD = f"a AS (SELECT symbol, ts, {_div(f'lead(close, 5) OVER ({SERIES_SQL}) - close', 'close')} AS ahead FROM candles), o AS (SELECT p.pattern, CASE WHEN p.direction = 'bearish' THEN -1 ELSE 1 END * a.ahead AS result FROM ({_PATTERN_SQL}) p JOIN a USING (symbol, ts) WHERE a.ahead IS NOT NULL), g AS (SELECT pattern, count(*) AS n, avg((result > 0)::INT) AS success_rate, coalesce(avg(result) FILTER (result > 0), 0) AS avg_win, coalesce(avg(result) FILTER (NOT result > 0), 0) AS avg_loss FROM o GROUP BY pattern)"


@query("pattern_profile", C(f"SELECT *, 5 AS avg_hold, least(1, n / 100 * success_rate) AS confidence, success_rate * avg_win + (1 - success_rate) * avg_loss AS expectancy, {_div('avg_win', 'abs(avg_loss)', '0')} AS win_loss_ratio FROM g", _AHEAD), "pattern n", "success_rate avg_win avg_loss avg_hold confidence expectancy win_loss_ratio")
def pattern_profile(spark, d):
    rows = hourly(spark, d)
    return profiles.pattern_profile(profiles.outcomes_of(patterns.patterns.detect(rows), rows))


@query("basic_features", C(f"SELECT symbol, ts, avg(close) OVER {over(20)} AS window_mean, coalesce(stddev_samp(close) OVER {over(20)}, 0) AS window_std, sum(close * volume) OVER {over(20)} / sum(volume) OVER {over(20)} AS window_vwap, coalesce(close - {lag_sql('close', 20)}, 0) AS flat_momentum FROM candles"), "symbol", "window_mean window_std window_vwap flat_momentum", "ts")
def basic_features(spark, d):
    return price.basic_features(hourly(spark, d))


@query("peer_features", C(f"SELECT symbol, ts, CASE WHEN count(CASE WHEN r IS NOT NULL AND pr IS NOT NULL THEN 1 END) OVER w = 20 AND var_pop(r) OVER w <> 0 AND var_pop(pr) OVER w <> 0 THEN corr(r, pr) OVER w END AS correlation, r - pr AS relative_return FROM (SELECT a.symbol, a.timeframe, a.ts, a.r, b.r AS pr FROM rr a ASOF LEFT JOIN (SELECT * FROM rr WHERE symbol = 'view') b ON a.timeframe = b.timeframe AND a.ts >= b.ts WHERE a.symbol <> 'view') WINDOW w AS ({SERIES_SQL} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)", f"rr AS (SELECT symbol, timeframe, ts, {_div(f'close - {lag_sql("close")}', lag_sql('close'))} AS r FROM candles)"), "symbol", "correlation relative_return", "ts")
def peer_features(spark, d):
    rows = hourly(spark, d)
    return correlation.peer_features(rows, rows.filter(F.col("symbol") == "view"), 20)
