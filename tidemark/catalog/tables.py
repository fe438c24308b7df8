"""Queries of joins, resampling, cleaning, quality, splits, scaling and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import windows as W
from ..operators import asof, cleaning, information, joins, quality, resample, scaling, splits
from ..schema import candles
from .base import CANDLES_SQL, SERIES_SQL, TIMEFRAMES_SQL, full_sql, hourly, lag_sql, query, read, ticks, with_candles

C = with_candles


def _split(spark, d):
    """Bars of the two halves of the ticks: those of each broker."""
    t = ticks(spark, d)
    return [candles(t.filter(F.col("side") == k), order=("ts", "event_id")) for k in (0, 1)]


_HALVES = ", ".join(f"h{k} AS (SELECT symbol, 'H1' AS timeframe, date_trunc('hour', ts) AS ts, last(last ORDER BY ts, event_id) AS close, count(*)::DOUBLE AS volume FROM ticks WHERE side = {k} GROUP BY symbol, date_trunc('hour', ts))" for k in (0, 1))


@query("compare_closes", f"WITH {CANDLES_SQL}, {_HALVES} SELECT a.symbol, a.ts, a.close AS close_a, b.close AS close_b, a.close - b.close AS diff, CASE WHEN a.close + b.close <> 0 THEN (a.close - b.close) * 10000 / ((a.close + b.close) / 2) END AS diff_bps FROM h0 a JOIN h1 b USING (symbol, ts)", "symbol", "close_a close_b diff diff_bps", "ts")
def compare_closes(spark, d):
    a, b = _split(spark, d)
    both = a.withColumn("broker", F.lit("A")).unionByName(b.withColumn("broker", F.lit("B")))
    return joins.compare_closes(both, "A", "B")


@query("instruments", "SELECT p_brand AS canonical_symbol, min(p_type) AS asset_class, count(DISTINCT p_size) AS n_brokers FROM part GROUP BY p_brand HAVING count(DISTINCT p_size) >= 20", "canonical_symbol asset_class n_brokers")
def instruments(spark, d):
    markets = read(spark, d, "part").select(F.col("p_size").alias("broker_id"), F.col("p_name").alias("symbol"), F.col("p_brand").alias("canonical_symbol"), F.col("p_type").alias("asset_class"))
    brokers = read(spark, d, "nation").select(F.col("n_nationkey").alias("broker_id"), F.col("n_name").alias("name"))
    return joins.instruments(markets, brokers, 20)


for _how, _sql in {"inner": "JOIN", "left": "LEFT JOIN", "right": "RIGHT JOIN", "outer": "FULL JOIN"}.items():

    @query(f"merge_{_how}", f"SELECT coalesce(a.k, b.k) AS k, a.c_name, b.s_name, a.v, b.v AS v_right FROM (SELECT 2 * c_custkey AS k, c_name, c_acctbal AS v FROM customer) a {_sql} (SELECT s_suppkey AS k, s_name, s_acctbal AS v FROM supplier) b ON a.k IS NOT DISTINCT FROM b.k", "k c_name s_name", "v v_right")
    def merge(spark, d, how=_how):
        a = read(spark, d, "customer").select((2 * F.col("c_custkey")).alias("k"), "c_name", F.col("c_acctbal").alias("v"))
        b = read(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), "s_name", F.col("s_acctbal").alias("v"))
        return joins.merge(a, b, "k", how)


@query("merge_all", "SELECT n_nationkey AS k, any_value(n_name) AS n_name, count(DISTINCT s_suppkey) AS suppliers, count(DISTINCT c_custkey) AS customers FROM nation JOIN supplier ON s_nationkey = n_nationkey JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey", "k n_name suppliers customers")
def merge_all(spark, d):
    n = read(spark, d, "nation").select(F.col("n_nationkey").alias("k"), "n_name")
    s = read(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    c = read(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return joins.merge_all({"n": n, "s": s, "c": c}, "k").selectExpr("k", "n_n_name AS n_name", "s_n AS suppliers", "c_n AS customers")


@query("key_overlap", "SELECT (SELECT count(DISTINCT o_custkey) FROM orders) AS left_keys, (SELECT count(*) FROM customer) AS right_keys, (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)) AS shared_keys, (SELECT count(*) - count(DISTINCT o_custkey) FROM orders) AS left_duplicates", "left_keys right_keys shared_keys left_duplicates")
def key_overlap(spark, d):
    return joins.key_overlap(read(spark, d, "orders").select(F.col("o_custkey").alias("k")), read(spark, d, "customer").select(F.col("c_custkey").alias("k")), "k")


_ASOF = f"WITH {CANDLES_SQL}, {_HALVES} SELECT a.symbol, a.ts, a.close, b.ts AS right_ts, b.close AS right_close FROM h0 a"


@query("asof_backward", f"{_ASOF} ASOF LEFT JOIN h1 b ON a.symbol = b.symbol AND a.ts >= b.ts", "symbol", "close right_close", "ts right_ts")
def asof_backward(spark, d):
    return asof.asof_join(*_split(spark, d), ["symbol", "timeframe"], columns=["close"])


@query("asof_forward", f"{_ASOF} ASOF LEFT JOIN h1 b ON a.symbol = b.symbol AND a.ts <= b.ts", "symbol", "close right_close", "ts right_ts")
def asof_forward(spark, d):
    return asof.asof_join(*_split(spark, d), ["symbol", "timeframe"], direction="forward", columns=["close"])


@query("asof_tolerance", f"WITH {CANDLES_SQL}, {_HALVES} SELECT a.symbol, a.ts, a.close, CASE WHEN date_diff('second', b.ts, a.ts) <= 7200 THEN b.close END AS right_close FROM h0 a ASOF LEFT JOIN h1 b ON a.symbol = b.symbol AND a.ts >= b.ts", "symbol", "close right_close", "ts")
def asof_tolerance(spark, d):
    return asof.asof_join(*_split(spark, d), ["symbol", "timeframe"], tolerance=7200, columns=["close"])


@query("asof_nearest", f"WITH {CANDLES_SQL}, {_HALVES}, f AS (SELECT a.symbol, a.ts, a.close, b.ts AS bt, b.close AS bc FROM h0 a ASOF LEFT JOIN h1 b ON a.symbol = b.symbol AND a.ts >= b.ts), g AS (SELECT a.symbol, a.ts, b.ts AS nt, b.close AS nc FROM h0 a ASOF LEFT JOIN h1 b ON a.symbol = b.symbol AND a.ts <= b.ts) SELECT symbol, ts, close, CASE WHEN nt IS NULL OR (bt IS NOT NULL AND ts - bt <= nt - ts) THEN bc ELSE nc END AS right_close FROM f JOIN g USING (symbol, ts)", "symbol", "close right_close", "ts")
def asof_nearest(spark, d):
    return joins.merge_aligned(*_split(spark, d), ["symbol", "timeframe"], ["close"], "nearest")


@query("asof_interpolate", f"WITH {CANDLES_SQL}, {_HALVES}, f AS (SELECT a.symbol, a.ts, a.close, b.ts AS bt, b.close AS bc FROM h0 a ASOF LEFT JOIN h1 b ON a.symbol = b.symbol AND a.ts >= b.ts), g AS (SELECT a.symbol, a.ts, b.ts AS nt, b.close AS nc FROM h0 a ASOF LEFT JOIN h1 b ON a.symbol = b.symbol AND a.ts <= b.ts) SELECT symbol, ts, close, coalesce(bc + (nc - bc) * CASE WHEN nt > bt THEN date_diff('second', bt, ts)::DOUBLE / date_diff('second', bt, nt) ELSE 0 END, bc, nc) AS right_close FROM f JOIN g USING (symbol, ts)", "symbol", "close right_close", "ts")
def asof_interpolate(spark, d):
    return joins.merge_aligned(*_split(spark, d), ["symbol", "timeframe"], ["close"], "interpolate")


@query("align_blocks", f"WITH {CANDLES_SQL}, {_HALVES}, d1 AS (SELECT symbol, date_trunc('day', ts) AS ts, max(high) AS high FROM candles GROUP BY symbol, date_trunc('day', ts)) SELECT a.symbol, a.ts, coalesce(b.close, -1) AS other_close, coalesce(c.high, -1) AS day_high FROM h0 a ASOF LEFT JOIN h1 b ON a.symbol = b.symbol AND a.ts >= b.ts ASOF LEFT JOIN d1 c ON a.symbol = c.symbol AND a.ts >= c.ts", "symbol", "other_close day_high", "ts")
def align_blocks(spark, d):
    a, b = _split(spark, d)
    day = candles(ticks(spark, d), "day", "D1", order=("ts", "event_id")).select("symbol", "ts", "high")
    return asof.align_blocks(a, {"other": b.select("symbol", "ts", "close"), "day": day}, ["symbol"], fill=-1.0)


@query("inventory", C("SELECT CASE WHEN symbol IN ('click', 'view') THEN 'a' ELSE 'b' END AS asset_class, symbol, timeframe, count(*) AS bars, min(ts) AS first_ts, max(ts) AS last_ts FROM candles GROUP BY ALL"), "asset_class symbol timeframe bars", times="first_ts last_ts")
def inventory(spark, d):
    return joins.inventory(hourly(spark, d), F.when(F.col("symbol").isin("click", "view"), "a").otherwise("b"))


@query("download_queue", "SELECT c_mktsegment AS symbol, 'x' AS timeframe, min(c_nationkey)::BIGINT AS priority FROM customer WHERE c_mktsegment <> 'BUILDING' GROUP BY c_mktsegment UNION ALL SELECT 'BUILDING', 'x', 1", "symbol timeframe priority")
def download_queue(spark, d):
    queue = spark.createDataFrame([("BUILDING", "x", 1)], "symbol string, timeframe string, priority long")
    requests = read(spark, d, "customer").select(F.col("c_mktsegment").alias("symbol"), F.lit("x").alias("timeframe"), F.col("c_nationkey").cast("long").alias("priority"))
    return joins.pending(queue, requests)


_BARS = "first(open ORDER BY ts) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY ts) AS close, sum(volume) AS volume"


@query("resample_calendar", C(f"SELECT symbol, time_bucket(INTERVAL 4 HOUR, ts) AS ts, {_BARS}, count(*) AS bars FROM (SELECT symbol, time_bucket(INTERVAL 4 HOUR, ts) AS b, * EXCLUDE (symbol) FROM candles) GROUP BY symbol, time_bucket(INTERVAL 4 HOUR, ts)"), "symbol bars", "open high low close volume", "ts")
def resample_calendar(spark, d):
    return resample.by_calendar(hourly(spark, d), "H4")


@query("resample_count", C(f"SELECT symbol, min(ts) AS ts, {_BARS}, count(*) AS bars FROM (SELECT *, (row_number() OVER ({SERIES_SQL}) - 1) // 4 AS g FROM candles) GROUP BY symbol, g"), "symbol bars", "open high low close volume", "ts")
def resample_count(spark, d):
    return resample.by_count(hourly(spark, d), "H1", "H4")


@query("resample_weighted", C("SELECT symbol, date_trunc('day', ts) AS ts, sum(open * volume) / sum(volume) AS open, max(high) AS high, sum(close * volume) / sum(volume) AS close FROM candles GROUP BY symbol, date_trunc('day', ts)"), "symbol", "open high close", "ts")
def resample_weighted(spark, d):
    return resample.by_calendar(hourly(spark, d), "D1", "weighted")


@query("resample_mean", C("SELECT symbol, date_trunc('day', ts) AS ts, avg(open) AS open, avg(close) AS close, sum(volume) AS volume FROM candles GROUP BY symbol, date_trunc('day', ts)"), "symbol", "open close volume", "ts")
def resample_mean(spark, d):
    return resample.by_calendar(hourly(spark, d), "D1", "mean")


@query("resample_interpolated", C(f"SELECT symbol, ts + to_seconds(k * 900) AS ts, close + (coalesce(nx, close) - close) * k / n AS close, 4 AS per_source FROM (SELECT *, unnest(range(n)) AS k FROM (SELECT symbol, ts, close, lead(close) OVER ({SERIES_SQL}) AS nx, coalesce(greatest(1, date_diff('second', ts, lead(ts) OVER ({SERIES_SQL})) // 900), 1) AS n FROM candles))"), "symbol", "close per_source", "ts")
def resample_interpolated(spark, d):
    return resample.interpolated(hourly(spark, d), "H1", "M15")


@query("volume_bars", C("SELECT symbol, g AS volume_group, min(ts) AS ts, avg(open) AS open, avg(high) AS high, avg(low) AS low, avg(close) AS close, sum(volume) AS volume, count(*) AS bars FROM e JOIN n USING (symbol, i) GROUP BY symbol, g", f"n AS (SELECT *, row_number() OVER ({SERIES_SQL}) AS i FROM candles), e AS (SELECT symbol, i, 0::BIGINT AS g, volume AS v FROM n WHERE i = 1 UNION ALL SELECT n.symbol, n.i, CASE WHEN e.v >= 20 THEN e.g + 1 ELSE e.g END, CASE WHEN e.v >= 20 THEN n.volume ELSE e.v + n.volume END FROM e JOIN n ON n.symbol = e.symbol AND n.i = e.i + 1)").replace("WITH ", "WITH RECURSIVE ", 1), "symbol volume_group bars", "open high low close volume", "ts")
def volume_bars(spark, d):
    return resample.by_volume(hourly(spark, d), 20.0)


@query("detect_timeframe", C("SELECT symbol, m AS mean_gap, CASE WHEN min(abs(m - seconds) / seconds) <= 0.3 THEN arg_min(name, abs(m - seconds) / seconds) END AS timeframe FROM (SELECT symbol, avg(g) AS m FROM (SELECT symbol, date_diff('second', lag(ts) OVER w, ts) AS g, row_number() OVER w AS i FROM candles WINDOW w AS (PARTITION BY symbol ORDER BY ts)) WHERE i <= 101 AND g > 0 GROUP BY symbol), tf GROUP BY symbol, m", TIMEFRAMES_SQL), "symbol timeframe", "mean_gap")
def detect_timeframe(spark, d):
    return resample.detected_timeframe(hourly(spark, d))


def _holed(spark, d):
    return hourly(spark, d).withColumn("close", F.when(F.hour("ts") % 5 != 0, F.col("close")))


_HOLED = "SELECT * REPLACE (CASE WHEN hour(ts) % 5 <> 0 THEN close END AS close) FROM candles"


@query("drop_duplicates", "SELECT user_id, min(event_id) AS event_id FROM events GROUP BY user_id", "user_id event_id")
def drop_duplicates(spark, d):
    return cleaning.drop_duplicates(read(spark, d, "events"), ("user_id",), ("event_id",))


@query("missing_counts", C(f"SELECT 'close' AS field, count(*) AS n_rows, count(*) - count(close) AS missing, (count(*) - count(close))::DOUBLE / count(*) AS rate FROM ({_HOLED})"), "field n_rows missing", "rate")
def missing_counts(spark, d):
    return cleaning.missing_counts(_holed(spark, d), ["close"])


@query("fill_linear", C(f"SELECT symbol, ts, coalesce(close, pv + (nv - pv) * (i - pi) / (ni - pi), pv, nv) AS close FROM (SELECT *, last_value(v.c IGNORE NULLS) OVER a AS pv, last_value(v.i IGNORE NULLS) OVER a AS pi, first_value(v.c IGNORE NULLS) OVER b AS nv, first_value(v.i IGNORE NULLS) OVER b AS ni FROM (SELECT *, CASE WHEN close IS NOT NULL THEN {{'c': close, 'i': i}} END AS v FROM (SELECT *, row_number() OVER ({SERIES_SQL}) AS i FROM ({_HOLED}))) WINDOW a AS ({SERIES_SQL} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS ({SERIES_SQL} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"), "symbol", "close", "ts")
def fill_linear(spark, d):
    return cleaning.fill_missing(_holed(spark, d), ["close"], "linear")


for _method, _value in {"mean": "avg(close) OVER (PARTITION BY symbol)", "median": "quantile_cont(close, 0.5) OVER (PARTITION BY symbol)", "forward": f"last_value(close IGNORE NULLS) OVER ({SERIES_SQL}), avg(close) OVER (PARTITION BY symbol)", "backward": f"first_value(close IGNORE NULLS) OVER ({SERIES_SQL} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), avg(close) OVER (PARTITION BY symbol)", "zero": "0"}.items():

    @query(f"fill_{_method}", C(f"SELECT symbol, ts, coalesce(close, {_value}) AS close FROM ({_HOLED})"), "symbol", "close", "ts")
    def fill(spark, d, method=_method):
        return cleaning.fill_missing(_holed(spark, d), ["close"], method)


_AROUND = f"({SERIES_SQL} ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING)"
_Z = f"SELECT *, avg(close) OVER {_AROUND} AS m, stddev_samp(close) OVER {_AROUND} AS s, CASE WHEN stddev_samp(close) OVER {_AROUND} <> 0 THEN (close - avg(close) OVER {_AROUND}) / stddev_samp(close) OVER {_AROUND} ELSE 0 END AS z, list_sort(list(close) OVER {_AROUND}) AS l, quantile_cont(close, 0.5) OVER {_AROUND} AS med FROM candles"

for _method, _value in {"clip": "m + sign(z) * 1.5 * s", "median": "med", "winsorize": "least(greatest(close, l[1 + (len(l) * 0.05)::INT]), l[1 + (len(l) * 0.95 - 0.5)::INT])"}.items():

    @query(f"outliers_{_method}", C(f"SELECT symbol, ts, CASE WHEN abs(z) > 1.5 THEN {_value.replace('(len(l) * 0.05)::INT', 'floor(len(l) * 0.05)::INT').replace('(len(l) * 0.95 - 0.5)::INT', 'floor(len(l) * 0.95)::INT')} ELSE close END AS close FROM ({_Z})"), "symbol", "close", "ts")
    def outliers(spark, d, method=_method):
        return cleaning.handle_outliers(hourly(spark, d), ["close"], method, 1.5)


@query("outliers_drop", C(f"SELECT symbol, ts, close FROM ({_Z}) WHERE abs(z) <= 1.5"), "symbol", "close", "ts")
def outliers_drop(spark, d):
    return cleaning.handle_outliers(hourly(spark, d), ["close"], "drop", 1.5)


_ISSUES = f"SELECT symbol, issue, count(*) AS n FROM (SELECT symbol, unnest(list_filter([CASE WHEN high = low THEN 'zero_range' END, CASE WHEN close <> 0 AND (high - low) / close > 0.05 THEN 'wide_range' END, CASE WHEN n >= 10 AND volume > 10 * med THEN 'volume_spike' END, CASE WHEN least(open, high, low, close) < 1e-4 THEN 'out_of_range' END, CASE WHEN gap > 3 * mg AND gap > 10 THEN 'long_gap' END], lambda x: x IS NOT NULL)) AS issue FROM (SELECT *, quantile_cont(volume, 0.5) OVER p AS med, count(*) OVER p AS n, avg(CASE WHEN gap > 0 THEN gap END) OVER p AS mg FROM (SELECT *, date_diff('second', {lag_sql('ts')}, ts) AS gap FROM candles) WINDOW p AS (PARTITION BY symbol, timeframe))) GROUP BY symbol, issue"


@query("quality_issues", C(_ISSUES), "symbol issue n")
def quality_issues(spark, d):
    return quality.issue_counts(quality.issues(hourly(spark, d), "strict"))


_MORE_ISSUES = f"SELECT symbol, unnest(list_filter([CASE WHEN abs(z) > 3 THEN 'extreme_close' END, CASE WHEN again THEN 'repeated_bar' END, CASE WHEN close <> 0 AND span / close < 5e-4 THEN 'flat_price' END], lambda x: x IS NOT NULL)) AS issue FROM (SELECT *, CASE WHEN stddev_samp(close) OVER p <> 0 THEN (close - avg(close) OVER p) / stddev_samp(close) OVER p ELSE 0 END AS z, open = {lag_sql('open')} AND high = {lag_sql('high')} AND low = {lag_sql('low')} AND close = {lag_sql('close')} AS again, {full_sql('max', 'high', 10)} - {full_sql('min', 'low', 10)} AS span FROM candles WINDOW p AS (PARTITION BY symbol, timeframe))"


@query("quality_comprehensive", C(f"SELECT * FROM ({_ISSUES}) UNION ALL SELECT symbol, issue, count(*) AS n FROM ({_MORE_ISSUES}) GROUP BY symbol, issue"), "symbol issue n")
def quality_comprehensive(spark, d):
    return quality.issue_counts(quality.issues(hourly(spark, d), "comprehensive"))


@query("field_statistics", C(" UNION ALL ".join(f"SELECT '{c}' AS field, count({c}) AS n, min({c}) AS min, max({c}) AS max, avg({c}) AS mean, stddev_samp({c}) AS std FROM candles" for c in ("close", "volume"))), "field n", "min max mean std")
def field_statistics(spark, d):
    return quality.field_statistics(hourly(spark, d), ["close", "volume"])


_GAPS = f"SELECT symbol, f AS gap_start, ts AS gap_end, dl // 3600 - 1 AS missing FROM (SELECT symbol, ts, {lag_sql('ts')} AS f, date_diff('second', {lag_sql('ts')}, ts) AS dl FROM candles) WHERE dl > 5400 AND NOT (isodow(f) >= 5 AND isodow(ts) IN (1, 7) AND dl <= 302400)"


@query("gaps", C(_GAPS), "symbol missing", times="gap_start gap_end")
def gaps(spark, d):
    return quality.gaps(hourly(spark, d))


@query("series_report", C(f"SELECT c.symbol, c.bars, c.invalid, c.corrupted, coalesce(g.gaps, 0) AS gaps, coalesce(g.missing, 0)::BIGINT AS missing, CASE WHEN c.bars >= 100 AND c.invalid = 0 AND c.corrupted = 0 AND coalesce(g.gaps, 0) <= 1000 THEN 'PASS' ELSE 'FAIL' END AS status FROM (SELECT symbol, count(*) AS bars, count(*) FILTER (high < low OR high < greatest(open, close) OR low > least(open, close)) AS invalid, count(*) FILTER (least(open, high, low, close) <= 0) AS corrupted FROM candles GROUP BY symbol) c LEFT JOIN (SELECT symbol, count(*) AS gaps, sum(missing) AS missing FROM ({_GAPS}) GROUP BY symbol) g USING (symbol)"), "symbol bars invalid corrupted gaps missing status")
def series_report(spark, d):
    return quality.series_report(hourly(spark, d), most_gaps=1000)


@query("gap_repair", C(f"SELECT s.symbol, s.ts, s.close FROM candles s JOIN (SELECT symbol, f, ts FROM (SELECT symbol, ts, lag(ts) OVER ({SERIES_SQL}) AS f, date_diff('second', lag(ts) OVER ({SERIES_SQL}), ts) AS dl FROM candles WHERE hour(ts) NOT IN (5, 6, 7)) WHERE dl > 5400 AND NOT (isodow(f) >= 5 AND isodow(ts) IN (1, 7) AND dl <= 302400)) g ON s.symbol = g.symbol AND s.ts > g.f AND s.ts < g.ts"), "symbol", "close", "ts")
def gap_repair(spark, d):
    rows = hourly(spark, d)
    return quality.repairable(quality.gaps(rows.filter(~F.hour("ts").isin(5, 6, 7))), rows)


@query("scaler_state", "SELECT 'o_totalprice' AS field, count(*) AS n, min(o_totalprice) AS min, max(o_totalprice) AS max, avg(o_totalprice) AS mean, stddev_samp(o_totalprice) AS std, quantile_cont(o_totalprice, 0.25) AS q25, quantile_cont(o_totalprice, 0.75) AS q75 FROM orders", "field n", "min max mean std q25 q75")
def scaler_state(spark, d):
    return scaling.fit(read(spark, d, "orders"), ["o_totalprice"])


_SCALES = {
    "min_max": "(x - lo) / (hi - lo)", "z_score": "(x - m) / s", "robust": "(x - q25) / (q75 - q25)", "max_abs": "x / ma", "mean": "x / m", "unit_vector": "x / nm",
    "log": "CASE WHEN x > 0 THEN ln(x) ELSE 0 END", "square_root": "CASE WHEN x >= 0 THEN sqrt(x) ELSE 0 END",
}
for _method, _value in _SCALES.items():

    @query(f"normalize_{_method}", f"SELECT c_custkey, {_value} AS x FROM (SELECT c_custkey, c_acctbal AS x, min(c_acctbal) OVER () AS lo, max(c_acctbal) OVER () AS hi, avg(c_acctbal) OVER () AS m, stddev_samp(c_acctbal) OVER () AS s, quantile_cont(c_acctbal, 0.25) OVER () AS q25, quantile_cont(c_acctbal, 0.75) OVER () AS q75, max(abs(c_acctbal)) OVER () AS ma, sqrt(sum(c_acctbal * c_acctbal) OVER ()) AS nm FROM customer)", "c_custkey", "x")
    def normalize(spark, d, method=_method):
        rows = read(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("x"))
        return scaling.transform(rows, scaling.fit(rows, ["x"], method), ["x"], method)


@query("normalize_inverse", "SELECT c_custkey, c_acctbal AS x FROM customer", "c_custkey", "x")
def normalize_inverse(spark, d):
    rows = read(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("x"))
    state = scaling.fit(rows, ["x"])
    return scaling.inverse(scaling.transform(rows, state, ["x"], "robust"), state, ["x"], "robust")


@query("scale_by_train", f"WITH {CANDLES_SQL}, n AS (SELECT *, row_number() OVER ({SERIES_SQL}) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM candles), p AS (SELECT *, CASE WHEN i < floor(n * 0.7::DOUBLE) THEN 'train' WHEN i < floor(n * 0.7::DOUBLE) + 5 THEN NULL WHEN i < floor(n * (0.7::DOUBLE + 0.15::DOUBLE)) THEN 'val' WHEN i < floor(n * (0.7::DOUBLE + 0.15::DOUBLE)) + 5 THEN NULL ELSE 'test' END AS split FROM n) SELECT symbol, ts, split, (close - (SELECT avg(close) FROM p WHERE split = 'train')) / (SELECT stddev_pop(close) FROM p WHERE split = 'train') AS close FROM p WHERE split IS NOT NULL", "symbol split", "close", "ts")
def scale_by_train(spark, d):
    return scaling.scale_splits(splits.chronological(hourly(spark, d)), ["close"])


@query("feature_selection", "SELECT feature, variance, score, row_number() OVER (ORDER BY score DESC, feature) AS position FROM (SELECT 'l_quantity' AS feature, var_pop(l_quantity) AS variance, abs(corr(l_quantity, l_extendedprice)) AS score FROM lineitem UNION ALL SELECT 'l_discount', var_pop(l_discount), abs(corr(l_discount, l_extendedprice)) FROM lineitem UNION ALL SELECT 'l_tax', var_pop(l_tax), abs(corr(l_tax, l_extendedprice)) FROM lineitem) QUALIFY row_number() OVER (ORDER BY score DESC, feature) <= 2", "feature position", "variance score")
def feature_selection(spark, d):
    return scaling.selected(read(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", 2)


@query("mutual_information", "WITH b AS (SELECT least(9, floor((l_quantity - (SELECT min(l_quantity) FROM lineitem)) / (SELECT max(l_quantity) - min(l_quantity) FROM lineitem) * 10)) AS b, l_returnflag AS t FROM lineitem), c AS (SELECT b, t, count(*) AS n FROM b GROUP BY b, t), m AS (SELECT n, sum(n) OVER (PARTITION BY b) AS nb, sum(n) OVER (PARTITION BY t) AS nt, sum(n) OVER () AS a FROM c) SELECT sum(n / a * ln(n * a / (nb * nt))) AS information FROM m", "", "information")
def mutual_information(spark, d):
    return scaling.binned_information(read(spark, d, "lineitem"), "l_quantity", "l_returnflag")


@query("knn_information", keys="pair n", values="information")
def knn_information(spark, d):
    """What the price of a line tells of its price for one, and what that tells of the order's number."""
    rows = read(spark, d, "lineitem").withColumn("unit", F.col("l_extendedprice") / F.col("l_quantity"))
    pairs = (("l_extendedprice", "unit"), ("unit", "l_orderkey"))
    found = [information.knn_information(rows, x, y).withColumn("pair", F.lit(f"{x} {y}")) for x, y in pairs]
    return found[0].unionByName(found[1])


@query("walk_forward", C(f"SELECT symbol, ts, fold, CASE WHEN i < fold * 60 + 300 THEN 'train' ELSE 'test' END AS part FROM (SELECT symbol, ts, i, unnest(range(greatest(0, (n - 300) // 60)))::INT AS fold FROM (SELECT *, row_number() OVER ({SERIES_SQL}) - 1 AS i, count(*) OVER (PARTITION BY symbol, timeframe) AS n FROM candles)) WHERE i >= fold * 60 AND i < fold * 60 + 360"), "symbol fold part", times="ts")
def walk_forward(spark, d):
    """Longer training, shorter tests and more folds than walk_forward_whole has."""
    return splits.rolling_walk_forward(hourly(spark, d), 300, 60)


@query("walk_forward_whole", C(f"SELECT symbol, ts, fold, CASE WHEN i < fold * 100 + 200 THEN 'train' ELSE 'test' END AS part FROM (SELECT symbol, ts, i, unnest(range(greatest(0, (n - 200) // 100)))::INT AS fold FROM (SELECT *, row_number() OVER ({SERIES_SQL}) - 1 AS i, count(*) OVER (PARTITION BY symbol, timeframe) AS n FROM candles)) WHERE i >= fold * 100 AND i < fold * 100 + 300"), "symbol fold part", times="ts")
def walk_forward_whole(spark, d):
    return splits.rolling_walk_forward(hourly(spark, d), 200, 100)


@query("k_folds", C(f"SELECT symbol, ts, ntile(5) OVER ({SERIES_SQL}) - 1 AS fold FROM candles"), "symbol fold", times="ts")
def k_folds(spark, d):
    return splits.k_folds(hourly(spark, d), 5)


@query("sequences", C(f"SELECT symbol, ts, list_sum(l) AS total, len(l) AS size, label FROM (SELECT symbol, ts, list(close) OVER ({SERIES_SQL} ROWS BETWEEN 15 PRECEDING AND CURRENT ROW) AS l, row_number() OVER ({SERIES_SQL}) AS i, lead(volume, 2) OVER ({SERIES_SQL}) AS label FROM candles) WHERE i >= 16 AND (i - 16) % 4 = 0 AND label IS NOT NULL"), "symbol size", "total label", "ts")
def sequences(spark, d):
    out = splits.sequences(hourly(spark, d), ["close"], 16, 4, "volume", 2)
    total = F.aggregate("sequence", F.lit(0.0), lambda s, x: s + x[0])
    return out.withColumns({"total": total, "size": F.size("sequence")})


@query("stride_and_batches", C(f"SELECT symbol, ts, i // 3 // 32 AS batch FROM (SELECT *, row_number() OVER ({SERIES_SQL}) - 1 AS i FROM candles) WHERE i % 3 = 0"), "symbol batch", times="ts")
def stride_and_batches(spark, d):
    return splits.batches(splits.every(hourly(spark, d), 3), 32)


@query("text_functions", "SELECT p_partkey, CASE WHEN length(p_name) <= 10 THEN p_name ELSE substr(p_name, 1, 7) || '...' END AS short, lower(regexp_replace(regexp_replace(p_name, '[\\s-]+', '_', 'g'), '([a-z])([A-Z])', '\\1_\\2', 'g')) AS snake FROM part", "p_partkey short snake")
def text_functions(spark, d):
    return read(spark, d, "part").select("p_partkey", S.truncated(F.col("p_name"), 10).alias("short"), S.snake_case(F.col("p_name")).alias("snake"))


@query("number_functions", "SELECT event_id, least(75, greatest(25, value)) AS clipped, round(value, 2) AS rounded, CASE WHEN user_id <> 0 THEN value * 100.0 / user_id ELSE 0 END AS pct FROM events", "event_id", "clipped rounded pct")
def number_functions(spark, d):
    return read(spark, d, "events").select("event_id", S.clip(F.col("value"), 25.0, 75.0).alias("clipped"), S.round_price(F.col("value"), 2).alias("rounded"), S.percentage(F.col("value"), F.col("user_id")).alias("pct"))


@query("json_functions", "SELECT event_id, coalesce(json_extract_string(props, '$.k'), 'none') AS k FROM events", "event_id k")
def json_functions(spark, d):
    return read(spark, d, "events").select("event_id", S.json_path(F.col("props"), "k", "none").alias("k"))


@query("time_functions", "SELECT event_id, ts, strftime(ts, '%Y%m%d') AS day, floor(epoch(ts))::BIGINT AS seconds FROM events", "event_id day seconds", times="ts")
def time_functions(spark, d):
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    return read(spark, d, "events").select("event_id", S.parse_time(text).alias("ts"), F.date_format("ts", "yyyyMMdd").alias("day"), F.unix_timestamp("ts").alias("seconds"))


_TOOK = "concat_ws(' ', " + ", ".join(f"CASE WHEN {n} > 0 THEN ({n})::VARCHAR || '{unit}' END" for n, unit in (("n // 86400", "d"), ("n // 3600 % 24", "h"), ("n // 60 % 60", "m"), ("n % 60", "s"))) + ")"


@query("human_units", f"SELECT o_orderkey, CASE WHEN n = 0 THEN '0ms' ELSE {_TOOK} END AS took, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN format('{{:.2f}}', n / 1024.0::DOUBLE) || ' KB' ELSE format('{{:.2f}}', n / 1048576.0::DOUBLE) || ' MB' END AS size FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN floor(o_totalprice / 1000) ELSE floor(o_totalprice * 10) END::BIGINT AS n FROM orders)", "o_orderkey took size")
def human_units(spark, d):
    n = F.floor(F.when(F.col("o_orderkey") % 10 == 0, F.col("o_totalprice") / 1000).otherwise(F.col("o_totalprice") * 10))
    return read(spark, d, "orders").select("o_orderkey", S.duration(n).alias("took"), S.byte_size(n).alias("size"))


@query("date_range", "SELECT o_orderkey, unnest(generate_series(o_orderdate::TIMESTAMP, o_orderdate::TIMESTAMP + to_days((o_orderkey % 4)::INT), INTERVAL 6 HOUR)) AS ts FROM orders", "o_orderkey", times="ts")
def date_range(spark, d):
    last = F.col("o_orderdate") + F.make_dt_interval(days=(F.col("o_orderkey") % 4).cast("int"))
    return read(spark, d, "orders").select("o_orderkey", F.explode(S.intervals(F.col("o_orderdate"), last, 21600)).alias("ts"))


@query("content_hashes", """SELECT p_partkey, sha256('{"p_name":"' || p_name || '","p_brand":"' || p_brand || '"}') AS hash FROM part""", "p_partkey hash")
def content_hashes(spark, d):
    return read(spark, d, "part").select("p_partkey", S.content_hash(F.col("p_name"), F.col("p_brand")).alias("hash"))


@query("softmax", "SELECT vec_id, list_sum(list_transform(embedding, lambda x: exp(x - list_max(embedding)))) AS denominator, 1 / list_sum(list_transform(embedding, lambda x: exp(x::DOUBLE - list_max(embedding)))) AS top FROM embeddings", "vec_id", "top")
def softmax(spark, d):
    return read(spark, d, "embeddings").select("vec_id", F.array_max(S.softmax(F.transform("embedding", lambda x: x.cast("double")))).alias("top"))


@query("rolling_windows_list", C(f"SELECT symbol, ts, list_sum(list(close) OVER ({SERIES_SQL} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) AS total FROM candles"), "symbol", "total", "ts")
def rolling_windows_list(spark, d):
    return hourly(spark, d).withColumn("total", F.aggregate(F.collect_list("close").over(W.last(5)), F.lit(0.0), lambda s, x: s + x))
