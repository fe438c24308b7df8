"""Windows, recursive indicators, labels, resampling and as-of joins against plain Python on small series."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import windows as W
from tidemark.operators import asof, cleaning, indicators, labels, patterns, price, quality, recursive, resample, splits

START = dt.datetime(2024, 1, 1)
SCHEMA = "symbol string, timeframe string, ts timestamp, open double, high double, low double, close double, volume double"


def walk(n=400, seed=3, symbol="EURUSD"):
    rng, close, out = random.Random(seed), 100.0, []
    for i in range(n):
        o, close = close, close + rng.gauss(0, 0.5)
        out.append((symbol, "H1", START + dt.timedelta(hours=i), o, max(o, close) + rng.random() / 4, min(o, close) - rng.random() / 4, close, float(rng.randint(1, 9))))
    return out


@pytest.fixture(scope="module")
def candles(spark):
    return spark.createDataFrame(walk() + walk(30, 5, "XAUUSD"), SCHEMA).cache()


def series(df, column, symbol="EURUSD"):
    return [r[0] for r in df.filter(F.col("symbol") == symbol).orderBy("ts").select(column).collect()]


def near(a, b):
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert (x is None) == (y is None or y != y), (x, y)
        if x is not None:
            assert math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9), (x, y)


def plain_ema(x, p):
    n, out = min(p, len(x)), [None] * len(x)
    out[n - 1] = sum(x[:n]) / n
    for i in range(n, len(x)):
        out[i] = out[i - 1] + (x[i] - out[i - 1]) * 2 / (p + 1)
    return out


@pytest.mark.parametrize("period", [1, 5, 200, 390, 1000])
def test_ema(candles, period):
    near(series(recursive.ema(candles, "close", period), f"ema_{period}"), plain_ema([r[6] for r in walk()], period))


def test_ema_of_a_short_series_is_seeded_at_its_end(candles):
    got = series(recursive.ema(candles, "close", 50), "ema_50", "XAUUSD")
    assert got[:-1] == [None] * 29 and got[-1] is not None


def test_ema_holds_over_missing_values(spark):
    rows = [("A", "H1", START + dt.timedelta(hours=i), x) for i, x in enumerate([1.0, 2.0, None, 4.0, float("nan"), 6.0])]
    df = spark.createDataFrame(rows, "symbol string, timeframe string, ts timestamp, close double")
    got = series(recursive.ema(df, "close", 2), "ema_2", "A")
    near(got, [None, 1.5, 1.5, 1.5 + 2.5 * 2 / 3, 1.5 + 2.5 * 2 / 3, 0.0 + (1.5 + 2.5 * 2 / 3) / 3 + 6 * 2 / 3])


def test_rsi_of_flat_and_rising_series(spark):
    flat = [("F", "H1", START + dt.timedelta(hours=i), 1.0) for i in range(20)]
    up = [("U", "H1", START + dt.timedelta(hours=i), 1.0 + i) for i in range(20)]
    df = spark.createDataFrame(flat + up, "symbol string, timeframe string, ts timestamp, close double")
    out = recursive.rsi(df)
    assert series(out, "rsi_14", "F") == [None] * 14 + [50.0] * 6
    assert series(out, "rsi_filled_14", "F")[-1] == 100.0 and series(out, "rsi_filled_14", "F")[0] == 50.0
    assert series(out, "rsi_14", "U") == [None] * 14 + [100.0] * 6


def test_adx_and_macd(candles):
    rows = walk()
    n, p = len(rows), 14
    tr = [max(r[4] - r[5], abs(r[4] - rows[max(i - 1, 0)][6]), abs(r[5] - rows[max(i - 1, 0)][6])) if i else max(r[4] - r[5], abs(r[4] - r[6]), abs(r[5] - r[6])) for i, r in enumerate(rows)]
    plus, minus = [0.0] * n, [0.0] * n
    for i in range(1, n):
        up, down = rows[i][4] - rows[i - 1][4], rows[i - 1][5] - rows[i][5]
        plus[i], minus[i] = (up if up > down and up > 0 else 0.0), (down if down > up and down > 0 else 0.0)

    def wilder(x):
        first = next(i for i in range(p - 1, n) if all(v is not None for v in x[i - p + 1 : i + 1]))
        out = [None] * n
        out[first] = sum(x[first - p + 1 : first + 1]) / p
        for i in range(first + 1, n):
            out[i] = (out[i - 1] * (p - 1) + (out[i - 1] if x[i] is None else x[i])) / p
        return out

    t, a, b = wilder(tr), wilder(plus), wilder(minus)
    pd = [None if x is None else 100 * x / y for x, y in zip(a, t)]
    md = [None if x is None else 100 * x / y for x, y in zip(b, t)]
    adx = wilder([None if x is None else 100 * abs(x - y) / (x + y) for x, y in zip(pd, md)])
    out = recursive.adx(candles).cache()
    near(series(out, "plus_di"), pd)
    near(series(out, "adx_14"), adx)
    close = [r[6] for r in rows]
    line = [None if x is None or y is None else x - y for x, y in zip(plain_ema(close, 12), plain_ema(close, 26))]
    signal = [None] * 25 + plain_ema(line[25:], 9)
    out = recursive.macd(candles).cache()
    near(series(out, "macd"), line)
    near(series(out, "macd_signal"), signal)


def test_supertrend_follows_its_bands(candles):
    rows = recursive.supertrend(candles).filter("symbol = 'EURUSD'").orderBy("ts").collect()
    assert all(r["supertrend"] is None for r in rows[:9]) and rows[9]["supertrend_direction"] == 1.0
    for r in rows[9:]:
        assert r["supertrend"] == (r["supertrend_lower"] if r["supertrend_direction"] == 1.0 else r["supertrend_upper"])
    assert {r["supertrend_direction"] for r in rows[9:]} == {1.0, -1.0}


def test_a_window_needs_all_its_rows(spark):
    df = spark.createDataFrame([("A", "H1", START + dt.timedelta(hours=i), 1.0) for i in range(3)], "symbol string, timeframe string, ts timestamp, close double")
    assert series(df.withColumn("m", W.mean("close", 5)), "m", "A") == [None] * 3
    flat = df.withColumn("s", W.std("close", 3))
    assert series(flat, "s", "A") == [None, None, 0.0]


def test_features_of_flat_bars(spark):
    df = spark.createDataFrame([("A", "H1", START + dt.timedelta(hours=i), 1.0, 1.0, 1.0, 1.0, 0.0) for i in range(30)], SCHEMA)
    for f in (price.price_features, price.return_features, price.candle_features, price.basic_features, patterns.pattern_flags, indicators.moving_averages, indicators.momentum, indicators.channels, indicators.volume_flow, indicators.structure, indicators.regime, indicators.microstructure, indicators.sessions, indicators.calendar):
        assert f(df).count() == 30, f.__name__
    last = indicators.channels(df).orderBy(F.desc("ts")).first()
    assert last["bollinger_percent_b_20"] is None and last["donchian_position_20"] is None
    assert price.candle_features(df).first()["candle_is_doji"] == 1.0
    assert indicators.volume_flow(df).orderBy(F.desc("ts")).first()["mfi_14"] == 50.0


def test_triple_barrier_takes_the_stop_first(spark):
    bars = [(10, 10, 10, 10), (10, 13, 8, 10), (10, 10, 10, 10)]
    df = spark.createDataFrame([("A", "H1", START + dt.timedelta(hours=i), *map(float, b), 1.0) for i, b in enumerate(bars)], SCHEMA).withColumn("size", F.lit(1.0))
    assert series(labels.triple_barrier(df, 1, "y", "size"), "y", "A") == [-1.0, 0.0, None]


def test_direction_of_words_and_numbers(spark):
    df = spark.createDataFrame([("BUY",), ("sell",), ("2.5",), ("-1",), ("0",), ("what",), (None,)], "x string")
    assert [r[0] for r in df.select(labels.direction_of(F.col("x"))).collect()] == [1.0, -1.0, 1.0, -1.0, 0.0, 0.0, None]


def test_count_bars_keep_a_partial_one(spark):
    df = spark.createDataFrame([("A", "M5", START + dt.timedelta(minutes=5 * i), 1.0, 2.0, 0.5, 1.5, 1.0) for i in range(5)], SCHEMA)
    assert [r["bars"] for r in resample.by_count(df, "M5", "M15").orderBy("ts").collect()] == [3, 2]


def test_volume_bars(spark):
    volumes = [4.0, 7.0, 3.0, 8.0, 2.0]
    df = spark.createDataFrame([("A", "M5", START + dt.timedelta(minutes=5 * i), 1.0, 2.0, 0.5, 1.5, v) for i, v in enumerate(volumes)], SCHEMA)
    assert [r["volume"] for r in resample.by_volume(df, 10.0).orderBy("ts").collect()] == [11.0, 11.0, 2.0]


def test_asof_cases(spark):
    def at(h, m):
        return dt.datetime(2024, 1, 1, h, m)

    left = spark.createDataFrame([("A", at(10, 0)), ("A", at(10, 5)), ("A", at(10, 10))], "k string, ts timestamp")
    right = spark.createDataFrame([("A", at(10, 1), 1.0), ("A", at(10, 5), 5.0)], "k string, ts timestamp, v double")
    assert [r["right_v"] for r in asof.asof_join(left, right, ["k"]).orderBy("ts").collect()] == [None, 5.0, 5.0]
    assert [r["right_v"] for r in asof.asof_join(left, right, ["k"], tolerance=240).orderBy("ts").collect()] == [None, 5.0, None]
    assert [r["right_v"] for r in asof.asof_join(left, right, ["k"], direction="forward").orderBy("ts").collect()] == [1.0, 5.0, None]
    assert [r["right_v"] for r in asof.asof_join(left, right, ["k"], direction="exact").orderBy("ts").collect()] == [None, 5.0, None]


@pytest.mark.parametrize("direction", ["backward", "forward", "nearest"])
@pytest.mark.parametrize("chunk", [60, 3600, 10**7])
def test_asof_against_brute_force(spark, direction, chunk):
    rng = random.Random(chunk)
    keys = ["A", "B", None]
    left = [(rng.choice(keys), i, START + dt.timedelta(seconds=rng.randrange(20_000))) for i in range(300)]
    stamps = {(rng.choice(keys), START + dt.timedelta(seconds=rng.randrange(20_000))) for _ in range(120)}
    right = [(k, t, float(i)) for i, (k, t) in enumerate(sorted(stamps, key=str))]
    got = {r["i"]: r["right_v"] for r in asof.asof_join(spark.createDataFrame(left, "k string, i int, ts timestamp"), spark.createDataFrame(right, "k string, ts timestamp, v double"), ["k"], direction=direction, chunk_seconds=chunk).collect()}
    for k, i, t in left:
        own = [(s, v) for kk, s, v in right if kk == k]
        before = max(((s, v) for s, v in own if s <= t), default=None)
        after = min(((s, v) for s, v in own if s >= t), default=None)
        best = before if direction == "backward" else after if direction == "forward" else min((x for x in (before, after) if x), key=lambda x: abs(x[0] - t), default=None)
        assert got[i] == (best[1] if best else None), (k, i, t)


def test_a_weekend_is_no_gap(spark):
    friday, monday = dt.datetime(2024, 1, 5, 21), dt.datetime(2024, 1, 8, 0)
    df = spark.createDataFrame([("EURUSD", "H1", friday), ("EURUSD", "H1", monday), ("EURUSD", "H1", monday + dt.timedelta(hours=5))], "symbol string, timeframe string, ts timestamp")
    found = quality.gaps(df).collect()
    assert [(r["gap_start"], r["missing"]) for r in found] == [(monday, 4)]
    assert quality.gaps(df, F.lit(True)).count() == 2


def test_issues_name_broken_rules(spark):
    rows = [("A", "H1", START, 1.0, 0.5, 2.0, 1.0, -1.0), ("A", "H1", START, None, 1.0, 1.0, 1.0, 0.0), ("A", "H1", START + dt.timedelta(hours=1), 1.0, float("nan"), 1.0, 1.0, 1.0)]
    found = [set(r["issues"]) for r in quality.issues(spark.createDataFrame(rows, SCHEMA)).orderBy("ts", F.desc_nulls_last("open")).collect()]
    assert {"high_below_low", "negative_volume", "duplicate_time"} <= found[0]
    assert "missing_price" in found[1] and "not_finite" in found[2]


def test_fills_chain_and_fall_back(spark):
    rows = [("A", "H1", START + dt.timedelta(hours=i), x) for i, x in enumerate([None, 1.0, None, None, 4.0, float("nan")])]
    df = spark.createDataFrame(rows, "symbol string, timeframe string, ts timestamp, close double")
    assert series(cleaning.fill_missing(df, ["close"], "linear"), "close", "A") == [1.0, 1.0, 2.0, 3.0, 4.0, 4.0]
    assert series(cleaning.fill_missing(df, ["close"], "forward"), "close", "A") == [2.5, 1.0, 1.0, 1.0, 4.0, 4.0]
    assert series(cleaning.fill_missing(df, ["close"], "backward"), "close", "A") == [1.0, 1.0, 4.0, 4.0, 4.0, 2.5]
    assert series(cleaning.fill_missing(df, ["close"], "drop"), "close", "A") == [1.0, 4.0]


def test_splits_leave_out_the_embargo(candles):
    got = {r["split"]: r["n"] for r in splits.chronological(candles.filter("symbol = 'EURUSD'")).groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert got == {"train": 280, "val": 55, "test": 55}


def test_detectors_can_be_added(candles):
    book = patterns.Patterns()

    @book.register("up")
    def up(rows):
        return rows.filter("close > open").withColumns({"direction": F.lit("bullish"), "confidence": F.lit(0.9)})

    assert book.detect(candles).count() == candles.filter("close > open").count()
    assert book.detect(candles, least=0.95).count() == 0


def test_rolling_folds_follow_each_series(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [(s, "H1", start + dt.timedelta(hours=i), i) for s, n in (("a", 1050), ("b", 300), ("c", 299)) for i in range(n)]
    df = spark.createDataFrame(rows, "symbol string, timeframe string, ts timestamp, i int")
    for step in (100, 70, 400):
        want = {(s, k, part, i) for s, n in (("a", 1050), ("b", 300), ("c", 299)) for k, a in enumerate(range(0, n - 299, step)) for part, x, y in (("train", a, a + 200), ("test", a + 200, a + 300)) for i in range(x, y)}
        got = [(r["symbol"], r["fold"], r["part"], r["i"]) for r in splits.rolling_walk_forward(df, 200, 100, step).collect()]
        assert len(got) == len(want) and set(got) == want


@pytest.mark.parametrize("name", ["walk_forward_whole", "walk_forward_search_whole"])
def test_later_folds_are_in_the_queries(spark, name):
    from tidemark import catalog

    assert catalog.QUERIES[name](spark, "/root/testdata/sf0.1").agg(F.max("fold")).first()[0] == 4


def test_supertrend_is_that_of_a_plain_loop(candles):
    rows = walk()
    close, high, low = ([r[k] for r in rows] for k in (6, 4, 5))
    before = [close[0], *close]
    size = plain_ema([max(h - l, abs(h - c), abs(l - c)) for h, l, c in zip(high, low, before, strict=False)], 10)
    line, upper, lower, out = None, None, None, []
    for k, r in enumerate(size):
        if r is None:
            out.append(None)
            continue
        up, down = (high[k] + low[k]) / 2 + 3 * r, (high[k] + low[k]) / 2 - 3 * r
        if line is None:
            upper, lower, line = up, down, down
        else:
            falling = line == upper
            upper = up if up < upper or close[k - 1] > upper else upper
            lower = down if down > lower or close[k - 1] < lower else lower
            line = (upper if close[k] <= upper else lower) if falling else (lower if close[k] >= lower else upper)
        out.append(line)
    near(series(recursive.supertrend(candles), "supertrend"), out)


def test_training_table_has_the_values_of_its_groups(candles):
    from tidemark.plans import datasets

    table = datasets.training_table(candles, ["momentum", "channels", "rsi"], scale="none").cache()
    found = 0
    for f in (indicators.momentum, indicators.channels, recursive.rsi):
        alone = f(candles)
        new = [c for c in alone.columns if c in table.columns and c not in candles.columns]
        keys = ["symbol", "timeframe", "ts"]
        got = {tuple(r)[:3]: tuple(r)[3:] for r in table.select(*keys, *new).collect()}
        want = {tuple(r)[:3]: tuple(r)[3:] for r in alone.select(*keys, *new).collect()}
        assert new and got and set(got) <= set(want)
        for k, values in got.items():
            near(list(values), list(want[k]))
        found += len(new)
    assert found > 5
    scaled = datasets.training_table(candles, ["momentum", "rsi"]).filter("split = 'train'")
    r = scaled.agg(F.avg("rsi_14").alias("m"), F.stddev_pop("rsi_14").alias("s")).first()
    near([r["m"], r["s"]], [0.0, 1.0])
