"""Smoothings over time chunks: equal to plain loops over whole series, whatever the chunks are."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import recurrence, recursive

START = dt.datetime(2024, 1, 1)
SCHEMA = "symbol string, timeframe string, ts timestamp, open double, high double, low double, close double, volume double"
HOUR = 3600


def walk(symbol, n, seed, gaps=0.0):
    """Hourly bars; a share of the closes is missing, some hours have no bar, and a stretch is flat."""
    rng, close, out = random.Random(seed), 100.0, []
    for i in range(n):
        if gaps and rng.random() < gaps:
            continue
        flat = n // 3 < i < n // 2
        o, close = close, close if flat else close + rng.gauss(0, 0.5)
        noise = 0.0 if flat else rng.random() / 4
        out.append((symbol, "H1", START + dt.timedelta(hours=i), o, max(o, close) + noise, min(o, close) - noise, None if gaps and rng.random() < gaps else close, 1.0))
    return out


def average(x, period, alpha, rows=math.inf):
    need, seen, total, y, out = min(period, rows), 0, 0.0, None, []
    for v in x:
        if v is not None and y is not None:
            y = (1 - alpha) * y + alpha * v
        elif v is not None:
            seen, total = seen + 1, total + v
            y = total / need if seen == need else None
        out.append(y)
    return out


def ema(x, period, rows=math.inf):
    return average(x, period, 2 / (period + 1), rows)


def near(got, want):
    assert len(got) == len(want)
    for x, y in zip(got, want, strict=True):
        assert (x is None) == (y is None), (x, y)
        assert x is None or math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9), (x, y)


def column(df, name, symbol):
    return [r[0] for r in df.filter(F.col("symbol").eqNullSafe(F.lit(symbol))).orderBy("ts").select(name).collect()]


@pytest.fixture(scope="module")
def bars():
    return {"LONG": walk("LONG", 500, 1), "GAPS": walk("GAPS", 300, 2, 0.3), None: walk(None, 40, 3), "ONE": walk("ONE", 1, 4)}


@pytest.fixture(scope="module")
def candles(spark, bars):
    return spark.createDataFrame([r for rows in bars.values() for r in rows], SCHEMA).cache()


@pytest.mark.parametrize("width", [HOUR, 7 * HOUR, 100 * HOUR, 10_000 * HOUR])
@pytest.mark.parametrize("period", [1, 6, 60])
def test_averages_do_not_depend_on_chunks(candles, bars, width, period):
    out = recursive.ema(candles, "close", period, width=width)
    assert out.columns == [*candles.columns, f"ema_{period}"]
    for symbol, rows in bars.items():
        near(column(out, f"ema_{period}", symbol), ema([r[6] for r in rows], period, len(rows)))


@pytest.mark.parametrize("width", [9 * HOUR, 10_000 * HOUR])
def test_averages_of_averages(candles, bars, width):
    out = recursive.macd(candles, 5, 9, 4, width=width).cache()
    for symbol, rows in bars.items():
        x = [r[6] for r in rows]
        line = [a - b if a is not None and b is not None else None for a, b in zip(ema(x, 5, len(x)), ema(x, 9, len(x)), strict=True)]
        near(column(out, "macd", symbol), line)
        near(column(out, "macd_signal", symbol), ema(line, 4))


def test_chunks_give_what_whole_series_give(candles):
    for f in (recursive.rsi, recursive.atr, recursive.adx, recursive.keltner, lambda c, width: recursive.wilder(c, "close", 14, width=width), lambda c, width: recursive.filled_ema(c, "close", 14, "e", width)):
        parts, whole = (f(candles, width=w).orderBy("symbol", "ts").collect() for w in (5 * HOUR, 10**9))
        assert len(parts) == len(whole) > 0
        for a, b in zip(parts, whole, strict=True):
            near([x if isinstance(x, float) else None for x in a], [x if isinstance(x, float) else None for x in b])


def test_first_range_of_a_chunk_knows_the_close_before(candles, bars):
    got = column(recursive.atr(candles, 3, width=HOUR), "atr_3", "LONG")
    rows = bars["LONG"]
    ranges = [max(h - l, abs(h - c), abs(l - c)) for (*_, h, l, _, _), c in zip(rows, [rows[0][6], *[r[6] for r in rows]], strict=False)]
    near(got, ema(ranges, 3))


def test_a_series_is_worked_on_by_several_tasks(candles):
    seen = recursive.ema(candles, "close", 5, width=20 * HOUR).withColumn("_task", F.spark_partition_id())
    candles.sparkSession.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        spread = seen.filter("symbol = 'LONG'").select("_task").distinct().count()
    finally:
        candles.sparkSession.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert spread > 1


def test_rows_are_shuffled_once(spark, candles, tmp_path):
    candles.write.parquet(str(tmp_path / "candles"))
    out = recursive.macd(spark.read.parquet(str(tmp_path / "candles")), width=20 * HOUR)
    out.collect()
    final = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    own = [line for line in final.splitlines() if "REPARTITION_BY_COL" in line and "ReusedExchange" not in line]
    assert len(own) == 1


def test_order_by_numbers_and_empty_tables(spark):
    df = spark.createDataFrame([("a", n, float(n % 7)) for n in range(50)], "k string, n long, x double")
    out = recursive.ema(df, "x", 4, "e", keys=("k",), order=("n",), width=6)
    near([r["e"] for r in out.orderBy("n").collect()], ema([float(n % 7) for n in range(50)], 4))
    assert recursive.ema(df.filter("false"), "x", 4, "e", keys=("k",), order=("n",), width=6).collect() == []


def test_maps_compose():
    rng = random.Random(6)
    for _ in range(30):
        x = [rng.gauss(0, 1) for _ in range(rng.randrange(1, 40))]
        cuts = sorted({0, len(x), *[rng.randrange(len(x) + 1) for _ in range(4)]})
        whole, parts = recurrence.Average(5, 0.3), recurrence.Average(5, 0.3)
        whole(recurrence.np.array(x))
        for a, b in zip(cuts, cuts[1:], strict=False):
            c = recurrence.Composed(parts)
            c(recurrence.np.array(x[a:b]))
            parts.advance(c.count, c.smooth.last, c.head)
        assert parts.seen == whole.seen and (math.isclose(parts.smooth.last, whole.smooth.last, abs_tol=1e-12) or math.isnan(whole.smooth.last))
