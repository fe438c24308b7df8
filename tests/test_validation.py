"""Validation, positions of fills and files, against plain versions."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import joins, risk, validation
from tidemark.sources import files

START = dt.datetime(2024, 1, 1)


def test_positions_equal_a_plain_book(spark):
    draw = random.Random(3)
    fills = [("A", i, draw.choice((1, -1)), float(draw.randint(1, 9)), 1.0) for i in range(300)]
    book, want = [], []
    for _, i, side, price, _ in fills:
        if book and book[0][1] != side:
            at, held, entry = book.pop(0)
            want.append((at, held, entry, i, price))
        else:
            book.append((i, side, price))
    want += [(*b, None, None) for b in book]
    df = spark.createDataFrame(fills, "symbol string, ts int, side int, price double, size double")
    got = [(r["ts"], r["side"], r["entry"], r["ts_closed"], r["exit"]) for r in validation.positions(df).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert validation.positions(df.limit(0)).count() == 0


def test_short_curves_are_stable(spark):
    df = spark.createDataFrame([("A", i, float(1 + i * i)) for i in range(19)], "symbol string, ts int, equity double")
    row = validation.regimes(df).first()
    assert (row["early_sharpe"], row["late_sharpe"], row["collapsed"]) == (0.0, 0.0, False)


def test_collapse_is_seen(spark):
    up = [100 * 1.01**i * (1 + 0.002 * (i % 2)) for i in range(40)]
    down = [up[-1] * 0.99**i * (1 + 0.002 * (i % 2)) for i in range(1, 41)]
    df = spark.createDataFrame([("A", i, float(x)) for i, x in enumerate(up + down)], "symbol string, ts int, equity double")
    assert validation.regimes(df).first()["collapsed"]


def test_gate_names_the_first_stage_that_fails(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 0.0), (0.0, 0.0), (None, 1.0)], "a double, b double")
    got = [tuple(r[0]) for r in df.select(validation.gate([("train", F.col("a"), 0.5), ("test", F.col("b"), 0.5)])).collect()]
    assert got == [(True, "all_stages_passed"), (False, "test_failed"), (False, "train_failed"), (False, "train_failed")]


def test_cross_merge_pairs_all_rows(spark):
    a, b = spark.createDataFrame([(1, "x"), (None, "y")], "k int, v string"), spark.createDataFrame([(2, "z")], "k int, v string")
    assert sorted(map(tuple, joins.merge(a, b, "k", "cross").collect()), key=str) == [(1, "x", "z"), (None, "y", "z")]
    assert joins.merge(a, b.limit(0), "k", "cross").count() == 0


def test_ticks_take_the_symbol_from_the_file(spark, tmp_path):
    (tmp_path / "EURUSD_T1.csv").write_text("time,bid,ask\n2024-01-01 00:00:00,1.0,1.2\n,1.0,1.2\n2024-01-01 00:00:01,,\n2024-01-01 00:00:02,1.5,\n")
    got = sorted((r["symbol"], r["ts"].second, round(r["last"], 6)) for r in files.tick_files(spark, str(tmp_path)).collect())
    assert got == [("EURUSD", 0, 1.1), ("EURUSD", 2, 1.5)]


@pytest.mark.parametrize("replacement", [False, True])
def test_simulations_do_not_depend_on_partitions(spark, replacement):
    df = spark.createDataFrame([(i, ((i * 37) % 19 - 9) / 100) for i in range(60)], "ts int, r double")
    one, other = (sorted((r["simulation"], round(r["final"], 9), round(r["max_drawdown"], 9)) for r in risk.reshuffled(x, 5, replacement=replacement).collect()) for x in (df.repartition(1), df.repartition(7, "r")))
    assert one == other
    if not replacement:
        assert {f for _, f, _ in one} == {round(1 + sum(((i * 37) % 19 - 9) / 100 for i in range(60)), 9)}


def plain_lots(fills):
    """(open, closed, side, size, pnl) by a queue for each side."""
    queue, out = [], []
    for at, side, price, size in sorted(fills):
        while size > 1e-12 and queue and queue[0][1] == -side:
            opened = queue[0]
            part = min(size, opened[3])
            out.append((opened[0], at, opened[1], part, (price - opened[2]) * opened[1] * part))
            size, opened[3] = size - part, opened[3] - part
            if opened[3] <= 1e-12:
                queue.pop(0)
        if size > 1e-12:
            queue.append([at, side, price, size])
    return out + [(at, None, side, size, None) for at, side, _, size in queue]


def test_lots_are_those_of_a_queue(spark):
    import random

    from tidemark.operators import validation

    for seed in range(4):
        rng = random.Random(seed)
        fills = [(k, rng.choice([1, -1]), float(rng.randrange(90, 110)), float(rng.choice([1, 2, 3, 5, 8]))) for k in range(60)]
        more = [(61, 1, 100.0, 0.0), (62, 1, 100.0, None), (63, 0, 100.0, 1.0)]
        df = spark.createDataFrame([("A", *f) for f in fills + more] + [("B", 1, -1, 5.0, 2.0), (None, 1, 1, 5.0, 2.0), (None, 2, -1, 6.0, 3.0)], "symbol string, ts long, side int, price double, size double")
        rows = validation.lots(df).collect()
        got = sorted(((r["ts"], r["ts_closed"], r["side"], r["size"], r["pnl"]) for r in rows if r["symbol"] == "A"), key=repr)
        assert got == sorted(plain_lots(fills), key=repr)
        assert [(r["side"], r["size"], r["exit"]) for r in rows if r["symbol"] == "B"] == [(-1, 2.0, None)]
        assert sorted((r["side"], r["size"], r["pnl"]) for r in rows if r["symbol"] is None)[1] == (1, 2.0, 2.0)
    assert validation.lots(df.limit(0)).collect() == []


def test_fits_of_all_folds_are_those_of_each(spark):
    import numpy as np

    from tidemark.operators import models

    rng = np.random.default_rng(2)
    rows = [("A", t, float(rng.normal()), float(rng.normal())) for t in range(53)]
    rows = [(s, t, a, b, 2 * a - b + 3 + float(rng.normal()) / 9) for s, t, a, b in rows]
    rows[7] = ("A", 7, None, 1.0, 1.0)
    df = spark.createDataFrame([*rows, *[("B", t, 1.0, 2.0, 3.0) for t in range(11)]], "k string, t long, a double, b double, y double")
    for train, test, step in ((12, 6, None), (10, 4, 3), (2, 2, 40)):
        got = {r["fold"]: r for r in models.walk_forward_fit(df, ["a", "b"], "y", train, test, step, ("k",), ("t",)).filter("k = 'A'").collect()}
        move = step or test
        assert set(got) == set(range((53 - train - test) // move + 1))
        for f, r in got.items():
            parts = [[x for x in rows[f * move + low : f * move + high] if x[2] is not None] for low, high in ((0, train), (train, train + test))]
            assert [r["n_train"], r["n_test"]] == [len(p) for p in parts]
            if len(parts[0]) < 3:
                assert r["coefficients"] is None and r["test_rmse"] is None
                continue
            x, y = ([np.array([[1, a, b] for *_, a, b, _ in p]) for p in parts], [np.array([q[-1] for q in p]) for p in parts])
            beta = np.linalg.lstsq(x[0], y[0], rcond=None)[0]
            assert np.allclose(r["coefficients"], beta, atol=1e-6)
            for name, k in (("train_rmse", 0), ("test_rmse", 1)):
                assert abs(r[name] - np.sqrt(((y[k] - x[k] @ beta) ** 2).mean())) < 1e-6
    assert models.walk_forward_fit(df.limit(0), ["a"], "y", 5, 5, None, ("k",), ("t",)).collect() == []


@pytest.mark.parametrize("replacement", [False, True])
def test_equity_bands_are_those_of_plain_curves(spark, replacement):
    import numpy as np
    from pyspark.sql import functions as F

    from tidemark.operators import risk

    df = spark.createDataFrame([(k, (k * 37 % 101 - 50) / 1000) for k in range(90)], "ts long, r double")
    curves = {}
    for r in risk.simulated(df, 7, replacement=replacement).collect():
        curves.setdefault(r["simulation"], []).append((r["step"], r["r"], r["equity"], r["drawdown"]))
    assert set(curves) == set(range(7)) and len({tuple(x[1] for x in sorted(c)) for c in curves.values()}) == 7
    equity = []
    for curve in curves.values():
        step, r, e, d = (np.array(x) for x in zip(*sorted(curve), strict=True))
        assert (step == np.arange(1, 91)).all() and np.allclose(e, 1 + np.cumsum(r))
        peak = np.maximum.accumulate(np.append(1.0, e))[1:]
        assert np.allclose(d, e / peak - 1)
        if not replacement:
            assert sorted(r) == sorted(x["r"] for x in df.collect())
        equity.append(e)
    got = risk.equity_bands(df, 7, replacement=replacement).orderBy("step").collect()
    want = np.quantile(np.array(equity), [0.025, 0.5, 0.975], axis=0)
    assert np.allclose([[r["low"], r["median"], r["high"]] for r in got], want.T) and np.allclose([r["mean"] for r in got], np.mean(equity, 0))
    tasks = risk.simulated(df, 7).withColumn("_p", F.concat_ws(":", "simulation", F.spark_partition_id().cast("string")))
    assert risk.equity_bands(df.limit(0), 7).collect() == [] and tasks.count() == 630


def test_report_of_null_groups(spark):
    from pyspark.sql import functions as F

    from tidemark.operators import metrics

    df = spark.createDataFrame([("a", 1, 2.0), ("a", 2, -1.0), (None, 1, 3.0), (None, 2, None)], "s string, m int, r double")
    got = {(r["dimension"], r["value"]): (r["trades"], r["wins"], r["total"]) for r in metrics.report(df, "r", {"s": F.col("s"), "m": F.col("m")}).collect()}
    assert got == {("all", None): (3, 2, 4.0), ("s", "a"): (2, 1, 1.0), ("s", None): (1, 1, 3.0), ("m", "1"): (2, 2, 5.0), ("m", "2"): (1, 0, -1.0)}


def test_cleaning_counts_what_each_step_meets(spark):
    from tidemark.operators import cleaning

    t0 = dt.datetime(2024, 1, 1)
    rows = [("A", "H1", t0 + dt.timedelta(hours=k), 10.0, 11.0, 9.0, 10.0 + k % 2 / 10, 1.0, 0) for k in range(40)]
    rows[5] = (*rows[5][:6], None, 1.0, 0)
    rows[20] = (*rows[20][:6], 99.0, 1.0, 0)
    rows += [(*rows[3][:6], 50.0, 1.0, 1), ("A", "H1", t0 - dt.timedelta(hours=1), 10.0, 8.0, 9.0, 10.0, 1.0, 0), ("A", "H1", t0 - dt.timedelta(hours=2), -1.0, 8.0, 7.0, None, 1.0, 0)]
    df = spark.createDataFrame(rows, "symbol string, timeframe string, ts timestamp, open double, high double, low double, close double, volume double, copy int")
    for outliers, kept in (("clip", 40), ("drop", 39)):
        out, counters = cleaning.cleaned(df, ["close"], ("copy",), outliers=outliers)
        got = {r["ts"]: r["close"] for r in out.collect()}
        assert counters() == {"rows": 43, "invalid": 2, "duplicates": 1, "missing": 1, "outliers": 1, "kept": kept}
        assert len(got) == kept and got[rows[5][2]] == 10.0 and got[rows[3][2]] == 10.1 and got.get(rows[20][2], 0.0) < 99
        assert out.columns == df.columns


def test_no_task_holds_all_lots_of_a_symbol(spark):
    fills = spark.range(2000).select(F.lit("a").alias("symbol"), F.col("id").cast("timestamp").alias("ts"), F.when(F.col("id") % 3 == 0, -1).otherwise(1).alias("side"), F.col("id").cast("double").alias("price"), (1.0 + F.col("id") % 4).alias("size"))
    out = validation.lots(fills)
    plan = out._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if " Window [" in line]
    assert windows and "unboundedfollowing" not in plan and all("_range" in line for line in windows)
    assert out.agg(F.sum(F.col("size") * F.when(F.col("exit").isNull(), 1).otherwise(2))).first()[0] == sum(1.0 + k % 4 for k in range(2000))
