"""Joins, changes, metrics, graphs, files and streams on small tables."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import ordered, symbols
from tidemark.functions import scalars as S
from tidemark.operators import discovery, drift, graphs, joins, metrics, repository, risk, scaling, vectors
from tidemark.sources import files
from tidemark.streaming import bars

START = dt.datetime(2024, 1, 1)


def test_upsert_and_insert(spark):
    old = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "k int, v string, n int")
    new = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 1)], "k int, v string, n int")
    assert {r["k"]: r["v"] for r in repository.upsert(old, new, ["k"], ["n"]).collect()} == {1: "a", 2: "y", 3: "z"}
    assert {r["k"]: r["v"] for r in repository.insert_new(old, new, ["k"], ["n"]).collect()} == {1: "a", 2: "b", 3: "z"}


def test_merges_join_null_keys(spark):
    a, b = spark.createDataFrame([(1, "a"), (None, "n")], "k int, v string"), spark.createDataFrame([(None, "m"), (2, "c")], "k int, v string")
    got = {(r["k"], r["v"], r["v_right"]) for r in joins.merge(a, b, "k", "outer").collect()}
    assert got == {(1, "a", None), (None, "n", "m"), (2, None, "c")}


def test_delete_keeps_unknown(spark):
    df = spark.createDataFrame([(1,), (None,), (-1,)], "x int")
    assert {r["x"] for r in repository.delete_where(df, F.col("x") < 0).collect()} == {1, None}


def test_times_in_many_formats(spark):
    texts = ["2024-01-02 03:04:05", "2024-01-02T03:04:05", "2024.01.02 03:04", "2024-01-02", "20240102", "1704164645", "1704164645000", "nonsense", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(S.parse_time(F.col("t"))).collect()]
    full = dt.datetime(2024, 1, 2, 3, 4, 5)
    assert got == [full, full, full.replace(second=0), dt.datetime(2024, 1, 2), dt.datetime(2024, 1, 2), full, full, None, None]


def test_map_and_hash_helpers(spark):
    df = spark.createDataFrame([({"a": 1, "b": 2}, {"b": 3}, "x", None)], "m map<string,int>, n map<string,int>, s string, t string")
    r = df.select(S.merged_maps(F.col("m"), F.col("n")).alias("m"), S.content_hash(F.col("s"), F.col("t")).alias("h"), S.content_hash(F.col("t"), F.col("s")).alias("g")).first()
    assert r["m"] == {"a": 1, "b": 3} and r["h"] != r["g"] and len(r["h"]) == 64


def test_csv_sources(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "EURUSD.a_M15.csv").write_text("Time,Open,High,Low,Close,Vol\n2024-01-01 00:00:00,1.1,1.2,1.0,1.15,10\n2024-01-01 00:15:00,1.1,1.2,1.0,x,10\n")
    first = files.candle_files(spark, str(tmp_path))
    got = first.collect()
    assert [(r["symbol"], r["timeframe"], r["canonical"], r["close"], r["volume"]) for r in got] == [("EURUSD.a", "M15", "EURUSD", 1.15, 10.0)]
    (tmp_path / "deep" / "EURUSD.a_M15.csv").write_text("Time,Open,High,Low,Close,Vol\n2024-01-01 00:30:00,1.1,1.2,1.0,1.2,10\n")
    again = files.only_new(files.candle_files(spark, str(tmp_path)), spark.createDataFrame(got, first.schema), ["symbol", "timeframe"])
    assert [r["close"] for r in again.collect()] == [1.2]


def test_scaler_state_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(float(i),) for i in range(10)], "x double")
    state = scaling.fit(df, ["x"])
    files.save_state(state, str(tmp_path / "s"))
    again = files.load_state(spark, str(tmp_path / "s"), state.schema)
    for method in ("min_max", "z_score", "robust", "max_abs", "mean", "unit_vector"):
        back = scaling.inverse(scaling.transform(df, again, ["x"], method), again, ["x"], method)
        assert np.allclose(sorted(r[0] for r in back.collect()), range(10)), method


def test_scaling_a_constant(spark):
    df = spark.createDataFrame([(2.0,), (2.0,), (None,)], "x double")
    state = scaling.fit(df, ["x"])
    assert [r[0] for r in scaling.transform(df, state, ["x"], "min_max").collect()][:2] == [0.5, 0.5]
    assert [r[0] for r in scaling.transform(df, state, ["x"], "z_score").collect()] == [0.0, 0.0, None]


def test_metrics_of_one_class_and_ties(spark):
    one = spark.createDataFrame([(1, 0.5, 1), (1, 0.5, 2)], "y int, s double, doc_id int")
    assert metrics.roc_auc(one).first()["auc"] is None
    tied = spark.createDataFrame([(1, 0.5, 1), (0, 0.5, 2)], "y int, s double, doc_id int")
    assert metrics.roc_auc(tied).first()["auc"] == 0.5
    nothing = tied.filter("false")
    assert metrics.confusion(nothing.withColumn("p", F.col("y"))).first()["accuracy"] == 0.0
    gains = spark.createDataFrame([(1.0,), (2.0,)], "r double")
    got = metrics.trades(gains).first()
    assert got["profit_factor"] == math.inf and got["profit_factor_or_zero"] == 0.0


def test_quantiles_by_ranges_are_the_exact_ones(spark):
    x = F.when(F.col("id") % 11 != 0, F.floor(F.col("id") * F.col("id") % 97).cast("double") / 7)
    df = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("g"), x.alias("x")).union(spark.sql("SELECT 7L, CAST(NULL AS DOUBLE) UNION ALL SELECT 8L, 2.5D"))
    fractions = [0.0, 0.05, 0.5, 0.77, 1.0]
    want = {r["g"]: r["q"] for r in df.groupBy("g").agg(F.percentile("x", F.array(*map(F.lit, fractions))).alias("q")).collect() if r["q"]}
    got = {r["g"]: r["q"] for r in ordered.quantiles(df, "x", fractions, ("g",)).collect()}
    assert got == want and set(got) == {None, 1, 2, 8}
    whole = df.agg(F.percentile("x", F.array(*map(F.lit, fractions))).alias("q")).first()["q"]
    assert ordered.quantiles(df, "x", fractions).first()["q"] == whole
    assert ordered.quantiles(df.limit(0), "x", [0.5]).collect() == []


def test_drift_of_equal_and_moved_tables(spark):
    a = spark.range(1000).select(F.col("id").cast("double").alias("x"))
    same = drift.stability(a, a, ["x"]).first()
    assert abs(same["psi"]) < 1e-12 and not same["drifted"]
    assert drift.stability(a, a.select((F.col("x") / 4).alias("x")), ["x"]).first()["drifted"]
    flat = a.select(F.lit(1.0).alias("x"))
    assert drift.stability(flat, a, ["x"]).first()["psi"] == 0.0


def test_paths(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "src int, dst int")
    assert [r["node"] for r in graphs.path(edges, 1, 4).orderBy("position").collect()] == [1, 2, 3, 4]
    assert graphs.path(edges, 4, 1).count() == 0
    assert graphs.path(edges, 1, 4, most=3).count() == 0
    assert [r["node"] for r in graphs.path(edges, 2, 2).collect()] == [2]


def test_cycles_end(spark):
    tree = spark.createDataFrame([("a", "b"), ("b", "a")], "node string, parent string")
    assert {(r["node"], r["ancestor"]) for r in graphs.ancestors(tree).collect()} == {("a", "b"), ("b", "a"), ("a", "a"), ("b", "b")}


def test_principal_components_and_k_means(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 3)) * [5, 1, 0.1]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id int, v array<double>")
    mean, components, shares = vectors.principal_components(df, "v", share=0.9)
    assert np.allclose(mean, x.mean(0)) and len(components) == 1 and shares[0] > 0.9
    values, basis = np.linalg.eigh(np.cov(x.T))
    assert np.isclose(abs(components[0] @ basis[:, -1]), 1)
    y = np.concatenate([rng.normal(size=(50, 2)), rng.normal(size=(50, 2)) + 20])
    rows, centres = vectors.k_means(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(y)], "vec_id int, v array<double>"), "v", 2)
    groups = [r["cluster"] for r in rows.orderBy("vec_id").collect()]
    assert len(set(groups[:50])) == len(set(groups[50:])) == 1 and groups[0] != groups[50]


def test_allocations():
    cov = np.diag([1.0, 4.0])
    assert np.allclose(risk.allocation(np.zeros(2), cov, "minimum_variance", ridge=0), [0.8, 0.2])
    assert np.allclose(risk.allocation(np.zeros(2), cov, "risk_parity", ridge=0), [2 / 3, 1 / 3], atol=1e-6)
    assert np.allclose(risk.allocation(np.array([-1.0, -1.0]), cov, "mean_variance"), [0.5, 0.5])


def test_backtest_stops_before_targets(spark):
    bars_ = [(10, 10, 10, 10), (10, 13, 8, 10), (10, 10, 10, 10), (10, 12, 10, 12)]
    df = spark.createDataFrame([("A", "H1", START + dt.timedelta(hours=i), *map(float, b), 1.0) for i, b in enumerate(bars_)], "symbol string, timeframe string, ts timestamp, open double, high double, low double, close double, volume double")
    side = F.when(F.hour("ts").isin(0, 2), 1.0).otherwise(0.0)
    got = [r["trade_return"] for r in risk.backtest(df, side, F.lit(1.0), F.lit(2.0)).orderBy("ts").collect()]
    assert got == [pytest.approx(0.2)]
    stopped = [r["trade_return"] for r in risk.backtest(df, F.when(F.hour("ts") == 0, 1.0).otherwise(0.0), F.lit(0.0), F.lit(9.0), hold=1).collect()]
    assert stopped == [pytest.approx(0.0)]


def test_streams_give_the_bars_of_a_batch(spark, tmp_path):
    ticks = spark.createDataFrame([("A", START + dt.timedelta(minutes=m), float(m % 7), 1.0) for m in range(300)], "symbol string, ts timestamp, last double, volume double")
    ticks.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ticks.schema).parquet(str(tmp_path / "in"))
    bars.stream_into(bars.tumbling_bars(stream), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = {r["ts"]: r["close"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {r["ts"]: r["close"] for r in bars.tumbling_bars(ticks).collect()}
    assert got and got.items() <= want.items() and len(want) - len(got) <= 1


def test_volume_bars_keep_state_between_batches(spark, tmp_path):
    ticks = spark.createDataFrame([("A", START + dt.timedelta(minutes=m), float(m), 1.0) for m in range(25)], "symbol string, ts timestamp, last double, volume double")
    for k in range(2):
        ticks.filter(F.minute("ts") % 2 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ticks.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    bars.stream_into(bars.volume_bars(stream, 10.0), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert [r["volume"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [10.0, 10.0]


@pytest.mark.parametrize("name", ["graph_neighbours_all", "graph_subgraph_all", "graph_statistics_all", "graph_distances_strongest"])
def test_graph_queries_have_edges_on_the_largest_tables(spark, name):
    from tidemark import catalog

    rows = catalog.QUERIES[name](spark, "/root/testdata/sf0.1")
    if name == "graph_statistics_all":
        assert rows.first()["edges"] > 0
    elif name == "graph_distances_strongest":
        assert rows.filter("depth > 1").count() > 0
    else:
        assert rows.count() > 0


def test_identities_of_names(spark):
    want = {
        "EURUSDm": ("EURUSD", "EUR", "USD", "FOREX"), "eur_usd": ("EURUSD", "EUR", "USD", "FOREX"), "DJ30": ("US30", None, None, "INDEX"), "GOLD": ("XAUUSD", None, None, "METAL"),
        "US30.cash": ("US30", None, None, "INDEX"), "BTCUSDpro": ("BTCUSD", None, None, "CRYPTO"), "UKOIL": ("UKOIL", None, None, "ENERGY"), "foo": ("FOO", None, None, "UNKNOWN"), "": ("", None, None, "UNKNOWN"),
    }
    rows = spark.createDataFrame([(n,) for n in want], "name string").select("name", symbols.identity(F.col("name")).alias("i"), discovery.market_type(F.col("name"), F.lit(None)).alias("m")).collect()
    assert {r["name"]: tuple(r["i"]) for r in rows} == want
    assert {r["name"]: r["m"]["market_type"] for r in rows if r["name"] in ("GOLD", "", "foo")} == {"GOLD": "COMMODITY", "": "UNKNOWN", "foo": "UNKNOWN"}


def test_scans_over_ranges_are_those_of_one_pass(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "a", "a", None, "c"]), k, rng.randint(-9, 9), k if rng.random() < 0.02 else None) for k in range(3000)]
    df = spark.createDataFrame(rows, "g string, k long, v long, n long").repartition(3)
    results = {"s": ("sum", F.col("v")), "p": ("peak", F.col("v")), "t": ("total", F.col("v")), "l": ("last", F.col("n")), "a": ("after", F.col("k"))}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for order, turn in ((F.col("k").asc(), False), (F.col("k").desc(), True)):
            out = ordered.scanned(df, [order], results, ("g",))
            windows = [line for line in out._jdf.queryExecution().executedPlan().toString().splitlines() if " Window [" in line]
            assert windows and all("_range" in line for line in windows if "_side" in line)
            want = []
            for g in ("a", None, "c"):
                own, s, p, last = sorted((r for r in rows if r[0] == g), key=lambda r: r[1], reverse=turn), 0, None, None
                for r, after in zip(own, [*own[1:], None], strict=True):
                    s += r[2]
                    p, last = s if p is None else max(p, s), last if r[3] is None else r[3]
                    want.append((*r, s, p, sum(x[2] for x in own), last, after and after[1]))
            assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_trades_of_one_group_are_scanned_by_ranges(spark):
    rng = random.Random(8)
    rows = [("a" if k % 5 else None, k, rng.choice([None, -2.0, -1.0, 1.0, 3.0])) for k in range(2000)]
    df = spark.createDataFrame(rows, "g string, ts long, r double").repartition(3)
    told = {"streaks": metrics.streaks(df, by=("g",)), "equity": metrics.equity(df, by=("g",), start=100.0), "risk": metrics.risk(df, by=("g",))}
    for out in (told["streaks"], told["equity"]):
        windows = [line for line in out._jdf.queryExecution().executedPlan().toString().splitlines() if " Window [" in line]
        assert windows and all("_range" in line for line in windows)
    assert " Join" not in told["risk"]._jdf.queryExecution().optimizedPlan().toString().replace("Join LeftOuter", "", 1)
    streaks, curve, risk_of = ({k: [r for r in out.collect() if r["g"] == k] for k in ("a", None)} for out in told.values())
    for g in ("a", None):
        own, runs, at, peak, want = [r[2] for r in rows if r[0] == g], {True: 0, False: 0}, 100.0, 100.0, []
        run, kind = 0, None
        for r in own:
            now = None if r is None else r > 0
            run, kind = (run + 1 if now == kind else 1), now
            if now is not None:
                runs[now] = max(runs[now], run)
            at += r or 0.0
            peak = max(peak, at)
            want.append((at, peak))
        assert [(r["max_wins"], r["max_losses"]) for r in streaks[g]] == [(runs[True], runs[False])]
        assert [(r["equity"], r["peak"]) for r in sorted(curve[g], key=lambda r: r["ts"])] == want
        known = np.array([r for r in own if r is not None])
        for p in (95, 99):
            q = np.quantile(known, 1 - p / 100)
            assert risk_of[g][0][f"var_{p}"] == pytest.approx(q) and risk_of[g][0][f"cvar_{p}"] == pytest.approx(known[known <= q].mean())
    assert tuple(metrics.risk(df.limit(0)).first()) == (None,) * 5


def test_softmax_works_out_its_largest_element_and_sum_once(spark):
    rows = [([1.0, 2.0, 800.0, 801.0],), ([],), (None,), ([3.0] * 500,)]
    out = spark.createDataFrame(rows, "x array<double>").select(S.softmax(F.col("x")).alias("p"))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("array_max(") == 1
    got = [r["p"] for r in out.collect()]
    e = np.exp(np.array(rows[0][0]) - 801.0)
    assert got[0] == pytest.approx(e / e.sum()) and got[1:3] == [[], None] and got[3] == pytest.approx([1 / 500] * 500)
