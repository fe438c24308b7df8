"""Positions, limits, allocations, resampled trade results and promotion rules."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import windows as W
from ..functions.scalars import clip, div
from .recursive import ordered_positions


def position_size(equity: Column, entry: Column, stop: Column, fraction: float = 0.01, cap: float = 0.02, pip_value: float = 1.0, drawdown: Column | None = None, least: float = 0.01, most: float = 100.0) -> Column:
    """Lots that lose the risked share of equity at the stop, within the lot limits, less by the drawdown; 0 without a stop distance."""
    lots = div(equity * min(fraction, cap), F.abs(entry - stop) * pip_value, 0.0)
    if drawdown is not None:
        lots = lots * F.greatest(F.lit(0.0), 1 - F.abs(drawdown))
    return F.when(lots > 0, clip(lots, least, most)).otherwise(0.0)


def limit_broken(state: dict[str, Column], max_drawdown: float = 0.2, daily_loss: float = 0.05, open_trades: int = 5, correlation: float = 0.8, portfolio_risk: float = 0.06) -> Column:
    """The first rule broken: circuit_breaker, max_drawdown, daily_loss, open_trades, correlation, portfolio_risk; null if none is."""
    return (
        F.when(state["halted"], "circuit_breaker").when(F.abs(state["drawdown"]) >= max_drawdown, "max_drawdown").when(state["daily_pnl"] <= -daily_loss, "daily_loss")
        .when(state["open_trades"] >= open_trades, "open_trades").when(F.abs(state["correlation"]) >= correlation, "correlation").when(state["risk"] >= portfolio_risk, "portfolio_risk")
    )


def signals(df: DataFrame, prediction: Column, probability: Column, least: float = 0.55, sessions: list[str] | None = None, trend: Column | None = None, cooldown: int = 0) -> DataFrame:
    """`side` (1, -1, 0) and `rejected`: filters by confidence, session, trend and rows since the last raw signal, in this order."""
    raw = F.signum(prediction)
    rejected = F.when(raw == 0, "no_side").when(probability < least, "confidence")
    if sessions is not None:
        rejected = rejected.when(~F.col("session").isin(*sessions), "session")
    if trend is not None:
        rejected = rejected.when(F.signum(trend) == -raw, "trend")
    out = df.withColumns({"_raw": raw, "rejected": rejected})
    if cooldown:
        recent = F.max(F.when(F.col("rejected").isNull(), 1)).over(W.series().rowsBetween(-cooldown, -1))
        out = out.withColumn("rejected", F.coalesce("rejected", F.when(recent == 1, "cooldown")))
    return out.withColumn("side", F.when(F.col("rejected").isNull(), F.col("_raw")).otherwise(0.0)).drop("_raw")


def backtest(candles: DataFrame, side: Column, stop: Column, target: Column, hold: int = 20, cost: float = 0.0) -> DataFrame:
    """Trades of one position at a time, entered at the bar after a signal: (symbol, timeframe, ts, trade_return) less the cost of each trade."""
    rows = candles.withColumn("_signal", F.struct(side.alias("s"), stop.alias("sd"), target.alias("td")))
    before = F.lag("_signal").over(W.series())
    rows = rows.withColumn("_before", before)
    found = ordered_positions(rows, F.coalesce(F.col("_before.s") != 0, F.lit(False)), F.coalesce(F.col("_before.s"), F.lit(0.0)), F.col("_before.sd"), F.col("_before.td"), hold)
    return found.filter(F.col("trade_return").isNotNull()).select(*W.SERIES, "ts", (F.col("trade_return") - cost).alias("trade_return"))


def inverse_volatility(returns: DataFrame, by: str = "symbol", value: str = "r") -> DataFrame:
    """(by, volatility, weight): 1 / deviation over its sum."""
    each = returns.groupBy(by).agg(F.stddev_samp(value).alias("volatility"))
    return each.withColumn("_w", div(F.lit(1.0), F.col("volatility"), 0.0)).withColumn("weight", div(F.col("_w"), F.sum("_w").over(Window.partitionBy()), 0.0)).drop("_w")


def covariance(returns: DataFrame, by: str = "symbol", time: str = "ts", value: str = "r") -> tuple[list[str], np.ndarray, np.ndarray]:
    """(names, mean, covariance) of aligned returns: computed by Spark, one number for each two names on the driver."""
    other = returns.select(F.col(by).alias("_b"), F.col(time).alias("_t"), F.col(value).alias("_y"))
    both = returns.join(other, F.col(time) == F.col("_t"))
    rows = both.groupBy(F.col(by).alias("a"), F.col("_b").alias("b")).agg(F.covar_samp(value, "_y").alias("c")).collect()
    means = {r[0]: r[1] for r in returns.groupBy(by).agg(F.avg(value)).collect()}
    names = sorted(means)
    at = {n: i for i, n in enumerate(names)}
    cov = np.zeros((len(names), len(names)))
    for r in rows:
        cov[at[r["a"]], at[r["b"]]] = r["c"] or 0.0
    return names, np.array([means[n] for n in names]), cov


def allocation(mean: np.ndarray, cov: np.ndarray, kind: str = "mean_variance", risk_free: float = 0.0, ridge: float = 1e-6, rounds: int = 500) -> np.ndarray:
    """Long-only weights that sum to 1: mean_variance, minimum_variance or risk_parity (equal shares of the variance)."""
    n = len(mean)
    c = cov + ridge * np.eye(n)
    if kind == "risk_parity":
        w = np.full(n, 1 / n)
        for _ in range(rounds):
            w = w * np.sqrt((w @ c @ w / n) / np.maximum(w * (c @ w), 1e-300))
            w /= w.sum()
        return w
    w = np.linalg.pinv(c) @ ((mean - risk_free) if kind == "mean_variance" else np.ones(n))
    w = np.maximum(w, 0)
    return w / w.sum() if w.sum() > 0 else np.full(n, 1 / n)


#: Ranges that the trades of a simulation are dealt to.
RANGES = 32


def simulated(trades: DataFrame, simulations: int, result: str = "r", ids: tuple[str, ...] = ("ts",), seed: int = 7, replacement: bool = False, ranges: int | None = None) -> DataFrame:
    """(simulation, step, r, equity, drawdown) of trades in other orders, or drawn again with replacement; equity starts at 1.

    Every simulation orders the rows by a hash of its own and their `ids`, so it is the same however the rows are
    dealt; drawing with replacement counts a row Poisson(1) times. Hashes spread evenly, so their high bits deal each simulation
    to `ranges` of its order: sums, peaks and steps are worked out within a range, and what lies before it comes
    from a table of one row for each range of each simulation.
    """
    ranges = ranges or RANGES
    rows = trades.select(F.col(result).cast("double").alias("_r"), F.struct(*ids).alias("_id"))
    many = rows.withColumn("simulation", F.explode(F.sequence(F.lit(0), F.lit(simulations - 1))))
    if replacement:
        u = (F.pmod(F.xxhash64(F.lit(seed), "simulation", "_id"), F.lit(1 << 30)) + 0.5) / float(1 << 30)
        times = sum(((u > float(p)).cast("int") for p in _poisson_steps()), F.lit(0))
        many = many.withColumn("_r", F.col("_r") * times)
    many = many.withColumn("_h", F.pmod(F.xxhash64(F.lit(seed + 1), "simulation", "_id"), F.lit(1 << 30)))
    many = many.withColumn("_range", F.floor(F.col("_h") * ranges / (1 << 30)).cast("int"))
    w = Window.partitionBy("simulation", "_range").orderBy("_h", "_id").rowsBetween(Window.unboundedPreceding, 0)
    here = many.withColumns({"_s": F.coalesce(F.sum("_r").over(w), F.lit(0.0)), "_n": F.count(F.lit(1)).over(w)})
    here = here.withColumn("_m", F.max("_s").over(w))
    ends = here.groupBy("simulation", "_range").agg(F.sum("_r").alias("_total"), F.max("_n").alias("_count"), F.max("_s").alias("_most"))
    before = Window.partitionBy("simulation").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    off = F.coalesce(F.sum("_total").over(before), F.lit(0.0))
    ends = ends.withColumns({"_off": off, "_before": F.coalesce(F.sum("_count").over(before), F.lit(0))}).withColumn("_top", F.coalesce(F.max(F.col("_off") + F.col("_most")).over(before), F.lit(0.0)))
    table = ends.select("simulation", "_range", "_off", "_before", "_top")
    curve = here.join(F.broadcast(table) if simulations * ranges <= 1_000_000 else table, ["simulation", "_range"])
    curve = curve.withColumns({"equity": 1 + F.col("_off") + F.col("_s"), "_peak": 1 + F.greatest(F.lit(0.0), F.col("_top"), F.col("_off") + F.col("_m"))})
    return curve.select("simulation", (F.col("_before") + F.col("_n")).alias("step"), F.col("_r").alias("r"), "equity", div(F.col("equity") - F.col("_peak"), F.col("_peak"), 0.0).alias("drawdown"))


def reshuffled(trades: DataFrame, simulations: int, result: str = "r", ids: tuple[str, ...] = ("ts",), seed: int = 7, replacement: bool = False) -> DataFrame:
    """(simulation, final, max_drawdown) of `simulated` trades."""
    return simulated(trades, simulations, result, ids, seed, replacement).groupBy("simulation").agg((1 + F.sum("r")).alias("final"), F.min("drawdown").alias("max_drawdown"))


def equity_bands(trades: DataFrame, simulations: int, result: str = "r", ids: tuple[str, ...] = ("ts",), seed: int = 7, replacement: bool = False, confidence: float = 0.95) -> DataFrame:
    """(step, mean, low, median, high): equity after each step over all simulations. A step has a value for each simulation, which partial aggregates merge."""
    low, high = (1 - confidence) / 2, (1 + confidence) / 2
    curves = simulated(trades, simulations, result, ids, seed, replacement)
    q = F.percentile("equity", F.array(*map(F.lit, (low, 0.5, high))))
    bands_ = curves.groupBy("step").agg(F.avg("equity").alias("mean"), q.alias("_q"))
    return bands_.select("step", "mean", *[F.get("_q", F.lit(k)).alias(n) for k, n in enumerate(("low", "median", "high"))])


def _poisson_steps() -> list[float]:
    """Cumulative probabilities of 0, 1, 2, ... at mean 1."""
    total, term, out = 0.0, np.exp(-1.0), []
    for k in range(12):
        total += term
        out.append(total)
        term /= k + 1
    return out


def bands(simulated: DataFrame, confidence: float = 0.95) -> DataFrame:
    """Mean and quantiles of final equity and drawdown over simulations."""
    low, high = (1 - confidence) / 2, (1 + confidence) / 2
    return simulated.agg(*[f.alias(f"{c}_{n}") for c in ("final", "max_drawdown") for n, f in (("mean", F.avg(c)), ("low", F.percentile(c, low)), ("median", F.percentile(c, 0.5)), ("high", F.percentile(c, high)))])


def binomial_tail(wins: Column, n: Column, p: float = 0.5) -> Column:
    """P(X >= wins) of a binomial, by the normal approximation with continuity correction; 1 for no trials."""
    z = (wins - 0.5 - n * p) / F.sqrt(n * p * (1 - p))
    from .correlation import normal_two_sided

    half = normal_two_sided(z) / 2
    return F.when(n > 0, F.when(z >= 0, half).otherwise(1 - half)).otherwise(1.0)


def promotion(challenger: Column, champion: Column, least: float = 0.005, minimize: bool = False) -> Column:
    """Whether a challenger takes over: never without a metric, always without a champion's, else by an improvement of `least`."""
    delta = champion - challenger if minimize else challenger - champion
    return F.when(challenger.isNull(), False).when(champion.isNull(), True).otherwise(delta >= least)


def readiness(metrics: dict[str, Column], least_trades: int = 30, least_days: int = 30, sharpe: float = 0.5, drawdown: float = 0.15, profit_factor: float = 1.2, accuracy: float = 0.52) -> Column:
    """The sorted names of the rules that fail, of trades, days, sharpe, drawdown, profit_factor and accuracy (with enough trades)."""
    rules = {
        "trades": metrics["trades"] < least_trades, "days": metrics["days"] < least_days, "sharpe": metrics["sharpe"] < sharpe, "drawdown": F.abs(metrics["drawdown"]) > drawdown,
        "profit_factor": metrics["profit_factor"] < profit_factor, "accuracy": (metrics["trades"] >= least_trades) & (metrics["accuracy"] < accuracy),
    }
    return F.array_compact(F.array(*[F.when(F.coalesce(r, F.lit(True)), F.lit(n)) for n, r in sorted(rules.items())]))


def allocations(positions: DataFrame) -> DataFrame:
    """Exposure (|quantity| * price) of each symbol and its share of all."""
    each = positions.groupBy("symbol").agg(F.sum(F.abs(F.col("quantity") * F.col("price"))).alias("exposure"))
    return each.withColumn("share", div(F.col("exposure"), F.sum("exposure").over(Window.partitionBy()), 0.0))
