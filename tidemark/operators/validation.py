"""Whether a model or a strategy holds up: overfitting, regimes, staged gates, baselines, and positions made of fills."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import windows as W
from ..functions.ordered import running_totals, scanned
from ..functions.scalars import clip, div

#: Gap of accuracy and least training accuracy of an overfit model; early Sharpe that can collapse, and the share that is left then.
GAP, LEAST_TRAIN, EARLY, COLLAPSE = 0.15, 0.60, 0.2, 0.35
#: Order of timeframes where the preferred one is missing.
TIMEFRAME_ORDER = ("D1", "H1", "H4", "M15")


def overfit(train: Column, test: Column, gap: float = GAP) -> Column:
    """(gap, overfit) of accuracies in training and in testing; a missing accuracy is 0."""
    a, b = F.coalesce(train.cast("double"), F.lit(0.0)), F.coalesce(test.cast("double"), F.lit(0.0))
    return F.struct((a - b).alias("gap"), ((a - b > gap) & (a >= LEAST_TRAIN)).alias("overfit"))


def edge_left(years: Column, score: float = 1.0, half_life: float = 2.0) -> Column:
    """How much of an edge is left after so many years, within [0, 1]."""
    return clip(score * F.pow(F.lit(0.5), F.greatest(years, F.lit(0.0)) / max(half_life, 1e-6)), 0.0, 1.0)


def regimes(curve: DataFrame, equity: str = "equity", by=("symbol",), order=("ts",), window: int = 252) -> DataFrame:
    """Per curve: Sharpe of its first and last returns, and whether it collapsed; the window is at most a third of the returns, 10 at least.

    A curve of fewer than 20 rows has 0 for both and is stable.
    """
    w, whole = Window.partitionBy(*by).orderBy(*order), Window.partitionBy(*by)
    before = F.lag(equity).over(w)
    rows = curve.select(*by, ((F.col(equity) - before) / F.greatest(before, F.lit(1e-12))).alias("_r"), (F.row_number().over(w) - 1).alias("_i"), (F.count(F.lit(1)).over(whole) - 1).alias("_n"))
    rows = rows.withColumn("window", F.greatest(F.lit(10), F.least(F.lit(window), F.greatest(F.lit(10), F.floor(F.col("_n") / 3)))).cast("int"))

    def sharpe(inside: Column) -> Column:
        r = F.when(inside, F.col("_r"))
        return F.when(F.max("_n") >= 19, div(F.avg(r), F.stddev_samp(r), 0.0) * F.sqrt(F.max("window"))).otherwise(0.0)

    out = rows.groupBy(*by).agg(F.max("window").alias("window"), sharpe(F.col("_i") <= F.col("window")).alias("early_sharpe"), sharpe(F.col("_i") > F.col("_n") - F.col("window")).alias("late_sharpe"))
    return out.withColumn("collapsed", (F.col("early_sharpe") > EARLY) & (F.col("late_sharpe") < F.col("early_sharpe") * COLLAPSE))


def gate(stages: list[tuple[str, Column, float]]) -> Column:
    """(passed, reason) of stages (name, score, least score) taken in turn: the first that fails is the reason. A missing score fails."""
    reason = F.coalesce(*[F.when(~F.coalesce(score >= least, F.lit(False)), F.lit(f"{name}_failed")) for name, score, least in stages], F.lit("all_stages_passed"))
    return F.struct((reason == "all_stages_passed").alias("passed"), reason.alias("reason"))


def baselines(report: DataFrame, preferred: str = "D1") -> DataFrame:
    """Per symbol (upper case) the row of the preferred timeframe, else of the next one there is; rows with an error or no symbol are left out."""
    known = F.when(F.col("timeframe") == preferred, -1)
    for k, t in enumerate(TIMEFRAME_ORDER):
        known = known.when(F.col("timeframe") == t, k)
    rows = report.filter("error IS NULL AND symbol <> ''").withColumns({"symbol": F.upper("symbol"), "_rank": known.otherwise(9)})
    w = Window.partitionBy("symbol").orderBy("_rank", "timeframe")
    return rows.withColumn("_first", F.row_number().over(w)).filter("_first = 1").drop("_first", "_rank", "error")


def objectives(returns: DataFrame, result: str = "r", by=("symbol",), order=("ts",), periods: int = 252) -> DataFrame:
    """Per series: total and mean return, Sharpe, drawdown of the compounded curve from 1, and Calmar (0 without a drawdown)."""
    from .metrics import equity, total_return

    curve = equity(returns.filter(F.col(result).isNotNull()), result, by, order, 1.0, compounded=True)
    out = curve.groupBy(*by).agg(total_return(result).alias("total_return"), F.avg(result).alias("mean_return"), (div(F.avg(result), F.stddev_samp(result), 0.0) * math.sqrt(periods)).alias("sharpe"), F.min("drawdown").alias("max_drawdown"))
    return out.withColumn("calmar", div(F.col("mean_return") * periods, F.abs("max_drawdown"), 0.0))


def positions(fills: DataFrame, by=("symbol",), order=("ts",)) -> DataFrame:
    """Trades and open positions of fills (side 1 or -1, price, size): a fill closes the oldest open position of the other side, else it opens one.

    With only one side open at a time, the running sum of sides tells opening fills from closing ones, and the k-th
    closing of a side goes with its k-th opening: a window and an equi-join, without state in a loop.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    net = F.sum("side").over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = fills.select(*by, *order, "side", "price", "size").withColumn("_net", net)
    rows = rows.withColumn("_opens", F.abs("_net") > F.abs(F.col("_net") - F.col("side")))
    rows = rows.withColumn("_side", F.when(F.col("_opens"), F.col("side")).otherwise(-F.col("side")))
    rows = rows.withColumn("_k", F.row_number().over(Window.partitionBy(*by, "_side", "_opens").orderBy(*order)))
    opened = rows.filter("_opens").drop("_opens", "_net", "_side")
    closed = rows.filter("NOT _opens").select(*by, F.col("_side").alias("side"), "_k", *[F.col(c).alias(f"{c}_closed") for c in order], F.col("price").alias("exit"))
    both = opened.join(closed, [*by, "side", "_k"], "left")
    return both.select(*by, *order, "side", "size", F.col("price").alias("entry"), "exit", *[f"{c}_closed" for c in order], ((F.col("exit") - F.col("price")) * F.col("side") * F.col("size")).alias("pnl"))


def lots(fills: DataFrame, by=("symbol",), order=("ts",)) -> DataFrame:
    """First in, first out: a row for each part of a fill that another closes, and for each part that stays open (exit null), of fills (side 1 or -1, price, size).

    Bought and sold quantities are laid end to end, each side on an axis of its own, in order of time; what the k-th
    unit bought and the k-th unit sold have in common is one lot, opened by the earlier fill and closed by the later
    one. So a fill that closes more than is open opens the other side with the rest, and positions of both sides
    never stand at once. The overlaps come from the ends of all intervals in order, scanned by ranges: no pair of
    fills is tried, no state is kept in a loop, and no task holds a whole symbol. Fills without a positive size do not count.
    """
    key, keys = F.struct(*[F.col(c) for c in order]), list(by)
    rows = fills.filter((F.col("size") > 0) & F.col("side").isin(1, -1)).select(*keys, *order, "side", "price", F.col("size").cast("double").alias("size"))
    rows = running_totals(rows, [F.col(c).asc() for c in order], {"_end": F.col("size")}, (*keys, "side"))
    # Every end of an interval closes a part: it belongs to the fill of either side that reaches that far.
    fill = F.struct(key.alias("at"), F.col("price").alias("price"))
    ends = rows.groupBy(*keys, "_end").agg(*[F.max(F.when(F.col("side") == s, fill)).alias(f"_to_{n}") for s, n in ((1, "long"), (-1, "short"))])
    # From the last end back: the latest fill seen is the first that reaches this far, and the next end is the one below.
    here = {"_long": ("last", F.col("_to_long")), "_short": ("last", F.col("_to_short")), "_below": ("after", F.col("_end"))}
    parts = scanned(ends, [F.col("_end").desc()], here, tuple(keys))
    parts = parts.withColumn("size", F.col("_end") - F.coalesce("_below", F.lit(0.0))).filter(F.col("size") > 0)
    first = F.col("_short").isNull() | (F.col("_long.at") < F.col("_short.at"))
    parts = parts.withColumns({"side": F.when(first, 1).otherwise(-1), "_open": F.when(first, F.col("_long")).otherwise(F.col("_short")), "_close": F.when(first, F.col("_short")).otherwise(F.col("_long"))})
    parts = parts.withColumns({"entry": F.col("_open.price"), "exit": F.col("_close.price")})
    return parts.select(*keys, *[F.col(f"_open.at.{c}").alias(c) for c in order], "side", "size", "entry", "exit", *[F.col(f"_close.at.{c}").alias(f"{c}_closed") for c in order], ((F.col("exit") - F.col("entry")) * F.col("side") * F.col("size")).alias("pnl"))


def concentration(pairs: DataFrame, held: DataFrame, limit: float = 0.8) -> DataFrame:
    """One row: the symbols held, the largest absolute correlation between two of them, the pairs at or beyond the limit, and whether there are any.

    `pairs` is (a, b, r); what is held is a handful of names, as is checked by reading two names a pair.
    """
    own = held.select("symbol").distinct()
    inside = pairs.join(own.withColumnRenamed("symbol", "a"), "a", "left_semi").join(own.withColumnRenamed("symbol", "b"), "b", "left_semi")
    counts = inside.agg(F.coalesce(F.max(F.abs("r")), F.lit(0.0)).alias("largest"), F.count_if(F.abs("r") >= limit).alias("pairs"))
    return own.agg(F.count(F.lit(1)).alias("symbols")).join(counts).withColumn("overconcentrated", F.col("pairs") > 0)  # one row each


def with_significance(matrix: DataFrame) -> DataFrame:
    """A matrix (n, r) with t, whether it is significant at 5 percent, and confidence."""
    from .correlation import confidence, significant, t_statistic

    r, n = F.col("r"), F.col("n")
    return matrix.withColumns({"t": t_statistic(r, n), "significant": significant(r, n)}).withColumn("confidence", confidence(r, n, F.col("significant")))


def held_at_end(trades: DataFrame, by=W.SERIES[:1]) -> DataFrame:
    """Positions of `positions` that no fill has closed."""
    return trades.filter(F.col("exit").isNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("open"), F.sum(F.col("side") * F.col("size")).alias("exposure"))
