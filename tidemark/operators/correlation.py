"""Correlation between series: matrices, best lags, ranks, and rolling features against peers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import windows as W
from ..functions.scalars import div
from ..functions.symbols import peer_class
from .asof import asof_join

#: Bands of absolute correlation, the least rows, the largest lag.
BANDS = ((0.9, "very_strong"), (0.7, "strong"), (0.4, "moderate"), (0.2, "weak"))
LEAST_ROWS, MOST_LAG = 30, 10


def strength(r: Column) -> Column:
    out = F.when(r == 0, "none")
    for limit, name in BANDS:
        out = out.when(F.abs(r) >= limit, name)
    return out.when(F.abs(r) > 0, "very_weak").otherwise("none")


def direction(r: Column) -> Column:
    return F.when(r > 0.05, "positive").when(r < -0.05, "negative").otherwise("none")


def confidence(r: Column, n: Column, significant: Column) -> Column:
    sure = F.least(F.lit(1.0), F.abs(r) + F.when(significant, 0.15).otherwise(0.0))
    return F.least(F.lit(1.0), sure + 0.05 * F.least(F.lit(1.0), n / (2 * LEAST_ROWS)))


def t_statistic(r: Column, n: Column) -> Column:
    return F.when((n > 2) & (F.abs(r) < 1), r * F.sqrt((n - 2) / (1 - r * r)))


def significant(r: Column, n: Column) -> Column:
    """At 5 percent, two-sided: by the normal distribution's quantile, widened for few rows."""
    df = n - 2
    return F.coalesce(F.abs(t_statistic(r, n)) >= 1.959964 * (1 + 1.0 / (F.greatest(df, F.lit(1)) * 0.81)), F.abs(r) >= 1)


def returns_by_position(candles: DataFrame, value: str = "close") -> DataFrame:
    """(symbol, pos, x): returns of each symbol, numbered from its end, as series are matched by their tails."""
    r = candles.select("symbol", "ts", div(F.col(value) - W.lag(value, 1, ("symbol",)), W.lag(value, 1, ("symbol",))).alias("x")).filter(F.col("x").isNotNull())
    return r.select("symbol", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts"))).alias("pos"), "x")


def pairs(series: DataFrame) -> DataFrame:
    """(a, b, pos, x, y) for a < b, matched by position: an equi-join, whose rows are symbols squared for each position."""
    other = series.select(F.col("symbol").alias("b"), "pos", F.col("x").alias("y"))
    return series.select(F.col("symbol").alias("a"), "pos", "x").join(other, "pos").filter(F.col("a") < F.col("b"))


def matrix(series: DataFrame) -> DataFrame:
    """(a, b, n, r) for every two symbols, with strength and direction."""
    out = pairs(series).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), W.pearson("x", "y").alias("r"))
    return out.withColumns({"strength": strength(F.col("r")), "direction": direction(F.col("r"))})


def average_ranks(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """`name`: the rank of each value in its group, equal values sharing their mean rank."""
    w = Window.partitionBy(*keys).orderBy(value)
    return df.withColumn(name, F.rank().over(w) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, value)) - 1) / 2)


def spearman(series: DataFrame) -> DataFrame:
    """(a, b, n, rho): correlation of average ranks."""
    both = average_ranks(average_ranks(pairs(series), ["a", "b"], "x", "_rx"), ["a", "b"], "y", "_ry")
    return both.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), W.pearson("_rx", "_ry").alias("rho"))


def gamma(series: DataFrame, chunk: int = 256) -> DataFrame:
    """(a, b, n, gamma): concordant less discordant pairs of positions over their sum, ties left out.

    The statistic looks at every two positions. Positions are held in chunks of bounded size; every two chunks of two
    symbols are one row, in which pairs are counted, never listed. With more positions there are more rows, not larger ones.
    """
    both = pairs(series).withColumn("_chunk", F.floor((F.col("pos") - 1) / chunk))
    held = both.groupBy("a", "b", "_chunk").agg(F.collect_list(F.struct("pos", "x", "y")).alias("_v"))
    other = held.select(F.col("a").alias("_a"), F.col("b").alias("_b"), F.col("_chunk").alias("_c"), F.col("_v").alias("_w"))
    met = held.join(other, (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")) & (F.col("_chunk") <= F.col("_c")))

    def sign(p: Column, q: Column) -> Column:
        return F.when(p["pos"] < q["pos"], F.signum((p["x"] - q["x"]) * (p["y"] - q["y"]))).otherwise(0.0)

    def counted(p: Column) -> Column:
        return F.aggregate("_w", F.struct(F.lit(0).cast("long").alias("c"), F.lit(0).cast("long").alias("d")), lambda s, q: F.struct((s["c"] + (sign(p, q) > 0).cast("long")).alias("c"), (s["d"] + (sign(p, q) < 0).cast("long")).alias("d")))

    # Two chunks of the same symbols each meet once; a pair within them counts in the order of its positions, whichever side holds it.
    sums = met.withColumn("_s", F.transform("_v", counted))
    total = sums.groupBy("a", "b").agg(*[F.sum(F.aggregate(F.col(f"_s.{k}"), F.lit(0).cast("long"), lambda s, x: s + x)).alias(f"_{k}") for k in ("c", "d")])
    n = both.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    return n.join(total, ["a", "b"]).select("a", "b", "n", div((F.col("_c") - F.col("_d")).cast("double"), F.col("_c") + F.col("_d"), 0.0).alias("gamma"))


def best_lag(series: DataFrame, most: int = MOST_LAG, least_rows: int = LEAST_ROWS) -> DataFrame:
    """(a, b, lag, n, r): the lag in [-most, most] with the largest |r|, the most negative one on a tie.

    A positive lag means that a leads: its value `lag` rows earlier goes with b's. Each row of a meets 2 * most + 1 rows
    of b by an equi-join on the shifted position.
    """
    shifted = series.select(F.col("symbol").alias("a"), F.explode(F.sequence(F.lit(-most), F.lit(most))).alias("lag"), "pos", "x").withColumn("pos", F.col("pos") - F.col("lag"))
    other = series.select(F.col("symbol").alias("b"), "pos", F.col("x").alias("y"))
    both = shifted.join(other, "pos").filter(F.col("a") < F.col("b"))
    each = both.groupBy("a", "b", "lag").agg(F.count(F.lit(1)).alias("n"), W.pearson("x", "y").alias("r")).filter((F.col("n") >= least_rows) & F.col("r").isNotNull())
    best = each.groupBy("a", "b").agg(F.max_by(F.struct("lag", "n", "r"), F.struct(F.round(F.abs("r"), 12), -F.col("lag"))).alias("_b"))
    return best.select("a", "b", "_b.lag", "_b.n", "_b.r")


def leading(lags: DataFrame) -> DataFrame:
    """Pairs whose best lag is not 0, with who leads."""
    return lags.filter(F.col("lag") != 0).withColumn("leader", F.when(F.col("lag") > 0, F.col("a")).otherwise(F.col("b")))


def peer_features(base: DataFrame, peers: DataFrame, window: int = 50) -> DataFrame:
    """Long table (base's symbol, timeframe, ts, peer): correlation, beta and relative return of returns, z-score of the close ratio.

    Peers are aligned as of the base's times.
    """
    def with_return(df: DataFrame) -> DataFrame:
        return df.select("symbol", "timeframe", "ts", "close", div(F.col("close") - W.lag("close"), W.lag("close")).alias("ret"))

    names = peers.select(F.col("symbol").alias("peer"), "timeframe").distinct()
    # Every base row meets every peer of its timeframe: the feature's own shape, one row for each base row and peer.
    wide = with_return(base).join(names, "timeframe").filter(F.col("symbol") != F.col("peer"))
    other = with_return(peers).withColumnRenamed("symbol", "peer")
    both = asof_join(wide, other, ["peer", "timeframe"], columns=["close", "ret"])
    keys = ("symbol", "timeframe", "peer")
    w = W.last(window, keys)
    known = F.when(F.col("ret").isNotNull() & F.col("right_ret").isNotNull(), 1)
    both = both.withColumns({"_n": F.count(known).over(w), "_ratio": div(F.col("close"), F.col("right_close"))})
    enough = F.col("_n") == window
    ratio_mean, ratio_std = W.full(window, "_ratio", F.avg, w), W.full(window, "_ratio", F.stddev_pop, w)
    return both.select(
        *keys, "ts", F.when(enough, W.pearson("ret", "right_ret", lambda a: a.over(w))).alias("correlation"), F.when(enough, div(F.covar_pop("ret", "right_ret").over(w), F.var_pop("right_ret").over(w))).alias("beta"),
        (F.col("ret") - F.col("right_ret")).alias("relative_return"), div(F.col("_ratio") - ratio_mean, ratio_std).alias("spread_zscore"), peer_class(F.col("peer")).alias("peer_class"),
    )


def class_means(features: DataFrame) -> DataFrame:
    """Per base row and peer class, the mean correlation and absolute correlation of its peers."""
    return features.groupBy("symbol", "timeframe", "ts", "peer_class").agg(F.avg("correlation").alias("correlation"), F.avg(F.abs("correlation")).alias("abs_correlation"))


def normal_two_sided(z: Column) -> Column:
    """Two-sided p of a standard normal by a rational approximation of the error function (1.5e-7)."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return poly * F.exp(-x * x)
