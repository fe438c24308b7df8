"""Metrics of predictions and trades. Each takes rows and returns one row, or one for each of `by`."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordered import counted, quantiles_of, running_totals, scanned, with_group
from ..functions.scalars import clip, div

INF = float("inf")


def _grouped(df: DataFrame, by):
    return df.groupBy(*by) if by else df.groupBy()


def regression(df: DataFrame, actual: str = "y", predicted: str = "p", by=(), epsilon: float = 1e-12) -> DataFrame:
    """n, rmse, mae, mse, mape (percent, small targets floored), mape_nonzero (zero targets skipped) and r2 (0 for a constant target)."""
    y, p = F.col(actual).cast("double"), F.col(predicted).cast("double")
    e = y - p
    total = F.var_pop(y) * F.count(e)
    return _grouped(df.filter(y.isNotNull() & p.isNotNull()), by).agg(
        F.count(e).alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"),
        (100 * F.avg(F.abs(e) / F.greatest(F.abs(y), F.lit(epsilon)))).alias("mape"), (100 * F.avg(F.when(y != 0, F.abs(e / y)))).alias("mape_nonzero"),
        (1 - div(F.sum(e * e), total, 1.0)).alias("r2"),
    )


def confusion(df: DataFrame, actual: str = "y", predicted: str = "p", by=()) -> DataFrame:
    """tp, fp, tn, fn and accuracy, precision, recall, f1, specificity and fpr of labels 0 and 1; 0 where undefined."""
    y, p = F.col(actual) == 1, F.col(predicted) == 1
    counted = _grouped(df.filter(F.col(actual).isNotNull() & F.col(predicted).isNotNull()), by).agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(~y & ~p).alias("tn"), F.count_if(y & ~p).alias("fn"))
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    precision, recall = div(tp, tp + fp, 0.0), div(tp, tp + fn, 0.0)
    return counted.withColumns(
        {
            "accuracy": div(tp + tn, tp + fp + tn + fn, 0.0), "precision": precision, "recall": recall, "f1": div(2 * precision * recall, precision + recall, 0.0),
            "specificity": div(tn, tn + fp, 0.0), "fpr": div(fp, fp + tn, 0.0),
        }
    )


def confusion_table(df: DataFrame, actual: str = "y", predicted: str = "p") -> DataFrame:
    """(actual, predicted, n) in long form."""
    return df.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def per_class(df: DataFrame, actual: str = "y", predicted: str = "p") -> DataFrame:
    """Per class: support, precision, recall and f1, from the table of counts, which is small."""
    table = confusion_table(df, actual, predicted)
    sides = table.select(F.col("actual").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("named"), F.when(F.col("actual").eqNullSafe(F.col("predicted")), F.col("n")).otherwise(0).alias("hit")).unionByName(
        table.select(F.col("predicted").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("named"), F.lit(0).cast("long").alias("hit"))
    )
    out = sides.groupBy("label").agg(F.sum("support").alias("support"), F.sum("named").alias("named"), F.sum("hit").alias("hit"))
    precision, recall = div(F.col("hit"), F.col("named"), 0.0), div(F.col("hit"), F.col("support"), 0.0)
    return out.select("label", "support", precision.alias("precision"), recall.alias("recall"), div(2 * precision * recall, precision + recall, 0.0).alias("f1"))


def averaged(classes: DataFrame) -> DataFrame:
    """Macro and weighted means of `per_class`."""
    total = F.sum("support")
    return classes.agg(*[F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")], *[div(F.sum(F.col(c) * F.col("support")), total, 0.0).alias(f"weighted_{c}") for c in ("precision", "recall", "f1")])


def _by_score(df: DataFrame, actual: str, score: str, by) -> DataFrame:
    """Rows with each score of each group, positive and all: equal scores are one row before anything is ordered."""
    known = df.filter(F.col(actual).isNotNull() & F.col(score).isNotNull())
    return known.groupBy(*by, F.col(score).alias("_s")).agg(F.sum((F.col(actual) == 1).cast("long")).alias("_pos"), F.count(F.lit(1)).alias("_all"))


def roc_auc(df: DataFrame, actual: str = "y", score: str = "s", by=()) -> DataFrame:
    """Area under the ROC curve by rank sums, tied scores sharing their mean rank; null with one class only."""
    scores = _by_score(df, actual, score, by)
    summed = running_totals(scores, [F.col("_s").asc()], {"_upto": F.col("_all")}, tuple(by))
    ranked = summed.withColumn("_rank", F.col("_upto") - (F.col("_all") - 1) / 2)
    out = _grouped(ranked, by).agg(F.sum("_pos").alias("positives"), F.sum(F.col("_all") - F.col("_pos")).alias("negatives"), F.sum(F.col("_pos") * F.col("_rank")).alias("_ranks"))
    p, n = F.col("positives"), F.col("negatives")
    return out.withColumn("auc", div(F.col("_ranks") - p * (p + 1) / 2, p * n)).drop("_ranks")


def average_precision(df: DataFrame, actual: str = "y", score: str = "s", by=(), tie: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Mean precision at each positive by falling score; equal scores go by `tie`, so the result is the same each time."""
    known = df.filter(F.col(actual).isNotNull() & F.col(score).isNotNull()).withColumn("_hit", (F.col(actual) == 1).cast("long"))
    order = [F.col(score).desc(), *[F.col(t).asc() for t in tie]]
    ranked = running_totals(known, order, {"_hits": F.col("_hit"), "_rows": F.lit(1).cast("long")}, tuple(by)).withColumn("_precision", F.col("_hits") / F.col("_rows"))
    return _grouped(ranked, by).agg(F.sum("_hit").alias("positives"), div(F.sum(F.col("_hit") * F.col("_precision")), F.sum("_hit"), 0.0).alias("average_precision"))


def log_loss(df: DataFrame, actual: str = "y", probability: str = "s", by=(), epsilon: float = 1e-15) -> DataFrame:
    p = clip(F.col(probability), epsilon, 1 - epsilon)
    return _grouped(df, by).agg(F.count(probability).alias("n"), F.avg(-F.when(F.col(actual) == 1, F.ln(p)).otherwise(F.ln(1 - p))).alias("log_loss"))


def calibration(df: DataFrame, actual: str = "y", probability: str = "s", bins: int = 10) -> DataFrame:
    """Equal-width bins of the probability: rows, mean probability and share of positives; an empty bin has its middle and 0."""
    found = df.filter(F.col(probability).isNotNull()).groupBy(F.least(F.lit(bins - 1), F.floor(F.col(probability) * bins)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(probability).alias("mean_probability"), F.avg((F.col(actual) == 1).cast("double")).alias("positive_share"))
    grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return grid.join(found, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("mean_probability", (F.col("bin") + 0.5) / bins).alias("mean_probability"), F.coalesce("positive_share", F.lit(0.0)).alias("positive_share"))


def calibration_error(bins: DataFrame) -> DataFrame:
    """Mean absolute gap of the bins that have rows, and the gap weighted by rows."""
    gap = F.abs(F.col("mean_probability") - F.col("positive_share"))
    return bins.filter("n > 0").agg(F.avg(gap).alias("mean_gap"), div(F.sum(gap * F.col("n")), F.sum("n"), 0.0).alias("weighted_gap"))


def trades(df: DataFrame, result: str = "r", by=(), periods: int = 252) -> DataFrame:
    """Wins and losses (0 is a loss), profit factor (infinite without loss; null as profit_factor_or_zero does 0), expectancy, Sharpe and Sortino by year."""
    r = F.col(result)
    gain, loss = F.coalesce(F.sum(F.when(r > 0, r)), F.lit(0.0)), F.abs(F.coalesce(F.sum(F.when(r < 0, r)), F.lit(0.0)))
    down = F.stddev_samp(F.when(r < 0, r))
    year = math.sqrt(periods)
    return _grouped(df.filter(r.isNotNull()), by).agg(
        F.count(r).alias("n"), F.count_if(r > 0).alias("wins"), F.count_if(r <= 0).alias("losses"), gain.alias("gross_profit"), loss.alias("gross_loss"), F.sum(r).alias("net"),
        F.when(loss > 0, gain / loss).when(gain > 0, INF).otherwise(0.0).alias("profit_factor"), div(gain, loss, 0.0).alias("profit_factor_or_zero"),
        F.avg(r).alias("expectancy"), F.avg((r > 0).cast("double")).alias("win_rate"), F.coalesce(F.avg(F.when(r > 0, r)), F.lit(0.0)).alias("avg_win"), F.coalesce(F.avg(F.when(r < 0, r)), F.lit(0.0)).alias("avg_loss"),
        div(F.avg(F.when(r > 0, r)), F.abs(F.avg(F.when(r < 0, r)))).alias("risk_reward"), F.max(r).alias("best"), F.min(r).alias("worst"),
        (div(F.avg(r), F.stddev_samp(r), 0.0) * year).alias("sharpe"), (div(F.avg(r), down, 0.0) * year).alias("sortino"),
    )


def risk(df: DataFrame, result: str = "r", by=()) -> DataFrame:
    """Value at risk at 95 and 99 percent (interpolated) and the mean result at or beyond it, and mean over deviation without a year."""
    rows, keys = (df, tuple(by)) if by else (df.withColumn("_one", F.lit(1)), ("_one",))
    moments = rows.groupBy(*keys).agg(F.avg(result).alias("mean"), F.stddev_samp(result).alias("std"))
    levels = with_group(moments, quantiles_of(counted(rows, result, keys), [0.05, 0.01], keys, tails=True), keys)  # a row for each group on both sides
    told = levels.select(*by, *[F.get(c, F.lit(k)).alias(f"{n}_{p}") for n, c in (("var", "q"), ("cvar", "tail")) for k, p in enumerate((95, 99))], div(F.col("mean"), F.col("std"), 0.0).alias("sharpe_plain"))
    return told if by else told.agg(*[F.first(c).alias(c) for c in told.columns])  # a row even of no rows


def equity(df: DataFrame, result: str = "r", by=(), order=("ts",), start: float = 1.0, compounded: bool = False) -> DataFrame:
    """`df` with equity after each row, its peak so far and the drawdown from it as a negative share; scanned by ranges of the order. A compounded curve starts above 0."""
    r = F.coalesce(F.col(result).cast("double"), F.lit(0.0))
    step = F.ln(F.greatest(1 + r, F.lit(1e-12))) if compounded else r
    out = scanned(df.drop("equity", "peak"), [F.col(c).asc() for c in order], {"equity": ("sum", step), "peak": ("peak", step)}, tuple(by))

    def curve(c: str) -> Column:
        return start * F.exp(c) if compounded else start + F.col(c)

    out = out.withColumns({"equity": curve("equity"), "peak": F.greatest(curve("peak"), F.lit(start))})
    return out.withColumn("drawdown", div(F.col("equity") - F.col("peak"), F.col("peak"), 0.0))


def drawdown(curve: DataFrame, by=(), order: str = "ts") -> DataFrame:
    """Of an equity curve: the deepest drawdown and when it was, the last equity, and the largest peak less the lowest equity."""
    return _grouped(curve, by).agg(
        F.min("drawdown").alias("max_drawdown"), F.min_by(order, F.struct("drawdown", order)).alias("trough_at"), F.max_by("equity", order).alias("final_equity"), (F.max("peak") - F.min("equity")).alias("global_drawdown"),
    )


def streaks(df: DataFrame, result: str = "r", by=(), order=("ts",)) -> DataFrame:
    """The longest runs of wins and of losses, by islands: rows of a run have as many rows of another kind before them. Unknown results end a run."""
    rows = df.select(*by, *order, (F.col(result) > 0).alias("_win"))
    same = {"_all": F.lit(1), "_wins": F.when(F.col("_win"), 1).otherwise(0), "_losses": F.when(~F.col("_win"), 1).otherwise(0)}
    rows = scanned(rows, [F.col(c).asc() for c in order], {n: ("sum", c) for n, c in same.items()}, tuple(by))
    runs = rows.groupBy(*by, "_win", (F.col("_all") - F.when(F.col("_win"), F.col("_wins")).otherwise(F.col("_losses"))).alias("_island")).agg(F.count(F.lit(1)).alias("_n"))
    return _grouped(runs, by).agg(F.coalesce(F.max(F.when(F.col("_win"), F.col("_n"))), F.lit(0)).alias("max_wins"), F.coalesce(F.max(F.when(~F.col("_win"), F.col("_n"))), F.lit(0)).alias("max_losses"))


def total_return(result: str = "r") -> Column:
    """Aggregate: the product of 1 + r, less 1."""
    return F.exp(F.sum(F.ln(F.greatest(1 + F.col(result), F.lit(1e-12))))) - 1


def normalized_importance(df: DataFrame, value: str = "value", by=()) -> DataFrame:
    """`share`: absolute value over the sum of absolute values."""
    return df.withColumn("share", div(F.abs(F.col(value)), F.sum(F.abs(F.col(value))).over(Window.partitionBy(*by)), 0.0))


def mean_importance(maps: DataFrame, column: str = "importance") -> DataFrame:
    """Per feature, the mean over maps of feature to importance."""
    return maps.select(F.explode(column).alias("feature", "value")).groupBy("feature").agg(F.avg("value").alias("importance"), F.count(F.lit(1)).alias("n"))


def compare(a: DataFrame, b: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Differences b - a of the metrics, whose b is better, and exp(-2 * relative difference) as a rough p-value."""
    both = a.select(*keys, *[F.col(m).alias(f"{m}_a") for m in metrics]).join(b.select(*keys, *[F.col(m).alias(f"{m}_b") for m in metrics]), keys)
    new = {}
    for m in metrics:
        delta = F.col(f"{m}_b") - F.col(f"{m}_a")
        relative = div(F.abs(delta), F.greatest(F.abs(F.col(f"{m}_a")), F.abs(F.col(f"{m}_b"))), 0.0)
        new |= {f"{m}_delta": delta, f"{m}_better": delta > 0, f"{m}_p": F.exp(-2 * relative)}
    return both.withColumns(new)


def composite_score(weights: dict[str, tuple[Column, float]]) -> Column:
    """Weighted mean of parts within [0, 1]."""
    total = sum(w for _, w in weights.values())
    return sum((clip(c, 0.0, 1.0) * w for c, w in weights.values()), F.lit(0.0)) / total


def report(df: DataFrame, result: str, dimensions: dict[str, Column]) -> DataFrame:
    """(dimension, value, trades, wins, total, expectancy, win_rate, profit_factor, best, worst): all trades, and those of each value of each dimension.

    One aggregation by grouping sets: trades are read once, and partial sums of all dimensions are shuffled together.
    `dimension` is `all` for the row of everything. Values are text; a null value is a group of its own.
    """
    x = F.col(result)
    rows = df.select(x.alias("_r"), *[c.cast("string").alias(n) for n, c in dimensions.items()])
    r, names = F.col("_r"), list(dimensions)
    sets = rows.groupingSets([[F.col(n)] for n in names] + [[]], *names)
    gains, losses = F.sum(F.when(r > 0, r)), F.sum(F.when(r < 0, r))
    out = sets.agg(
        F.grouping_id(*names).alias("_g"), F.count("_r").alias("trades"), F.count_if(r > 0).alias("wins"), F.sum("_r").alias("total"), F.avg("_r").alias("expectancy"),
        F.avg((r > 0).cast("int")).alias("win_rate"), (gains / -losses).alias("profit_factor"), F.max("_r").alias("best"), F.min("_r").alias("worst"),
    )
    full = (1 << len(names)) - 1
    dimension, value = F.lit("all"), F.lit(None).cast("string")
    for k, n in enumerate(names):
        own = F.col("_g") == full - (1 << (len(names) - 1 - k))
        dimension, value = F.when(own, n).otherwise(dimension), F.when(own, F.col(n)).otherwise(value)
    return out.select(dimension.alias("dimension"), value.alias("value"), *[c for c in out.columns if c not in ("_g", *names)])
