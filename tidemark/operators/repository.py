"""Scans, filters and changes of stored tables, as DataFrame expressions.

A change returns the new table; `sources.tables` writes it by partition. Ranges include both ends.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import all_finite, div
from ..schema import TIMEFRAMES, seconds_between, seconds_of

Condition = tuple  # (column, operator, value)


def condition(column: str, operator: str, value=None) -> Column:
    """One comparison: = != > >= < <= LIKE IN, NOT IN, BETWEEN, IS NULL, IS NOT NULL."""
    c = F.col(column)
    made = {
        "=": lambda: c == value, "!=": lambda: c != value, ">": lambda: c > value, ">=": lambda: c >= value, "<": lambda: c < value, "<=": lambda: c <= value,
        "LIKE": lambda: c.like(value), "IN": lambda: c.isin(*value), "NOT IN": lambda: ~c.isin(*value), "BETWEEN": lambda: c.between(*value),
        "IS NULL": c.isNull, "IS NOT NULL": c.isNotNull,
    }
    return made[operator]()


def any_of(groups: list[list[Condition]]) -> Column:
    """A disjunction of conjunctions of conditions."""
    return reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [condition(*c) for c in group]) for group in groups])


def in_range(df: DataFrame, symbol: str | None = None, timeframe: str | None = None, start=None, end=None, after=None, status: str | None = None) -> DataFrame:
    """Rows of a series in a time range; `after` leaves out times up to it, so a page starts where the last one ended."""
    out = df
    for column, value in (("symbol", symbol), ("timeframe", timeframe), ("status", status)):
        if value is not None:
            out = out.filter(F.col(column) == value)
    if start is not None:
        out = out.filter(F.col("ts") >= F.lit(start).cast("timestamp"))
    if end is not None:
        out = out.filter(F.col("ts") <= F.lit(end).cast("timestamp"))
    if after is not None:
        out = out.filter(F.col("ts") > F.lit(after).cast("timestamp"))
    return out


def latest(df: DataFrame, n: int = 1, keys=("symbol", "timeframe"), order=("ts",)) -> DataFrame:
    """The n last rows of each series. One row comes by aggregation, several by a window that Spark limits before it shuffles."""
    if n == 1:
        picked = df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias("_row"))
        return picked.select("_row.*")
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]))
    return df.withColumn("_number", number).filter(F.col("_number") <= n).drop("_number")


def latest_of(df: DataFrame, symbols: DataFrame, timeframe: str) -> DataFrame:
    """The last row of each of `symbols` (column symbol); those without rows get nulls."""
    found = latest(df.filter(F.col("timeframe") == timeframe))
    wanted = symbols.select(F.upper("symbol").alias("_wanted")).distinct()
    upper = found.withColumn("_key", F.upper("symbol"))
    return wanted.join(upper, F.col("_wanted") == F.col("_key"), "left").select(F.col("_wanted").alias("wanted"), *found.columns)


def range_bar(df: DataFrame, keys=("symbol", "timeframe")) -> DataFrame:
    """One bar of all rows of each series: first open, highest, lowest, last close, volume (0 if there is none)."""
    return df.groupBy(*keys).agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"),
        F.coalesce(F.sum("volume"), F.lit(0.0)).alias("volume"), F.count(F.lit(1)).alias("bars"),
    )


def coverage(df: DataFrame, keys=("symbol", "timeframe")) -> DataFrame:
    """First and last time and rows of each series, and whether rows are missing on a grid without closing hours."""
    out = df.groupBy(*keys).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("bars"))
    steps = F.floor(seconds_between(F.col("first_ts"), F.col("last_ts")) / seconds_of(F.col("timeframe"))) + 1
    return out.withColumns({"expected": steps.cast("long"), "has_gap": F.col("bars") < steps})


def missing_ranges(df: DataFrame, keys=("symbol", "timeframe")) -> DataFrame:
    """Ranges without bars between neighbours: from the time after one bar up to the next bar, and the bars that fit."""
    before = F.lag("ts").over(Window.partitionBy(*keys).orderBy("ts"))
    step = seconds_of(F.col("timeframe"))
    rows = df.select(*keys, "ts").withColumn("_before", before).withColumn("_delta", seconds_between(F.col("_before"), F.col("ts")))
    start = F.timestamp_add("SECOND", step.cast("int"), F.col("_before"))
    return rows.filter(F.col("_delta") > step).select(*keys, start.alias("gap_start"), F.col("ts").alias("gap_end"), (F.floor(F.col("_delta") / step) - 1).cast("long").alias("missing"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """`old` with the rows of `new` in place of those of equal keys; of equal keys in `new` the last by `order` wins."""
    return old.join(_one_each(new, keys, order, last=True).select(*keys).distinct(), keys, "left_anti").unionByName(_one_each(new, keys, order, last=True))


def insert_new(old: DataFrame, new: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """`old` with the rows of `new` whose keys it does not have; of equal keys in `new` the first by `order` is taken."""
    return old.unionByName(_one_each(new, keys, order, last=False).join(old.select(*keys).distinct(), keys, "left_anti"))


def _one_each(new: DataFrame, keys: list[str], order: list[str] | None, last: bool) -> DataFrame:
    pick = F.max_by if last else F.min_by
    by = F.struct(*(order or [c for c in new.columns if c not in keys]))
    return new.groupBy(*keys).agg(pick(F.struct(*new.columns), by).alias("_row")).select("_row.*")


def update_where(df: DataFrame, where: Column, values: dict[str, Column]) -> DataFrame:
    return df.withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in values.items()})


def delete_where(df: DataFrame, where: Column) -> DataFrame:
    return df.filter(~F.coalesce(where, F.lit(False)))


def delete_keys(df: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(gone.select(*keys).distinct(), keys, "left_anti")


def replace_series(df: DataFrame, new: DataFrame, keys=("symbol", "timeframe")) -> DataFrame:
    """Drops all rows of the series that `new` has, and puts its rows there."""
    return delete_keys(df, new, list(keys)).unionByName(new)


def valid_candle() -> Column:
    """Finite positive prices, high and low around open and close, volume not negative."""
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    return F.coalesce(all_finite(o, h, l, c) & (F.least(o, h, l, c) > 0) & (h >= F.greatest(o, c, l)) & (l <= F.least(o, c)) & (F.coalesce(F.col("volume"), F.lit(0.0)) >= 0), F.lit(False))


def counts_by(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


#: Codes that a table of currencies may have where every two of them are paired.
CURRENCIES = 10_000


def currency_pairs(currencies: DataFrame, majors: list[str]) -> DataFrame:
    """(base, quote): every two different majors, and every coin with every fiat currency; `currencies` has code and kind.

    The result is all pairs, so the table has to be one of currencies: CURRENCIES codes at most, which is checked.
    """
    if currencies.count() > CURRENCIES:
        raise ValueError(f"more than {CURRENCIES} currencies")
    major = currencies.filter(F.col("code").isin(*majors)).select("code")
    fiat, coins = (currencies.filter(F.col("kind") == k).select("code") for k in ("fiat", "crypto"))

    def pairs(a: DataFrame, b: DataFrame) -> DataFrame:
        return a.withColumnRenamed("code", "base").crossJoin(F.broadcast(b.withColumnRenamed("code", "quote"))).filter("base <> quote")

    return pairs(major, major).unionByName(pairs(coins, fiat))


def minor_currencies(currencies: DataFrame, majors: list[str]) -> DataFrame:
    return currencies.filter((F.col("kind") == "fiat") & ~F.col("code").isin(*majors))


def timeframe_ladder(timeframes: DataFrame) -> DataFrame:
    """Each timeframe with the next lower and higher one and how many of it make one of the higher, 0 without one."""
    w = Window.orderBy("sort_order")  # nine rows
    out = timeframes.withColumns({"lower": F.lag("name").over(w), "higher": F.lead("name").over(w), "_higher": F.lead("seconds").over(w)})
    return out.withColumn("per_higher", F.coalesce(F.floor(F.col("_higher") / F.col("seconds")), F.lit(0)).cast("long")).drop("_higher")


def bars_per(lower: str, higher: str) -> int:
    return TIMEFRAMES[higher] // TIMEFRAMES[lower]


def paper_trades(trades: DataFrame, predictions: DataFrame) -> DataFrame:
    """One row: closed trades, their mean, total and worst pnl, and the share of resolved predictions with the right direction."""
    t = trades.filter(F.col("closed")).agg(F.count(F.lit(1)).alias("n_trades"), F.avg("pnl").alias("avg_pnl"), F.sum("pnl").alias("total_pnl"), F.min("pnl").alias("worst_pnl"))
    hit = F.when(F.signum("predicted") == F.signum("actual"), 1.0).otherwise(0.0)
    p = predictions.filter(F.col("resolved")).agg(F.count(F.lit(1)).alias("n_predictions"), F.avg(hit).alias("accuracy"))
    return t.withColumn("_one", F.lit(1)).join(p.withColumn("_one", F.lit(1)), "_one").drop("_one")


def champion(models: DataFrame, model_id: str, symbol: str, timeframe: str) -> DataFrame:
    """Makes one model of a series its champion and demotes the others."""
    mine = (F.col("symbol") == symbol) & (F.col("timeframe") == timeframe)
    return models.withColumn("is_champion", F.when(mine, F.col("model_id") == model_id).otherwise(F.col("is_champion")))


def share(value: Column, total: Column) -> Column:
    return div(value, total, 0.0)
