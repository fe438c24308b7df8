"""Data quality: rules on rows, counts by series, gaps, and reports with pass or fail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import windows as W
from ..functions.scalars import div
from ..schema import seconds_between, seconds_of

#: Limits of the rules.
LEAST_PRICE, MOST_PRICE, WIDE, SPIKE, FLAT = 1e-4, 1e12, 0.05, 10.0, 5e-4
#: Gaps count from so many steps; those over a weekend do not, up to so many seconds; days and longer tolerate so many steps.
GAP_STEPS, WEEKEND_SECONDS, LONG_STEPS = 1.5, 3.5 * 86_400, 5
LEVELS = ("basic", "standard", "strict", "comprehensive")


def _any(*conditions: Column) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | F.coalesce(c, F.lit(False))
    return out


def issues(candles: DataFrame, level: str = "strict") -> DataFrame:
    """`candles` with `issues`, the sorted names of the rules that a row breaks.

    basic: missing fields. standard: also values that are not finite or out of range. strict: also the
    logic of open, high, low and close, volume and times. comprehensive: also extreme values and flat stretches.
    """
    prices = [F.col(c) for c in ("open", "high", "low", "close")]
    o, h, l, c = prices
    v = F.col("volume")
    rules: dict[str, Column] = {"missing_price": _any(*[p.isNull() for p in prices]), "missing_time": F.col("ts").isNull()}
    depth = LEVELS.index(level)
    if depth >= 1:
        rules |= {"not_finite": _any(*[F.isnan(p) | (F.abs(p) == float("inf")) for p in prices]), "out_of_range": _any(*[(p < LEAST_PRICE) | (p > MOST_PRICE) for p in prices]), "missing_volume": v.isNull()}
    df = candles
    if depth >= 2:
        whole = Window.partitionBy(*W.SERIES)
        df = df.withColumns({"_gap": seconds_between(W.lag("ts"), F.col("ts")), "_median": F.percentile("volume", 0.5).over(whole), "_rows": F.count(F.lit(1)).over(whole)})
        df = df.withColumns({"_mean_gap": F.avg(F.when(F.col("_gap") > 0, F.col("_gap"))).over(whole), "_same": F.count(F.lit(1)).over(Window.partitionBy(*W.SERIES, "ts"))})
        rules |= {
            "high_below_low": h < l, "high_below_body": h < F.greatest(o, c), "low_above_body": l > F.least(o, c), "zero_range": h == l, "wide_range": div(h - l, c) > WIDE,
            "negative_volume": v < 0, "zero_volume": v == 0, "volume_spike": (F.col("_rows") >= 10) & (v > SPIKE * F.col("_median")),
            "duplicate_time": F.col("_same") > 1, "long_gap": (F.col("_gap") > 3 * F.col("_mean_gap")) & (F.col("_gap") > 10),
        }
    if depth >= 3:
        whole = Window.partitionBy(*W.SERIES)
        df = df.withColumn("_z", div(c - F.avg("close").over(whole), F.stddev_samp("close").over(whole), 0.0))
        same_bar = (o == W.lag("open")) & (h == W.lag("high")) & (l == W.lag("low")) & (c == W.lag("close"))
        df = df.withColumns({"_repeat": same_bar, "_span": div(W.highest("high", 10) - W.lowest("low", 10), c)})
        rules |= {"extreme_close": F.abs("_z") > 3, "repeated_bar": F.col("_repeat"), "flat_price": F.col("_span") < FLAT}
    broken = F.array_compact(F.array(*[F.when(F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in sorted(rules.items())]))
    return df.withColumn("issues", broken).select(*candles.columns, "issues")


def issue_counts(checked: DataFrame) -> DataFrame:
    return checked.select("symbol", "timeframe", F.explode("issues").alias("issue")).groupBy("symbol", "timeframe", "issue").agg(F.count(F.lit(1)).alias("n"))


def field_statistics(df: DataFrame, fields: list[str]) -> DataFrame:
    """Per field: rows with a value, smallest, largest, mean and sample deviation."""
    long = df.unpivot([], fields, "field", "value")
    return long.groupBy("field").agg(F.count("value").alias("n"), F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))


def gaps(candles: DataFrame, around_the_clock: Column | None = None) -> DataFrame:
    """Gaps of each series: start, end and bars missing.

    A gap is more than GAP_STEPS steps; from Friday to Monday it does not count up to WEEKEND_SECONDS, unless the
    market never closes; series of a day and longer tolerate LONG_STEPS steps.
    """
    step = seconds_of(F.col("timeframe"))
    rows = candles.select(*W.SERIES, "ts").withColumn("_from", W.lag("ts")).withColumn("_delta", seconds_between(F.col("_from"), F.col("ts")))
    weekend = (F.weekday("_from") >= 4) & ((F.weekday("ts") == 0) | (F.weekday("ts") == 6)) & (F.col("_delta") <= WEEKEND_SECONDS)
    if around_the_clock is not None:
        weekend = weekend & ~around_the_clock
    slow = (step >= 86_400) & (F.col("_delta") <= LONG_STEPS * step)
    found = rows.filter((F.col("_delta") > GAP_STEPS * step) & ~weekend & ~slow)
    return found.select(*W.SERIES, F.col("_from").alias("gap_start"), F.col("ts").alias("gap_end"), (F.floor(F.col("_delta") / step) - 1).cast("long").alias("missing"))


def duplicates(candles: DataFrame) -> DataFrame:
    """Per series, the rows beyond the first of each time."""
    each = candles.groupBy(*W.SERIES, "ts").agg(F.count(F.lit(1)).alias("_n"))
    return each.groupBy(*W.SERIES).agg(F.sum(F.col("_n") - 1).alias("duplicates"))


def series_report(candles: DataFrame, least_bars: int = 100, most_gaps: int = 0) -> DataFrame:
    """Per series: bars, first and last time, rule violations, duplicates, gaps, whether spreads are known, and status PASS or FAIL."""
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    invalid = _any(h < l, h < F.greatest(o, c), l > F.least(o, c), o.isNull(), h.isNull(), l.isNull(), c.isNull())
    corrupted = _any(*[(p <= 0) | F.isnan(p) for p in (o, h, l, c)])
    spread = F.count("spread") > 0 if "spread" in candles.columns else F.lit(False)
    base = candles.groupBy(*W.SERIES).agg(F.count(F.lit(1)).alias("bars"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count_if(invalid).alias("invalid"), F.count_if(corrupted).alias("corrupted"), spread.alias("has_spread"))
    gap_counts = gaps(candles).groupBy(*W.SERIES).agg(F.count(F.lit(1)).alias("gaps"), F.sum("missing").alias("missing"))
    out = base.join(duplicates(candles), list(W.SERIES), "left").join(gap_counts, list(W.SERIES), "left").fillna(0, subset=["duplicates", "gaps", "missing"])
    good = (F.col("bars") >= least_bars) & (F.col("duplicates") == 0) & (F.col("invalid") == 0) & (F.col("corrupted") == 0) & (F.col("gaps") <= most_gaps)
    return out.withColumn("status", F.when(good, "PASS").otherwise("FAIL"))


def passed(report: DataFrame) -> DataFrame:
    return report.filter(F.col("status") == "PASS").select(*W.SERIES)


def repairable(gap_rows: DataFrame, source: DataFrame) -> DataFrame:
    """Rows of `source` (candles) that lie strictly inside a gap.

    Each row finds the next gap's end of its series by a window over both, so no pairs of ranges and rows are made.
    """
    events = source.withColumn("_bar", F.struct(*source.columns)).select(*W.SERIES, F.col("ts").alias("_at"), "_bar", F.lit(None).cast("timestamp").alias("_start"), F.lit(None).cast("timestamp").alias("_end"))
    bounds = gap_rows.select(*W.SERIES, F.col("gap_end").alias("_at"), F.lit(None).cast(events.schema["_bar"].dataType).alias("_bar"), F.col("gap_start").cast("timestamp").alias("_start"), F.col("gap_end").cast("timestamp").alias("_end"))
    w = Window.partitionBy(*W.SERIES).orderBy("_at").rowsBetween(0, Window.unboundedFollowing)
    both = events.unionByName(bounds).withColumn("_next", F.first(F.when(F.col("_end").isNotNull(), F.struct("_start", "_end")), ignorenulls=True).over(w))
    inside = F.col("_bar").isNotNull() & (F.col("_at") > F.col("_next._start")) & (F.col("_at") < F.col("_next._end"))
    return both.filter(inside).select("_bar.*")


def assert_finite(df: DataFrame, columns: list[str]) -> DataFrame:
    """`df` as it is; reading it fails where one of the columns holds null, NaN or an infinity."""
    fine = [F.coalesce(~F.isnan(c) & (F.abs(F.col(c)) != float("inf")), F.lit(False)) for c in columns]
    return df.withColumns({c: F.when(ok, F.col(c)).otherwise(F.raise_error(F.lit(f"{c} is not finite")).cast("double")) for c, ok in zip(columns, fine, strict=True)})
