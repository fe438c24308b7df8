"""Candlestick patterns, as flags on candles and as a long table of detections."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import windows as W
from ..functions.scalars import div
from .price import flag


def _ohlc():
    return tuple(F.col(x) for x in ("open", "high", "low", "close"))


def pattern_flags(candles: DataFrame, fractal: int = 2) -> DataFrame:
    """engulfing (1 up, -1 down), pin bars, inside and outside bars, and fractals confirmed `fractal` bars later.

    Comparisons of engulfing, inside and outside bars include equality. A pin bar is null in a bar without range.
    """
    o, h, l, c = _ohlc()
    po, pc, ph, pl = (W.lag(x) for x in ("open", "close", "high", "low"))
    up = (c > o) & (pc < po) & (o <= pc) & (c >= po)
    down = (c < o) & (pc > po) & (o >= pc) & (c <= po)
    size, body = h - l, F.abs(c - o)
    upper, lower = h - F.greatest(o, c), F.least(o, c) - l
    small = div(body, size) <= 0.35
    bull = small & (lower >= 2 * F.greatest(body, F.lit(1e-12))) & (lower > upper) & (div(c - l, size) >= 0.55)
    bear = small & (upper >= 2 * F.greatest(body, F.lit(1e-12))) & (upper > lower) & (div(c - l, size) <= 0.45)
    span = 2 * fractal + 1
    w = W.last(span)
    centre_high, centre_low = W.lag("high", fractal), W.lag("low", fractal)

    def alone(column: str, centre: Column) -> Column:
        held = F.collect_list(column).over(w)
        return F.size(F.filter(held, lambda x: x == centre)) == 1

    enough = F.count("high").over(w) == span
    return candles.withColumns(
        {
            "pattern_engulfing": F.when(F.coalesce(up, F.lit(False)), 1.0).when(F.coalesce(down, F.lit(False)), -1.0).otherwise(0.0),
            "pattern_pin_bull": F.when(size != 0, flag(bull)), "pattern_pin_bear": F.when(size != 0, flag(bear)),
            "pattern_inside": flag((h <= ph) & (l >= pl)), "pattern_outside": flag((h >= ph) & (l <= pl)),
            "pattern_fractal_high": flag(enough & (centre_high == F.max("high").over(w)) & alone("high", centre_high)),
            "pattern_fractal_low": flag(enough & (centre_low == F.min("low").over(w)) & alone("low", centre_low)),
        }
    )


Detector = Callable[[DataFrame], DataFrame]
#: Where a pattern is, its direction and its confidence, as columns over the helper columns of `prepared`.
Shape = Callable[[], tuple[Column, Column, Column]]


class Patterns:
    """Named detectors, of two kinds: shapes, which are looked for on one row of `prepared`, and functions of all its rows."""

    def __init__(self):
        self.shapes: dict[str, Shape] = {}
        self.detectors: dict[str, Detector] = {}

    def shape(self, name: str):
        def add(f: Shape) -> Shape:
            self.shapes[name] = f
            return f

        return add

    def register(self, name: str):
        """Adds a function that takes the rows of `prepared` and returns those with the pattern, with direction and confidence."""

        def add(f: Detector) -> Detector:
            self.detectors[name] = f
            return f

        return add

    def detect(self, candles: DataFrame, names: list[str] | None = None, least: float = 0.5, latest: bool = False) -> DataFrame:
        """(symbol, timeframe, ts, pattern, direction, confidence) of the patterns found with a confidence of `least` or more.

        All shapes are looked for in one pass: each candle has an array of what was found, which is exploded. A
        registered function adds a pass of its own. With `latest`, only those on the last candle of each series.
        """
        rows = prepared(candles)
        if latest:
            rows = rows.filter(F.col("_from_end") == 1)
        chosen = names or sorted(self.shapes | self.detectors)
        parts = []
        shapes = [n for n in chosen if n in self.shapes]
        if shapes:
            found = F.array_compact(F.array(*[_found(n, *self.shapes[n]()) for n in shapes]))
            parts.append(rows.select("symbol", "timeframe", "ts", F.explode(found).alias("_f")).select("symbol", "timeframe", "ts", "_f.*"))
        parts += [self.detectors[n](rows).select("symbol", "timeframe", "ts", F.lit(n).alias("pattern"), "direction", "confidence") for n in chosen if n not in self.shapes]
        return reduce(DataFrame.unionByName, parts).filter(F.col("confidence") >= least)


def _found(name: str, where: Column, direction: Column, confidence: Column) -> Column:
    return F.when(where, F.struct(F.lit(name).alias("pattern"), direction.alias("direction"), confidence.cast("double").alias("confidence")))


def prepared(candles: DataFrame) -> DataFrame:
    """Candles with body, wicks and ranges as shares, two bars before, the move and slope of the last five, and their row numbers."""
    o, h, l, c = _ohlc()
    w, number = W.series(), F.row_number().over(W.series())
    rows = candles.withColumns(
        {
            "_i": number - 1, "_from_end": F.row_number().over(Window.partitionBy(*W.SERIES).orderBy(F.desc("ts"))),
            "_size": h - l, "_body": F.abs(c - o), "_upper": h - F.greatest(o, c), "_lower": F.least(o, c) - l,
            **{f"_{x[0]}{k}": F.lag(x, k).over(w) for x in ("open", "high", "low", "close") for k in (1, 2)},
        }
    )
    # The move over the five bars before this one, and slopes over this and the four before, and the four bars before it.
    five, four = w.rowsBetween(-5, -1), w.rowsBetween(-4, -1)
    first, final = F.first("close").over(five), F.last("close").over(five)
    return rows.withColumns(
        {
            "_move": F.when(F.col("_i") >= 5, div(final - first, first, 0.0)),
            "_slope": F.when(F.col("_i") >= 4, F.regr_slope("close", "_i").over(w.rowsBetween(-4, 0))),
            "_slope4": F.when(F.col("_i") >= 4, F.regr_slope("close", "_i").over(four)),
        }
    )


patterns = Patterns()


def _share(x: str) -> Column:
    """A part of the candle as a share of its range; null without a range."""
    return F.col(x) / F.when(F.col("_size") > 0, F.col("_size"))


def _trend_side() -> Column:
    return F.when(F.col("close") > F.col("open"), "bullish").when(F.col("close") < F.col("open"), "bearish").otherwise("neutral")


# Fixed values in the shapes below: limits of shares and slopes, and confidences.


@patterns.shape("doji")
def doji():
    first, rose = F.col("_i") == 0, F.col("close") > F.col("_c1")
    return _share("_body") < 0.1, F.when(first, "neutral").when(rose, "bullish").otherwise("bearish"), F.when(first, 0.5).when(rose, 0.65).otherwise(0.55)


@patterns.shape("hammer")
def hammer():
    where = (_share("_body") < 0.3) & (_share("_lower") > 0.6) & (_share("_upper") < 0.1)
    return where, F.lit("bullish"), F.when(F.col("_i") < 5, 0.6).when(F.col("_move") < -0.005, 0.75).otherwise(0.55)


@patterns.shape("shooting_star")
def shooting_star():
    where = (_share("_body") < 0.3) & (_share("_upper") > 0.6) & (_share("_lower") < 0.1)
    return where, F.lit("bearish"), F.when(F.col("_i") < 5, 0.6).when(F.col("_move") > 0.005, 0.75).otherwise(0.55)


@patterns.shape("marubozu")
def marubozu():
    return (_share("_body") > 0.8) & (_share("_upper") < 0.05) & (_share("_lower") < 0.05), _trend_side(), F.lit(0.8)


@patterns.shape("spinning_top")
def spinning_top():
    return (_share("_body") > 0.3) & (_share("_body") < 0.6), F.lit("neutral"), F.lit(0.5)


@patterns.shape("engulfing")
def engulfing():
    """Strict inequalities, unlike the flag of the same name."""
    o, c, po, pc = F.col("open"), F.col("close"), F.col("_o1"), F.col("_c1")
    up = (pc < po) & (c > o) & (o < pc) & (c > po)
    down = (pc > po) & (c < o) & (o > pc) & (c < po)
    return up | down, F.when(up, "bullish").otherwise("bearish"), F.when(F.abs(c - o) > 1.5 * F.abs(pc - po), 0.85).otherwise(0.7)


@patterns.shape("harami")
def harami():
    o, c, po, pc = F.col("open"), F.col("close"), F.col("_o1"), F.col("_c1")
    inside = (F.greatest(o, c) < F.greatest(po, pc)) & (F.least(o, c) > F.least(po, pc))
    up, down = inside & (pc < po) & (c > o), inside & (pc > po) & (c < o)
    return up | down, F.when(up, "bullish").otherwise("bearish"), F.lit(0.65)


def _three(sign: int) -> Column:
    def bodied(o: str, h: str, l: str, c: str) -> Column:
        body = (F.col(c) - F.col(o)) * sign
        return (body > 0) & (F.col(h) > F.col(l)) & (body > 0.5 * (F.col(h) - F.col(l)))

    c0, c1, c2 = F.col("close") * sign, F.col("_c1") * sign, F.col("_c2") * sign
    return bodied("open", "high", "low", "close") & bodied("_o1", "_h1", "_l1", "_c1") & bodied("_o2", "_h2", "_l2", "_c2") & (c0 > c1) & (c1 > c2)


@patterns.shape("three_white_soldiers")
def three_white_soldiers():
    return _three(1), F.lit("bullish"), F.lit(0.8)


@patterns.shape("three_black_crows")
def three_black_crows():
    return _three(-1), F.lit("bearish"), F.lit(0.8)


@patterns.shape("trend")
def trend():
    """A slope of more than 0.5 price units a bar over five bars; a continuation if 1.5 times that of the four bars before."""
    slope, before = F.col("_slope"), F.col("_slope4") * 1.5
    faster = F.when(slope > 0, slope > before).otherwise(slope < before)
    direction = F.when(faster, "continuation").when(slope > 0, "bullish").otherwise("bearish")
    return F.abs(slope) > 0.5, direction, F.when(faster, 0.7).otherwise(0.6)


def summary(found: DataFrame) -> DataFrame:
    """Per pattern and direction: how many, and their mean confidence."""
    return found.groupBy("pattern", "direction").agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("confidence"))


def strongest(found: DataFrame, n: int) -> DataFrame:
    """The n detections with the largest confidence; ties by series, time and pattern."""
    return found.orderBy(F.desc("confidence"), "symbol", "timeframe", "ts", "pattern").limit(n)
