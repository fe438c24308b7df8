"""Recursive indicators: each value depends on the one before, so no window can express them.

Smoothings and what is made of them (averages, RSI, MACD, ADX, ATR, Keltner) run on time chunks, many for each
series, as in recurrence. SuperTrend, bars by volume and positions held one at a time depend on their last state in a way that does not
compose: there a series is dealt to one partition, sorted, and streamed through a state machine batch by batch,
so a task holds one Arrow batch and a few numbers however long the series is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import windows as W
from ..functions.scalars import div
from .recurrence import Average, smoothed

Machine = Callable[..., tuple[np.ndarray, ...]]


def scan(df: DataFrame, inputs: dict[str, Column], outputs: list[str], machine: Callable[[], Machine], keys=W.SERIES, order=("ts",)) -> DataFrame:
    """`df` with double columns `outputs`, which a fresh machine for each series makes from the arrays of `inputs` in order.

    Nulls go in as NaN and NaN comes out as null. Keys that are null form a series of their own.
    """
    names = [f"_in{k}" for k in range(len(inputs))]
    helped = df.withColumns({n: c.cast("double") for n, c in zip(names, inputs.values(), strict=True)})
    sorted_rows = helped.repartition(*keys).sortWithinPartitions(*keys, *order)
    schema = T.StructType([*df.schema.fields, *[T.StructField(c, T.DoubleType()) for c in outputs]])
    columns = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, step = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
            cuts = [0, *[i for i in range(1, len(ids)) if ids[i] != ids[i - 1]], len(ids)]
            values = [np.asarray(batch.column(n).to_numpy(zero_copy_only=False), float) for n in names]
            made: list[list[np.ndarray]] = [[] for _ in outputs]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if step is None or ids[a] != now:
                    now, step = ids[a], machine()
                for kept, new in zip(made, step(*[v[a:b] for v in values]), strict=True):
                    kept.append(new)
            new = [np.concatenate(m) for m in made]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], *[pa.array(x, mask=np.isnan(x)) for x in new]], [*columns, *outputs])

    return sorted_rows.mapInArrow(run, schema)


def length(keys=W.SERIES) -> Column:
    """Rows of the series: a short one is seeded at its last row."""
    return F.count(F.lit(1)).over(Window.partitionBy(*keys))


def _ema(period: int, rows: float = np.inf) -> Callable[[], Average]:
    return lambda: Average(period, 2 / (period + 1), rows)


def _wilder(period: int) -> Callable[[], Average]:
    return lambda: Average(period, 1 / period)


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(b == 0, np.nan, a / b)


def _true_range(lag: Callable[[str], Column]) -> Column:
    before = F.coalesce(lag("close"), F.col("close"))
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def ema(df: DataFrame, value: str, period: int, name: str | None = None, keys=W.SERIES, order=("ts",), width: float | None = None) -> DataFrame:
    """Exponential average with weight 2 / (period + 1), seeded by the mean of the first `period` rows."""

    def program(x, rows, first):
        (y,) = yield [(_ema(period, rows), x)]
        return (y,)

    return smoothed(df, lambda lag: {"x": F.col(value)}, [name or f"ema_{period}"], program, 1, keys, order, width)


def wilder(df: DataFrame, value: str, period: int, name: str | None = None, width: float | None = None) -> DataFrame:
    """Wilder's average: (last * (period - 1) + x) / period, seeded by a mean."""

    def program(x, rows, first):
        (y,) = yield [(_wilder(period), x)]
        return (y,)

    return smoothed(df, lambda lag: {"x": F.col(value)}, [name or f"wilder_{period}"], program, width=width)


def atr(candles: DataFrame, period: int = 14, width: float | None = None) -> DataFrame:
    """atr: the exponential average of the true range; atr_wilder: Wilder's, 0 in warm-up; atr_pct against the close."""

    def program(tr, rows, first):
        later = tr.copy()
        if first:  # Wilder's seed leaves out the first bar, whose range has no close before it.
            later[0] = np.nan
        mean, slow = yield [(_ema(period, rows), tr), (_wilder(period), later)]
        return mean, np.where(np.isnan(slow), 0.0, slow)

    out = smoothed(candles, lambda lag: {"tr": _true_range(lag)}, [f"atr_{period}", f"atr_wilder_{period}"], program, width=width)
    return out.withColumn(f"atr_pct_{period}", div(F.col(f"atr_{period}"), F.col("close")))


def rsi(candles: DataFrame, period: int = 14, width: float | None = None) -> DataFrame:
    """rsi: null in warm-up, 50 in a flat market; rsi_filled: 50 in warm-up, 100 without losses."""

    def program(change, rows, first):
        gain, loss = yield [(_wilder(period), np.maximum(change, 0.0)), (_wilder(period), np.maximum(-change, 0.0))]
        with np.errstate(divide="ignore", invalid="ignore"):
            value = np.where(loss == 0, np.where(gain == 0, 50.0, 100.0), 100 - 100 / (1 + gain / loss))
        value = np.where(np.isnan(gain), np.nan, value)
        return value, np.where(np.isnan(gain), 50.0, np.where(loss == 0, 100.0, value))

    return smoothed(candles, lambda lag: {"change": F.col("close") - lag("close")}, [f"rsi_{period}", f"rsi_filled_{period}"], program, width=width)


def macd(candles: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, width: float | None = None) -> DataFrame:
    """macd, macd_signal and macd_histogram."""

    def program(x, rows, first):
        quick, late = yield [(_ema(fast, rows), x), (_ema(slow, rows), x)]
        line = quick - late
        (mean,) = yield [(_ema(signal), line)]
        return line, mean, line - mean

    return smoothed(candles, lambda lag: {"x": F.col("close")}, ["macd", "macd_signal", "macd_histogram"], program, 2, width=width)


def adx(candles: DataFrame, period: int = 14, width: float | None = None) -> DataFrame:
    """plus_di, minus_di and adx by Wilder's averages."""

    def inputs(lag):
        up, down = F.col("high") - lag("high"), lag("low") - F.col("low")
        return {"tr": _true_range(lag), "plus": F.when((up > down) & (up > 0), up).otherwise(0.0), "minus": F.when((down > up) & (down > 0), down).otherwise(0.0)}

    def program(tr, plus, minus, rows, first):
        tr, plus, minus = yield [(_wilder(period), x) for x in (tr, plus, minus)]
        plus, minus = 100 * _ratio(plus, tr), 100 * _ratio(minus, tr)
        (mean,) = yield [(_wilder(period), 100 * _ratio(np.abs(plus - minus), plus + minus))]
        return plus, minus, mean

    return smoothed(candles, inputs, ["plus_di", "minus_di", f"adx_{period}"], program, 2, width=width)


def keltner(candles: DataFrame, period: int = 20, multiple: float = 2.0, width: float | None = None) -> DataFrame:
    """Channel of `multiple` average true ranges around the exponential average."""

    def program(close, tr, rows, first):
        mid, size = yield [(_ema(period, rows), close), (_ema(period, rows), tr)]
        top, bottom = mid + multiple * size, mid - multiple * size
        return mid, top, bottom, _ratio(top - bottom, mid), _ratio(close - bottom, top - bottom)

    names = ["keltner_mid", "keltner_upper", "keltner_lower", "keltner_width", "keltner_position"]
    return smoothed(candles, lambda lag: {"close": F.col("close"), "tr": _true_range(lag)}, names, program, width=width)


def supertrend(candles: DataFrame, period: int = 10, multiple: float = 3.0) -> DataFrame:
    """supertrend, its direction (1 up, -1 down) and the final bands."""

    def machine():
        own: list = []
        last = [np.nan] * 4  # upper, lower, line, close

        def step(high, low, close, tr, n):
            if not own:
                own.append(_ema(period, n[0])())
            size = own[0](tr)
            out = np.full((4, len(close)), np.nan)
            for i, (mid, r, c) in enumerate(zip(((high + low) / 2).tolist(), size.tolist(), close.tolist(), strict=True)):
                if r != r:
                    continue
                up, down = mid + multiple * r, mid - multiple * r
                if last[0] != last[0]:
                    upper, lower, line = up, down, down
                else:
                    upper = up if up < last[0] or last[3] > last[0] else last[0]
                    lower = down if down > last[1] or last[3] < last[1] else last[1]
                    falling = last[2] == last[0]
                    line = (upper if c <= upper else lower) if falling else (lower if c >= lower else upper)
                out[:, i] = line, 1.0 if line == lower else -1.0, upper, lower
                last[:] = upper, lower, line, c
            return tuple(out)

        return step

    names = ["supertrend", "supertrend_direction", "supertrend_upper", "supertrend_lower"]
    return scan(candles, {"high": F.col("high"), "low": F.col("low"), "close": F.col("close"), "tr": W.true_range(), "n": length()}, names, machine)


def filled_ema(df: DataFrame, value: str, period: int, name: str, width: float | None = None) -> DataFrame:
    """Exponential average whose warm-up rows are the values themselves; in a series shorter than the period, its first value."""

    def program(x, rows, first):
        (y,) = yield [(_ema(period), x)]
        return (np.where(np.isnan(y), x, y),)

    out = smoothed(df, lambda lag: {"x": F.col(value)}, [name], program, width=width)
    short = F.first(F.col(value).cast("double")).over(W.series().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return out.withColumn(name, F.when(length() < period, short).otherwise(F.col(name)))


def volume_group(rows: DataFrame, threshold: float, keys=W.SERIES, order=("ts",), volume: str = "volume") -> DataFrame:
    """volume_group: rows are gathered until their volume reaches the threshold; then a new group starts."""

    def machine():
        state = [0.0, 0.0]  # group, volume so far

        def step(v):
            out = np.empty(len(v))
            for i, x in enumerate(np.nan_to_num(v).tolist()):
                out[i] = state[0]
                state[1] += x
                if state[1] >= threshold:
                    state[:] = state[0] + 1, 0.0
            return (out,)

        return step

    return scan(rows, {"v": F.col(volume)}, ["volume_group"], machine, keys, order)


def ordered_positions(df: DataFrame, entry: Column, side: Column, stop: Column, target: Column, hold: int, keys=W.SERIES, order=("ts",)) -> DataFrame:
    """One position at a time: exits before entries, stop before target within a bar, closed after `hold` bars.

    `entry` marks bars at whose open a position of `side` (1 or -1) starts, with a stop and a target at the
    given distances from it. Returns df with trade_return at the bar of each exit, and position, the side held after the bar.
    An open position is closed at the last bar of the series.
    """

    def machine():
        held = [0.0, 0.0, 0.0, 0.0, 0]  # side, price, stop, target, age

        def step(o, h, l, c, e, s, sd, td, left):
            out, pos = np.full(len(o), np.nan), np.zeros(len(o))
            for i in range(len(o)):
                if held[0]:
                    held[4] += 1
                    worst, best = (l[i], h[i]) if held[0] > 0 else (h[i], l[i])
                    exit_at = None
                    if (worst - held[2]) * held[0] <= 0:
                        exit_at = held[2]
                    elif (best - held[3]) * held[0] >= 0:
                        exit_at = held[3]
                    elif held[4] >= hold:
                        exit_at = c[i]
                    if exit_at is not None:
                        out[i] = (exit_at - held[1]) * held[0] / held[1]
                        held[0] = 0.0
                elif e[i] > 0 and left[i] > 0:
                    held[:] = s[i], o[i], o[i] - s[i] * sd[i], o[i] + s[i] * td[i], 0
                if held[0] and left[i] == 0:
                    out[i] = (c[i] - held[1]) * held[0] / held[1]
                    held[0] = 0.0
                pos[i] = held[0]
            return out, pos

        return step

    left = length(keys) - F.row_number().over(W.series(keys, order))
    inputs = {"o": F.col("open"), "h": F.col("high"), "l": F.col("low"), "c": F.col("close"), "e": entry.cast("int"), "s": side, "sd": stop, "td": target, "left": left}
    return scan(df, inputs, ["trade_return", "position"], machine, keys, order)
