"""Rolling primitives. A series is the rows of equal keys, ordered by time; a value needs its whole window."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from .scalars import div

SERIES = ("symbol", "timeframe")


def series(keys=SERIES, order=("ts",)) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def last(n: int, keys=SERIES, order=("ts",)) -> WindowSpec:
    return series(keys, order).rowsBetween(1 - n, 0)


def following(n: int, keys=SERIES, order=("ts",)) -> WindowSpec:
    return series(keys, order).rowsBetween(1, n)


def so_far(keys=SERIES, order=("ts",)) -> WindowSpec:
    return series(keys, order).rowsBetween(Window.unboundedPreceding, 0)


def full(n: int, value: Column | str, agg: Callable[[Column], Column], window: WindowSpec | None = None) -> Column:
    """The aggregate where all n values are there, else null."""
    c, w = F.col(value) if isinstance(value, str) else value, window or last(n)
    return F.when(F.count(c).over(w) == n, agg(c).over(w))


def lag(c: Column | str, n: int = 1, keys=SERIES) -> Column:
    return F.lag(c, n).over(series(keys))


def mean(c, n):
    return full(n, c, F.avg)


def std(c, n):
    return full(n, c, F.stddev_pop)


def highest(c, n):
    return full(n, c, F.max)


def lowest(c, n):
    return full(n, c, F.min)


def total(c, n):
    return full(n, c, F.sum)


def true_range(keys=SERIES) -> Column:
    before = F.coalesce(lag("close", 1, keys), F.col("close"))
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def returns(c: str, n: int = 1) -> Column:
    """Relative change over n rows; 0 where the base is zero."""
    return div(F.col(c) - lag(c, n), lag(c, n), 0.0)


def log_returns(c: str, n: int = 1) -> Column:
    return F.when((F.col(c) > 0) & (lag(c, n) > 0), F.ln(F.col(c) / lag(c, n)))


def percent_rank(c: str, n: int) -> Column:
    """The share of the window that is at most the current value."""
    held = F.collect_list(c).over(last(n))
    return F.when(F.count(c).over(last(n)) == n, F.size(F.filter(held, lambda x: x <= F.col(c))) / n)


def pearson(x: str, y: str, over: Callable[[Column], Column] = lambda a: a) -> Column:
    """Correlation of the rows that have both, as an aggregate or over a window; null where one of them does not vary."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    return div(over(F.covar_pop(a, b)), over(F.stddev_pop(a)) * over(F.stddev_pop(b)))


def correlation(x: str, y: str, n: int) -> Column:
    both = F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1)
    return F.when(F.count(both).over(last(n)) == n, pearson(x, y, lambda a: a.over(last(n))))


def beta(target: str, benchmark: str, n: int) -> Column:
    both = F.when(F.col(target).isNotNull() & F.col(benchmark).isNotNull(), 1)
    return F.when(F.count(both).over(last(n)) == n, div(F.covar_pop(target, benchmark).over(last(n)), F.var_pop(benchmark).over(last(n))))


def forward_fill(c: str, keys=SERIES, order=("ts",)) -> Column:
    return F.last(c, ignorenulls=True).over(so_far(keys, order))


def backward_fill(c: str, keys=SERIES, order=("ts",)) -> Column:
    return F.first(c, ignorenulls=True).over(series(keys, order).rowsBetween(0, Window.unboundedFollowing))
