"""Chronological splits, folds and sequences. Each row gets its number in its series by time; splits are ranges of that number."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import windows as W


def numbered(df: DataFrame, keys=W.SERIES, order=("ts",)) -> DataFrame:
    """`row` from 0 and `rows` of each series."""
    return df.withColumns({"row": F.row_number().over(W.series(keys, order)) - 1, "rows": F.count(F.lit(1)).over(Window.partitionBy(*keys))})


def chronological(df: DataFrame, train: float = 0.7, validation: float = 0.15, embargo: int = 5, keys=W.SERIES, order=("ts",)) -> DataFrame:
    """`split`: train, then val, then test; the first `embargo` rows of val and test are left out."""
    rows = numbered(df, keys, order)
    first, second = F.floor(F.col("rows") * train), F.floor(F.col("rows") * F.lit(train + validation))
    split = F.when(F.col("row") < first, "train").when(F.col("row") < first + embargo, None).when(F.col("row") < second, "val").when(F.col("row") < second + embargo, None).otherwise("test")
    return rows.withColumn("split", split).filter(F.col("split").isNotNull()).drop("row", "rows")


def _by_folds(rows: DataFrame, folds: Sequence[tuple[int, int, int, int, int]]) -> DataFrame:
    """Rows of each fold (fold, train from, train to, test from, test to): exploded from the folds that take them, not joined on ranges."""
    parts = [
        F.when((F.col("row") >= a) & (F.col("row") < b), F.struct(F.lit(k).alias("fold"), F.lit("train").alias("part"))).when((F.col("row") >= c) & (F.col("row") < d), F.struct(F.lit(k).alias("fold"), F.lit("test").alias("part")))
        for k, a, b, c, d in folds
    ]
    return rows.withColumn("_f", F.explode(F.array_compact(F.array(*parts)))).select(*[c for c in rows.columns if c not in ("row", "rows")], "_f.fold", "_f.part")


def expanding_folds(n: int, folds: int = 5, embargo: int = 5, least_train: int | None = None) -> list[tuple[int, int, int, int, int]]:
    """Training from the start up to each test block, less the embargo."""
    size = n // (folds + 1)
    first = least_train or size
    out = []
    for k in range(folds):
        start = first + k * size
        end = n if k == folds - 1 else min(n, start + size)
        if start + embargo < end:
            out.append((k, 0, start, start + embargo, end))
    return out


def rolling_folds(n: int, train: int, test: int, step: int | None = None, most: int | None = None) -> list[tuple[int, int, int, int, int]]:
    """Windows of fixed size that move on by `step`."""
    starts = range(0, max(0, n - train - test + 1), step or test)
    return [(k, a, a + train, a + train, a + train + test) for k, a in enumerate(starts) if most is None or k < most]


def walk_forward(df: DataFrame, folds: Sequence[tuple[int, int, int, int, int]], keys=W.SERIES, order=("ts",)) -> DataFrame:
    """A row for each fold and part (train or test) that a row belongs to."""
    return _by_folds(numbered(df, keys, order), folds)


def rolling_walk_forward(df: DataFrame, train: int, test: int, step: int | None = None, keys=W.SERIES, order=("ts",)) -> DataFrame:
    """As walk_forward, with all whole folds of each series: windows of fixed size that move on by `step` up to its own last row."""
    step, row, size = step or test, F.col("row"), train + test
    first = F.greatest(F.lit(0), F.ceil((row - size + 1) / step)).cast("int")
    last = F.least(F.floor(row / step), F.floor((F.col("rows") - size) / step)).cast("int")
    rows = numbered(df, keys, order)
    dealt = rows.withColumn("fold", F.explode(F.when(first <= last, F.sequence(first, last))))
    part = F.when(row < F.col("fold") * step + train, "train").otherwise("test")
    return dealt.withColumn("part", part).select(*[c for c in rows.columns if c not in ("row", "rows")], "fold", "part")


def k_folds(df: DataFrame, k: int, keys=W.SERIES, order=("ts",), shuffle_by: str | None = None) -> DataFrame:
    """`fold` of each row: blocks in order of time, or, with a column to shuffle by, its hash."""
    if shuffle_by:
        return df.withColumn("fold", F.pmod(F.xxhash64(shuffle_by), F.lit(k)).cast("int"))
    return df.withColumn("fold", F.ntile(k).over(W.series(keys, order)) - 1)


def sequences(df: DataFrame, columns: list[str], length: int, stride: int = 1, label: str | None = None, label_offset: int = 0, keys=W.SERIES, order=("ts",)) -> DataFrame:
    """(keys, order, sequence, label): `length` rows up to each kept row as arrays; the label is that of `label_offset` rows later.

    Sequences start every `stride` rows; those that are not whole, or whose label lies past the end, are left out.
    """
    w = W.last(length, keys, order)
    held = F.collect_list(F.struct(*[F.col(c).cast("double").alias(c) for c in columns])).over(w)
    number = F.row_number().over(W.series(keys, order))
    ahead = [] if label is None else [F.lead(label, label_offset).over(W.series(keys, order)).alias("label")]
    rows = df.select(*keys, *order, held.alias("_s"), number.alias("_i"), *ahead)
    whole = (F.col("_i") >= length) & (F.pmod(F.col("_i") - length, F.lit(stride)) == 0)
    if label is not None:
        whole = whole & F.col("label").isNotNull()
    sequence = F.transform("_s", lambda s: F.array(*[s[c] for c in columns]))
    return rows.filter(whole).select(*keys, *order, sequence.alias("sequence"), *([] if label is None else ["label"]))


def every(df: DataFrame, stride: int, keys=W.SERIES, order=("ts",)) -> DataFrame:
    """Every stride-th row of each series, from its first on."""
    return numbered(df, keys, order).filter(F.pmod("row", F.lit(stride)) == 0).drop("row", "rows")


def batches(df: DataFrame, size: int, keys=W.SERIES, order=("ts",)) -> DataFrame:
    """`batch`: the number of each row's batch of `size` rows."""
    return numbered(df, keys, order).withColumn("batch", F.floor(F.col("row") / size).cast("long")).drop("row", "rows")
