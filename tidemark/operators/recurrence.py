"""Smoothings of long series by a prefix scan over time chunks.

A smoothing y = (1 - a) * last y + a * x is an affine map of the last y, and so is any run of them. A series is cut
into time chunks, which are dealt to tasks one by one. Each chunk first gives the composed map of its rows; the
maps of a series, one row for each chunk, are applied one after the other; with the state that enters it, each
chunk then works out its rows on its own. Smoothings that start with the mean of their first values fit in: a
chunk also gives as many of its first values as a seed can take. What a chunk's first row makes of the row before
it is worked out where the maps of a series meet, as each chunk also gives its first and last rows.

Smoothings of smoothings take a round for each level. Rows are shuffled once, whatever the number of rounds: each
round reads the same exchange.
"""

from __future__ import annotations

from collections.abc import Callable, Generator, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type

from ..functions import windows as W

#: Seconds of a chunk, or as many units where the order is by a number.
CHUNK = 30 * 86_400
BLOCK = 128


class Smooth:
    """y = (1 - a) * last y + a * x, a block at a time; a NaN input repeats the last y."""

    def __init__(self, alpha: float, last: float = np.nan):
        k = np.arange(BLOCK)
        self.last = last
        self.weights = np.tril(alpha * (1 - alpha) ** np.clip(k[:, None] - k[None, :], 0, None))
        self.decay = (1 - alpha) ** (k + 1)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        known, entering = ~np.isnan(x), self.last
        dense, out = x[known], np.empty(int(known.sum()))
        for a in range(0, len(dense), BLOCK):
            part = dense[a : a + BLOCK]
            n = len(part)
            out[a : a + n] = self.weights[:n, :n] @ part + self.decay[:n] * self.last
            self.last = out[a + n - 1]
        return np.append(entering, out)[np.cumsum(known)]


class Average:
    """Smoothing that starts with the mean of the first `period` known values, at the last of them; NaN before.

    A series of fewer `rows` is seeded by all of them.
    """

    def __init__(self, period: int, alpha: float, rows: float = np.inf):
        self.alpha, self.need = alpha, int(min(period, rows))
        self.total, self.seen, self.smooth = 0.0, 0, Smooth(alpha)

    def enter(self, seen: int, total: float, last: float) -> None:
        self.seen, self.total, self.smooth.last = seen, total, last

    def advance(self, count: int, end: float, head: np.ndarray) -> None:
        """As after a chunk of `count` known values that starts with `head` and, entered with 0, ends at `end`."""
        decay = (1 - self.alpha) ** count
        if self.seen >= self.need:
            if count:
                self.smooth.last = decay * self.smooth.last + end
            return
        part = head[: self.need - self.seen]
        self.total += part.sum()
        self.seen += len(part)
        if self.seen == self.need:
            before = Smooth(self.alpha, 0.0)
            before(part)
            after = (1 - self.alpha) ** (count - len(part))
            self.smooth.last = after * (self.total / self.need) + end - after * before.last

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.seen >= self.need:
            return self.smooth(x)
        out = np.full(len(x), np.nan)
        known = np.flatnonzero(~np.isnan(x))[: self.need - self.seen]
        self.total += x[known].sum()
        self.seen += len(known)
        if self.seen == self.need:
            at = int(known[-1])
            self.smooth.last = out[at] = self.total / self.need
            out[at + 1 :] = self.smooth(x[at + 1 :])
        return out


class Composed:
    """The map of a chunk's rows: how many values it takes, where it ends if entered with 0, and its first values."""

    def __init__(self, average: Average):
        self.need, self.count, self.head, self.smooth = average.need, 0, np.empty(0), Smooth(average.alpha, 0.0)

    def __call__(self, x: np.ndarray) -> None:
        known = x[~np.isnan(x)]
        self.count += len(known)
        self.head = np.append(self.head, known[: self.need - len(self.head)])
        self.smooth(known)


#: A program gets arrays of the inputs, the rows of the series and whether its first row is the series' first; it
#: yields, level by level, lists of (make, x), gets the smoothings of the x in turn, and returns its outputs.
Program = Callable[..., Generator[list[tuple[Callable[[], Average], np.ndarray]], list[np.ndarray], tuple[np.ndarray, ...]]]


def chunk_of(df: DataFrame, order: str, width: float) -> Column:
    kind = df.schema[order].dataType
    number = F.unix_micros(F.col(order).cast("timestamp")) / 1e6 if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)) else F.col(order).cast("double")
    return F.floor(number / width).cast("long")


def _chunks(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[pa.RecordBatch, bool, list[np.ndarray]]]:
    """Pieces of batches that lie in one chunk: batch, whether a chunk starts, inputs."""
    for batch in batches:
        if not batch.num_rows:
            continue
        nth = batch.column("_nth").to_numpy()
        values = [np.asarray(batch.column(n).to_numpy(zero_copy_only=False), float) for n in names]
        cuts = sorted({0, *np.flatnonzero(nth == 1).tolist(), batch.num_rows})
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a), bool(nth[a] == 1), [v[a:b] for v in values]


def _place(batch: pa.RecordBatch, starts: bool) -> tuple[float, bool]:
    """Rows of the series, and whether its first row comes first here."""
    return batch.column("_rows")[0].as_py(), starts and batch.column("_begins")[0].as_py()


MAP = pa.list_(pa.struct([("count", pa.int64()), ("end", pa.float64()), ("head", pa.list_(pa.float64())), ("alpha", pa.float64()), ("need", pa.int32())]))
STATE = pa.list_(pa.struct([("seen", pa.int64()), ("total", pa.float64()), ("last", pa.float64())]))


def _maps(program: Program, names: list[str], level: int, columns: list[str]):
    """A row for each chunk: its first and last row, and the maps of its smoothings of this level, those of the levels below being entered with their states.

    The first level leaves a chunk's first row to the scan.
    """

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = below = own = None
        count = 0

        def row() -> pa.RecordBatch:
            found = [{"count": c.count, "end": c.smooth.last, "head": c.head.tolist(), "alpha": a.alpha, "need": a.need} for c, a in own]
            ends = [pa.StructArray.from_arrays([r.column(c) for c in columns], columns) for r in (first, last)]
            return pa.RecordBatch.from_arrays([first.column("_k"), *ends, pa.array([count]), pa.array([found], MAP)], ["_k", "_top", "_end", "_in", "_maps"])

        for batch, starts, values in _chunks(batches, names):
            if starts:
                if first is not None:
                    yield row()
                first, below, own, count = batch.slice(0, 1), [], None, 0
            last, count = batch.slice(batch.num_rows - 1), count + batch.num_rows
            if level:
                running = program(*values, *_place(batch, starts))
            else:
                running = program(*[v[1:] if starts else v for v in values], np.inf, False)
            wanted = next(running)
            for k in range(level):
                if len(below) <= k:
                    below.append(_entered(wanted, batch, k))
                wanted = running.send([f(x) for f, (_, x) in zip(below[k], wanted, strict=True)])
            if own is None:
                own = [(Composed(a), a) for a in (make() for make, _ in wanted)]
            for (c, _), (_, x) in zip(own, wanted, strict=True):
                c(x)
        if first is not None:
            yield row()

    return maps


def _entered(wanted: list, batch: pa.RecordBatch, level: int) -> list[Average]:
    """The smoothings of a level, with the states that enter the chunk."""
    out = []
    for (make, _), state in zip(wanted, batch.column(f"_state{level}")[0].as_py(), strict=True):
        average = make()
        average.enter(state["seen"], state["total"], np.nan if state["last"] is None else state["last"])
        out.append(average)
    return out


def _scan(program: Program, names: list[str], level: int):
    """Of the chunks of whole series in order, the states that enter each of them."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[Average] = []
        for batch in batches:
            states = []
            tops = [np.asarray(batch.column(n).to_numpy(zero_copy_only=False), float) for n in names]
            for k, (begins, rows, maps) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("_begins", "_rows", "_maps")), strict=True)):
                wanted = [] if level else next(program(*[t[k : k + 1] for t in tops], rows, begins))
                if begins:
                    own = [Average(m["need"], m["alpha"]) for m in maps] if level else [make() for make, _ in wanted]
                states.append([{"seen": a.seen, "total": a.total, "last": None if np.isnan(a.smooth.last) else a.smooth.last} for a in own])
                for a, (_, x) in zip(own, wanted, strict=False):
                    a(x)
                for a, m in zip(own, maps, strict=True):
                    a.advance(m["count"], m["end"], np.array(m["head"], float))
            more = [] if level else [batch.column(c) for c in ("_before", "_rows", "_begins")]
            yield pa.RecordBatch.from_arrays([batch.column("_k"), pa.array(states, STATE), *more], ["_k", f"_state{level}", "_before", "_rows", "_begins"][: 2 + len(more)])

    return scan


def smoothed(df: DataFrame, inputs: Callable[[Callable[[str], Column]], dict[str, Column]], outputs: list[str], program: Program, levels: int = 1, keys=W.SERIES, order=("ts",), width: float | None = None) -> DataFrame:
    """`df` with double columns `outputs`, which `program` makes of the arrays of `inputs`, with smoothings in `levels` levels.

    `inputs` gets a function that gives a column of the row before in the series; it may look at a row and the one before.
    Chunks are `width` seconds long (or units of the first of `order`). Nulls go in as NaN and NaN comes out as null.
    Keys that are null form a series of their own; rows without a time are a chunk of their own, the first.
    """
    columns, width = df.columns, CHUNK if width is None else width
    base = df.withColumn("_k", F.struct(*[F.col(k) for k in keys], chunk_of(df, order[0], width).alias("_chunk"))).repartition("_k")
    inside = Window.partitionBy("_k").orderBy(*order)
    made = inputs(F.col)
    names = [f"_in{k}" for k in range(len(made))]

    def with_inputs(rows: DataFrame, lag: Callable[[str], Column]) -> DataFrame:
        return rows.withColumns({n: c.cast("double") for n, c in zip(names, inputs(lag).values(), strict=True)})

    def rows_of(states: list[DataFrame]) -> DataFrame:
        """Rows in order of chunks and time, with inputs and states. Sides of one row for each chunk are hashed, so the rows keep their exchange and their order."""
        out = base.sortWithinPartitions("_k", *order)
        for s in states:
            out = out.join(s.hint("shuffle_hash"), "_k")
        out = out.withColumn("_nth", F.row_number().over(inside))

        def lag(c: str) -> Column:
            before = F.lag(c).over(inside)
            return F.when(F.col("_nth") == 1, F.col("_before").getField(c)).otherwise(before) if states else before

        return with_inputs(out, lag).drop("_before").sortWithinPartitions("_k", *order)

    states: list[DataFrame] = []
    for level in range(levels):
        key, row = base.schema["_k"].dataType, df.schema
        schema = T.StructType([T.StructField("_k", key), T.StructField("_top", row), T.StructField("_end", row), T.StructField("_in", T.LongType()), T.StructField("_maps", from_arrow_type(MAP))])
        maps = rows_of(states).mapInArrow(_maps(program, names, level, columns), schema)
        series = Window.partitionBy(F.struct(*[F.col("_k").getField(k) for k in keys]))
        by_chunk = series.orderBy(F.col("_k._chunk"))
        more = {"_begins": F.row_number().over(by_chunk) == 1, "_rows": F.sum("_in").over(series), "_before": F.lag("_end").over(by_chunk)}
        met = maps.withColumns(more).select("_k", "_top.*", "_before", "_rows", "_begins", "_maps")
        if level == 0:
            met = with_inputs(met, lambda c: F.col("_before").getField(c))
        fields = [T.StructField("_k", key), T.StructField(f"_state{level}", from_arrow_type(STATE))]
        fields += [] if level else [T.StructField("_before", row), T.StructField("_rows", T.LongType()), T.StructField("_begins", T.BooleanType())]
        kept = [c for c in met.columns if c in ("_k", "_begins", "_rows", "_maps", *([] if level else ["_before", *names]))]
        states.append(met.select(*kept).mapInArrow(_scan(program, names if level == 0 else [], level), T.StructType(fields)))

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[list[Average]] = []
        for batch, starts, values in _chunks(batches, names):
            if starts:
                own = []
            running, level = program(*values, *_place(batch, starts)), 0
            wanted = next(running)
            while True:
                if len(own) <= level:
                    own.append(_entered(wanted, batch, level))
                try:
                    wanted = running.send([f(x) for f, (_, x) in zip(own[level], wanted, strict=True)])
                except StopIteration as done:
                    made = done.value
                    break
                level += 1
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], *[pa.array(np.asarray(x, float), mask=np.isnan(x)) for x in made]], [*columns, *outputs])

    return rows_of(states).mapInArrow(finished, T.StructType([*df.schema.fields, *[T.StructField(c, T.DoubleType()) for c in outputs]]))
