"""Event-time bars and monitors on Structured Streaming. Each function takes a streaming or a static DataFrame of ticks (symbol, ts, last)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LATE = "10 minutes"


def _ohlc() -> list:
    at = F.struct("ts", "last")
    return [F.min_by("last", at).alias("open"), F.max("last").alias("high"), F.min("last").alias("low"), F.max_by("last", at).alias("close"), F.count(F.lit(1)).alias("ticks")]


def tumbling_bars(ticks: DataFrame, size: str = "1 hour", late: str = LATE) -> DataFrame:
    """Bars of fixed length; a bar is final when the watermark passes its end, and later ticks are left out."""
    out = ticks.withWatermark("ts", late).groupBy("symbol", F.window("ts", size)).agg(*_ohlc())
    return out.select("symbol", F.col("window.start").alias("ts"), "open", "high", "low", "close", "ticks")


def sliding_bars(ticks: DataFrame, size: str = "1 hour", slide: str = "15 minutes", late: str = LATE) -> DataFrame:
    out = ticks.withWatermark("ts", late).groupBy("symbol", F.window("ts", size, slide)).agg(*_ohlc())
    return out.select("symbol", F.col("window.start").alias("ts"), F.col("window.end").alias("end_ts"), "open", "high", "low", "close", "ticks")


def activity_sessions(ticks: DataFrame, gap: str = "30 minutes", late: str = LATE) -> DataFrame:
    """Stretches of ticks no further apart than `gap`."""
    out = ticks.withWatermark("ts", late).groupBy("symbol", F.session_window("ts", gap).alias("w")).agg(*_ohlc())
    return out.select("symbol", F.col("w.start").alias("ts"), F.col("w.end").alias("end_ts"), "open", "high", "low", "close", "ticks")


def distinct_ticks(ticks: DataFrame, keys: tuple[str, ...] = ("symbol", "ts", "last"), late: str = LATE) -> DataFrame:
    return ticks.withWatermark("ts", late).dropDuplicatesWithinWatermark(list(keys))


def volume_bars(ticks: DataFrame, threshold: float, order: tuple[str, ...] = ("ts",), idle: int | None = None, late: str = LATE) -> DataFrame:
    """Bars that close when so much volume has gone by (column volume), with state of one open bar for each symbol.

    The ticks of a symbol in one micro-batch are put into `order` together, so a micro-batch is held to what a worker
    takes by the source's own limit (files or offsets a trigger). With `idle`, an open bar also closes once the
    watermark is so many seconds past its last tick; without, it stays open. Ticks without a price are left out.
    """
    names = list(dict.fromkeys([*order, "ts", "last", "volume"]))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        bar, out = (list(state.get) if state.exists else None), []
        if state.hasTimedOut:
            out.append((key[0], *bar[:-1]))
            bar = None
        else:
            rows = pd.concat([b[[*names, "_at"]].dropna(subset=["last"]) for b in batches], ignore_index=True).sort_values(list(order))
            for ts, price, volume, at in rows[["ts", "last", "volume", "_at"]].itertuples(index=False, name=None):
                if bar is None:
                    bar = [ts, price, price, price, price, 0.0, at]
                bar[2], bar[3], bar[4], bar[5], bar[6] = max(bar[2], price), min(bar[3], price), price, bar[5] + volume, max(bar[6], at)
                if bar[5] >= threshold:
                    out.append((key[0], *bar[:-1]))
                    bar = None
        if bar is not None:
            state.update(tuple(bar))
            if idle is not None:
                state.setTimeoutTimestamp(max(bar[6] + idle * 1000, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["symbol", "ts", "open", "high", "low", "close", "volume"])

    schema = "symbol string, ts timestamp, open double, high double, low double, close double, volume double"
    kept = "ts timestamp, open double, high double, low double, close double, volume double, at long"
    rows = ticks.select("symbol", *names, F.unix_millis("ts").alias("_at"))
    if idle is not None:
        rows = rows.withWatermark("ts", late)
    return rows.groupBy("symbol").applyInPandasWithState(step, schema, kept, "append", GroupStateTimeout.NoTimeout if idle is None else GroupStateTimeout.EventTimeTimeout)


def live_monitor(results: DataFrame, keep: int = 500, order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """Running snapshot for each symbol of (symbol, ts, r): trades, equity, win rate, Sharpe and drawdown over the last `keep` results.

    Results of one micro-batch are put into `order` together.
    """

    names = list(dict.fromkeys([*order, "ts", "r"]))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat([b[names] for b in batches], ignore_index=True).sort_values(list(order))
        held = ((list(state.get[0]) if state.exists else []) + rows["r"].tolist())[-keep:]
        state.update((held,))
        r = pd.Series(held, dtype=float)
        equity = 1 + r.cumsum()
        std = r.std() if len(r) > 1 else 0.0
        drawdown = float((equity / equity.cummax().clip(lower=1.0) - 1).min())
        yield pd.DataFrame([(key[0], rows["ts"].iloc[-1], len(r), float(equity.iloc[-1]), float((r > 0).mean()), float(r.mean() / std) if std else 0.0, drawdown)], columns=["symbol", "ts", "n", "equity", "win_rate", "sharpe", "drawdown"])

    schema = "symbol string, ts timestamp, n long, equity double, win_rate double, sharpe double, drawdown double"
    rows = results.select("symbol", *names)
    return rows.groupBy("symbol").applyInPandasWithState(step, schema, "held array<double>", "update", GroupStateTimeout.NoTimeout)


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Windowed(StatefulProcessor):
    """Holds the last `window` rows of a key in a list state and scores each row with the rows up to it."""

    def __init__(self, key: str, features: list[str], window: int, least: int, score: Callable[[np.ndarray], np.ndarray], order: list[str], idle: int):
        self.key, self.features, self.window, self.least, self.score, self.order, self.idle = key, features, window, least, score, order, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "x array<double>")
        self.until = handle.getValueState("until", "ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat([*rows]).sort_values(self.order)
        before = [list(r[0]) for r in self.held.get()]
        x = np.array(before + new[self.features].to_numpy(float).tolist(), float).reshape(-1, len(self.features))
        self.held.put([(r,) for r in x[-self.window :].tolist()])
        last = int(new["at_ms"].max()) + 1000 * self.idle
        if self.until.exists():
            last = max(last, self.until.get()[0])
            self.handle.deleteTimer(self.until.get()[0])
        self.until.update((last,))
        self.handle.registerTimer(last)
        yield self.scored(key[0], new, x, len(before))

    def scored(self, key, new: pd.DataFrame, x: np.ndarray, before: int) -> pd.DataFrame:
        """Windows of one length are scored together: all whole ones, and those of a key's first rows one length at a time."""
        ends = np.arange(before, len(x)) + 1
        out = np.full(len(ends), np.nan)
        size = np.minimum(ends, self.window)
        for n in np.unique(size[size >= self.least]):
            own = np.flatnonzero(size == n)
            out[own] = self.score(np.stack([x[e - n : e] for e in ends[own]]))
        done = pd.DataFrame({self.key: key, "ts": new["ts"].to_numpy(), "rows": size, "prediction": out})
        return done[size >= self.least]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.held.clear()
        self.until.clear()
        yield pd.DataFrame({self.key: [], "ts": [], "rows": [], "prediction": []})

    def close(self) -> None:
        pass


def windowed_predictions(bars: DataFrame, features: list[str], score: Callable[[np.ndarray], np.ndarray], window: int, least: int = 1, key: str = "symbol", order: tuple[str, ...] = ("ts",), idle: int = 7 * 86_400, late: str = LATE) -> DataFrame:
    """(key, ts, rows, prediction): every streamed row scored with the last `window` rows of its key, once there are `least`.

    `score` gets an array of windows, (number, rows, features), and gives a number for each. The state of a key is at
    most `window` rows of features; it goes when the watermark is `idle` seconds past the key's last row, after which the key
    starts anew. Rows of one micro-batch are put into `order` together. State lists and timers need the RocksDB store (`ROCKS`).
    """
    timed = bars.withColumn("ts", F.col("ts").cast("timestamp"))
    # Workers rename columns that start with an underscore, so all that the processor reads has a name of its own.
    named = [F.col(c).alias(f"x{k}") for k, c in enumerate(features)] + [F.col(c).alias(f"o{k}") for k, c in enumerate(order)]
    rows = timed.select(key, "ts", *named, F.unix_millis("ts").alias("at_ms")).withWatermark("ts", late)
    kind = bars.schema[key].dataType.simpleString()
    return rows.groupBy(key).transformWithStateInPandas(
        statefulProcessor=_Windowed(key, [f"x{k}" for k in range(len(features))], window, least, score, [f"o{k}" for k in range(len(order))], idle), outputStructType=f"{key} {kind}, ts timestamp, rows long, prediction double", outputMode="Append", timeMode="EventTime",
    )


def with_closing_tick(ticks: DataFrame, after: str = "1 day") -> DataFrame:
    """Finite ticks and one of no symbol and no price, so much later: once read, the watermark has passed every other tick."""
    end = ticks.agg((F.max("ts") + F.expr(f"INTERVAL {after}")).alias("ts"))
    return ticks.unionByName(end, allowMissingColumns=True)


def stream_into(bars: DataFrame, path: str, checkpoint: str, mode: str = "append", once: bool = True):
    """Writes a stream as Parquet; with `once`, what is there now and then ends. Restarts go on from the checkpoint."""
    writer = bars.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")).start()


def upsert_batches(stream: DataFrame, apply, checkpoint: str, mode: str = "append"):
    """Hands each micro-batch to `apply(batch, number)`, which merges it into a table: last write wins as with any upsert."""
    return stream.writeStream.outputMode(mode).foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
