"""As-of joins of time series: the row of the other side at, before or after each time.

Both sides are cut into time chunks, so that a series, however long, is spread over many tasks. Within a
chunk a window finds the match. What a chunk needs from outside is one row: the last (or first) row of the
nearest chunk that has any, which comes from a table of one row for each chunk.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK_SECONDS = 7 * 86_400


def _chunk(ts: Column, seconds: int) -> Column:
    return F.floor(F.unix_micros(ts.cast("timestamp")) / (seconds * 1_000_000)).cast("long")


def _matched(left: DataFrame, right: DataFrame, keys: list[str], ts: str, backward: bool, seconds: int, name: str) -> DataFrame:
    """`left` with struct column `name`: the columns of the nearest row of `right` that is not later (or not earlier), or null."""
    fields = [c for c in right.columns if c not in keys]
    key_columns = [*keys, "_chunk"]
    here = left.withColumns({"_chunk": _chunk(F.col(ts), seconds), "_row": F.struct(*[c for c in left.columns])})
    there = right.filter(F.col(ts).isNotNull()).withColumns({"_chunk": _chunk(F.col(ts), seconds), "_other": F.struct(*fields)})
    # Right rows stand on the near side of left rows with an equal time, so equal times match.
    tagged = here.select(*key_columns, F.col(ts).alias("_ts"), F.lit(1).alias("_left"), "_row", F.lit(None).cast(there.schema["_other"].dataType).alias("_other")).unionByName(
        there.select(*key_columns, F.col(ts).alias("_ts"), F.lit(0).alias("_left"), F.lit(None).cast(here.schema["_row"].dataType).alias("_row"), "_other")
    )
    order = [F.col("_ts").asc(), F.col("_left").asc()] if backward else [F.col("_ts").desc(), F.col("_left").asc()]
    inside = tagged.withColumn("_found", F.last("_other", ignorenulls=True).over(Window.partitionBy(*key_columns).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    # One row for each chunk of the right side, and for each chunk of the left side what lies in the nearest chunk before (after).
    best = (F.max_by if backward else F.min_by)("_other", ts)
    ends = there.groupBy(*key_columns).agg(best.alias("_end"))
    near = ends.unionByName(here.select(*key_columns).distinct().withColumn("_end", F.lit(None).cast(ends.schema["_end"].dataType)))
    near = near.groupBy(*key_columns).agg(F.first("_end", ignorenulls=True).alias("_end"))
    chunk_order = F.col("_chunk").asc() if backward else F.col("_chunk").desc()
    w = Window.partitionBy(*keys).orderBy(chunk_order).rowsBetween(Window.unboundedPreceding, -1)
    carried = near.withColumn("_carry", F.last("_end", ignorenulls=True).over(w)).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key_columns)], "_carry")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(key_columns)])
    joined = inside.filter("_left = 1").join(carried.filter(F.col("_carry").isNotNull()), same, "left")
    return joined.select("_row.*", F.coalesce("_found", "_carry").alias(name))


def asof_join(
    left: DataFrame, right: DataFrame, keys: list[str], ts: str = "ts", direction: str = "backward", tolerance: int | None = None,
    prefix: str = "right_", columns: list[str] | None = None, chunk_seconds: int = CHUNK_SECONDS,
) -> DataFrame:
    """Every row of `left` with `columns` of the row of `right` at the nearest time, prefixed, and its time.

    direction: `backward` takes the last row at or before the time, `forward` the first at or after it,
    `nearest` the closer of both (the earlier one on a tie), `exact` only one of the same time. With
    `tolerance` (seconds) rows further away do not count. Rows without a match get nulls. `right` has one
    row for each key and time; of several, one is taken. Null keys match null keys.
    """
    wanted = columns or [c for c in right.columns if c not in (*keys, ts)]
    other = right.select(*keys, ts, *wanted)
    if direction not in ("backward", "forward", "nearest", "exact"):
        raise ValueError(f"unknown direction {direction!r}")
    found = left
    if direction != "forward":
        found = _matched(found, other, keys, ts, True, chunk_seconds, "_before")
    if direction in ("forward", "nearest"):
        found = _matched(found, other, keys, ts, False, chunk_seconds, "_after")

    def gap(side: str) -> Column:
        return F.abs(F.unix_micros(F.col(f"{side}.{ts}").cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp")))

    if direction == "nearest":
        before = F.col("_after").isNull() | (F.col("_before").isNotNull() & (gap("_before") <= gap("_after")))
        match, distance = F.when(before, F.col("_before")).otherwise(F.col("_after")), F.when(before, gap("_before")).otherwise(gap("_after"))
    else:
        side = "_after" if direction == "forward" else "_before"
        match, distance = F.col(side), gap(side)
    limit = 0 if direction == "exact" else tolerance
    if limit is not None:
        match = F.when(distance <= limit * 1_000_000, match)
    out = found.withColumn("_match", match)
    return out.select(*left.columns, F.col(f"_match.{ts}").alias(f"{prefix}{ts}"), *[F.col(f"_match.{c}").alias(f"{prefix}{c}") for c in wanted])


def interpolated_join(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str], ts: str = "ts", prefix: str = "right_", chunk_seconds: int = CHUNK_SECONDS) -> DataFrame:
    """Numbers of `right` at the times of `left`: linear in time between its neighbours, the nearer one at the ends."""
    other = right.select(*keys, ts, *columns)
    found = _matched(left, other, keys, ts, True, chunk_seconds, "_before")
    found = _matched(found, other, keys, ts, False, chunk_seconds, "_after")

    def micros(c: str) -> Column:
        return F.unix_micros(F.col(c).cast("timestamp")).cast("double")

    share = F.when(micros(f"_after.{ts}") > micros(f"_before.{ts}"), (micros(ts) - micros(f"_before.{ts}")) / (micros(f"_after.{ts}") - micros(f"_before.{ts}"))).otherwise(0.0)

    def value(c: str) -> Column:
        a, b = F.col(f"_before.{c}").cast("double"), F.col(f"_after.{c}").cast("double")
        return F.coalesce(a + (b - a) * share, a, b).alias(f"{prefix}{c}")

    return found.select(*left.columns, *[value(c) for c in columns])


def align_blocks(primary: DataFrame, blocks: dict[str, DataFrame], keys: list[str], ts: str = "ts", tolerance: int | None = None, fill: float | None = None) -> DataFrame:
    """`primary` with the latest columns of each block at its times, prefixed by the block's name; `fill` stands for missing numbers."""
    out = primary
    for name, block in blocks.items():
        out = asof_join(out, block, keys, ts, "backward", tolerance, f"{name}_")
        out = out.drop(f"{name}_{ts}")
        if fill is not None:
            out = out.fillna(fill, subset=[f"{name}_{c}" for c in block.columns if c not in (*keys, ts)])
    return out
