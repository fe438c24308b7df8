"""Mutual information of two continuous columns by nearest neighbours."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import written

#: Points of a region in the mean, regions at most, points of the sample for each of them, and points of a block within a region.
TILE, REGIONS, SAMPLE, BLOCK = 20_000, 4096, 32, 128
#: Points of a stretch of an axis in the mean, and queries of a chunk of one.
STRETCH, CHUNK = 250_000, 500_000
#: Distances that differ by less than this share are equal.
EQUAL = 1e-9


def digamma(m: Column) -> Column:
    """The digamma function of a positive number, to about 1e-13."""
    z = m + 10.0
    square = 1.0 / (z * z)
    series = F.ln(z) - 0.5 / z - square * (1 / 12 - square * (1 / 120 - square * (1 / 252 - square / 240)))
    return series - sum((1.0 / (m + float(j)) for j in range(10)), F.lit(0.0))


def _halved(x: np.ndarray, y: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The plane halved at medians until no part has more than `most` points, or all are equal: (cuts, boxes, members).

    A row of `cuts` is (axis, value, part below, part from it on), parts below 0 being -1 - the number of a box; a row of `boxes`
    is (low x, low y, high x, high y), the high ends not included; `members` are the points of each box.
    """
    v, cuts, boxes, members = (x, y), [], [], []
    todo = [(np.arange(len(x)), (-np.inf, -np.inf, np.inf, np.inf), None)]
    while todo:
        own, box, above = todo.pop()
        spans = [np.ptp(c[own]) if len(own) > most else 0.0 for c in v]
        axis = int(spans[1] > spans[0])
        if above is not None:
            cuts[above[0]][above[1]] = len(cuts) if spans[axis] > 0 else -1 - len(boxes)
        if not spans[axis] > 0:
            boxes.append(box)
            members.append(own)
            continue
        c = v[axis][own]
        at = np.partition(c, len(c) // 2)[len(c) // 2]
        at = at if (c < at).any() else c[c > at].min()
        cuts.append([axis, at, 0, 0])
        for side, inside in ((2, c < at), (3, c >= at)):
            edges = list(box)
            edges[axis + 2 if side == 2 else axis] = at
            todo.append((own[inside], tuple(edges), (len(cuts) - 1, side)))
    return np.array(cuts, float).reshape(-1, 4), np.array(boxes, float), members


def _box_of(cuts: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The number of the box of each point."""
    part = np.full(len(x), 0 if len(cuts) else -1)
    while (open_ := np.flatnonzero(part >= 0)).size:
        cut = cuts[part[open_]]
        beyond = np.where(cut[:, 0] == 0, x[open_], y[open_]) >= cut[:, 1]
        part[open_] = np.where(beyond, cut[:, 3], cut[:, 2])
    return -1 - part


def _nearest(points, queries, k: int, reach: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(d, w), a row for each query: distances of its k nearest points but itself, in order, and how often each is there; inf and 0 where there are fewer.

    Points and queries are (id, x, y, w). Points beyond `reach` need not be found; without, queries are the points.
    Queries of a block meet the blocks of points that are as near as the farthest reach of one of them.
    """
    ids, px, py, w = points
    near, often = np.full((len(queries[0]), k), np.inf), np.zeros((len(queries[0]), k), np.int64)
    blocks = _halved(px, py, BLOCK)[2]
    box = np.array([(px[m].min(), py[m].min(), px[m].max(), py[m].max()) for m in blocks])

    def gaps(q, c):
        return np.maximum(np.abs(queries[1][q][:, None] - px[c]), np.abs(queries[2][q][:, None] - py[c]))

    for q in blocks if reach is None else _halved(queries[1], queries[2], BLOCK)[2]:
        x, y = queries[1][q], queries[2][q]
        if reach is not None:
            far = reach[q].max()
        else:
            far = np.partition(gaps(q, q), k, axis=1)[:, k].max() if len(q) > k else np.inf
        far *= 1 + EQUAL
        met = (box[:, 0] <= x.max() + far) & (box[:, 2] >= x.min() - far) & (box[:, 1] <= y.max() + far) & (box[:, 3] >= y.min() - far)
        if not met.any():
            continue
        c = np.concatenate([blocks[m] for m in np.flatnonzero(met)])
        weight = w[c] - (queries[0][q][:, None] == ids[c])
        d = np.where(weight > 0, gaps(q, c), np.inf)
        take = min(k, len(c))
        first = np.argpartition(d, take - 1, axis=1)[:, :take]
        d = np.take_along_axis(d, first, 1)
        order = np.argsort(d, axis=1, kind="stable")
        near[q, :take], often[q, :take] = np.take_along_axis(d, order, 1), np.take_along_axis(np.take_along_axis(weight, first, 1), order, 1)
    often[~np.isfinite(near)] = 0
    return near, often


def _columns(table, *names):
    return tuple(table.column(n).to_numpy() for n in names)


def kth_distances(points: DataFrame, k: int) -> DataFrame:
    """(_id, _x, _y, _w, _d) of points (_id, _x, _y, _w: how often each is there): the largest of the two gaps to the k-th neighbour.

    The plane is cut into regions of about as many points each, by medians of a sample. Points look in their own
    region; only those whose k-th neighbour may lie beyond its edges go to the regions in reach, too. A region's
    points are moved once for each of the two, whatever their number, and no copy of a point is made.
    """
    n = points.count()
    regions = min(REGIONS, -(-n // TILE))
    sample = max(SAMPLE, 4 * (k + 1))
    drawn = points.select("_x", "_y").sample(min(1.0, regions * sample / n), seed=7).toArrow() if regions > 1 else None
    cuts, boxes, _ = _halved(*(_columns(drawn, "_x", "_y") if drawn is not None else (np.empty(0), np.empty(0))), sample)

    def placed(batches):
        for batch in batches:
            x, y = _columns(batch, "_x", "_y")
            yield batch.append_column("_region", pa.array(_box_of(cuts, x, y).astype(np.int32)))

    def inside(table):
        own = _columns(table, "_id", "_x", "_y", "_w")
        near, often = _nearest(own, own, k)
        d = np.where(np.cumsum(often, 1) >= k, near, np.inf).min(1)
        box, reach = boxes[table.column("_region")[0].as_py()], d * (1 + EQUAL)
        beyond = (own[1] - reach < box[0]) | (own[2] - reach < box[1]) | (own[1] + reach >= box[2]) | (own[2] + reach >= box[3])
        beyond &= len(boxes) > 1
        lists = [pa.array([list(r) if b else None for r, b in zip(v.tolist(), beyond, strict=True)], t) for v, t in ((near, pa.list_(pa.float64())), (often, pa.list_(pa.int64())))]
        return pa.table([*[table.column(c) for c in ("_id", "_x", "_y", "_w", "_region")], pa.array(d), *lists], ["_id", "_x", "_y", "_w", "_region", "_d", "_near", "_often"])

    def reaching(batches):
        for batch in batches:
            x, y, d, own = _columns(batch, "_x", "_y", "_d", "_region")
            for low in range(0, len(x), 1000):
                at = slice(low, low + 1000)
                a, b, r = x[at, None], y[at, None], d[at, None] * (1 + EQUAL)
                row, region = np.nonzero((a - r < boxes[:, 2]) & (b - r < boxes[:, 3]) & (a + r >= boxes[:, 0]) & (b + r >= boxes[:, 1]) & (own[at, None] != np.arange(len(boxes))))
                part = batch.slice(low, 1000).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("_id", "_x", "_y", "_w")], pa.array(region.astype(np.int32)), part.column("_d")], ["_id", "_x", "_y", "_w", "_region", "_d"])

    def outside(table):
        asks = pc.is_valid(table.column("_d"))
        queries, own = table.filter(asks), table.filter(pc.invert(asks))
        if not len(queries) or not len(own):
            return pa.table({"_id": pa.array([], pa.int64()), "_near": pa.array([], pa.list_(pa.float64())), "_often": pa.array([], pa.list_(pa.int64()))})
        near, often = _nearest(_columns(own, "_id", "_x", "_y", "_w"), _columns(queries, "_id", "_x", "_y", "_w"), k, queries.column("_d").to_numpy())
        return pa.table([queries.column("_id"), pa.array(near.tolist(), pa.list_(pa.float64())), pa.array(often.tolist(), pa.list_(pa.int64()))], ["_id", "_near", "_often"])

    base = "_id long, _x double, _y double, _w long, _region int"
    dealt = points.select("_id", "_x", "_y", "_w").mapInArrow(placed, base)
    told = written(dealt.groupBy("_region").applyInArrow(inside, f"{base}, _d double, _near array<double>, _often array<long>"), "near")
    whole = told.filter("_near IS NULL").select("_id", "_x", "_y", "_w", "_d")
    if len(boxes) == 1:
        return whole
    asking = told.filter("_near IS NOT NULL")
    asked = asking.select("_id", "_x", "_y", "_w", "_region", "_d").mapInArrow(reaching, f"{base}, _d double")
    others = told.select("_id", "_x", "_y", "_w", "_region", F.lit(None).cast("double").alias("_d")).unionByName(asked)
    found = others.groupBy("_region").applyInArrow(outside, "_id long, _near array<double>, _often array<long>").unionByName(asking.select("_id", "_near", "_often"))
    every = found.groupBy("_id").agg(F.array_sort(F.flatten(F.collect_list(F.arrays_zip("_near", "_often")))).alias("_all"))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(float("inf")).alias("d"))
    kth = F.aggregate("_all", start, lambda s, v: F.struct((s["n"] + v["_often"]).alias("n"), F.when((s["n"] < k) & (s["n"] + v["_often"] >= k), v["_near"]).otherwise(s["d"]).alias("d")))
    return whole.unionByName(asking.select("_id", "_x", "_y", "_w").join(every.select("_id", kth["d"].alias("_d")), "_id"))


def _counts_within(near: DataFrame) -> DataFrame:
    """(psi): the sum over both axes and all points of digamma of how many points are nearer than _d there, itself included, times how often the point is there.

    Axes are cut into stretches by a sample. Values of a stretch are summed up before they move; a point asks in each
    stretch that its interval meets, which for nearly all is one. Those whose stretch holds very many are dealt in chunks.
    """
    n = near.count()
    stretches = min(REGIONS, -(-n // STRETCH))
    drawn = near.select("_x", "_y").sample(min(1.0, stretches * SAMPLE / n), seed=11).toArrow() if stretches > 1 else None
    ends = [np.unique(np.quantile(v, np.arange(1, stretches) / stretches)) if drawn is not None and len(v) else np.empty(0) for v in (_columns(drawn, "_x", "_y") if drawn is not None else (np.empty(0),) * 2)]

    def held(batches):
        for batch in batches:
            axis, v = _columns(batch, "_axis", "_v")
            at = np.where(axis == 0, np.searchsorted(ends[0], v, "right"), np.searchsorted(ends[1], v, "right"))
            yield batch.append_column("_at", pa.array(at.astype(np.int32)))

    def asked(batches):
        for batch in batches:
            ids, w, d = _columns(batch, "_id", "_w", "_d")
            for axis, c in enumerate(("_x", "_y")):
                v = batch.column(c).to_numpy()
                low, high = v - d * (1 - EQUAL), v + d * (1 - EQUAL)
                first, last = (np.searchsorted(ends[axis], e, "right") for e in (low, high))
                many = last - first + 1
                row = np.repeat(np.arange(len(v)), many)
                at = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                yield pa.RecordBatch.from_arrays([pa.array(a) for a in (np.full(len(row), axis, np.int32), at.astype(np.int32), ids[row], low[row], high[row], w[row], many[row].astype(np.int32))], ["_axis", "_at", "_id", "_low", "_high", "_w", "_many"])

    def counted(table):
        values, queries = (table.filter(pc.is_valid(table.column(c))) for c in ("_v", "_low"))
        v, w = _columns(values, "_v", "_w")
        order = np.argsort(v)
        upto = np.concatenate([[0], np.cumsum(w[order])]).astype(np.int64)
        low, high = _columns(queries, "_low", "_high")
        number = upto[np.searchsorted(v[order], high, "right")] - upto[np.searchsorted(v[order], low, "left")]
        return pa.table([queries.column("_axis"), queries.column("_id"), pa.array(number), queries.column("_w"), queries.column("_many")], ["_axis", "_id", "_n", "_w", "_many"])

    axes = [near.select(F.lit(k).alias("_axis"), F.col(c).alias("_v"), "_w") for k, c in enumerate(("_x", "_y"))]
    values = axes[0].unionByName(axes[1]).groupBy("_axis", "_v").agg(F.sum("_w").alias("_w")).mapInArrow(held, "_axis int, _v double, _w long, _at int")
    queries = near.mapInArrow(asked, "_axis int, _at int, _id long, _low double, _high double, _w long, _many int")
    chunks = F.broadcast(queries.groupBy("_axis", "_at").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("_chunks")))  # a row for each stretch
    values = values.join(chunks, ["_axis", "_at"]).withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1))).drop("_chunks")
    queries = queries.join(chunks, ["_axis", "_at"]).withColumn("_chunk", F.pmod(F.xxhash64("_id"), "_chunks").cast("int")).drop("_chunks")
    both = values.unionByName(queries, allowMissingColumns=True)
    found = both.groupBy("_axis", "_at", "_chunk").applyInArrow(counted, "_axis int, _id long, _n long, _w long, _many int")

    def psi(number: Column, weight: Column) -> Column:
        return weight * digamma(number.cast("double"))

    alone = F.col("_many") == 1
    sums = found.groupBy("_axis", F.when(~alone, F.col("_id")).alias("_part")).agg(F.sum(F.when(alone, psi(F.col("_n"), F.col("_w")))).alias("_psi"), F.sum("_n").alias("_n"), F.max("_w").alias("_w"))
    return sums.agg(F.sum(F.when(F.col("_part").isNull(), F.col("_psi")).otherwise(psi(F.col("_n"), F.col("_w")))).alias("psi"))


def knn_information(df: DataFrame, x: str, y: str, k: int = 3) -> DataFrame:
    """(n, information): mutual information in nats of two numeric columns, by the first estimator of Kraskov, Stoegbauer and Grassberger.

    Columns are divided by their deviations. A point's distance is the larger of both gaps to its k-th neighbour;
    information is psi(n) + psi(k) less the mean of psi(n_x) + psi(n_y), where n_x counts the points nearer on
    one axis, itself included. It is not below 0. Equal points are one with a weight, however many there are. Rows
    with nulls, NaN or infinities do not count; with k rows or fewer, information is null.
    """
    numbers = [F.col(c).cast("double") for c in (x, y)]
    ok = [n.isNotNull() & ~F.isnan(n) & (F.abs(n) < float("inf")) for n in numbers]
    rows = df.filter(ok[0] & ok[1]).select(numbers[0].alias("_x"), numbers[1].alias("_y"))
    s = rows.agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{n}{c}") for c in ("_x", "_y") for n, f in (("low", F.min), ("high", F.max), ("std", F.stddev_pop))]).first()
    n = s["n"]
    if n <= k:
        return df.sparkSession.createDataFrame([(n, None)], "n long, information double")
    counts = rows.groupBy("_x", "_y").agg(F.count(F.lit(1)).alias("_w"))
    scaled = [((F.col(c) - s[f"low{c}"]) / (s[f"std{c}"] or 1.0)).alias(c) for c in ("_x", "_y")]
    points = written(counts.select(F.monotonically_increasing_id().alias("_id"), *scaled, "_w"), "points")
    near = written(kth_distances(points, k), "distances")
    mean = _counts_within(near).select((F.col("psi") / n).alias("_mean"))
    value = digamma(F.lit(float(n))) + digamma(F.lit(float(k))) - F.col("_mean")
    return mean.select(F.lit(n).cast("long").alias("n"), F.greatest(F.lit(0.0), value).alias("information"))
