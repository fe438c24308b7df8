"""Density clusters and hierarchies of vectors (array columns)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ordered import written
from .graphs import components

#: Vectors that the space is divided by, rows and components that a chunk of a cell has at most, rows that are compared at once, and copies of a class's row when its vectors meet it.
PIVOTS, CHUNK, COMPONENTS, STEP, SALTS = 16, 65_536, 1 << 22, 1024, 16
#: Items that a hierarchy is built of: its distance table has a row for each pair of them.
ITEMS = 2000


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), float).reshape(len(column), -1)


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T, 0.0)


def _near_pairs(x: np.ndarray, y: np.ndarray, radius: float, same: bool):
    """Arrays (i, j) of the pairs of rows of `x` and `y` that are at most `radius` apart, STEP rows of each at a time; with `same`, each pair (i, j) with i <= j.

    One product gives minus half of all squares, and what it may be wrong by. Single precision will do if that is small
    against `radius`; close calls are worked out from the differences in double precision.
    """
    xx, yy = (x * x).sum(1), (y * y).sum(1)
    square, d = radius * radius, x.shape[1]
    kind, slack, scale = np.float32, 1.2e-7 * (d + 8), xx.max() + yy.max() + square
    if not (slack * scale < 0.01 * square and 1e-30 < scale < 1e30):
        kind, slack = np.float64, max(1e-12, 4.4e-16 * (d + 8))
    a = np.column_stack([x, (slack - 0.5) * xx, np.ones(len(x))]).astype(kind)
    b = np.column_stack([y, np.ones(len(y)), (slack - 0.5) * yy]).astype(kind)
    for p in range(0, len(x), STEP):
        for q in range(p if same else 0, len(y), STEP):
            half = a[p : p + STEP] @ b[q : q + STEP].T
            at = np.flatnonzero(half >= kind((-0.5 - slack) * square))
            i, j = np.divmod(at, half.shape[1])
            if same and p == q:
                i, j, at = (v[i <= j] for v in (i, j, at))
            near = half.ravel()[at] - 2 * slack * (xx[p + i] + yy[q + j]) > (slack - 0.5) * square
            close = np.flatnonzero(~near)
            for k in range(0, len(close), 1 << 15):
                c = close[k : k + (1 << 15)]
                near[c] = np.sqrt(((x[p + i[c]] - y[q + j[c]]) ** 2).sum(1)) <= radius
            yield p + i[near], q + j[near]


def _cells(rows: DataFrame, pivots: np.ndarray, radius: float) -> DataFrame:
    """`rows` (_id, _x, ...) with _home, the cell of the nearest pivot, and _reach, all cells whose vectors may be within `radius`.

    If y is nearest to pivot p and x to q, d(x, p) <= d(x, y) + d(y, p) <= d(x, y) + d(y, q) <= 2 d(x, y) + d(x, q).
    """
    fields = rows.schema

    def dealt(batches):
        for batch in batches:
            if batch.num_rows:
                d = np.sqrt(_squares(_matrix(batch.column("_x")), pivots))
                row, cell = np.nonzero(d <= d.min(1, keepdims=True) + 2 * radius + 1e-6 * (1 + d))
                starts = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
                reach = pa.ListArray.from_arrays(pa.array(starts), pa.array(cell.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(d.argmin(1).astype(np.int32)), reach], [*fields.names, "_home", "_reach"])

    return rows.mapInArrow(dealt, T.StructType([*fields.fields, T.StructField("_home", T.IntegerType()), T.StructField("_reach", T.ArrayType(T.IntegerType()))]))


def _blocks(placed: DataFrame, chunk: int) -> DataFrame:
    """`placed` once for each block (_i, _j) that it is in, with _own, its chunk: pairs of chunks, a chunk and itself too.

    A row meets the chunks of the cells that it reaches, and is in the same block as they, so the copies are
    as many as there are cells and do not grow with the rows until a cell has more than `chunk`.
    """
    sizes = {r["_home"]: -(-r["count"] // chunk) for r in placed.groupBy("_home").count().collect()}  # a row for each pivot
    first, n = {}, 0
    for cell in sorted(sizes):
        first[cell], n = n, n + sizes[cell]
    chunks = F.create_map(*[v for cell, k in sorted(sizes.items()) for v in (F.lit(cell), F.array(*[F.lit(first[cell] + i) for i in range(k)]))]) if sizes else F.lit(None).cast("map<int,array<int>>")
    mine = F.element_at(chunks, F.col("_home"))
    rows = placed.withColumn("_own", F.element_at(mine, (F.pmod(F.xxhash64("_id"), F.size(mine)) + 1).cast("int")))
    met = rows.withColumn("_met", F.explode(F.flatten(F.transform("_reach", lambda c: F.coalesce(F.element_at(chunks, c), F.array().cast("array<int>"))))))
    return met.select("_id", "_x", "_w", "_own", F.least("_own", "_met").alias("_i"), F.greatest("_own", "_met").alias("_j"))


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest place that each of n places is joined to."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _linked(w_left: np.ndarray, w_right: np.ndarray, pairs, least: int, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What a block tells of its near `pairs`: the weight of the rows near each row (left rows, then right ones), links (i, j) of rows that are cores by this block alone, and other links (i, j).

    Links among such cores are cut down to a forest as they come. A pair is held only if one of its rows has not had `least`
    others until then, so a row holds fewer than that; in the end it has one for each tree that it reaches.
    """
    w = w_left if same else np.concatenate([w_left, w_right])
    n, shift = np.zeros(len(w), np.int64), 0 if same else len(w_left)
    enough = least - (w - 1)  # a row's equals are near it too
    label, held, joined = np.arange(len(w)), [], []

    def joins() -> None:
        nonlocal label
        if joined:
            i, j = (np.concatenate(v) for v in zip(*joined))
            label = _forest(len(w), label[i], label[j])[label]
            joined.clear()

    for i, j in pairs:
        j = j + shift
        apart = i != j
        i, j = i[apart], j[apart]
        np.add.at(n, i, w[j])
        np.add.at(n, j, w[i])
        both = (n[i] >= enough[i]) & (n[j] >= enough[j])
        held.append((i[~both], j[~both]))
        both &= label[i] != label[j]
        joined.append((i[both], j[both]))
        if sum(len(v[0]) for v in joined) > 1 << 20:
            joins()
    i, j = (np.concatenate([v[k] for v in held] or [np.empty(0, int)]) for k in (0, 1))
    both = (n[i] >= enough[i]) & (n[j] >= enough[j])
    joined.append((i[both], j[both]))
    joins()
    moved = np.flatnonzero(label != np.arange(len(w)))
    i, j = np.divmod(np.unique(label[i[~both]] * len(w) + label[j[~both]]), len(w))
    return n, moved, label[moved], i, j


def dbscan(df: DataFrame, id_col: str, vec: str, eps: float, min_samples: int = 5, metric: str = "euclidean") -> DataFrame:
    """(id, n_near, kind, cluster) of every row: how many others lie within `eps`; core (at least `min_samples`), border or noise; and the cluster.

    Cores within `eps` of each other are one cluster, named by its smallest core; a border row goes to the smallest
    cluster with a core in reach, noise has none. Distances are euclidean, or cosine (1 less the similarity).
    Pairs are looked for once, between chunks of the cells of PIVOTS vectors: a block returns counts and links that are cut down to
    a forest where both ends are sure to be cores, never all pairs. Equal vectors are one with a weight. Null and empty
    vectors, those with null or NaN components, zero ones under cosine, and those of another length than most have are noise.
    """
    if metric not in ("euclidean", "cosine"):
        raise ValueError(f"unknown metric {metric!r}")
    # Vectors of single precision travel as they are; all is worked out in double precision.
    single = metric == "euclidean" and df.schema[vec].dataType == T.ArrayType(T.FloatType(), df.schema[vec].dataType.containsNull)
    rows = df.select(F.col(id_col).alias("_id"), (F.col(vec) if single else F.col(vec).cast("array<double>")).alias("_x"))
    ok = (F.size("_x") > 0) & ~F.exists("_x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    if metric == "cosine":
        norm = F.sqrt(F.aggregate("_x", F.lit(0.0), lambda s, v: s + v * v))
        ok, rows, radius = ok & (norm > 0), rows.withColumn("_x", F.transform("_x", lambda v: v / norm)), float(np.sqrt(2 * eps))
        ok = F.exists("_x", lambda v: v.isNotNull() & ~F.isnan(v)) & ~F.exists("_x", lambda v: v.isNull() | F.isnan(v))
    else:
        radius = float(eps)
    size = rows.filter(ok).groupBy(F.size("_x").alias("_d")).count().orderBy(F.desc("count"), "_d").limit(1).collect()
    width = size[0]["_d"] if size else -1
    known = rows.filter(F.coalesce(ok, F.lit(False)) & (F.size("_x") == width))
    keys = {"_h1": F.xxhash64("_x"), "_h2": F.xxhash64(F.lit("vector"), "_x")}
    classes = written(known.withColumns(keys).groupBy("_h1", "_h2").agg(F.min("_id").alias("_id"), F.count(F.lit(1)).alias("_w"), F.any_value("_x").alias("_x")))
    first = classes.orderBy(F.xxhash64("_id"), "_id").limit(PIVOTS).collect()
    pivots = np.array([r["_x"] for r in first], float) if first else np.zeros((1, 1))
    id_type = rows.schema["_id"].dataType.simpleString()

    def met(key, table):
        """Rows of counts (_id, _n), links of sure cores (_id, _to, _sure) and other links."""
        own, same = table.column("_own").to_numpy(), key[0] == key[1]
        left, right = (table.filter(pa.array(own == k.as_py())) for k in key)
        v, w = (t.column("_w").to_numpy() for t in (left, right))
        ids = left.column("_id").combine_chunks()
        ids = ids if same else pa.concat_arrays([ids, right.column("_id").combine_chunks()])
        pairs = _near_pairs(_matrix(left.column("_x")), _matrix(right.column("_x")), radius, same) if len(v) and len(w) else ()
        n, a, b, c, d = _linked(v, w, pairs, min_samples, same)
        n = n + v if same else n
        counted = np.flatnonzero(n)
        taken = [pa.array(np.concatenate([counted, a, c])), pa.array(np.concatenate([counted, b, d]), mask=np.arange(len(counted) + len(b) + len(d)) < len(counted))]
        more = np.zeros(len(a) + len(c), np.int64)
        return pa.table({"_id": ids.take(taken[0]), "_to": ids.take(taken[1]), "_n": pa.array(np.concatenate([n[counted], more])), "_sure": pa.array(np.arange(len(counted) + len(more)) < len(counted) + len(a))})

    placed = written(_cells(classes.select("_id", "_x", "_w"), pivots, radius))
    blocks = _blocks(placed, max(1, min(CHUNK, COMPONENTS // max(width, 1))))
    found = written(blocks.groupBy("_i", "_j").applyInArrow(met, f"_id {id_type}, _to {id_type}, _n long, _sure boolean"))
    near = found.filter("_to IS NULL").groupBy("_id").agg((F.sum("_n") - 1).alias("_n"))
    near = written(near.withColumn("_core", F.col("_n") >= min_samples))
    links = found.filter("_to IS NOT NULL")
    unsure = links.filter("NOT _sure").select("_id", "_to").distinct()
    for end in ("_id", "_to"):
        unsure = unsure.join(near.select(F.col("_id").alias(end), F.col("_core").alias(f"_core{end}")), end)
    unsure = written(unsure.filter("_core_id OR _core_to"))
    both = links.filter("_sure").select("_id", "_to").unionByName(unsure.filter("_core_id AND _core_to").select("_id", "_to"))
    reach = components(both.toDF("src", "dst"))
    named = near.filter("_core").select("_id").join(reach.withColumnRenamed("node", "_id"), "_id", "left").withColumn("component", F.coalesce("component", "_id"))
    named = written(named)
    sides = [F.when(F.col("_core_id"), F.col(a)).otherwise(F.col(b)) for a, b in (("_id", "_to"), ("_to", "_id"))]
    edges = unsure.filter("_core_id <> _core_to").select(sides[0].alias("_id"), sides[1].alias("_edge"))
    border = edges.join(named, "_id").groupBy(F.col("_edge").alias("_id")).agg(F.min("component").alias("component"))
    told = near.join(named.unionByName(border), "_id", "left")
    info = classes.select("_h1", "_h2", "_id").join(told, "_id").drop("_id").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    # A class may hold a third of all rows: they meet SALTS copies of its row.
    out = rows.withColumns(keys | {"_salt": F.pmod(F.xxhash64("_id"), F.lit(SALTS)).cast("int")}).join(info, ["_h1", "_h2", "_salt"], "left")
    kind = F.when(F.col("_core"), "core").when(F.col("component").isNotNull(), "border").otherwise("noise")
    return out.select(F.col("_id").alias(id_col), F.coalesce("_n", F.lit(0)).alias("n_near"), kind.alias("kind"), F.col("component").alias("cluster"))


def distance_table(items: DataFrame, id_col: str, distance) -> DataFrame:
    """(a, b, d) for each ordered pair of different items; `distance` gets the two sides' structs. Items are at most ITEMS, which is checked."""
    n = items.count()
    if n > ITEMS:
        raise ValueError(f"{n} items; a hierarchy takes {ITEMS}: cluster rows by k-means first and give the centres")
    side = items.select(F.col(id_col).alias("_id"), F.struct(*items.columns).alias("_row"))
    a, b = (side.withColumnsRenamed({"_id": s, "_row": f"_{s}"}) for s in "ab")
    return a.crossJoin(F.broadcast(b)).filter("a <> b").select("a", "b", distance(F.col("_a"), F.col("_b")).alias("d"))


def linkage(distances: DataFrame, method: str = "complete") -> DataFrame:
    """(first, second, height, size) of every merge of the items in `distances` (a, b, d; both orders): complete, single or average.

    Clusters are named by their smallest item. In each round all pairs of clusters that are each other's nearest merge
    at once, which gives the same tree as merging the closest pair each time, and the table of distances is updated
    by the formula of Lance and Williams: the largest, smallest or weighted mean distance. Equal distances are taken in the order
    of the names.
    """
    if method not in ("complete", "single", "average"):
        raise ValueError(f"unknown method {method!r}")

    def both_ways(half: DataFrame) -> DataFrame:
        """Each distance is worked out once and read from both sides, so they agree to the last bit."""
        kept = written(half)
        return kept.unionByName(kept.select(F.col("b").alias("a"), F.col("a").alias("b"), "d", F.col("nb").alias("na"), F.col("na").alias("nb")))

    table = both_ways(distances.filter("a < b").select("a", "b", F.col("d").cast("double").alias("d"), F.lit(1).cast("long").alias("na"), F.lit(1).cast("long").alias("nb")))
    merges = None
    while not table.isEmpty():
        # Ties are broken by the pair, not by the side, so two clusters agree on which pair is nearer.
        nearest = table.groupBy("a").agg(F.min(F.struct("d", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"), "na", "nb")).alias("_n")).select("a", "_n.*")
        pairs = nearest.groupBy("lo", "hi", "d").agg(F.count(F.lit(1)).alias("_times"), F.max(F.col("na") + F.col("nb")).alias("size")).filter("_times = 2")
        new = written(pairs.select(F.col("lo").alias("first"), F.col("hi").alias("second"), F.col("d").alias("height"), "size"))
        merges = new if merges is None else merges.unionByName(new)
        named = F.broadcast(new.select(F.col("second").alias("_old"), F.col("first").alias("_new")))  # at most as many as items
        moved = table
        for side in ("a", "b"):
            moved = moved.join(named, F.col(side) == F.col("_old"), "left").withColumn(f"_{side}", F.coalesce("_new", side)).drop("_old", "_new")
        weight = F.col("na") * F.col("nb")
        value = {"complete": F.max("d"), "single": F.min("d"), "average": F.sum(F.col("d") * weight) / F.sum(weight)}[method]
        sizes = F.broadcast(new.select(F.col("first").alias("_f"), F.col("size").alias("_s")))
        moved = moved.filter("_a < _b").groupBy(F.col("_a").alias("a"), F.col("_b").alias("b")).agg(value.alias("d"), F.max("na").alias("na"), F.max("nb").alias("nb"))
        for side in ("a", "b"):
            moved = moved.join(sizes, F.col(side) == F.col("_f"), "left").withColumn(f"n{side}", F.coalesce("_s", f"n{side}")).drop("_f", "_s")
        table = both_ways(moved)
    if merges is None:
        return distances.select(F.col("a").alias("first"), F.col("b").alias("second"), F.col("d").cast("double").alias("height"), F.lit(2).cast("long").alias("size"))
    return merges


def cut(items: DataFrame, id_col: str, merges: DataFrame, clusters: int) -> DataFrame:
    """(id, cluster): the items after all merges but the last `clusters` - 1, by height; clusters are named by their smallest item."""
    order = Window.orderBy("height", "first", "second")  # as many rows as items
    ranked = merges.withColumn("_k", F.row_number().over(order))
    done = ranked.filter(F.col("_k") <= F.lit(items.count() - clusters)).select(F.col("second").alias("src"), F.col("first").alias("dst"))
    return items.select(F.col(id_col).alias("node")).join(components(done), "node", "left").select(F.col("node").alias(id_col), F.coalesce("component", "node").alias("cluster"))

