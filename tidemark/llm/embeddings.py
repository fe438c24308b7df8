"""Near-duplicate vectors by cross-polytope hashing with multiprobe buckets and verified pairs.

Unit vectors are rotated pseudo-randomly (three rounds of random signs and a fast Hadamard transform); the
largest coordinate and its sign are a hash. Each table joins several hashes into a bucket. A vector is
stored in its own bucket and looks also into the buckets that small changes would move it to. Pairs that
meet are verified by their exact cosine. The number of hashes of a table grows with the logarithm of the
number of vectors, so buckets of unrelated vectors stay small; the number of tables follows from the recall
that is asked for at the threshold.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks
from .common import stored
from .graph import components, least_ids

#: Rows of a chunk of a bucket.
CHUNK = 512
#: Copies of each class's row when vectors meet their class: a class may hold a third of all vectors.
SALTS = 16


class CrossPolytope:
    """Hash functions for vectors of `dim` components: `tables` buckets of `width` hashes, with `probes` more to look into."""

    def __init__(self, dim: int, width: int, tables: int, probes: int, seed: int = 7):
        self.size = 1 << max(1, (dim - 1).bit_length())
        self.width, self.tables, self.probes = width, tables, probes
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], (tables * width, 3, self.size))

    def rotated(self, unit: np.ndarray, k: int) -> np.ndarray:
        x = np.zeros((len(unit), self.size))
        x[:, : unit.shape[1]] = unit
        for signs in self.signs[k]:
            x *= signs
            step = 1
            while step < self.size:
                y = x.reshape(len(x), -1, 2, step)
                x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(len(x), self.size)
                step *= 2
            x /= math.sqrt(self.size)
        return x

    def codes(self, unit: np.ndarray) -> np.ndarray:
        """(rows, tables, 1 + probes): the own bucket, then those to look into, nearest first."""
        n, base, depth = len(unit), 2 * self.size, min(4, self.size)
        out = np.empty((n, self.tables, 1 + self.probes), np.int64)
        moves = [((j, r),) for j in range(self.width) for r in range(1, depth)] + [((j, 1), (k, 1)) for j, k in combinations(range(self.width), 2)]
        for t in range(self.tables):
            code, gap = np.empty((n, self.width, depth), np.int64), np.empty((n, self.width, depth))
            for j in range(self.width):
                y = self.rotated(unit, t * self.width + j)
                top = np.argsort(-np.abs(y), axis=1, kind="stable")[:, :depth]
                value = np.take_along_axis(y, top, 1)
                code[:, j] = (2 * top + (value < 0)) * base**j
                gap[:, j] = np.abs(value[:, :1]) - np.abs(value)
            own = code[:, :, 0].sum(1)
            cost = np.stack([sum(gap[:, j, r] ** 2 for j, r in m) for m in moves], 1)
            moved = np.stack([own + sum(code[:, j, r] - code[:, j, 0] for j, r in m) for m in moves], 1)
            best = np.argsort(cost, axis=1, kind="stable")[:, : self.probes]
            out[:, t, 0] = own
            out[:, t, 1:] = np.take_along_axis(moved, best, 1)
        return out + (np.arange(self.tables) * base**self.width)[None, :, None]


def meeting(codes: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The bucket in which a pair counts: where one is stored and the other looks, in the first such table; -1 if nowhere."""
    a, b = codes[i], codes[j]
    none = np.iinfo(np.int64).max
    left = np.where((a[:, :, :1] == b).any(2), a[:, :, 0], none)
    right = np.where((b[:, :, :1] == a).any(2), b[:, :, 0], none)
    first = np.minimum(left, right).min(1)  # buckets of earlier tables have smaller numbers
    return np.where(first == none, -1, first)


def plan(dim: int, rows: int, threshold: float, recall: float) -> CrossPolytope:
    """The functions for so many vectors: their recall is measured on random pairs at the threshold, with a fixed seed."""
    size = 1 << max(1, (dim - 1).bit_length())
    width = max(1, math.ceil(math.log(max(2, rows)) / math.log(2 * size)))
    width = min(width, max(1, int(56 / math.log2(2 * size))))
    probes = min(8, width * (min(4, size) - 1))
    rng = np.random.default_rng(11)
    u, v = unit_rows(rng.normal(size=(2000, dim))), rng.normal(size=(2000, dim))
    v = unit_rows(v - (u * v).sum(1, keepdims=True) * u) if dim > 1 else u
    v = threshold * u + math.sqrt(max(0.0, 1 - threshold**2)) * v
    trial = CrossPolytope(dim, width, 1, probes)
    codes = np.concatenate([trial.codes(u), trial.codes(unit_rows(v))])
    p = float((meeting(codes, np.arange(2000), np.arange(2000) + 2000) >= 0).mean())
    tables = max(2, math.ceil(math.log(1 - recall) / math.log(max(1e-9, 1 - min(p, 0.999)))))
    return CrossPolytope(dim, width, tables, probes)


def unit_rows(x: np.ndarray) -> np.ndarray:
    x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-300)
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-300)


def _matrix(column, dim: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), float).reshape(-1, dim)


def _one_dimension(classes: DataFrame, dim: int, rows: int, threshold: float, recall: float) -> DataFrame:
    """Links (a, b, n) between classes (_rep, _size, _vec) whose vectors have `dim` components."""
    functions = plan(dim, rows, threshold, recall)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                codes = functions.codes(unit_rows(_matrix(batch.column(1), dim))).reshape(batch.num_rows, -1)
                each = functions.tables * (1 + functions.probes)
                home = np.tile(np.arange(each) % (1 + functions.probes) == 0, batch.num_rows)
                yield pa.RecordBatch.from_arrays([pa.array(codes.ravel()), pa.array(np.repeat(batch.column(0).to_numpy(), each)), pa.array(home)], ["_bucket", "_rep", "_home"])

    places = stored(classes.select("_rep", "_vec").mapInArrow(hashed, "_bucket long, _rep long, _home boolean"), "places")
    met = places.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_in"), F.max("_home").alias("_stored"), F.min("_rep").alias("_a"), F.max("_rep").alias("_b"))
    met = met.filter(F.col("_stored") & (F.col("_a") != F.col("_b"))).select("_bucket", "_in")
    rows = blocks.in_blocks(places.join(met, "_bucket"), ["_bucket"], "_rep", F.ceil(F.col("_in") / CHUNK))
    full = rows.select("_bucket", "_lo", "_hi", "_own", "_rep").join(classes.select("_rep", "_size", "_vec"), "_rep")

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in blocks.runs(batches, ["_bucket"]):
            unit, ids, size = unit_rows(_matrix(table.column("_vec").combine_chunks(), dim)), table.column("_rep").to_numpy(), table.column("_size").to_numpy()
            own, lo, hi, at = (table.column(c).to_numpy() for c in ("_own", "_lo", "_hi", "_bucket"))
            left, right = [], []
            for a, b in zip(starts, starts[1:], strict=False):
                if b - a > 64:
                    near = np.triu((unit[a:b] @ unit[a:b].T) >= threshold - 1e-9, 1)
                    i, j = np.nonzero(near)
                    if lo[a] != hi[a]:
                        i, j = (x[own[a:b][i] != own[a:b][j]] for x in (i, j))
                else:
                    i, j = blocks.candidates(own[a:b], lo[a], hi[a])
                left.append(i + a)
                right.append(j + a)
            i, j = np.concatenate(left), np.concatenate(right)
            for k in range(0, len(i), 1 << 16):  # bounds what the checks below hold at once
                x, y = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
                near = (unit[x] * unit[y]).sum(1) >= threshold
                x, y = x[near], y[near]
                if len(x):
                    some, where = np.unique(np.concatenate([x, y]), return_inverse=True)
                    here = meeting(functions.codes(unit[some]), where[: len(x)], where[len(x) :]) == at[x]
                    x, y = x[here], y[here]
                    if len(x):
                        yield blocks.links(ids, size, x, y)

    return blocks.by_block(full, ["_bucket"], "_rep").mapInArrow(verified, blocks.LINKS)


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.95, recall: float = 0.999) -> DataFrame:
    """Per row of `df`: vec_id, n_links (other rows with a cosine of `threshold` or more), component_id and kept.

    Equal vectors are one class, keyed by its hashes, whose pairs are counted and never listed. `recall` is the expected share of links that are found at the threshold itself. Null, empty
    and zero vectors, those with null or non-finite components and rows with a null id link with nothing
    and are kept; vectors are compared with those of as many components. Repeated ids are rows of their
    own. An empty table gives an empty one.
    """
    vec = F.col(vec_col).cast("array<double>")
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ok = F.coalesce(F.col(id_col).isNotNull() & (F.size(vec) > 0) & ~bad & F.exists(vec, lambda x: x != 0), F.lit(False))
    rows = df.select(F.col(id_col).cast("long").alias("_id"), F.when(ok, vec).alias("_vec"))
    rows = rows.withColumns({"_h1": F.when(F.col("_vec").isNotNull(), F.xxhash64("_vec")), "_h2": F.when(F.col("_vec").isNotNull(), F.xxhash64(F.lit("vector"), "_vec"))})
    found = rows.filter(F.col("_vec").isNotNull()).groupBy("_h1", "_h2").agg(F.min("_id").alias("_least"), F.count(F.lit(1)).alias("_size"), F.any_value("_vec").alias("_vec"))
    classes = stored(found.withColumn("_rep", F.xxhash64("_h1", "_h2")), "classes")
    links = None
    for dim, n in sorted(map(tuple, classes.groupBy(F.size("_vec")).count().collect())):
        own = _one_dimension(classes.filter(F.size("_vec") == dim), dim, n, threshold, recall)
        links = own if links is None else links.unionByName(own)
    if links is None:
        return rows.select(F.col("_id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("_id").alias("component_id"), F.lit(True).alias("kept"))
    links = stored(links, "links")
    counts = links.filter(F.col("b").isNull()).groupBy(F.col("a").alias("_rep")).agg(F.sum("n").alias("_n"))
    reach = least_ids(components(links.filter(F.col("b").isNotNull())), classes, SALTS)
    info = classes.select("_h1", "_h2", "_rep", "_least", "_size").join(counts, "_rep", "left").join(reach, "_rep", "left")
    info = info.select("_h1", "_h2", (F.col("_size") - 1 + F.coalesce("_n", F.lit(0))).alias("_links"), F.coalesce("component", "_least").alias("_component"))
    salted = info.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    out = rows.withColumn("_salt", F.pmod(F.xxhash64("_id"), F.lit(SALTS)).cast("int")).join(salted, ["_h1", "_h2", "_salt"], "left")
    component = F.coalesce("_component", "_id")
    return out.select(F.col("_id").alias("vec_id"), F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("_id"), F.lit(True)).alias("kept"))
