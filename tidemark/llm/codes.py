"""Product codes of vectors in exact integer arithmetic, with the nearest entry found by annular pruning.

Vectors are cut into equal parts; each part position has a codebook, refined by rounds of assigning every part to
its nearest entry and moving each entry to the mean of its parts. Entries are sorted by their norms. The entry
whose norm is closest to that of a part gives a first distance; by the triangle inequality only entries whose
norms differ from the part's by no more than that can be as near, an interval that a binary search finds in the
sorted norms. Only these are evaluated, both ends included, and what comes closer narrows the interval further.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType

from .common import stored

#: Rows whose distances are worked out together in a task.
ROWS = 4096
#: A label with this share of the rows is frequent, so there are at most as many such labels.
FREQUENT = 1000


class Annulus:
    """Entries (k, d) of integers, sorted by norm, for exact nearest searches."""

    def __init__(self, entries: np.ndarray):
        norms = np.sqrt((entries.astype(float) ** 2).sum(1))
        self.order = np.argsort(norms, kind="stable")
        self.entries, self.norms = entries[self.order], norms[self.order]

    def interval(self, norm: np.ndarray, squared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first and the last place of entries that may be as near as sqrt(squared), rounding errors included."""
        reach = np.sqrt(squared.astype(float)) * (1 + 1e-12) + norm * 1e-12 + 1e-6
        return np.searchsorted(self.norms, norm - reach, "left"), np.searchsorted(self.norms, norm + reach, "right") - 1

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of the nearest entry of each row of `x`; ties go to the lower index."""

        def squares(rows: np.ndarray, places: np.ndarray) -> np.ndarray:
            gap = x[rows] - self.entries[places]
            return np.einsum("ij,ij->i", gap, gap)

        every = np.arange(len(x))
        norm = np.sqrt((x.astype(float) ** 2).sum(1))
        right = np.clip(np.searchsorted(self.norms, norm), 0, len(self.norms) - 1)
        left = np.maximum(right - 1, 0)
        start = np.where(np.abs(self.norms[left] - norm) <= np.abs(self.norms[right] - norm), left, right)
        best, index = squares(every, start), self.order[start]
        low, high = self.interval(norm, best)
        for side in (-1, 1):
            at, active = start + side, every
            while True:
                active = active[(at[active] >= low[active]) & (at[active] <= high[active])]
                if not len(active):
                    break
                found, place = squares(active, at[active]), self.order[at[active]]
                better = (found < best[active]) | ((found == best[active]) & (place < index[active]))
                rows = active[better]
                best[rows], index[rows] = found[better], place[better]
                low[rows], high[rows] = self.interval(norm[rows], best[rows])
                at[active] += side
        return index, best


def _scaled(x: Column, scale: int) -> Column:
    return F.floor(x.cast("double") * scale)


def _batches(batches: Iterator[pa.RecordBatch], column: int, dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for low in range(0, batch.num_rows, ROWS):
            piece = batch.slice(low, ROWS)
            yield piece, np.asarray(piece.column(column).flatten().to_numpy(zero_copy_only=False), np.int64).reshape(-1, dim)


def _moved(rows: DataFrame, books: list[list[list[int]]], dim: int) -> list[list[list[int]]]:
    """The codebooks after one round: each task sums its rows by entry, so as many numbers come together as entries have components for each task."""
    parts, width = len(books), dim // len(books)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = [Annulus(np.array(b, np.int64)) for b in books]
        size = len(books[0])
        total, count = np.zeros((parts, size, width), np.int64), np.zeros((parts, size), np.int64)
        for _, x in _batches(batches, 0, dim):
            for p, search in enumerate(searches):
                part = x[:, p * width : (p + 1) * width]
                index, _ = search.nearest(part)
                np.add.at(total[p], index, part)
                count[p] += np.bincount(index, minlength=size)
        p, e = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(e), pa.array(count[p, e]), pa.array(list(total[p, e]), pa.list_(pa.int64()))], ["p", "e", "n", "total"])

    found = rows.select("_x").mapInArrow(sums, "p long, e long, n long, total array<long>")
    exact = [F.sum(F.get("total", i).cast("decimal(38,0)")).alias(f"t{i}") for i in range(width)]
    out = [[list(entry) for entry in book] for book in books]
    for r in found.groupBy("p", "e").agg(F.sum("n").alias("n"), *exact).collect():
        out[r["p"]][r["e"]] = [int(r[f"t{i}"]) // r["n"] for i in range(width)]
    return out


def _coded(rows: DataFrame, books: list[list[list[int]]], dim: int) -> DataFrame:
    """(_id, label, codes, error) of rows (_id, label, _x)."""
    width = dim // len(books)
    schema = rows.select("_id", "label").schema.add("codes", ArrayType(IntegerType())).add("error", LongType())

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = [Annulus(np.array(b, np.int64)) for b in books]
        for batch, x in _batches(batches, 2, dim):
            found = [s.nearest(x[:, p * width : (p + 1) * width]) for p, s in enumerate(searches)]
            codes = np.stack([index for index, _ in found], 1).astype(np.int32)
            error = sum(d for _, d in found)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, codes.size + 1, codes.shape[1], dtype=np.int32)), pa.array(codes.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists, pa.array(error)], ["_id", "label", "codes", "error"])

    return rows.select("_id", "label", "_x").mapInArrow(assigned, schema)


def with_label_errors(rows: DataFrame) -> DataFrame:
    """`rows` with label_error, the sum of `error` over equal labels, nulls together.

    Sums of frequent labels are broadcast, of which there are at most FREQUENT; the others meet their rows by a shuffle.
    """
    key = F.struct("label")
    sums = stored(rows.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("_sum"), F.count(F.lit(1)).alias("_rows")), "label-sums")
    total = sums.agg(F.sum("_rows")).first()[0] or 0
    value = F.expr("try_cast(_sum AS bigint)").alias("label_error")
    named = sums.select(key.alias("_key"), value, (F.col("_rows") * FREQUENT >= total).alias("_often"))
    often, others = (named.filter(c).drop("_often") for c in (F.col("_often"), ~F.col("_often")))
    keyed = rows.withColumn("_key", key)
    return keyed.join(F.broadcast(often), "_key").unionByName(keyed.join(F.broadcast(often), "_key", "left_anti").join(others, "_key")).drop("_key")


def compress(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> tuple[DataFrame, list[list[list[int]]]]:
    """(rows, codebooks): per kept row `id_col`, label, codes (an entry for each part), error and label_error; codebooks by part, entry and component.

    Components become floor(scale * x). Each part's codebook starts as that part of the `entries` smallest kept ids
    (null ids last, equal ids by their vectors), or of all if there are fewer. Each of `rounds` rounds assigns every part to
    the nearest entry, ties to the lower index, and moves each entry to floor(sum / count) of its parts; entries
    without parts stay. `error` sums the squared distances of the last assignment over the parts, label_error the
    errors of equal labels, null being one label.

    Rows are dropped if their vector is null or empty, holds null or non-finite components, has another number of components than
    the smallest kept id's, or holds a component so large that an error might not fit a long (46 000 at 64 components).
    Vectors of a length that `parts` does not divide are filled up with zeros.
    Repeated rows are rows of their own. An empty table gives an empty one and no codebooks. Further columns do not matter.
    """
    vec = F.col(vec_col).cast("array<double>")
    limit = F.sqrt(F.lit(2.0**63) / F.size(vec)) / 2 - 1
    fine = (F.size(vec) > 0) & ~F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.forall(vec, lambda x: F.abs(x * scale) < limit)
    known = df.filter(F.coalesce(vec.isNotNull() & fine, F.lit(False)))
    whole = F.transform(vec, lambda x: _scaled(x, scale))
    filled = F.concat(whole, F.array_repeat(F.lit(0).cast("long"), F.pmod(-F.size(vec), F.lit(parts))))
    rows = stored(known.select(F.col(id_col).alias("_id"), F.col(label_col).alias("label"), F.size(vec).alias("_d"), filled.alias("_x")), "vectors")
    order = [F.col("_id").asc_nulls_last(), F.col("_x")]
    least = rows.orderBy(*order).limit(1).collect()
    if not least:
        empty = rows.select(F.col("_id").alias(id_col), "label", F.array().cast("array<int>").alias("codes"), *[F.lit(None).cast("long").alias(c) for c in ("error", "label_error")])
        return empty, []
    rows = rows.filter(F.col("_d") == least[0]["_d"])
    first = [r["_x"] for r in rows.orderBy(*order).limit(entries).collect()]
    dim = len(first[0])
    width = dim // parts
    books = [[x[p * width : (p + 1) * width] for x in first] for p in range(parts)]
    for _ in range(rounds):
        books = _moved(rows, books, dim)
    coded = stored(_coded(rows, books, dim), "codes")
    return with_label_errors(coded).select(F.col("_id").alias(id_col), "label", "codes", "error", "label_error"), books


def codebooks_digest(books: list[list[list[int]]]) -> str:
    return hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
