"""Pairs within buckets, counted block by block so that no bucket meets in one task and no pair becomes a row.

A bucket is cut into chunks by a hash of the id, as many as its weight asks for. Each pair of chunks is a
block, which a Python task verifies as a whole: it returns sums for each row and a spanning forest of the
links, never the links themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINKS = "a long, b long, n long"


def in_blocks(rows: DataFrame, keys: list[str], id_col: str, chunks: Column) -> DataFrame:
    """`rows` of buckets with _own (the row's chunk), _lo and _hi (the block), once for each block of the row."""
    own = rows.withColumn("_chunks", chunks.cast("int")).withColumn("_own", F.pmod(F.xxhash64(F.lit("chunk"), id_col), F.col("_chunks")).cast("int"))
    spread = own.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)))
    return spread.withColumns({"_lo": F.least("_own", "_other"), "_hi": F.greatest("_own", "_other")}).drop("_chunks", "_other")


def by_block(rows: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    order = [*keys, "_lo", "_hi"]
    return rows.repartition(*order).sortWithinPartitions(*order, id_col)


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole blocks, and where each block starts in them (and the end): a block is never cut between two."""
    held: list[pa.RecordBatch] = []
    order = [*keys, "_lo", "_hi"]
    for batch in batches:
        if not batch.num_rows:
            continue
        new = _starts(batch, order)
        if held and _same(held[-1], batch, order):
            new = new[1:]
        # All before the last start is complete.
        cut = int(new[-1]) if len(new) else -1
        if cut < 0:
            held.append(batch)
            continue
        done = [*held, batch.slice(0, cut)] if cut else held
        if done:
            table = pa.Table.from_batches(done).combine_chunks()
            yield table, np.append(_starts(table, order), table.num_rows)
        held = [batch.slice(cut)]
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, np.append(_starts(table, order), table.num_rows)


def _starts(table, order: list[str]) -> np.ndarray:
    change = np.zeros(table.num_rows, bool)
    change[0] = True
    for c in order:
        x = table.column(c).to_numpy(zero_copy_only=False) if isinstance(table, pa.RecordBatch) else table.column(c).to_numpy()
        change[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(change)


def _same(a: pa.RecordBatch, b: pa.RecordBatch, order: list[str]) -> bool:
    return all(a.column(c)[a.num_rows - 1] == b.column(c)[0] for c in order)


def candidates(own: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Local pairs i < j of a block: all of one chunk, or those across two."""
    if lo == hi:
        return np.triu_indices(len(own), 1)
    a, b = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
    return np.repeat(a, len(b)), np.tile(b, len(a))


def links(ids: np.ndarray, weights: np.ndarray, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    """Rows (a, null, n) with the weights that each id is linked to, and (a, b, 0) for a spanning forest."""
    n = np.bincount(i, weights[j], len(ids)) + np.bincount(j, weights[i], len(ids))
    label = np.arange(len(ids))
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        new = new[new]
        if (new == label).all():
            break
        label = new
    counted, joined = np.flatnonzero(n), np.flatnonzero(label != np.arange(len(ids)))
    a = np.concatenate([ids[counted], ids[joined]])
    b = pa.array(np.concatenate([np.zeros(len(counted), np.int64), ids[label[joined]]]), mask=np.arange(len(a)) < len(counted))
    return pa.RecordBatch.from_arrays([pa.array(a), b, pa.array(np.concatenate([n[counted], np.zeros(len(joined))]).astype(np.int64))], ["a", "b", "n"])
