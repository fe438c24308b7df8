"""Best-fit packing of tokenized documents into sequences, as a tree of residual packings.

Partitions pack their own pieces best-fit and emit nearly full bins. Underfull bins become the items of
the next round, which deals them to fewer partitions, and so on until one partition is left, or as few bins
as their volume asks for, or a round saves none. A partition never holds more than a block of items at once, so no task grows with
the corpus: with more underfull bins there are more partitions.
"""

from __future__ import annotations

import base64
import math
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored

CAPACITY = 1024
#: Bins from this share of the capacity on are emitted.
NEARLY_FULL = 0.995
#: Items that a task packs at once, and partitions that feed one in the next round.
BLOCK, FAN_IN = 100_000, 8

MEMBER = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("offset", pa.int64())])
BIN = pa.schema([("sequence_id", pa.int64()), ("fill", pa.int64()), ("members", pa.list_(MEMBER))])
BIN_DDL = "sequence_id long, fill long, members array<struct<doc_id:long,piece:int,start:long,length:long,ids_crc32:long,offset:long>>"


def encoding(ranks: bytes, pattern: str, special: dict[str, int]) -> tiktoken.Encoding:
    pairs = (line.split() for line in ranks.splitlines() if line)
    return tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens=special)


_WORKER: dict[str, tiktoken.Encoding] = {}


def token_pieces(docs: DataFrame, ranks_path: str, pattern: str, special: dict[str, int], end_id: int = 2, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's token ids and `end_id`, cut if longer than `capacity`.

    The first piece of a cut document takes the remainder, all others are full. Null and empty texts are
    `end_id` alone. Special strings inside a text are their own ids, as the tokenizer's library has it. Each
    row is a document of its own, repeated rows and those with a null id too; an empty table gives no pieces.
    Other columns may have any names.
    """
    with open(ranks_path, "rb") as f:
        shared, key = docs.sparkSession.sparkContext.broadcast((f.read(), pattern, special)), uuid.uuid4().hex

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _WORKER:
            _WORKER.clear()
            _WORKER[key] = encoding(*shared.value)
        encode = _WORKER[key].encode_to_numpy
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encode(text.as_py() or "", allowed_special="all"), np.uint32(end_id)).astype("<u4")
                cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)] if len(ids) > capacity else [0, len(ids)]
                rows += [(doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(pieces, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins as lists of item numbers: the longest item first, each into the fullest bin that still takes it."""
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    bins: list[list[int]] = []
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by the room that they have left
    rooms = 0  # bit r: some bin has room r
    for i in order:
        n = lengths[i]
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = open_at[room].pop()
            if not open_at[room]:
                rooms &= ~(1 << room)
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        if room > n:
            open_at[room - n].append(b)
            rooms |= 1 << (room - n)
    return bins


def _packer(level: int, capacity: int):
    """Packs each partition's bins, block by block; the order within a block does not depend on how its rows arrived."""

    def merged(items: list[dict], first: int) -> pa.RecordBatch:
        items.sort(key=lambda x: (-x["fill"], [(m["doc_id"] is not None, m["doc_id"] or 0, m["piece"], m["ids_crc32"]) for m in x["members"][:1]]))
        out = []
        for k, own in enumerate(best_fit([x["fill"] for x in items], capacity)):
            members, at = [], 0
            for x in (items[i] for i in own):
                members += [m | {"offset": m["offset"] + at} for m in x["members"]]
                at += x["fill"]
            out.append({"sequence_id": first + k, "fill": at, "members": members})
        return pa.RecordBatch.from_pylist(out, schema=BIN)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = (level << 56) + (TaskContext.get().partitionId() << 32)
        held: list[dict] = []
        for batch in batches:
            held += batch.to_pylist()
            while len(held) >= BLOCK:
                yield (done := merged(held[:BLOCK], first))
                held, first = held[BLOCK:], first + done.num_rows
        if held:
            yield merged(held, first)

    return pack


def pack(pieces: DataFrame, capacity: int = CAPACITY, nearly_full: float = NEARLY_FULL) -> DataFrame:
    """`pieces` (doc_id, piece, start, length, ids_crc32) with sequence_id and offset: gapless from 0 in each sequence.

    Repeated rows are pieces of their own, and pieces of equal length go by id, piece and checksum; null ids
    come first. No pieces give no rows. Lengths are 1 to `capacity`.
    """
    member = F.struct("doc_id", F.col("piece").cast("int").alias("piece"), "start", "length", "ids_crc32", F.lit(0).cast("long").alias("offset"))
    items = pieces.select(F.lit(0).cast("long").alias("sequence_id"), F.col("length").alias("fill"), F.array(member).alias("members"))
    full, level, done = F.col("fill") >= math.ceil(capacity * nearly_full), 0, []
    parts, was = None, None
    while True:
        bins = stored(items.mapInArrow(_packer(level, capacity), BIN_DDL), f"bins{level}")
        # Of the bins of this round those that are full are done, and the others are the items of the next one.
        left = bins.filter(~full)
        volume, count, total = bins.agg(F.coalesce(F.sum(F.when(~full, F.col("fill"))), F.lit(0)), F.count_if(~full), F.count(F.lit(1))).first()
        # Their volume needs so many bins at least; more rounds save nothing then, nor after one that saved none.
        if parts == 1 or count <= -(-volume // capacity) or total == was:
            done.append(bins)
            break
        done.append(bins.filter(full))
        parts, was = max(-(-(parts or bins.rdd.getNumPartitions()) // FAN_IN), -(-count // (BLOCK // 2))), count
        items, level = left.repartition(parts), level + 1
    rows = done[0]
    for more in done[1:]:
        rows = rows.unionByName(more)
    return rows.select("sequence_id", F.inline("members")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
