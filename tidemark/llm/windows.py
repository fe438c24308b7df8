"""Removal of word windows that an earlier document has, by super-k-mer partitioning.

Each window of `size` words has a minimiser: the least hash of the short grams in it. Consecutive windows that share
one are a super-k-mer, and travel as one packed string to the minimiser's bucket. A window's bucket depends on its
words alone, so equal windows meet there, where they are sorted and counted exactly.

Three steps keep the traffic small. Buckets that one document has to itself hold no repeated window and are left out
before any text moves. Equal super-k-mers are one, with the smallest id that has it, so that a passage in a third of
all documents travels once for each task. In a bucket with one distinct super-k-mer there is nothing to sort. Buckets
of many windows are dealt anew by window, so no minimiser, however common, fills a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, row_key, same, stored
from .jaccard import mixed
from .repeats import sliding_min

#: Words of a gram, a multiplier for their hashes, and the most windows of a super-k-mer.
GRAM, RATIO, LONGEST = 5, 0x9E3779B97F4A7C15, 64
#: Bytes of text, about, whose words are hashed together.
PART = 1 << 22
#: Windows of a bucket that one task sorts. Larger buckets are dealt by window, in as many parts as that takes.
BUCKET = 1 << 14
#: Copies of the rows of windows of large buckets that several super-k-mers have.
SALTS = 16


class Hashes(dict):
    """Hashes of words, kept for the next time until there are too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 500_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def pieces(raw: bytes, size: int) -> Iterator[tuple[int, list[bytes]]]:
    """(place of the first word, words): a long text comes in parts that overlap by size - 1 words, so each window is in one of them."""
    if len(raw) <= PART:
        yield 0, raw.split()
        return
    place, held, rest = 0, [], b""
    for low in range(0, len(raw), PART):
        chunk = rest + raw[low : low + PART]
        last = low + PART >= len(raw)
        words = chunk.split()
        rest = b""
        if words and not last and not chunk[-1:].isspace():
            rest = words.pop()  # goes on in the next part
        words = held + words
        if len(words) >= size:
            yield place, words
            held = words[len(words) - size + 1 :]
            place += len(words) - size + 1
        else:
            held = words


def super_kmers(words: list[bytes], bounds: np.ndarray, size: int, hashes: Hashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, windows, minimiser) of each super-k-mer of texts that are joined at `bounds`; windows are numbered by their first word in `words`."""
    gram = min(GRAM, size)
    empty = np.empty(0, np.int64)
    lengths = np.diff(bounds)
    count = np.maximum(lengths - size + 1, 0)
    if not count.sum():
        return empty, empty, empty
    one = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    h = one[: len(one) - gram + 1].copy()
    for k in range(1, gram):
        h = h * np.uint64(RATIO) + one[k : len(one) - gram + 1 + k]
    least = sliding_min(mixed(h), size - gram + 1)
    text = np.repeat(np.arange(len(lengths)), count)
    start = np.arange(len(text)) + np.repeat(bounds[:-1] - (np.cumsum(count) - count), count)
    value = least[start]
    new = np.flatnonzero(np.append(True, (value[1:] != value[:-1]) | (text[1:] != text[:-1])))
    run = np.diff(np.append(new, len(start)))
    # Long runs are cut: all pieces but the last have LONGEST windows.
    cuts = -(-run // LONGEST)
    nth = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
    first = np.repeat(new, cuts) + nth * LONGEST
    windows = np.minimum(np.repeat(run, cuts) - nth * LONGEST, LONGEST)
    return start[first], windows, value[first].view(np.int64)


def _groups(batch: pa.RecordBatch, size: int) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]]:
    """Words of texts (the last column), some MB at a time: words, bounds, row and place of each part."""
    words, bounds, rows, places, total = [], [0], [], [], 0
    for row, text in enumerate(batch.column(batch.num_columns - 1)):
        raw = (text.as_py() or "").encode()
        for place, own in pieces(raw, size):
            if len(own) < size:
                continue
            words += own
            bounds.append(len(words))
            rows.append(row)
            places.append(place)
            total += min(len(raw), PART)
            if total >= PART:
                yield words, np.array(bounds), np.array(rows), np.array(places)
                words, bounds, rows, places, total = [], [0], [], [], 0
    if words:
        yield words, np.array(bounds), np.array(rows), np.array(places)


def _found(size: int):
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, digest = Hashes(), xxhash.xxh3_64_intdigest
        for batch in batches:
            for words, bounds, rows, places in _groups(batch, size):
                start, windows, bucket = super_kmers(words, bounds, size, hashes)
                part = np.searchsorted(bounds, start, "right") - 1
                packed = b" ".join(words)
                at = np.cumsum([0, *(len(w) + 1 for w in words)])
                low, high = at[start], at[start + windows + size - 1] - 1
                key = np.array([digest(packed[a:b]) for a, b in zip(low.tolist(), high.tolist(), strict=True)], np.uint64).view(np.int64)
                row, place = pa.array(rows[part]), start - bounds[part] + places[part]
                columns = [place.astype(np.int64), windows.astype(np.int32), bucket, key]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), *map(pa.array, columns)], ["_id", "_row", "_at", "_n", "_bucket", "_key"])

    return found


def _packed(size: int):
    """Of texts and the super-k-mers wanted of them (columns _text, _want), their packed strings."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, total = [], 0
            for text, wanted in zip(*batch.columns, strict=True):
                raw = (text.as_py() or "").encode()
                want = sorted(wanted.as_py(), key=lambda w: w["_at"])
                nth = 0
                for place, words in pieces(raw, size):
                    while nth < len(want) and want[nth]["_at"] <= place + len(words) - size:
                        w = want[nth]
                        low = w["_at"] - place
                        out.append((w["_bucket"], w["_key"], w["_least"], w["_parts"], b" ".join(words[low : low + w["_n"] + size - 1])))
                        total += len(out[-1][-1])
                        nth += 1
                        if total >= PART:
                            yield made(out)
                            out, total = [], 0
            if out:
                yield made(out)

    def made(out: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["_bucket", "_key", "_least", "_parts", "_words"])

    return packed


def _cut_up(size: int):
    """Super-k-mers of large buckets as one row for each window, at its place in the super-k-mer."""

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, place, out = [], [], []
            for r, packed in enumerate(batch.column(4)):
                words = packed.as_py().split()
                for k in range(len(words) - size + 1):
                    row.append(r)
                    place.append(k)
                    out.append(b" ".join(words[k : k + size]))
            taken = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(taken) for c in range(3)), pa.array(place, pa.int32()), pa.array(out, pa.binary())], ["_bucket", "_key", "_least", "_k", "_words"])

    return cut_up


def _sorted(size: int):
    """Rows (_bucket, _key, _least, _words) of whole buckets, in order: for each super-k-mer the smallest id with each of its windows."""

    def judged(rows: list[tuple]) -> pa.RecordBatch:
        windows = []
        for r, (_, _, least, packed) in enumerate(rows):
            words = packed.split()
            windows += [(b" ".join(words[k : k + size]), least, r, k) for k in range(len(words) - size + 1)]
        windows.sort()
        out = [[0] * (len(packed.split()) - size + 1) for *_, packed in rows]
        last, first = None, 0
        for window, least, r, k in windows:
            if window != last:
                last, first = window, least
            out[r][k] = first
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int64()), pa.array([x[1] for x in rows], pa.int64()), pa.array(out, pa.list_(pa.int64()))], ["_bucket", "_key", "_ids"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bucket = [], None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != bucket and len(held) >= 1024:
                    yield judged(held)
                    held = []
                bucket = row[0]
                held.append(row)
        if held:
            yield judged(held)

    return whole


def _least_ids(strings: DataFrame, size: int) -> DataFrame:
    """(_bucket, _key, _ids) of packed super-k-mers: the smallest id that has each window."""
    small = strings.filter(F.col("_parts") == 1).select("_bucket", "_key", "_least", "_words").repartition("_bucket").sortWithinPartitions("_bucket")
    found = small.mapInArrow(_sorted(size), "_bucket long, _key long, _ids array<long>")
    each = stored(strings.filter(F.col("_parts") > 1).mapInArrow(_cut_up(size), "_bucket long, _key long, _least long, _k int, _words binary"), "windows")
    # Only windows that several super-k-mers have can have a smaller id elsewhere; their rows are salted, as one may be in very many.
    several = each.groupBy("_bucket", "_words").agg(F.min("_least").alias("_first"), F.count(F.lit(1)).alias("_in")).filter(F.col("_in") > 1).drop("_in")
    salted = several.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    own = each.withColumn("_salt", F.pmod("_key", F.lit(SALTS)).cast("int")).join(salted, ["_bucket", "_words", "_salt"], "left")
    ids = F.transform(F.array_sort(F.collect_list(F.struct("_k", F.coalesce("_first", "_least").alias("_i")))), lambda x: x["_i"])
    return found.unionByName(own.groupBy("_bucket", "_key").agg(ids.alias("_ids")))


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 13) -> DataFrame:
    """(_id, _row, _runs): for each row that has any, runs (first, last) of windows, by their first words, whose words also start in a row with a smaller id.

    `_row` is `row_key` of the text. A null id counts as the smallest.
    """
    order = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    rows = docs.select(order.alias("_id"), row_key(F.col(text_col)).alias("_row"), F.col(text_col).alias("_text"))
    every = stored(rows.mapInArrow(_found(size), "_id long, _row long, _at long, _n int, _bucket long, _key long"), "super-k-mers")
    shared = every.groupBy("_bucket").agg(F.min("_id").alias("_a"), F.max("_id").alias("_b")).filter(F.col("_a") < F.col("_b")).select("_bucket")
    # Written first, so that the join has a shuffle of its own whose hot buckets Spark can split.
    buckets = stored(shared, "buckets")
    near = stored(every.join(buckets, "_bucket"), "near")
    discard(every)
    discard(buckets)
    dictionary = stored(near.groupBy("_bucket", "_key").agg(F.min("_id").alias("_least"), F.max("_id").alias("_most"), F.min(F.struct("_id", "_row", "_at", "_n")).alias("_first")), "dictionary")
    weight = dictionary.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_kinds"), F.sum("_first._n").alias("_windows")).filter(F.col("_kinds") > 1)
    parts = weight.select("_bucket", F.ceil(F.col("_windows") / BUCKET).cast("int").alias("_parts"))
    want = dictionary.join(parts, "_bucket").select(F.col("_first._id").alias("_wid"), F.col("_first._row").alias("_wrow"), F.struct("_bucket", "_key", "_least", "_parts", "_first._at", "_first._n").alias("_w"))
    want = want.groupBy("_wid", "_wrow").agg(F.collect_list("_w").alias("_want"))
    texts = rows.dropDuplicates(["_id", "_row"]).join(want, same(F.col("_id"), F.col("_wid")) & (F.col("_row") == F.col("_wrow"))).select("_text", "_want")
    strings = stored(texts.mapInArrow(_packed(size), "_bucket long, _key long, _least long, _parts int, _words binary"), "strings")
    ids = stored(_least_ids(strings, size), "ids")
    discard(strings)

    # What a super-k-mer's places need: its own smallest id, or that of each window where windows differ.
    judged = dictionary.select("_bucket", "_key", "_least", "_most").join(ids, ["_bucket", "_key"], "left")
    told = judged.withColumn("_below", F.coalesce(F.array_min("_ids"), F.col("_least"))).filter(F.col("_below") < F.col("_most"))
    told = stored(told.select("_bucket", "_key", "_least", F.when(F.exists("_ids", lambda i: i != F.col("_least")), F.col("_ids")).alias("_ids")), "told")

    def run(k: Column) -> Column:
        return F.struct((F.col("_at") + k).alias("first"), (F.col("_at") + k).alias("last"))

    places = F.sequence(F.lit(0), F.col("_n") - 1)
    single = F.transform(F.filter(places, lambda k: F.get(F.col("_ids"), k) < F.col("_id")), run)
    whole = F.when(F.col("_least") < F.col("_id"), F.array(F.struct(F.col("_at").alias("first"), (F.col("_at") + F.col("_n") - 1).alias("last"))))
    hits = near.join(told, ["_bucket", "_key"]).select("_id", "_row", F.when(F.col("_ids").isNull(), whole).otherwise(single).alias("_runs")).filter(F.size("_runs") > 0)
    found = stored(hits.groupBy("_id", "_row").agg(F.flatten(F.collect_list("_runs")).alias("_runs")), "runs")
    for t in (near, dictionary, ids, told):
        discard(t)
    return found


def _kept(size: int):
    """Columns of any kind, _text, _runs: texts without the words of their windows."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int, str]] = []
            for text, runs in zip(batch.column(1), batch.column(2), strict=True):
                words = (text.as_py() or "").encode().split()
                n, found = len(words), runs.as_py()
                if found:
                    edge = np.zeros(n + 1, np.int64)
                    np.add.at(edge, [r["first"] for r in found], 1)
                    np.add.at(edge, [r["last"] + size for r in found], -1)
                    words = [words[k] for k in np.flatnonzero(np.cumsum(edge)[:n] == 0).tolist()]
                out.append((n, n - len(words), b" ".join(words).decode()))
            columns = [pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_words", "n_removed", "kept"])

    return kept


def remove_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 13) -> DataFrame:
    """Per row of `docs`: doc_id, n_words, n_removed and kept, the words that stay, joined by one space.

    Words are runs of anything but space and \\t to \\r, unchanged. A word goes if a window of `size` consecutive words
    covers it whose words also start in a row with a smaller id; windows are judged on the input. Repeats within
    one text, and in rows of the same id, take nothing away. A null id counts as smaller than all others. Null and
    empty texts have no words, texts of fewer than `size` words no window. Rows with one id and equal texts get equal
    results. An empty table gives an empty one. Other columns of `docs` do not matter.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), row_key(F.col(text_col)).alias("_row"), F.col(text_col).alias("_text"))
    runs = repeated_windows(docs, id_col, text_col, size).select(F.col("_id").alias("_sid"), F.col("_row").alias("_srow"), "_runs")
    found = rows.join(runs, (F.coalesce("_id", F.lit(-(1 << 63))) == F.col("_sid")) & (F.col("_row") == F.col("_srow")), "left").select("_id", "_text", "_runs")
    return found.mapInArrow(_kept(size), "doc_id long, n_words long, n_removed long, kept string")
