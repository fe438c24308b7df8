"""Removal of repeated byte strings, by prefix-free parsing with content-defined triggers.

A rolling hash over short grams is minimised over a window; the places where a minimum lies are triggers.
Every string of `size` bytes has one, at a place that depends on its bytes alone, so equal strings are
parsed alike wherever they stand. The parse is the triggers in order; the phrase of a trigger is all that
the strings it stands for cover. Phrases overlap by `size` - 1 bytes, so none is a prefix of what follows
another, and each string lies in one phrase of the dictionary. Equal phrases that follow each other, as in
text with a short period, are one run, counted as many times as it holds.

The corpus order of suffixes is needed to depth `size` only, and only up to equality. So phrases are
ranked first by the bytes that all strings of a trigger share (their core), then as a whole. A core that
stands once rules out all its strings; phrases that stand twice repeat as a whole. Only cores with several
phrases have their suffixes compared, once for each phrase of the dictionary: first by stretches of STRETCH
starts, by what all strings of a stretch share and by all that they cover, and one by one only where those
two disagree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, row_key, same, stored
from .jaccard import mixed

#: Bytes that are parsed together. Places fit into PLACE_BITS.
PART, PLACE_BITS = 1 << 22, 24
#: Starts of strings, counted back from the trigger, that are compared together.
STRETCH = 16
_LETTER = np.random.default_rng(1_123).integers(1, 1 << 63, 256, dtype=np.uint64)
_RATIO = 0x9E3779B97F4A7C15


def shape(size: int) -> tuple[int, int]:
    """(gram, window): bytes of a gram, a power of two, and grams that a minimum is taken over."""
    gram = 1 << max(0, (size * 2 // 25).bit_length() - 1)
    return gram, max(1, size * 4 // 5)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A rolling hash of the `gram` bytes from each place on."""
    h, ratio, step = _LETTER[data], _RATIO, 1
    while step < gram:
        h = h[:-step] * np.uint64(ratio) + h[step:]
        ratio, step = ratio * ratio % (1 << 64), 2 * step
    return mixed(h)


def sliding_min(x: np.ndarray, window: int) -> np.ndarray:
    step = 1
    while 2 * step <= window:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    return np.minimum(x[: len(x) - (window - step)], x[window - step :]) if window > step else x


def parse(data: bytes, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(part, trigger, low, high) of each phrase: strings start from low to high. `bounds` are where the parts of `data` start, and its end."""
    gram, window = shape(size)
    empty = np.empty(0, np.int64)
    if len(data) < size:
        return empty, empty, empty, empty
    places = np.uint64((1 << PLACE_BITS) - 1)
    h = gram_hashes(np.frombuffer(data, np.uint8), gram)
    h = (h & ~places) | np.arange(len(h), dtype=np.uint64)
    least = (sliding_min(h, window) & places).astype(np.int64)
    lengths = np.diff(bounds)
    count = np.maximum(lengths - size + 1, 0)
    part = np.repeat(np.arange(len(lengths)), count)
    start = np.arange(len(part)) + np.repeat(bounds[:-1] - (np.cumsum(count) - count), count)
    if not len(start):
        return empty, empty, empty, empty
    trigger = least[start]
    new = np.flatnonzero(np.append(True, (trigger[1:] != trigger[:-1]) | (part[1:] != part[:-1])))
    return part[new], trigger[new], start[new], start[np.append(new[1:], len(start)) - 1]


def _parts(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[bytes, np.ndarray, list[int], list[int], pa.RecordBatch]]:
    """Texts cut into parts that overlap by size - 1 bytes, some MB at a time: data, bounds, row and place of each part."""
    for batch in batches:
        data, rows, places, total = [], [], [], 0

        def packed():
            return b"".join(data), np.cumsum([0, *map(len, data)]), rows, places, batch

        for row, text in enumerate(batch.column(batch.num_columns - 1)):
            raw = (text.as_py() or "").encode()
            if len(raw) < size:
                continue
            for low in range(0, len(raw) - size + 1, PART):
                piece = raw[low : low + PART + size - 1]
                if total and total + len(piece) > PART:
                    yield packed()
                    data, rows, places, total = [], [], [], 0
                data.append(piece)
                rows.append(row)
                places.append(low)
                total += len(piece)
        if data:
            yield packed()


def _phrases(size: int):
    core = size - shape(size)[1] + 1

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for data, bounds, rows, places, batch in _parts(batches, size):
            part, trigger, low, high = parse(data, bounds, size)
            g = np.array([digest(data[t : t + core]) for t in trigger.tolist()], np.uint64).view(np.int64)
            f = np.array([digest(data[a : b + size], 1) for a, b in zip(low.tolist(), high.tolist(), strict=True)], np.uint64).view(np.int64)
            new = np.flatnonzero(np.append(True, (g[1:] != g[:-1]) | (f[1:] != f[:-1]) | (part[1:] != part[:-1])))[: len(g)]
            times = np.diff(np.append(new, len(g)))
            part, trigger, low, high, g, f = (x[new] for x in (part, trigger, low, high, g, f))
            row, shift = np.array(rows, np.int64)[part], (np.array(places, np.int64) - bounds[:-1])[part]
            columns = [low + shift, (high - low).astype(np.int32), (trigger - low).astype(np.int32), g, f, times]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), *map(pa.array, columns)], ["_id", "_row", "_low", "_more", "_trigger", "_g", "_f", "_times"])

    return phrases


def _suffixes(size: int):
    """Of texts and the phrases wanted of them (columns _text, _want), a row for each stretch of starts.

    _at is the stretch's first start in the phrase, _inner a hash of the bytes that all strings of the whole
    stretch share, _outer one of all bytes that those of this phrase cover, _strings their hashes one by one.
    """

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            rows: list[tuple] = []
            for text, wanted in zip(*batch.columns, strict=True):
                raw = (text.as_py() or "").encode()
                for w in wanted.as_py():
                    low, trigger = w["_low"], w["_low"] + w["_trigger"]
                    last = low + w["_more"]
                    for k in range((trigger - last) // STRETCH, (trigger - low) // STRETCH + 1):
                        end = trigger - k * STRETCH  # the stretch's last start if the phrase goes on
                        a, b = max(low, end - STRETCH + 1), min(last, end)
                        inner = digest(raw[end : end - STRETCH + 1 + size], 3)
                        rows.append((w["_g"], w["_f"], w["_single"], a - low, inner, digest(raw[a : b + size], 4), [digest(raw[s : s + size], 2) for s in range(a, b + 1)]))
                if len(rows) >= 1 << 14:
                    yield packed(rows)
                    rows = []
            if rows:
                yield packed(rows)

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        g, f, single, at, inner, outer, strings = zip(*rows, strict=True)
        inner, outer, flat = (np.array(x, np.uint64).view(np.int64) for x in (inner, outer, [h for own in strings for h in own]))
        ends = np.cumsum([0, *map(len, strings)], dtype=np.int32)
        return pa.RecordBatch.from_arrays(
            [pa.array(g, pa.int64()), pa.array(f, pa.int64()), pa.array(single, pa.bool_()), pa.array(at, pa.int32()), pa.array(inner), pa.array(outer), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
            ["_g", "_f", "_single", "_at", "_inner", "_outer", "_strings"],
        )

    return suffixes


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns _id, _text, _spans: texts without the bytes of their spans."""
    for batch in batches:
        out: list[tuple[int, int, int, bytes]] = []
        for text, spans in zip(batch.column(1), batch.column(2), strict=True):
            raw = (text.as_py() or "").encode()
            kept, at, removed, runs = [], 0, 0, 0
            end = -1
            for s in sorted((s["start"], s["end"]) for s in spans.as_py() or ()):
                if s[0] > end:
                    runs += 1
                    kept.append(raw[at : s[0]])
                    removed += s[1] - s[0]
                elif s[1] > end:
                    removed += s[1] - end
                end = at = max(end, s[1])
            kept.append(raw[at:])
            out.append((len(raw), removed, runs, b"".join(kept)))
        columns = [pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def _shared_starts(suffixes: DataFrame) -> DataFrame:
    """(_g, _f, _at, _n): stretches of starts, or single ones, of phrases that stand once whose strings another phrase has too."""

    def several(rows: DataFrame, key: str) -> DataFrame:
        found = rows.groupBy("_g", key).agg(F.min("_f").alias("_least"), F.max("_f").alias("_most"))
        return found.filter(F.col("_least") != F.col("_most")).select("_g", key, "_least")

    # What no other phrase shares the middle of has no shared string.
    near = stored(suffixes.join(several(suffixes, "_inner").drop("_least"), ["_g", "_inner"]).drop("_inner"), "stretches")
    discard(suffixes)
    alike = several(near.select("_g", "_f", "_outer"), "_outer")
    marked = stored(near.join(alike, ["_g", "_outer"], "left").drop("_outer"), "marked")
    discard(near)
    whole = marked.filter(F.col("_single") & F.col("_least").isNotNull()).select("_g", "_f", "_at", F.size("_strings").alias("_n"))
    # Strings of stretches that are not alike as a whole meet each other, and those of one phrase of each that is.
    open_ = marked.filter(F.col("_least").isNull() | (F.col("_least") == F.col("_f")))
    strings = open_.select("_g", "_f", (F.col("_single") & F.col("_least").isNull()).alias("_open"), "_at", F.posexplode("_strings").alias("_k", "_h"))
    twice = several(strings.select("_g", "_f", "_h"), "_h").drop("_least")
    part = strings.filter("_open").join(twice, ["_g", "_h"]).select("_g", "_f", (F.col("_at") + F.col("_k")).alias("_at"), F.lit(1).alias("_n"))
    found = stored(whole.unionByName(part), "shared")
    discard(marked)
    return found


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 200) -> DataFrame:
    """(_id, _row, _spans): for each row that has any, spans (start, end) of UTF-8 bytes that strings of `size` bytes cover which start anywhere else too. They are apart."""
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), row_key(F.col(text_col)).alias("_row"), F.col(text_col).alias("_text"))
    phrases = stored(rows.mapInArrow(_phrases(size), "_id long, _row long, _low long, _more int, _trigger int, _g long, _f long, _times long"), "phrases")
    # Written first, so that the join has a shuffle of its own whose hot cores Spark can split.
    cores = stored(phrases.groupBy("_g").agg(F.sum("_times").alias("_in")).filter(F.col("_in") > 1).select("_g"), "cores")
    near = stored(phrases.join(cores, "_g"), "near")
    discard(phrases)
    discard(cores)
    dictionary = stored(near.groupBy("_g", "_f").agg(F.sum("_times").alias("_in"), F.min(F.struct("_id", "_row", "_low", "_more", "_trigger")).alias("_first")), "dictionary")
    several = dictionary.groupBy("_g").agg(F.count(F.lit(1)).alias("_kinds")).filter(F.col("_kinds") > 1).select("_g")

    want = dictionary.join(several, "_g").select(F.col("_first._id").alias("_wid"), F.col("_first._row").alias("_wrow"), F.struct("_first._low", "_first._more", "_first._trigger", "_g", "_f", (F.col("_in") == 1).alias("_single")).alias("_w"))
    want = want.groupBy("_wid", "_wrow").agg(F.collect_list("_w").alias("_want"))
    texts = rows.join(want, same(F.col("_id"), F.col("_wid")) & (F.col("_row") == F.col("_wrow"))).select("_text", "_want")
    schema = "_g long, _f long, _single boolean, _at int, _inner long, _outer long, _strings array<long>"
    shared = _shared_starts(stored(texts.mapInArrow(_suffixes(size), schema), "suffixes"))

    whole = near.join(dictionary.filter(F.col("_in") > 1).select("_g", "_f"), ["_g", "_f"])
    whole = whole.select("_id", "_row", F.col("_low").alias("start"), (F.col("_low") + (F.col("_more") + 1) * F.col("_times") - 1 + size).alias("end"))
    start = F.col("_first._low") + F.col("_at")
    part = dictionary.filter(F.col("_in") == 1).join(shared, ["_g", "_f"]).select("_first._id", "_first._row", start.alias("start"), (start + F.col("_n") - 1 + size).alias("end"))
    # Spans that meet are one, before a text's spans come together.
    joined = whole.unionByName(part)
    so_far = F.max("end").over(Window.partitionBy("_id", "_row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))
    numbered = joined.withColumn("_new", F.when(F.col("start") <= so_far, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(Window.partitionBy("_id", "_row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)))
    merged = numbered.groupBy("_id", "_row", "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    spans = merged.groupBy("_id", "_row").agg(F.collect_set(F.struct("start", "end")).alias("_spans"))
    found = stored(spans, "spans")
    for table in (near, dictionary, shared):
        discard(table)
    return found


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 200) -> DataFrame:
    """Per row of `docs`: doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept, the bytes that stay.

    A byte goes if a string of `size` bytes covers it that also starts anywhere else, in the same text or in
    another; strings never cross texts and are judged on the input. Null and empty texts have no bytes.
    Rows with equal ids and texts, a null id being an id like others, are texts of their own and repeat
    each other. An empty table gives an empty one. Other columns of `docs` do not matter.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), row_key(F.col(text_col)).alias("_row"), F.col(text_col).alias("_text"))
    spans = repeated_spans(docs, id_col, text_col, size).withColumnsRenamed({"_id": "_sid", "_row": "_srow"})
    found = rows.join(spans, same(F.col("_id"), F.col("_sid")) & (F.col("_row") == F.col("_srow")), "left").select("_id", "_text", "_spans")
    return found.mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
