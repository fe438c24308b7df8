"""Near-duplicate texts: a similarity join of word shingles by a MinHash LSH forest with exact verification.

Each class of texts with equal shingle sets has a signature for each tree: DEPTH minima of a byte each, in one
long. The forest is the table of signatures, sorted by tree and signature; in it every node of a tree's prefix
trie is one run of rows. Classes that share a node meet. The first round takes whole signatures. What its
verified pairs tell of all pairs at each similarity says how short the prefixes have to be for the share of
lost pairs that is allowed; the next round takes nodes of that depth, and so on until the target recall is
reached. A pair is verified once, on its whole shingle sets, at the deepest prefix by which it meets.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks
from .common import discard, row_key, stored
from .graph import components, least_ids

#: Trees, values of a signature (a byte each), and the shortest prefix that is tried.
TREES, DEPTH, SHORTEST = 16, 8, 4
#: Trees by which nodes without a new pair are told early.
TOLD_BY = 4
#: Similarities are counted in steps of 1 / STEPS.
STEPS = 200
#: Rows, and shingles, of a chunk of a bucket.
CHUNK_ROWS, CHUNK_SHINGLES = 256, 1 << 17
#: Copies of each class's row when documents meet their class: a class may hold a third of all documents.
SALTS = 16

_BYTES = np.arange(256, dtype=np.uint8)
_LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
_IN_WORD = (_LOWER >= 128) | ((_LOWER >= 97) & (_LOWER <= 122)) | ((_LOWER >= 48) & (_LOWER <= 57))
_RANDOM = np.random.default_rng(20_240_601)
_LETTER = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64)[_LOWER]
_RATIO, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_PLACE = _RANDOM.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_PERMUTE = _RANDOM.integers(0, 1 << 32, (TREES * DEPTH, 2), dtype=np.uint32) | np.array([1, 0], np.uint32)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * _RATIO
    return x ^ (x >> np.uint64(32))


def recall_at(similarity: float, depth: int, trees: int = TREES) -> float:
    """The chance that a pair shares a prefix of `depth` values in a tree at least."""
    return 1 - (1 - similarity**depth) ** trees


def next_depth(found: dict[int, int], depth: int, threshold: float, recall: float) -> int:
    """The longest prefix that loses at most 1 - `recall` of all pairs, as far as those found tell; `depth` if it does.

    `found` counts verified pairs by similarity, in steps. Each stands for as many as its chance of being
    found says; one more pair at the threshold stands for those that nothing was found of.
    """
    pairs = [(threshold, 1.0)] + [(max(threshold, step / STEPS), n / recall_at(max(threshold, step / STEPS), depth)) for step, n in found.items()]
    total = sum(n for _, n in pairs)
    return next((d for d in range(depth, SHORTEST, -1) if sum(n * (1 - recall_at(s, d)) for s, n in pairs) <= (1 - recall) * total), SHORTEST)


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Sorted 64-bit shingle hashes of each text. Words are runs of digits, letters and non-ASCII bytes, A-Z lower-cased.

    A text of fewer than `size` words, but not none, has one shingle: all of them.
    """
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    # A blank after each text keeps words apart.
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    ends = np.cumsum(lengths + 1)
    inside = _IN_WORD[data]
    edge = np.diff(inside.view(np.int8), prepend=np.int8(0))
    starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return [np.empty(0, np.uint64)] * len(texts)
    at = np.flatnonzero(inside)
    long = stops - starts
    first = np.cumsum(long) - long
    power = np.cumprod(np.full(int(long.max()), _RATIO))
    words = np.add.reduceat(_LETTER[data[at]] * power[np.arange(len(at)) - np.repeat(first, long)], first)
    words = mixed(words + long.astype(np.uint64))
    bounds = np.searchsorted(starts, np.concatenate([[0], ends]))
    n = len(words)
    whole = max(0, n - size + 1)
    each = np.zeros(whole, np.uint64)
    for k in range(size):
        each += words[k : k + whole] * _PLACE[k]
    each = mixed(each)
    out = []
    for a, b in zip(bounds, bounds[1:], strict=False):
        if b - a >= size:
            out.append(np.unique(each[a : b - size + 1]))
        elif b > a:
            out.append(mixed(np.array([(words[a:b] * _PLACE[: b - a]).sum() + np.uint64(b - a)], np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, TREES): for each tree DEPTH minima, a byte of each, the first one on top; the sets are not empty."""
    out = np.empty((len(sets), TREES), np.uint64)
    low = 0
    while low < len(sets):  # as many sets at once as the processor's cache holds
        high, total = low, 0
        while high < len(sets) and (high == low or total + len(sets[high]) <= 1 << 15):
            total += len(sets[high])
            high += 1
        flat = (np.concatenate(sets[low:high]) >> np.uint64(32)).astype(np.uint32)
        starts = np.cumsum([0, *map(len, sets[low : high - 1])])
        for t in range(TREES):
            key = np.zeros(high - low, np.uint64)
            for a, b in _PERMUTE[t * DEPTH : (t + 1) * DEPTH]:
                least = mixed(np.minimum.reduceat(flat * a + b, starts).astype(np.uint64) + np.uint64(t + 1))
                key = (key << np.uint64(8)) | (least >> np.uint64(56))
            out[low:high, t] = key
        low = high
    return out


def prefix(signature, depth: int):
    """The first `depth` values of signatures, as columns or arrays of signed longs."""
    bits = 8 * (DEPTH - depth)
    return F.shiftright(signature, bits) if isinstance(signature, Column) else signature >> bits


def _bytes(column) -> list[bytes]:
    return [(x.as_py() or "").encode() for x in column]


def _sliced(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Parts of batches with a MB of text each, or one longer text."""
    for batch in batches:
        low, texts = 0, _bytes(batch.column(column))
        while low < len(texts):
            high, total = low, 0
            while high < len(texts) and (high == low or total + len(texts[high]) <= 1 << 20):
                total += len(texts[high])
                high += 1
            yield batch.slice(low, high - low), texts[low:high]
            low = high


def _signed(size: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _sliced(batches, 2):
            sets = shingle_sets(texts, size)
            full = np.array([k for k, s in enumerate(sets) if len(s)], np.int64)
            keys: list = [None] * len(sets)
            for k, row in zip(full, signatures([sets[k] for k in full]).view(np.int64), strict=True):
                keys[k] = row
            one = np.array([s.sum() for s in sets], np.uint64).view(np.int64)
            two = np.array([mixed(s ^ _RATIO).sum() for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(one), pa.array(two), pa.array(keys, pa.list_(pa.int64()))], ["_id", "_row", "_n", "_h1", "_h2", "_keys"])

    return sign


def _shingled(size: int):
    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _sliced(batches, 1):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.view(np.int64) for s in shingle_sets(texts, size)], pa.list_(pa.int64()))], ["_rep", "_set"])

    return shingle


def intersections(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """(n, n): how many values each two of the n sets share; from the values that more than one holds, some at a time."""
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    new = np.append(True, values[1:] != values[:-1])
    run = np.cumsum(new) - 1
    shared = np.bincount(run)[run] > 1
    out = np.zeros((n, n), np.float32)
    owner, new = owner[shared], new[shared]
    if not len(owner):
        return out
    column = np.cumsum(new) - 1
    for low in range(0, int(column[-1]) + 1, 1 << 13):
        a, b = np.searchsorted(column, [low, low + (1 << 13)])
        x = np.zeros((n, int(column[b - 1]) - low + 1), np.float32)
        x[owner[a:b], column[a:b] - low] = 1
        out += x @ x.T
    return out


def _verified(threshold: float, depth: int, was: int | None):
    """Links of pairs that meet at `depth` and not at depth `was`; and rows (null, step, n): pairs of each similarity."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(STEPS + 1, np.int64)
        for table, starts in blocks.runs(batches, ["_tree", "_node"]):
            ids, size, own, lo, hi, tree = (table.column(c).to_numpy() for c in ("_rep", "_size", "_own", "_lo", "_hi", "_tree"))
            keys = table.column("_keys").combine_chunks().flatten().to_numpy().reshape(-1, TREES)
            here, before = prefix(keys, depth), None if was is None else prefix(keys, was)
            sets = table.column("_set").combine_chunks()
            offsets, values = sets.offsets.to_numpy() - sets.offsets[0].as_py(), sets.flatten().to_numpy()
            lengths = np.diff(offsets)
            left, right = [], []
            for a, b in zip(starts, starts[1:], strict=False):
                i, j = blocks.candidates(own[a:b], lo[a], hi[a])
                n = lengths[a:b]
                fits = np.minimum(n[i], n[j]) >= threshold * np.maximum(n[i], n[j]) - 1e-9
                i, j = i[fits], j[fits]
                fresh = ~(here[a:b, : tree[a]][i] == here[a:b, : tree[a]][j]).any(1)
                if before is not None:
                    fresh &= ~(before[a:b][i] == before[a:b][j]).any(1)
                i, j = i[fresh], j[fresh]
                if not len(i):
                    continue
                both = intersections(values[offsets[a] : offsets[b]], np.repeat(np.arange(b - a), n), b - a)[i, j].astype(float)
                either = n[i] + n[j] - both
                near = both >= threshold * either - 1e-9
                left.append(i[near] + a)
                right.append(j[near] + a)
                found += np.bincount((STEPS * both[near] / either[near]).astype(np.int64), minlength=STEPS + 1)
            i, j = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (left, right))
            if len(i):
                yield blocks.links(ids, size, i, j)
        steps = np.flatnonzero(found)
        if len(steps):
            yield pa.RecordBatch.from_arrays([pa.nulls(len(steps), pa.int64()), pa.array(steps), pa.array(found[steps])], ["a", "b", "n"])

    return verify


def _round(forest: DataFrame, classes: DataFrame, depth: int, was: int | None) -> DataFrame:
    """Members (_tree, _node, _rep, _own, _lo, _hi) of the blocks of all nodes of `depth` that hold pairs which did not meet at depth `was`."""
    places = forest.withColumn("_node", prefix(F.col("_sig"), depth))
    met = places.groupBy("_tree", "_node").agg(F.count(F.lit(1)).alias("_in"), F.min("_sig").alias("_a"), F.max("_sig").alias("_b")).filter(F.col("_in") > 1)
    if was is not None:  # nodes with a single child have no new pair
        met = met.filter(prefix(F.col("_a"), was) != prefix(F.col("_b"), was))
    near = stored(places.drop("_sig").join(met.select("_tree", "_node"), ["_tree", "_node"]).join(classes.select("_rep", "_n", "_keys"), "_rep"), "near")
    ends = [f(F.get("_keys", F.lit(t))).alias(f"_{n}{t}") for t in range(TOLD_BY) for n, f in (("min", F.min), ("max", F.max))]
    nodes = near.groupBy("_tree", "_node").agg(F.sum("_n").alias("_weight"), F.count(F.lit(1)).alias("_in"), *ends)

    # Nor has one whose members all met in one node of an earlier tree, or of the last round. A few trees tell
    # most of these; pairs that met before are left out of the others one by one.
    def shared(t: int, d: int) -> Column:
        return prefix(F.col(f"_min{t}"), d) == prefix(F.col(f"_max{t}"), d)

    known = reduce(lambda a, b: a | b, [(F.col("_tree") > t) & shared(t, depth) for t in range(TOLD_BY)] + [shared(t, was) for t in range(TOLD_BY) if was is not None])
    nodes = nodes.filter(~known).select("_tree", "_node", "_weight", "_in")
    chunks = F.greatest(F.ceil(F.col("_in") / CHUNK_ROWS), F.ceil(F.col("_weight") / CHUNK_SHINGLES))
    keys = ["_tree", "_node"]
    members = stored(blocks.in_blocks(near.select(*keys, "_rep").join(nodes, keys), keys, "_rep", chunks).drop("_weight", "_in"), "members")
    discard(near)
    return members


def _links(rows: DataFrame, classes: DataFrame, size: int, threshold: float, recall: float) -> DataFrame:
    """Links (a, b, n) of all rounds between classes (_rep, _least, _row, _n, _size, _keys), whose texts are in `rows`."""
    places = classes.select("_rep", F.posexplode("_keys").alias("_tree", "_sig"))
    forest = stored(places.repartitionByRange("_tree", "_sig", "_rep").sortWithinPartitions("_tree", "_sig", "_rep"), "forest")
    links, sets, found = None, None, Counter()
    depth, was = DEPTH, None
    while True:
        members = _round(forest, classes, depth, was)
        wanted = members.select("_rep").distinct()
        wanted = (wanted if sets is None else wanted.join(sets, "_rep", "left_anti")).join(classes.select("_rep", "_least", F.col("_row").alias("_want")), "_rep")
        texts = rows.join(wanted, (F.col("_id") == F.col("_least")) & (F.col("_row") == F.col("_want"))).select("_rep", "_text").dropDuplicates(["_rep"])
        more = stored(texts.mapInArrow(_shingled(size), "_rep long, _set array<long>"), "sets")
        sets = more if sets is None else sets.unionByName(more)
        full = members.join(sets, "_rep").join(classes.select("_rep", "_size", "_keys"), "_rep")
        own = stored(blocks.by_block(full, ["_tree", "_node"], "_rep").mapInArrow(_verified(threshold, depth, was), blocks.LINKS), "links")
        discard(members)
        links = own if links is None else links.unionByName(own)
        found.update(dict(map(tuple, own.filter(F.col("a").isNull()).groupBy("b").agg(F.sum("n")).collect())))
        then = next_depth(found, depth, threshold, recall)
        if then == depth:
            discard(forest)
            return links.filter(F.col("a").isNotNull())
        depth, was = then, depth


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, threshold: float = 0.8, recall: float = 0.9999, with_row: bool = False) -> DataFrame:
    """Per row of `docs`: doc_id, class_id, n_links, component_id and kept.

    Texts with equal shingle sets are a class, keyed by its hashes and named by its smallest id. n_links
    counts the other rows whose Jaccard similarity on word shingles of `size` is `threshold` or more, those of
    the same class included. `recall` is the share of the linked pairs of classes that is expected to be found,
    as the pairs that were found tell; with prefixes of SHORTEST values the search ends in any case, which
    finds 0.9997 of the pairs at a threshold of 0.8. component_id is the smallest id reachable by links; a row is kept if that is its own. Texts without a
    word (null and empty ones among them) and rows with a null id link with nothing and are kept. Repeated
    ids are rows of their own, also if their texts differ; `with_row` adds `row`, the row_key of the text,
    by which they are told apart. An empty table gives an empty one. Other columns of `docs` do not matter.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), row_key(F.col(text_col)).alias("_row"), F.col(text_col).alias("_text"))
    signed = stored(rows.mapInArrow(_signed(size), "_id long, _row long, _n long, _h1 long, _h2 long, _keys array<long>"), "signatures")
    linked = (F.col("_n") > 0) & F.col("_id").isNotNull()
    found = signed.filter(linked).groupBy("_h1", "_h2", "_n").agg(F.min(F.struct("_id", "_row")).alias("_first"), F.count(F.lit(1)).alias("_size"), F.any_value("_keys").alias("_keys"))
    classes = stored(found.select("_h1", "_h2", "_n", F.xxhash64("_h1", "_h2", "_n").alias("_rep"), F.col("_first._id").alias("_least"), F.col("_first._row").alias("_row"), "_size", "_keys"), "classes")
    links = _links(rows, classes, size, threshold, recall)

    counts = links.filter(F.col("b").isNull()).groupBy(F.col("a").alias("_rep")).agg(F.sum("n").alias("_links"))
    reach = least_ids(components(links.filter(F.col("b").isNotNull())), classes, SALTS)
    info = classes.select("_h1", "_h2", "_n", "_rep", "_least", "_size").join(counts, "_rep", "left").join(reach, "_rep", "left")
    info = info.select("_h1", "_h2", "_n", "_least", (F.col("_size") - 1 + F.coalesce("_links", F.lit(0))).alias("_links"), F.coalesce("component", "_least").alias("_component"))
    salted = info.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    own = signed.select("_id", "_row", F.when(linked, F.col("_h1")).alias("_h1"), "_h2", "_n", F.pmod(F.xxhash64("_id"), F.lit(SALTS)).cast("int").alias("_salt"))
    out = own.join(salted, ["_h1", "_h2", "_n", "_salt"], "left")
    component = F.coalesce("_component", "_id")
    return out.select(F.col("_id").alias("doc_id"), F.coalesce("_least", "_id").alias("class_id"), F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("_id"), F.lit(True)).alias("kept"), *([F.col("_row").alias("row")] if with_row else []))
