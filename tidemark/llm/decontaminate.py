"""Benchmark decontamination over a positional inverted index, with DataFrame functions only.

1. One pass over the corpus stores the postings (term, position) of all benchmark terms, in order, document
   by document.
2. The index tells how often each term stands in the corpus. Every distinct window of benchmark words lists
   its terms from the rarest on, with their offsets in it.
3. Postings of a window's rarest term meet the window; each gives a start, shifted by the term's offset. The
   lists of its other terms, shifted by theirs, are intersected with it in turn; a start that is left in the
   end is an exact phrase. For matches by proximity, so many of the rarest terms are anchors that no match
   lacks them all, and the terms of a window that stand near an anchor are counted.

Which words are benchmark terms is decided by a bitmap of fixed size, whose false positives the joins remove,
so nothing that is broadcast grows with the benchmark; windows are broadcast up to a checked number of rows
and bytes and shuffled beyond it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, row_key, same, stored

#: Whatever lies between words: all of ASCII but digits and lower-case letters.
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Slots of the bitmap at most, and for each term where they are fewer.
SLOTS, SPARSE = 1 << 20, 32
#: Windows that are broadcast at most, and bytes of their words.
BROADCAST_WINDOWS, BROADCAST_BYTES = 50_000, 20_000_000
#: Copies of each term's count: places of one benchmark word meet them by a hash of their window.
SALTS = 16
#: A match by proximity: the share of a window's distinct terms, and words of a document beyond the window's that they may take.
PROXIMITY, SLACK = 0.8, 5


def words(text: Column) -> Column:
    """The words of a text in order; none for null."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN_WORDS, -1), "")


def windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = 10) -> DataFrame:
    """(_win, item): the distinct windows of every item. An item of fewer words than `size`, but not none, is one."""
    rows = benchmark.select(F.col(id_col).alias("item"), F.inline(F.array(F.struct(words(F.col(text_col)).alias("_w")))))
    starts = F.sequence(F.lit(1), F.greatest(F.size("_w") - size + 1, F.lit(1)))
    return rows.filter(F.size("_w") > 0).select("item", F.explode(F.transform(starts, lambda i: F.slice(F.col("_w"), i, size))).alias("_win")).distinct()


def _bitmap(terms: DataFrame, column: str) -> tuple[bytes, int]:
    """A bit for each slot, 1 where a term falls, and the number of slots: a power of two, about SPARSE for each term, SLOTS at most.

    At most SLOTS numbers come to the driver, however many terms there are. Six slots make a printable byte.
    """
    taken = [slot for (slot,) in terms.select(F.pmod(F.xxhash64(column), F.lit(SLOTS)).cast("int")).distinct().collect()]
    slots = min(SLOTS, max(1 << 10, 1 << (SPARSE * len(taken)).bit_length()))
    bits = bytearray(b"0") * (slots // 6 + 1)
    for slot in {x % slots for x in taken}:
        bits[slot // 6] += 1 << slot % 6
    return bytes(bits), slots


def _marked(term: Column, bitmap: tuple[bytes, int]) -> Column:
    bits, slots = bitmap
    slot = F.pmod(F.xxhash64(term), F.lit(slots)).cast("int")
    own = F.ascii(F.substring(F.lit(bits), F.floor(slot / 6).cast("int") + 1, F.lit(1)).cast("string")) - ord("0")
    return F.getbit(own, slot % 6) == 1


def index(docs: DataFrame, wins: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The positional index: per row _id, _row, n_words and _posts, the postings (term, at) of all terms of `wins` in order."""
    bits = _bitmap(wins.select(F.explode("_win").alias("_term")), "_term")
    rows = docs.select(F.col(id_col).alias("_id"), row_key(F.col(text_col)).alias("_row"), F.inline(F.array(F.struct(words(F.col(text_col)).alias("_w")))))
    posts = F.filter(F.transform("_w", lambda w, i: F.struct(w.alias("term"), i.alias("at"))), lambda p: _marked(p["term"], bits))
    return rows.select("_id", "_row", F.size("_w").cast("long").alias("n_words"), posts.alias("_posts"))


def _bits(terms: Column) -> Column:
    """A long with a bit set for each term of an array of (term, ...), by its hash."""
    return F.aggregate(terms, F.lit(0).cast("long"), lambda acc, p: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(p["term"]), F.lit(64)).cast("int"))))


def anchors(indexed: DataFrame, wins: DataFrame, proximity: float | None = None, size: int = 10) -> DataFrame:
    """(_win, _lists, _need, _set, _least, _term, _rank): windows by the terms whose postings are looked up for them.

    `_lists` has (n, off, term) of all places of the window, the rarest in the index first, then by offset.
    The term of rank 0 is the first of them. With `proximity`, windows of `size` words have as many more of
    their distinct terms as make sure that no set of `_need` terms lacks all.
    """
    places = wins.select("_win").distinct().select("_win", F.posexplode("_win").alias("_off", "_term")).withColumn("_salt", F.pmod(F.xxhash64("_win"), F.lit(SALTS)).cast("int"))
    seen = indexed.select(F.explode("_posts.term").alias("_term")).groupBy("_term").agg(F.count(F.lit(1)).alias("_n"))
    salted = seen.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    counted = places.join(salted, ["_term", "_salt"], "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    listed = counted.groupBy("_win").agg(F.array_sort(F.collect_list(F.struct(F.col("_n").alias("n"), F.col("_off").alias("off"), F.col("_term").alias("term")))).alias("_lists"))
    terms = F.array_distinct(F.transform("_lists", lambda p: p["term"]))
    need = F.lit(None).cast("int") if proximity is None else F.when(F.size("_win") >= size, F.ceil(F.size(terms) * F.lit(proximity) - 1e-9).cast("int"))
    more = listed.withColumns({"_need": need, "_terms": terms})
    taken = more.withColumns({"_taken": F.coalesce(F.size("_terms") - F.col("_need") + 1, F.lit(1)), "_set": _bits(F.col("_lists"))})
    least = F.bit_count("_set") - F.size("_terms") + F.coalesce("_need", F.size("_terms"))  # a term that is not there takes one bit at most
    return taken.select("_win", "_lists", "_need", "_set", least.alias("_least"), F.posexplode(F.slice(F.col("_terms"), F.lit(1), F.col("_taken"))).alias("_rank", "_term"))


def matches(indexed: DataFrame, chosen: DataFrame, size: int = 10, slack: int = SLACK, broadcast: bool = False) -> DataFrame:
    """(_id, _row, _win, start, length, near): where windows occur in documents.

    `start` is that of an exact phrase, and null where there is none. `near` says that some `size` + `slack`
    consecutive words of the document hold `_need` distinct terms of the window, or more.
    """
    reach = size + slack - 1
    bits = _bitmap(chosen.select("_term"), "_term")

    def around(p: Column, k: Column) -> Column:
        low = F.greatest(k - reach, F.lit(0))
        return F.when(_marked(p["term"], bits), F.struct(p["term"].alias("_term"), p["at"].alias("at"), F.slice(F.col("_posts"), low + 1, k - low + reach + 1).alias("near")))

    posts = indexed.select("_id", "_row", F.inline(F.filter(F.transform("_posts", around), lambda x: x.isNotNull())))
    posts = posts.withColumn("_around", _bits(F.col("near")))
    both = posts.join(F.broadcast(chosen) if broadcast else chosen, "_term").filter(F.bit_count(F.col("_around").bitwiseAND(F.col("_set"))) >= F.col("_least"))

    def shifted(p: Column) -> Column:
        return F.transform(F.filter("near", lambda q: q["term"] == p["term"]), lambda q: q["at"] - p["off"])

    # What the bits left is worked out once, in a generated row.
    some = both.filter(F.col("_need").isNull() | (F.size(F.array_intersect("_win", F.col("near.term"))) >= F.col("_need")))
    # The anchor's own list gives one start; the others' lists are intersected with it from the rarest on.
    first = F.array(F.col("at") - F.get(F.col("_lists"), F.lit(0))["off"])
    starts = F.when(F.col("_rank") == 0, F.aggregate("_lists", first, lambda acc, p: F.when(F.size(acc) > 0, F.array_intersect(acc, shifted(p))).otherwise(acc)))

    def held(low: Column) -> Column:
        inside = F.filter("near", lambda q: (q["at"] >= low) & (q["at"] <= low + reach))
        return F.size(F.array_intersect("_win", F.transform(inside, lambda q: q["term"])))

    lows = F.filter("near", lambda q: (q["at"] <= F.col("at")) & (q["at"] >= F.col("at") - reach) & F.array_contains("_win", q["term"]))
    near = F.coalesce(F.exists(lows, lambda q: held(q["at"]) >= F.col("_need")), F.lit(False))
    judged = F.array(F.struct(F.get(starts, F.lit(0)).alias("start"), F.size("_win").alias("length"), near.alias("near")))
    return some.select("_id", "_row", "_win", F.inline(F.filter(judged, lambda x: x["start"].isNotNull() | x["near"]))).distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = 10, proximity: float | None = PROXIMITY, slack: int = SLACK, with_row: bool = False) -> DataFrame:
    """Per row of `docs`: doc_id, n_words, n_hit, n_items, items (array of strings, sorted), contaminated and n_near.

    n_hit counts the words inside exact phrases, n_items and items are the items that these come from. n_near
    counts the items with a window of `size` words of whose distinct terms a share of `proximity` stands in
    `size` + `slack` consecutive words of the document; without `proximity` it is 0. Null and empty texts
    have no words and are clean; so is everything if the benchmark is empty. Rows of `docs` that share id and
    text are judged alike, each with a row of its own; a null id is an id like others; `with_row` adds `row`,
    the row_key of the text. Items that share a window all count. Null item ids count as no item, but their
    words are hit. Terms that stand equally often go by their offset. Other columns may have any names.
    """
    wins = stored(windows(benchmark, item_col, item_text_col, size), "windows")
    count, volume = wins.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.aggregate("_win", F.lit(0).cast("long"), lambda acc, w: acc + F.octet_length(w))), F.lit(0))).first()
    small = count <= BROADCAST_WINDOWS and volume <= BROADCAST_BYTES
    indexed = stored(index(docs, wins, id_col, text_col), "index")
    chosen = stored(anchors(indexed, wins, proximity, size), "anchors")
    found = stored(matches(indexed, chosen, size, slack, small), "matches")
    phrases = found.filter(F.col("start").isNotNull())
    before = Window.partitionBy("_id", "_row").orderBy("start", "length").rowsBetween(Window.unboundedPreceding, -1)
    spans = phrases.select("_id", "_row", "start", "length", (F.col("start") + F.col("length")).alias("_end")).distinct()
    fresh = F.greatest(F.lit(0), F.col("_end") - F.greatest(F.col("start"), F.coalesce(F.max("_end").over(before), F.lit(0))))
    hit = spans.select("_id", "_row", fresh.alias("_new")).groupBy("_id", "_row").agg(F.sum("_new").alias("n_hit"))
    by_win = wins.withColumn("item", F.col("item").cast("string"))
    by_doc = found.groupBy("_id", "_row", "_win").agg(F.max(F.col("start").isNotNull()).alias("_phrase"), F.max("near").alias("_near"))
    items = (
        by_doc.join(F.broadcast(by_win) if small else by_win, "_win").groupBy("_id", "_row")
        .agg(F.array_sort(F.collect_set(F.when(F.col("_phrase"), F.col("item")))).alias("items"), F.count_distinct(F.when(F.col("_near"), F.col("item"))).alias("n_near"))
    )
    stats = items.join(hit, same(hit._id, items._id) & (hit._row == items._row), "left").select(items._id.alias("_did"), items._row.alias("_drow"), "n_hit", "items", "n_near")
    rows = indexed.select("_id", "_row", "n_words").join(stats, same(F.col("_id"), F.col("_did")) & (F.col("_row") == F.col("_drow")), "left")
    return rows.select(
        F.col("_id").alias("doc_id"), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.when(F.col("items").isNull(), 0).otherwise(F.size("items")).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        *([F.col("_row").alias("row")] if with_row else []),
    )
