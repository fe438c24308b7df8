"""Token counts by a two-tier lookup on the map side, without any shuffle of texts or pre-tokens.

Tier one is a compact table that is broadcast: the most frequent pre-tokens of a bounded sample, as one
string, and their lengths in tokens, as one array. Tier two is a cache in each Python worker for the
pre-tokens that miss the table; the tokenizer library encodes those once for each worker. The sample decides
only which words are looked up fast: every length is the library's.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

#: Entries that a worker's cache holds before it starts anew, and the longest pre-token that it keeps.
CACHE_ENTRIES, CACHE_CHARS = 400_000, 64
#: Rows of the sample that tier one is counted on, and its entries at most.
SAMPLE_ROWS, TABLE_ENTRIES = 10_000, 1 << 16

#: The pre-tokens of word_bpe_49k.json, in full and for texts below U+0250 (lower-cased).
SUFFIXES = "'s|'t|'re|'ve|'m|'ll|'d"
ANY_TEXT = regex.compile(rf"{SUFFIXES}|\p{{L}}+|\p{{N}}|[^\p{{White_Space}}\p{{L}}\p{{N}}]+")
LETTERS, SPACES = "a-zA-Zªµº\xc0-\xd6\xd8-\xf6\xf8-ɏ", "\t-\r \x85\xa0"
LATIN_TEXT = re.compile(rf"{SUFFIXES}|[{LETTERS}]+|[0-9]|[^{SPACES}{LETTERS}0-9]+")
NOT_LATIN = re.compile("[²³¹¼½¾ɐ-\U0010ffff]")


_BEYOND = re.compile("[\U00010000-\U0010ffff]")


@functools.cache
def _unassigned() -> re.Pattern:
    """The code points up to U+FFFF that Python's Unicode tables do not know; classes with more are slow."""
    known = np.fromiter((unicodedata.category(chr(c)) != "Cn" for c in range(1 << 16)), bool, 1 << 16)
    edges = np.flatnonzero(np.diff(np.concatenate([[True], known, [True]]).astype(np.int8)))
    return re.compile("[" + "".join(f"{re.escape(chr(a))}-{re.escape(chr(b - 1))}" for a, b in zip(edges[::2], edges[1::2], strict=True)) + "]")


def is_known(text: str) -> bool:
    """Whether Python's Unicode tables know all code points. A newer library may know more, so it splits the other texts."""
    if not NOT_LATIN.search(text):
        return True
    return not _unassigned().search(text) and all(unicodedata.category(c) != "Cn" for c in set(_BEYOND.findall(text)))


def pre_tokens(text: str) -> list[str]:
    """The normalised pre-tokens of a text without special strings and unassigned code points."""
    if text.isascii():
        return LATIN_TEXT.findall(text.lower())
    # The library lower-cases character by character, so a final sigma is like any other.
    text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
    return (ANY_TEXT if NOT_LATIN.search(text) else LATIN_TEXT).findall(text)


def _bare(spec: str) -> Tokenizer:
    """The tokenizer without its normaliser, for pre-tokens that are normalised already."""
    return Tokenizer.from_str(json.dumps(json.loads(spec) | {"normalizer": None}))


class Splitter:
    """The pre-tokens of texts: by patterns, and by the library itself where its tables may be newer than Python's."""

    def __init__(self, spec: str):
        data = json.loads(spec)
        self.library = Tokenizer.from_str(json.dumps(data | {"pre_tokenizer": data["pre_tokenizer"]["pretokenizers"][0]}))
        special = sorted((t["content"] for t in data["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special)) or r"(?!)")

    def parts(self, text: str) -> list[str]:
        """What special strings leave of a text; each of them stands between two parts."""
        return self.special.split(text) if "<|" in text else [text]

    def words(self, part: str) -> list[str]:
        if part.isascii() or is_known(part):
            return pre_tokens(part)
        return [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part))]


def _counted(spec: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter(spec)
        for batch in batches:
            found = Counter()
            for text in batch.column(0):
                for part in splitter.parts(text.as_py() or ""):
                    found.update(w for w in splitter.words(part) if len(w) <= CACHE_CHARS)
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])

    return count


def frequent_lengths(docs: DataFrame, text_col: str, spec: str, sample_rows: int = SAMPLE_ROWS, entries: int = TABLE_ENTRIES) -> tuple[str, np.ndarray]:
    """Tier one: the `entries` most frequent pre-tokens of about `sample_rows` rows of `docs`, a line each, and their token counts."""
    rows = docs.select(text_col)
    share = min(1.0, sample_rows / max(1, rows.count()))
    counts = rows.sample(share, seed=1).mapInArrow(_counted(spec), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    words = [w for w, _ in counts.orderBy(F.desc("n"), "word").limit(entries).collect()]
    return "\n".join(words), np.array([len(e.ids) for e in _bare(spec).encode_batch(words, add_special_tokens=False)], np.uint16)


class Lengths(dict):
    """Token counts by pre-token: those of the table, and as a cache those of what is missing in it."""

    def __init__(self, spec: str, words: str, lengths: np.ndarray):
        self.table = words, lengths
        super().__init__(self._known())
        self.tokenizer, self.splitter = _bare(spec), Splitter(spec)

    def _known(self):
        words, lengths = self.table
        return zip(words.split("\n") if len(lengths) else [], lengths.tolist(), strict=True)

    def __missing__(self, word: str) -> int:
        n = len(self.tokenizer.encode(word, add_special_tokens=False).ids)
        if len(word) <= CACHE_CHARS:
            self[word] = n
        return n

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if len(self) > len(self.table[1]) + CACHE_ENTRIES:
            self.clear()
            self.update(self._known())
        parts = self.splitter.parts(text)  # a special string is one token
        return len(parts) - 1 + sum(sum(map(self.__getitem__, self.splitter.words(p))) for p in parts)


_WORKER: dict[str, Lengths] = {}


def token_counts(docs: DataFrame, text_col: str, tokenizer_path: str) -> Column:
    """Tokens of each whole text of `docs` as the library counts them with add_special_tokens=False; 0 for null and empty ones.

    `tokenizer_path` is a file of the kind of word_bpe_49k.json (BPE with word ends) that the driver reads.
    Special strings inside a text are one token each, the library's default. One long for each row, repeated
    rows included, whatever the other columns hold and are called; texts of any length are counted whole, and
    an empty table gives an empty one. `docs` is read once more for the sample of tier one.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read()
    shared, key = docs.sparkSession.sparkContext.broadcast((spec, *frequent_lengths(docs, text_col, spec))), uuid.uuid4().hex

    @F.arrow_udf("long")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if key not in _WORKER:
            _WORKER.clear()
            _WORKER[key] = Lengths(*shared.value)
        lengths = _WORKER[key]
        for texts in batches:
            yield pa.array([lengths.count(t.as_py()) for t in texts], pa.int64())

    return count(F.col(text_col))
