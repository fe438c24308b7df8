"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text.

Texts are folded first: lower case, homoglyphs to Latin letters, digits and signs inside words to the
letters they stand for. A sign that may stand for several letters keeps all of its readings, and a word that signs
or invisible characters cut is read in its parts and as a whole. The lexicon's entries are words and
beginnings of words, weighted by the log odds of their document frequencies in toxic and other rows. Entries
inside an exception phrase do not count; those phrases are pairs of words with an entry that are found
mostly in other rows, and a few given ones.
The weights of a text's matches, as a sum and for its length, give the score by a logistic function.
"""

from __future__ import annotations

import math
import re
import uuid
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate, product

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, stored
from .pii import INVISIBLE

#: Characters that look like Latin letters, with those letters (Cyrillic, Greek, full-width).
HOMOGLYPHS = dict(zip("аеорсухіјѕһԁӏвкмнтαοερτυκν", "aeopcyxijshdlbkmhtaoeptukv", strict=True)) | {chr(0xFF41 + k): chr(97 + k) for k in range(26)} | {chr(0xFF10 + k): chr(48 + k) for k in range(10)}
#: Digits and signs that stand for letters inside words.
SUBSTITUTES = {"0": "o", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}
#: Those that may stand for several, the usual one first. ! and | do so before or between letters only.
READINGS = {"1": "il", "!": "il", "|": "il", "6": "gb6", "9": "gq9"}
#: Words with more of them teach their usual reading only; matching is not limited.
TAUGHT_SIGNS = 4
#: Given phrases in which an entry of the lexicon is harmless, beside those that are learned.
EXCEPTIONS = ("trash can", "trash cans", "trash bin", "class clown", "clown fish")
SHORTEST, LONGEST = 4, 6  # beginnings of words that are candidates
MOST_WEIGHT = 6.0

_FOLD, _LOOKALIKE = str.maketrans(HOMOGLYPHS), re.compile("[" + "".join(HOMOGLYPHS) + "]")
# In unmasked words, private characters stand for the signs of READINGS.
_OPEN = {chr(0xE000 + ord(c)): letters for c, letters in READINGS.items()}
_LEET = str.maketrans(SUBSTITUTES | {c: chr(0xE000 + ord(c)) for c in READINGS})
_USUAL = str.maketrans({c: letters[0] for c, letters in _OPEN.items()})
# Letters and signs that have a reading in common are one character for the automaton.
_CLASS = str.maketrans({c: "i" for c in ("l", *(chr(0xE000 + ord(c)) for c in "1!|"))} | {c: "g" for c in ("b", "q", "6", "9", *(chr(0xE000 + ord(c)) for c in "69"))})
_WORD = re.compile(r"[@$]?[^\W_]+(?:[@$]+[^\W_]+)*\$*")
_JOINED = re.compile(rf"[@$!|]?[^\W_]+(?:[@$!|{INVISIBLE}]+[^\W_]+)*\$*")
_CUT, _INVISIBLE = re.compile(f"[!|{INVISIBLE}]"), re.compile(f"[{INVISIBLE}]")
_DISGUISED = re.compile(r"[013-9@$!|]")


def _unmasked(word: str) -> str:
    return word.translate(_LEET) if _DISGUISED.search(word) and any(c.isalpha() for c in word) else word


def read(text: str | None) -> tuple[list[str], list[tuple[str, int, int]]]:
    """The words of a text, with open signs, and its words as they are across ! | and invisible characters.

    The latter come with the range of words that they take the place of; there are none if both are the same.
    A word is unmasked only if it has a letter besides its digits and signs.
    """
    if not text:
        return [], []
    text = text.lower()
    if not text.isascii() and _LOOKALIKE.search(text):
        text = text.translate(_FOLD)
    if not _CUT.search(text):
        words = _WORD.findall(text)
        return [_unmasked(w) for w in words] if _DISGUISED.search(text) else words, []
    words: list[str] = []
    joined, any_cut = [], False
    for token in _JOINED.findall(text):
        cut = _CUT.search(token) is not None
        own = _WORD.findall(token) if cut else [token]
        joined.append((_unmasked(_INVISIBLE.sub("", token)), len(words), len(words) + len(own)))
        words += map(_unmasked, own)
        any_cut |= cut
    return words, joined if any_cut else []


def fold(text: str | None) -> list[str]:
    """The folded words of a text, each in its usual reading."""
    return [w.translate(_USUAL) for w in read(text)[0]]


def readings(word: str) -> list[str]:
    signs = sum(c in _OPEN for c in word)
    if not signs or signs > TAUGHT_SIGNS:
        return [word.translate(_USUAL)]
    return ["".join(r) for r in product(*(_OPEN.get(c, c) for c in word))]


def features(words: list[str]) -> set[str]:
    """Candidates for the lexicon: whole words, and beginnings of words, both with a space in front."""
    found = {r for w in set(words) for r in readings(w)}
    return {f" {w} " for w in found if len(w) <= 24} | {f" {w[:k]}" for w in found for k in range(SHORTEST, LONGEST + 1) if len(w) > k}


def _starts(words: list[str]) -> list[int]:
    return list(accumulate((len(w) + 1 for w in words), initial=0))


@dataclass
class Lexicon:
    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    coefficients: tuple[float, ...] = (-4.0, 3.0, 1.0, 0.5)
    automaton: ahocorasick.Automaton | None = field(default=None, repr=False)

    def build(self) -> Lexicon:
        entries: dict[str, list[tuple[str, float]]] = {}
        for entry, weight in [*self.weights.items(), *((f" {p} ", 0.0) for p in self.exceptions)]:
            entries.setdefault(entry.translate(_CLASS), []).append((entry, weight))
        self.automaton = ahocorasick.Automaton()
        for key, own in entries.items():
            self.automaton.add_word(key, own)
        self.automaton.make_automaton()
        return self

    def _hits(self, words: list[str]) -> dict[int, float]:
        """The largest weight at each place where an entry matches, without those inside exception phrases."""
        if not words or not len(self.automaton):
            return {}
        text = f" {' '.join(words)} "
        best: dict[int, float] = {}
        spared: list[tuple[int, int]] = []  # by their ends, which rise
        for end, entries in self.automaton.iter(text.translate(_CLASS)):
            for entry, weight in entries:
                at = end - len(entry) + 1
                here = text[at : end + 1]
                if here != entry and not all(c == e or e in _OPEN.get(c, "") for c, e in zip(here, entry, strict=True)):
                    continue
                if weight:
                    best[at] = max(best.get(at, 0.0), weight)
                else:
                    spared.append((at, end))
        if not spared:
            return best
        # A place is spared if the phrases that end beyond it include one that starts at it or before.
        ends, starts = [b for _, b in spared], list(accumulate((a for a, _ in reversed(spared)), min))[::-1]
        return {at: w for at, w in best.items() if (k := bisect_right(ends, at)) == len(ends) or starts[k] > at}

    def matched(self, words: list[str], joined: list[tuple[str, int, int]] = ()) -> list[float]:
        """The largest weight at each word that an entry matches; a joined word counts where its parts match nothing."""
        own = self._hits(words)
        found = list(own.values())
        if joined:
            places = _starts(words)
            taken = {bisect_right(places, at) - 1 for at in own}
            whole = [w for w, _, _ in joined]
            places = _starts(whole)
            for at, weight in self._hits(whole).items():
                word, first, last = joined[bisect_right(places, at) - 1]
                if words[first:last] != [word] and taken.isdisjoint(range(first, last)):
                    found.append(weight)
        return found

    def inputs(self, text: str | None) -> tuple[float, float, float]:
        """Whether anything matches, how much, and how much for the length."""
        words, joined = read(text)
        total = sum(self.matched(words, joined))
        return float(total > 0), math.log1p(total), math.log1p(100 * total / max(20, len(words)))

    def score(self, text: str | None) -> float:
        z = self.coefficients[0] + sum(c * x for c, x in zip(self.coefficients[1:], self.inputs(text), strict=True))
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))


def _feature_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        toxic, other = Counter(), Counter()
        for text, label in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            words, joined = read(text.as_py())
            (toxic if label else other).update(features(words + [w for w, _, _ in joined]))
        names = list(toxic.keys() | other.keys())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([toxic[n] for n in names], pa.int64()), pa.array([other[n] for n in names], pa.int64())], ["entry", "toxic", "other"])


def _pair_counts(weights: dict[str, float]):
    """Pairs of neighbouring words, in their usual readings, one of which an entry matches: rows with them, by label."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Lexicon(weights, ()).build()
        for batch in batches:
            counts = Counter(), Counter()
            for text, label in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                words = read(text.as_py())[0]
                places = _starts(words)
                hit = {bisect_right(places, at) - 1 for at in own._hits(words)}
                pairs = {(i, i + 1) for i in hit if i + 1 < len(words)} | {(i - 1, i) for i in hit if i}
                counts[0 if label else 1].update({" ".join(words[k].translate(_USUAL) for k in p) for p in pairs})
            names = list(counts[0].keys() | counts[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([c[n] for n in names], pa.int64()) for c in counts)], ["entry", "toxic", "other"])

    return count


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.3, rounds: int = 50) -> np.ndarray:
    """Newton's method with a small ridge; the first coefficient is the intercept."""
    x = np.column_stack([np.ones(len(x)), x])
    b, keep = np.zeros(x.shape[1]), np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -50, 50)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep, x.T @ (y - p) - keep @ b)
        b = b + step
        if np.abs(step).max() < 1e-8:
            break
    return b


def _evidence(share: float) -> Column:
    """The log likelihood ratio of an entry's own share of toxic rows against the share of all rows."""
    rows, toxic, other = F.col("toxic") + F.col("other"), F.col("toxic"), F.col("other")
    rest = F.when(other > 0, other * (F.log(other / rows) - math.log(max(1e-12, 1 - share)))).otherwise(F.lit(0.0))
    return toxic * (F.log(toxic / rows) - math.log(max(1e-12, share))) + rest


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = 30_000, chance: float = 20.0, least_odds: float = 3.0, entries: int = 5_000, least_spared: int = 5, exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """A lexicon, its exception phrases and its logistic function from labelled rows.

    About `max_rows` labels, which a hash of the id chooses from all, are broadcast and meet their texts in
    one pass, so texts are not shuffled; those rows are written, as they are read three times. Entries have
    log odds of `least_odds` at least, and their likelihood ratio against the share of toxic rows is so large
    that of all candidates at most `chance` would reach it by chance: the support asked for follows from how
    many rows and candidates there are (4 rows in the smallest tables). The `entries` with the largest odds
    are kept; words above 24 characters are known by their beginnings. A pair of words with an entry is an exception if at least `least_spared` other rows
    hold it, and relatively more of them than of the toxic rows. Null labels and ids teach nothing; a text
    counts once for each label of its id, and rows that share an id all count. Ties of entries go by name.
    Without toxic rows, with empty tables too, the lexicon is empty and every score is that of a clean text.
    Other columns may have any names.
    """
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label"))
    total, toxic = known.agg(F.count(F.lit(1)), F.coalesce(F.sum("_label"), F.lit(0))).first()
    if not total or not toxic:
        return Lexicon({}, exceptions)
    chosen = known.filter(F.pmod(F.xxhash64(F.lit("fit"), F.col("_id")), F.lit(1_000_000)) < min(1.0, max_rows / total) * 1_000_000)
    texts = docs.select(F.col(id_col).alias("_did"), F.col(text_col).alias("_text"))
    rows = stored(texts.join(F.broadcast(chosen), F.col("_did") == F.col("_id")).select("_text", "_label"), "labelled")
    n, n_toxic = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("_label"), F.lit(0))).first()
    odds = F.log((F.col("toxic") + 0.5) / F.lit(n_toxic + 1.0)) - F.log((F.col("other") + 0.5) / F.lit(n - n_toxic + 1.0))

    def by_label(count) -> DataFrame:
        counts = rows.mapInArrow(count, "entry string, toxic long, other long")
        return counts.groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")).withColumn("odds", odds)

    candidates = stored(by_label(_feature_counts).filter("toxic > 0"), "candidates")
    best = candidates.filter((F.col("odds") >= least_odds) & (_evidence(n_toxic / max(1, n)) >= math.log(max(1, candidates.count()) / chance)))
    weights = {e: min(MOST_WEIGHT, o) for e, o in best.orderBy(F.desc("odds"), "entry").limit(entries).select("entry", "odds").collect()}
    discard(candidates)
    harmless = by_label(_pair_counts(weights)).filter((F.col("other") >= least_spared) & (F.col("odds") < 0))
    learned = [e for (e,) in harmless.orderBy("odds", "entry").limit(entries).select("entry").collect()]
    lexicon = Lexicon(weights, tuple(dict.fromkeys([*exceptions, *learned])))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Lexicon(lexicon.weights, lexicon.exceptions).build()
        for batch in batches:
            found = [own.inputs(t.as_py()) for t in batch.column(0)]
            inputs = [pa.array([x[k] for x in found], pa.float64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*inputs, batch.column(1).cast(pa.float64())], ["x", "y", "z", "label"])

    data = np.array(rows.mapInArrow(measured, "x double, y double, z double, label double").groupBy("x", F.round("y", 3), F.round("z", 3), "label").count().collect(), dtype=float)
    discard(rows)
    if len(data):
        data = np.repeat(data[:, :4], data[:, 4].astype(int), axis=0)
        lexicon.coefficients = tuple(float(c) for c in logistic(data[:, :3], data[:, 3]))
    return lexicon


_WORKER: dict[str, Lexicon] = {}


def score(df: DataFrame, lexicon: Lexicon, text: Column) -> Column:
    """The score of each whole text, 0 to 1; null and empty texts have that of a text without matches.

    It depends on the text alone, so repeated rows score alike whatever their other columns hold and are called.
    """
    shared, key = df.sparkSession.sparkContext.broadcast((lexicon.weights, lexicon.exceptions, lexicon.coefficients)), uuid.uuid4().hex

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if key not in _WORKER:
            _WORKER.clear()
            _WORKER[key] = Lexicon(*shared.value).build()
        for texts in batches:
            yield pa.array([_WORKER[key].score(t.as_py()) for t in texts], pa.float64())

    return scored(text)
