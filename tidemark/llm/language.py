"""Language identification by unigrams over a fixed public vocabulary, summed over all segmentations.

Each language has a probability for every piece. A word's likelihood is the sum over all ways of cutting
it into pieces, by the forward algorithm; a text's is the product over its words. The probabilities are
fitted by expectation maximisation on word counts of labelled rows.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

WORD, START = re.compile(r"[^\W\d_]+"), "▁"
LONGEST_PIECE = 16
#: Probability of a character that is no piece, in any language; weight of the pooled pieces in each language.
UNKNOWN, SMOOTHING = 1e-7, 1e-3
#: Words that a worker keeps the likelihoods of, and the longest of them.
CACHE_WORDS, CACHE_CHARS = 600_000, 32
#: Texts that are scored together.
AT_ONCE = 512
#: Of the hash by which pieces are looked up.
CODE_RATIO, CODE_STEP = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def vocabulary(model_path: str) -> list[str]:
    """The lower-case pieces of a sentencepiece model, without control and byte pieces."""
    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    plain = (sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)))
    return [p for p in plain if p == p.lower() and START not in p[1:] and len(p) <= LONGEST_PIECE]


def text_words(text: str | None) -> list[str]:
    """Runs of letters, lower-cased; none if there is no letter."""
    found = WORD.findall(text.lower()) if text else []
    return found if any(c.isalpha() for w in found for c in w) else []


@dataclass
class Model:
    """langs, sorted; their prior probabilities; for each piece its probability in each of them."""

    langs: list[str]
    prior: list[float]
    pieces: dict[str, tuple[float, ...]]

    def word(self, word: str) -> np.ndarray:
        """Log likelihood of a word in each language: the forward algorithm, scaled so that no word is too long."""
        text, n = START + word, len(self.langs)
        unknown, get = (UNKNOWN,) * n, self.pieces.get
        ahead: dict[int, list[float]] = {0: [1.0] * n}
        lost = 0.0
        for i in range(len(text)):
            at = ahead.pop(i, None)
            if at is None:
                continue
            if max(at) < 1e-120:
                at = [a * 1e120 for a in at]
                ahead = {k: [a * 1e120 for a in v] for k, v in ahead.items()}
                lost -= 120 * math.log(10)
            for j in range(i + 1, min(i + LONGEST_PIECE, len(text)) + 1):
                p = get(text[i:j])
                if p is None:
                    if j > i + 1:
                        continue
                    p = unknown
                was = ahead.get(j)
                ahead[j] = [a * b for a, b in zip(at, p, strict=True)] if was is None else [w + a * b for w, a, b in zip(was, at, p, strict=True)]
        return np.log(np.maximum(ahead[len(text)], 1e-300)) + lost


def expected_pieces(word: str, probability: dict[str, float], add: float, into: Counter) -> None:
    """Adds the expected number of each piece in `word`, `add` times, over all segmentations (forward and backward)."""
    text = START + word
    n = len(text)
    arcs = [[(j, text[i:j], p) for j in range(i + 1, min(i + LONGEST_PIECE, n) + 1) if (p := probability.get(text[i:j]) or (UNKNOWN if j == i + 1 else 0))] for i in range(n)]
    forward, backward = [0.0] * (n + 1), [0.0] * (n + 1)
    forward[0] = backward[n] = 1.0
    scale = 1e4  # for each character; it cancels out
    for i, own in enumerate(arcs):
        for j, _, p in own:
            forward[j] += forward[i] * p * scale ** (j - i)
    for i in range(n - 1, -1, -1):
        backward[i] = sum(p * scale ** (j - i) * backward[j] for j, _, p in arcs[i])
    total = forward[n]
    if 0 < total < math.inf:
        for i, own in enumerate(arcs):
            for j, piece, p in own:
                if piece in probability:
                    into[piece] += add * forward[i] * p * scale ** (j - i) * backward[j] / total


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: dict[str, Counter] = defaultdict(Counter)
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            counts[lang].update(text_words(text.as_py()))
        rows = [(lang, w, n) for lang, c in counts.items() for w, n in c.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["lang", "word", "n"])


def _expectation(shared):
    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, pieces = shared.value
        column = {lang: {p: v[k] for p, v in pieces.items()} for k, lang in enumerate(langs)}
        for batch in batches:
            counts: dict[str, Counter] = defaultdict(Counter)
            for lang, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                expected_pieces(word, column[lang], n, counts[lang])
            rows = [(lang, p, x) for lang, c in counts.items() for p, x in c.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.float64()))], ["lang", "piece", "x"])

    return expect


def fit(rows: DataFrame, pieces: list[str], text_col: str = "text", lang_col: str = "lang", key_col: str = "doc_id", max_docs: int = 10_000, rounds: int = 2) -> Model:
    """A model from labelled rows; rows without a text or a language teach nothing, and no rows give a model without languages.

    It is fitted on about `max_docs` rows, which a hash of `key_col` chooses from all; what comes to the
    driver is a number for each piece and language. Repeated rows all count; other columns may have any names.
    """
    spark = rows.sparkSession
    known = rows.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    share = known.groupBy(lang_col).count().collect()
    total = sum(r["count"] for r in share)
    langs = sorted(r[0] for r in share)
    if not langs:
        return Model([], [], {})
    prior = {r[0]: r["count"] / total for r in share}
    chosen = known.filter(F.pmod(F.xxhash64(F.lit("fit"), F.col(key_col)), F.lit(1_000_000)) < min(1.0, max_docs / total) * 1_000_000)
    counted = chosen.select(F.col(lang_col), F.col(text_col)).mapInArrow(_word_counts, "lang string, word string, n long")
    counts = stored(counted.groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    model = dict.fromkeys(pieces, (1 / len(pieces),) * len(langs))
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((langs, model))
        found = counts.mapInArrow(_expectation(shared), "lang string, piece string, x double").groupBy("lang", "piece").agg(F.sum("x").alias("x")).collect()
        seen: dict[str, dict[str, float]] = {lang: {} for lang in langs}
        for lang, piece, x in found:
            seen[lang][piece] = x
        sums = {lang: sum(v.values()) or 1.0 for lang, v in seen.items()}
        pooled = {p: (sum(seen[lang].get(p, 0.0) / sums[lang] for lang in langs) / len(langs) + 1 / len(pieces)) / 2 for p in pieces}
        model = {p: tuple((1 - SMOOTHING) * seen[lang].get(p, 0.0) / sums[lang] + SMOOTHING * pooled[p] for lang in langs) for p in pieces}
    return Model(langs, [prior[lang] for lang in langs], model)


class Scorer:
    """Likelihoods of texts. Those of words are kept; missing ones go through the forward algorithm together, by length."""

    def __init__(self, model: Model):
        self.model, self.place = model, {}
        pieces = sorted(model.pieces, key=self._code)
        self.codes = np.array([self._code(p) for p in pieces], np.uint64)
        self.probability = np.array([model.pieces[p] for p in pieces] + [(0.0,) * len(model.langs), (UNKNOWN,) * len(model.langs)])
        self.rows = np.zeros((1 << 12, len(model.langs)))

    @staticmethod
    def _code(piece: str) -> int:
        code = 0
        for c in piece:
            code = (code * CODE_RATIO + ord(c) * CODE_STEP + 1) & ((1 << 64) - 1)
        return code

    def _learn(self, words: list[str]) -> None:
        """Appends the log likelihoods of words, none of them longer than CACHE_CHARS."""
        words.sort(key=len)
        first = len(self.place)
        if first + len(words) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros((first + len(words), self.rows.shape[1]))])
        self.place.update(zip(words, range(first, first + len(words)), strict=True))
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        for size in np.unique(sizes):
            low, high = np.searchsorted(sizes, [size, size + 1])
            for k in range(low, high, 1 << 13):
                some = words[k : min(high, k + (1 << 13))]
                self.rows[first + k : first + k + len(some)] = self._forward(some, int(size) + 1)

    def _forward(self, words: list[str], n: int) -> np.ndarray:
        letters = np.frombuffer("".join(START + w for w in words).encode("utf-32-le"), np.uint32).reshape(len(words), n).astype(np.uint64).T
        letters = letters * np.uint64(CODE_STEP) + np.uint64(1)
        ahead = np.zeros((n + 1, len(words), self.probability.shape[1]))
        ahead[0] = 1.0
        none = len(self.codes)
        for i in range(n):
            code = np.zeros(len(words), np.uint64)
            for j in range(i, min(n, i + LONGEST_PIECE)):
                code = code * np.uint64(CODE_RATIO) + letters[j]
                at = np.minimum(np.searchsorted(self.codes, code), none - 1)
                piece = self.codes[at] == code
                if j == i:
                    ahead[j + 1] += ahead[i] * self.probability[np.where(piece, at, none + 1)]
                elif len(hits := np.flatnonzero(piece)):
                    ahead[j + 1, hits] += ahead[i, hits] * self.probability[at[hits]]
        return np.log(np.maximum(ahead[n], 1e-300))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        split = [text_words(t) for t in texts]
        if not self.model.langs:
            return [("und", 0.0)] * len(texts)
        if len(self.place) > CACHE_WORDS:
            self.place = {}
        self._learn([w for w in set().union(*split).difference(self.place) if len(w) <= CACHE_CHARS])
        get, found = self.place.get, []
        for words in split:
            if not words:
                found.append(("und", 0.0))
                continue
            at = list(map(get, words))
            total = np.log(self.model.prior)
            if None in at:
                total = total + sum(self.model.word(w) for w, k in zip(words, at, strict=True) if k is None)
                at = [k for k in at if k is not None]
            total = total + self.rows[at].sum(axis=0)
            p = np.exp(total - total.max())
            k = int(np.argmax(total))
            found.append((self.model.langs[k], float(p[k] / p.sum())))
        return found


_WORKER: dict[str, Scorer] = {}


def predict(df: DataFrame, model: Model, text: Column) -> Column:
    """struct(lang, score) of each whole text; lang `und` and score 0 if it is null or has no letter, or nothing was learned.

    Languages that are equally likely go by name. It depends on the text alone, so repeated rows have equal
    predictions whatever their other columns hold and are called; an empty table gives none.
    """
    shared, key = df.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    @F.arrow_udf("struct<lang:string,score:double>")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if key not in _WORKER:
            _WORKER.clear()
            _WORKER[key] = Scorer(shared.value)
        for texts in batches:
            found = [x for k in range(0, len(texts), AT_ONCE) for x in _WORKER[key].predict(texts[k : k + AT_ONCE].to_pylist())]
            yield pa.StructArray.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["lang", "score"])

    return scored(text)
