"""Language identification by word-first backoff.

A word seen in training is scored by its log frequency in each language. An unseen word falls back to its character
n-grams, the longest known ones only: 5-grams, else 4-grams and so on down to single characters, averaged, with word
boundaries marked. A text's language is the one with the greatest sum, and the score is its share after a softmax
over the mean evidence of a word, sharpened with the square root of the number of words.

A word is a maximal run of letters (Unicode category L) of the lower-cased text, in training and in prediction alike.
Counts come from a bounded sample of whole documents: about SAMPLE_ROWS labelled ones of each language, and no more than
hold SAMPLE_CHARS characters on average, chosen by hash of the id.

Odd input: a null text, or one without a letter (numerals are none), is ``und`` with score 0; null labels teach nothing;
without any label all texts are ``und``; equal sums go to the language that sorts first. Repeated rows are predicted, and
learned from, as often as they occur. A very long text is scored whole, in one worker, with memory in proportion to its
words. Extra columns are not read.
"""

from __future__ import annotations

import re
import sys
import unicodedata
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.llm.folds import sampled
from heddle.runtime import ship_package

#: Labelled documents of each language that counts are taken from at most (about).
SAMPLE_ROWS = 1500
#: Characters of each language's sample at most (about).
SAMPLE_CHARS = 30_000_000
#: A word is known from this many sightings on; rarer ones only feed the n-grams.
KNOWN_FROM = 2
LONGEST = 5
SMOOTHING = 0.5
CACHE_WORDS = 400_000
UNKNOWN = "und"
#: Letters: what ``\\w`` takes, without the underscore and all numerals. The short class still takes numerals such as ²; the
#: exact one is slow for its length and only looks at words.
_NUMERALS = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) in ("Nl", "No"))
_NUMERAL, _SHORT, _EXACT = re.compile(f"[{_NUMERALS}]"), re.compile(r"[^\W\d_]+"), re.compile(rf"[^\W\d_{_NUMERALS}]+")


def _exact(words: list[str]) -> list[str]:
    return [part for word in words for part in ((word,) if word.isascii() else _EXACT.findall(word))]


def words_of(text: str | None) -> list[str]:
    """Maximal runs of letters of the lower-cased text."""
    return _exact(_SHORT.findall((text or "").lower()))


def grams(word: str, n: int) -> list[str]:
    marked = f"<{word}>" if n > 1 else word
    return [marked[k : k + n] for k in range(len(marked) - n + 1)]


class BackoffModel:
    """Rows of log-frequency differences (a language against the mean of all), for words and n-grams of each length."""

    def __init__(self, counts: list[tuple[str, str, int]]):
        self.languages = sorted({lang for lang, _, _ in counts})
        place = {lang: k for k, lang in enumerate(self.languages)}
        words: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(place), np.float32))
        for lang, word, n in counts:
            words[word][place[lang]] += n
        self.grams: list[dict[str, np.ndarray]] = []
        for n in range(1, LONGEST + 1):
            table: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(place), np.float32))
            for word, row in words.items():
                for gram in grams(word, n):
                    table[gram] += row
            if n > 1:
                table = {g: row for g, row in table.items() if row.sum() >= KNOWN_FROM}
            self.grams.append(self._scored(table))
        self.words = self._scored({w: row for w, row in words.items() if row.sum() >= KNOWN_FROM})

    def _scored(self, table: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        if not table:
            return {}
        matrix = np.stack(list(table.values())) + SMOOTHING
        matrix = np.log(matrix / matrix.sum(axis=0))
        matrix -= matrix.mean(axis=1, keepdims=True)
        return dict(zip(table, matrix.astype(np.float32)))

    def row(self, word: str) -> np.ndarray:
        known = self.words.get(word)
        if known is not None:
            return known
        for n in range(min(LONGEST, len(word) + 2), 0, -1):
            rows = [r for g in grams(word, n) if (r := self.grams[n - 1].get(g)) is not None]
            if rows:
                return np.mean(rows, axis=0)
        return np.zeros(len(self.languages), np.float32)


class Scorer(dict):
    """word -> number of its row in a growing matrix, -1 for what holds a numeral and so is no word; emptied when it holds
    CACHE_WORDS words."""

    def __init__(self, model: BackoffModel):
        super().__init__()
        self.model = model
        self.rows = np.zeros((1024, max(1, len(model.languages))), np.float32)
        self.used = 0

    def __missing__(self, word: str) -> int:
        if not word.isascii() and _NUMERAL.search(word):
            self[word] = -1
            return -1
        k = self.used
        self.used += 1
        if k == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[k] = self.model.row(word)
        self[word] = k
        return k

    def predict(self, text: str | None) -> tuple[str, float]:
        words = _SHORT.findall((text or "").lower())
        if not words or not self.model.languages:
            return UNKNOWN, 0.0
        if len(self) > CACHE_WORDS:
            self.clear()
            self.used = 0
        numbers = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if (numbers < 0).any():
            words = _exact(words)
            if not words:
                return UNKNOWN, 0.0
            numbers = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        total = self.rows[numbers].sum(axis=0, dtype=np.float64)
        k = int(np.argmax(total))
        weight = np.exp((total - total[k]) / np.sqrt(len(words)))
        return self.model.languages[k], float(1 / weight.sum())


_SCORERS: dict[str, Scorer] = {}


def _predictor(shared: Broadcast):
    name = uuid.uuid4().hex

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def predict(text: pa.Array) -> pa.Array:
        if name not in _SCORERS:  # a worker keeps the scorer of the last model it met
            _SCORERS.clear()
            _SCORERS[name] = Scorer(shared.value)
        scorer = _SCORERS[name]
        found = [scorer.predict(t) for t in text.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=["lang_pred", "score"])

    return predict


def fit(rows: DataFrame, sample_rows: int = SAMPLE_ROWS) -> BackoffModel:
    """A model of ``rows`` (doc_id, text, lang), all of which may be learned from."""
    usable = rows.where("lang is not null and text is not null and doc_id is not null")
    sizes = {r[0]: (r[1], r[2]) for r in usable.groupBy("lang").agg(F.count("*"), F.sum(F.length("text"))).collect()}
    if not sizes:
        return BackoffModel([])
    share = F.lit(0.0)
    for lang, (n, chars) in sorted(sizes.items()):
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, sample_rows / n, SAMPLE_CHARS / max(1, chars)))).otherwise(share)
    ship_package(rows.sparkSession)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen.update((lang, word) for word in words_of(text))
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([k[j] for k in seen], pa.string()) for j in range(2)] + [pa.array(seen.values(), pa.int64())], names=["lang", "word", "n"])

    chosen = usable.where(sampled(F.col("doc_id"), share)).select(F.col("lang").cast("string"), "text")
    counted = chosen.mapInArrow(counts, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    found = counted.toPandas().sort_values(["lang", "word"], kind="stable")  # bounded by the sample
    return BackoffModel(list(zip(found["lang"], found["word"], found["n"].astype(int))))


def identify(docs: DataFrame, model: BackoffModel, text: str = "text") -> Column:
    """A struct (lang_pred, score) of the whole text."""
    ship_package(docs.sparkSession)
    return _predictor(docs.sparkSession.sparkContext.broadcast(model))(F.col(text))
