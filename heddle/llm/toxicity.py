"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its hashed character n-grams and itself; a window of words is the average of their bags' embeddings;
a linear layer with a softmax gives its probability. Unseen misspellings share n-gram vectors with what was seen.
Few words may make a long document toxic, so a document scores as its worst window, and training picks, round by round,
the worst window of each toxic document and the worst of the others (multiple-instance learning). A last logistic step on
worst windows sets the scale, and its shift is moved from the sample's odds to the odds among all labels. The layers are linear, so once trained each word is one number, and a document
costs a look-up per word and a running sum.

Training reads about SAMPLE_ROWS toxic and OTHER_ROWS other labelled documents, chosen by hash of the id.

Odd input: null and empty texts have no window and score as the bias alone would for a neutral one; null labels and
null ids teach nothing; a document labelled twice counts as toxic if either label says so; with only one label, or none,
every score is 0. Repeated rows score alike; windows that tie count once. A very long text is scored whole, in memory in
proportion to its words; the training sample is bounded in documents and, by SAMPLE_CHARS, in characters. Extra columns
are not read.
"""

from __future__ import annotations

import re
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.llm.folds import sampled
from heddle.runtime import ship_package

#: Toxic and other labelled documents that are learned from at most (about).
SAMPLE_ROWS, OTHER_ROWS = 800, 1600
#: Characters of each label's sample at most (about).
SAMPLE_CHARS = 20_000_000
WINDOW = 6
DIMENSION = 12
BUCKETS = 1 << 16
GRAM_LENGTHS = (3, 4, 5)
ROUNDS = 3
EPOCHS = 1
BATCH = 512
#: Batches of a round at least; a small sample is gone through more often.
LEAST_STEPS = 150
#: Windows drawn from a document in the first round, and worst windows kept of a harmless one in later rounds.
DRAWN = 12
WORST = 6
CACHE_WORDS = 500_000
THRESHOLD = 0.3
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")


def subwords(token: str) -> list[int]:
    """Buckets of a token's n-grams and of the whole word, without punctuation at its ends; none without letters."""
    word = _EDGE.sub("", token)
    if not word:
        return []
    marked = f"<{word}>"
    parts = [marked] + [marked[k : k + n] for n in GRAM_LENGTHS for k in range(len(marked) - n + 1)]
    return [zlib.crc32(part.encode()) % BUCKETS for part in parts]


def misspelt(token: str, rng: np.random.Generator) -> str:
    """The token with one letter dropped, doubled, swapped or replaced."""
    if len(token) < 4:
        return token
    k = int(rng.integers(1, len(token) - 1))
    kind = int(rng.integers(4))
    if kind == 0:
        return token[:k] + token[k + 1 :]
    if kind == 1:
        return token[:k] + token[k] + token[k:]
    if kind == 2:
        return token[: k - 1] + token[k] + token[k - 1] + token[k + 1 :]
    return token[:k] + "aeiou013!*"[int(rng.integers(10))] + token[k + 1 :]


class Net:
    """Embeddings of buckets and a linear softmax of two classes, trained with AdaGrad."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.rng = rng
        self.embed = (rng.standard_normal((BUCKETS, DIMENSION)) * 0.05).astype(np.float32)
        self.out = (rng.standard_normal((DIMENSION, 2)) * 0.1).astype(np.float32)
        self.bias = np.zeros(2, np.float32)
        self.seen_embed = np.full(BUCKETS, 1e-6, np.float32)
        self.seen_out, self.seen_bias = np.full_like(self.out, 1e-6), np.full_like(self.bias, 1e-6)

    def step(self, bags: list[list[list[int]]], labels: np.ndarray, rate: float) -> None:
        """One batch: bags[i] is a window, a list of words, each a list of buckets."""
        ids, weights, owners = [], [], []
        for row, words in enumerate(bags):
            for word in words:
                ids += word
                weights += [1.0 / (len(word) * len(words))] * len(word)
                owners += [row] * len(word)
        if not ids:
            return
        ids, weights, owners = np.array(ids), np.array(weights, np.float32), np.array(owners)
        rows = self.embed[ids] * weights[:, None]
        present, first = np.unique(owners, return_index=True)
        hidden = np.zeros((len(bags), DIMENSION), np.float32)
        hidden[present] = np.add.reduceat(rows, first, axis=0)
        logits = hidden @ self.out + self.bias
        logits -= logits.max(axis=1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=1, keepdims=True)
        share = np.where(labels == 1, 0.5 / max(1, labels.sum()), 0.5 / max(1, (labels == 0).sum())) * len(labels)
        p[np.arange(len(labels)), labels] -= 1
        p *= share[:, None].astype(np.float32)
        back = p @ self.out.T
        grad_out, grad_bias = hidden.T @ p / len(labels), p.mean(axis=0)
        self.seen_out += grad_out**2
        self.seen_bias += grad_bias**2
        self.out -= rate * grad_out / np.sqrt(self.seen_out)
        self.bias -= rate * grad_bias / np.sqrt(self.seen_bias)
        order = np.argsort(ids, kind="stable")
        grads = back[owners[order]] * weights[order][:, None]
        unique, starts = np.unique(ids[order], return_index=True)
        grads = np.add.reduceat(grads, starts, axis=0) / len(labels)
        self.seen_embed[unique] += (grads**2).mean(axis=1)
        self.embed[unique] -= rate * grads / np.sqrt(self.seen_embed[unique])[:, None]

    def buckets(self) -> np.ndarray:
        """Each bucket as one number: its part in the logit of class 1 against class 0."""
        return (self.embed @ (self.out[:, 1] - self.out[:, 0])).astype(np.float32)


@dataclass
class ToxicityModel:
    bucket: np.ndarray | None
    bias: float = 0.0
    scale: float = 1.0
    shift: float = 0.0


class Scorer(dict):
    """lower-cased token -> its number, from a bounded cache."""

    def __init__(self, model: ToxicityModel):
        super().__init__()
        self.model = model

    def __missing__(self, token: str) -> float:
        ids = subwords(token)
        value = float(self.model.bucket[ids].mean()) if ids else 0.0
        self[token] = value
        return value

    def numbers(self, text: str | None) -> np.ndarray:
        tokens = (text or "").lower().split()
        if len(self) > CACHE_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, tokens), np.float64, len(tokens))

    def windows(self, text: str | None) -> np.ndarray:
        """The logit of each window of the whole text; a shorter text is one window, an empty one none."""
        values = self.numbers(text)
        if not len(values):
            return values
        width = min(WINDOW, len(values))
        sums = np.concatenate([[0.0], np.cumsum(values)])
        return (sums[width:] - sums[:-width]) / width + self.model.bias

    def score(self, text: str | None) -> float:
        if self.model.bucket is None:
            return 0.0
        logits = self.windows(text)
        worst = float(logits.max()) if len(logits) else self.model.bias
        return float(1 / (1 + np.exp(-np.clip(self.model.scale * worst + self.model.shift, -30, 30))))


def _calibrated(worst: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic fit on worst windows by gradient descent on standardised values."""
    mean, spread = worst.mean(), max(worst.std(), 1e-6)
    x = (worst - mean) / spread
    a, b = 1.0, 0.0
    for _ in range(400):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        a -= 1.0 * (((p - labels) * x).mean() + 1e-3 * a)
        b -= 1.0 * (p - labels).mean()
    return a / spread, b - a * mean / spread


def train(texts: list[str | None], labels: np.ndarray, odds: float | None = None, seed: int = 7) -> ToxicityModel:
    """A model of texts and their labels; ``odds`` of toxic to other ones outside the sample, if they differ."""
    if not len(labels) or labels.min() == labels.max():
        return ToxicityModel(None)
    net = Net(seed)
    rng = np.random.default_rng(seed)
    tokens = [(t or "").lower().split() for t in texts]
    kept: dict[str, list[int]] = {}

    def bag(words: list[str]) -> list[list[int]]:
        out = []
        for word in words:
            if rng.random() < 0.15:
                ids = subwords(misspelt(word, rng))
            else:
                ids = kept.get(word)
                if ids is None:
                    ids = kept[word] = subwords(word)
            if ids:
                out.append(ids)
        return out

    def drawn(n: int) -> np.ndarray:
        """Starts of windows of a text of n words: evenly spread, DRAWN at most."""
        last = max(0, n - WINDOW)
        return np.unique(np.linspace(0, last, min(DRAWN, last // 3 + 1)).astype(int))

    model = ToxicityModel(None)
    for stage in range(ROUNDS):
        starts: list[tuple[int, int]] = []
        scorer = Scorer(model) if model.bucket is not None else None
        for k, words in enumerate(tokens):
            if not words:
                continue
            if scorer is None:
                # all of a toxic text, so that its few toxic words are met; some of another
                steps = range(0, max(1, len(words) - WINDOW + 1), WINDOW - 1) if labels[k] else drawn(len(words))
                starts += [(k, int(s)) for s in steps]
                continue
            logits = scorer.windows(texts[k])
            if labels[k]:
                starts += [(k, int(s)) for s in np.argsort(-logits, kind="stable")[:3] if logits[s] >= logits.max() - 1.0]
            else:
                starts += [(k, int(s)) for s in np.argsort(-logits, kind="stable")[:WORST]]
                starts += [(k, int(s)) for s in rng.integers(0, len(logits), 4)]
        batches = -(-len(starts) // BATCH)
        for _ in range(max(EPOCHS if scorer is None else 3 * EPOCHS, -(-LEAST_STEPS // max(1, batches)))):
            order = rng.permutation(len(starts))
            for at in range(0, len(order), BATCH):
                some = [starts[j] for j in order[at : at + BATCH]]
                net.step([bag(tokens[k][s : s + WINDOW]) for k, s in some], np.array([labels[k] for k, _ in some]), 0.1)
        model = ToxicityModel(net.buckets(), float(net.bias[1] - net.bias[0]))
    scorer = Scorer(model)
    worst = np.array([w.max() if len(w := scorer.windows(t)) else model.bias for t in texts])
    model.scale, model.shift = _calibrated(worst, labels.astype(float))
    if odds is not None:
        model.shift += float(np.log(odds) - np.log(labels.sum() / (labels == 0).sum()))
    return model


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, other_rows: int = OTHER_ROWS) -> ToxicityModel:
    """Train on labelled documents; ``docs`` and ``labels`` must hold only rows that may be learned from.

    The chosen ids are few by construction, so they are broadcast and no text is shuffled.
    """
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("__toxic"))
    sizes = {r[0]: r[1] for r in usable.groupBy("__toxic").agg(F.count("*")).collect()}
    if len(sizes) < 2:
        return ToxicityModel(None)
    mean = docs.agg(F.avg(F.length("text"))).first()[0] or 1.0
    least = max(1, int(SAMPLE_CHARS / max(1.0, mean)))
    shares = {1: min(1.0, min(sample_rows, least) / sizes[1]), 0: min(1.0, min(other_rows, least) / sizes[0])}
    share = F.when(F.col("__toxic") == 1, F.lit(shares[1])).otherwise(F.lit(shares[0]))
    chosen = usable.where(sampled(F.col("doc_id"), share))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").toPandas().sort_values(["doc_id", "text"], kind="stable")
    return train([t if isinstance(t, str) else None for t in rows["text"]], rows["__toxic"].to_numpy(np.int64), sizes[1] / sizes[0])


_SCORERS: dict[str, Scorer] = {}


def _scoring(shared: Broadcast):
    name = uuid.uuid4().hex

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        if name not in _SCORERS:  # a worker keeps the scorer of the last model it met
            _SCORERS.clear()
            _SCORERS[name] = Scorer(shared.value)
        scorer = _SCORERS[name]
        return pa.array([scorer.score(t) for t in text.to_pylist()], pa.float64())

    return score


def toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text") -> Column:
    """The probability that the whole text is toxic."""
    ship_package(docs.sparkSession)
    return _scoring(docs.sparkSession.sparkContext.broadcast(model))(F.col(text))
