"""Quality rules: a learned decision list over text statistics, emitted as ordered Spark conditional expressions.

Sequential covering in the manner of RIPPER: a rule is a conjunction of thresholds on statistics; it is grown on two
thirds of the labelled sample by information gain and pruned on the rest; the rows it covers are removed and the next
rule is learned. The list finds *bad* documents; what no rule covers is kept.

Defined results for odd input: a null text counts as the empty text (all statistics 0, so the base check fails);
rows with a null label, or whose label is neither 0 nor 1, teach nothing; a document labelled twice teaches its worse
label; with no usable labels the list is empty and only the base check decides. Extra columns pass through unread.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heddle.llm.folds import sampled
from heddle.llm.names import columns_of, spare
from heddle.runtime import ship_package

#: Labelled rows a list is learned from at most (a bounded sample by hash of the id).
SAMPLE_ROWS = 20_000
#: A rule stays only if at least this share of what it covers in the pruning set is bad.
MIN_PRECISION = 0.9
MIN_COVER = 4
MAX_RULES = 12
MAX_CONDITIONS = 4
WINDOW = 8

_SPACE = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256))
STATISTICS = ("n_chars", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_nonletter")
STATISTICS_TYPE = T.StructType([T.StructField(name, T.LongType()) for name in STATISTICS])
_MIX = np.uint64(0x9E3779B97F4A7C15)


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words that lie in a ``width``-word window found twice or more in the text, its first occurrence included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    numbers = {word: k for k, word in enumerate(dict.fromkeys(words))}
    keys = np.fromiter(map(numbers.__getitem__, words), np.uint64, len(words))
    windows = np.zeros(n, np.uint64)
    for k in range(width):
        windows *= _MIX
        windows += keys[k : n + k]
    order = np.argsort(windows, kind="stable")
    ordered = windows[order]
    same = np.flatnonzero(ordered[1:] == ordered[:-1])
    if not len(same):
        return 0
    suspects = np.unique(np.concatenate([order[same], order[same + 1]]))  # the few windows whose hash is not alone
    seen: dict[bytes, list[int]] = {}
    for k in suspects.tolist():
        seen.setdefault(keys[k : k + width].tobytes(), []).append(k)
    hits = np.array([k for places in seen.values() if len(places) > 1 for k in places], np.int64)
    edges = np.zeros(len(words) + 1, np.int32)
    np.add.at(edges, hits, 1)
    np.add.at(edges, hits + width, -1)
    return int(np.count_nonzero(np.cumsum(edges)[:-1]))


def statistics_of(raw: bytes, n_chars: int) -> tuple[int, ...]:
    words = raw.split()
    lines = raw.split(b"\n")
    full = [line for line in lines if line.strip()]
    spaces = len(raw) - len(raw.translate(None, _SPACE))
    return (
        n_chars,
        len(words),
        n_chars - spaces,
        len(raw) - len(raw.translate(None, _SYMBOLS)),
        len(full),
        len(full) - len(set(full)),
        repeated_words(words),
        len(raw) - len(raw.translate(None, _UPPER)),
        len(raw.translate(None, _LETTERS)) - spaces,
    )


@F.arrow_udf(STATISTICS_TYPE)
def text_statistics(text: pa.Array) -> pa.Array:
    """One struct of statistics for each whole text."""
    n_chars = pc.fill_null(pc.utf8_length(text), 0).to_pylist()
    rows = [statistics_of(raw or b"", n) for raw, n in zip(text.cast(pa.binary()).to_pylist(), n_chars)]
    columns = list(zip(*rows)) if rows else [()] * len(STATISTICS)
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=list(STATISTICS))


@dataclass(frozen=True)
class Feature:
    """``numerator / denominator`` of two statistics, or the numerator itself."""

    numerator: str
    denominator: str | None = None

    def values(self, table: dict[str, np.ndarray]) -> np.ndarray:
        top = table[self.numerator].astype(float)
        return top if self.denominator is None else top / np.maximum(table[self.denominator], 1)

    def column(self, stats: Column) -> Column:
        top = stats[self.numerator].cast("double")
        return top if self.denominator is None else top / F.greatest(stats[self.denominator], F.lit(1))


FEATURES = (
    Feature("n_words"),
    Feature("word_chars", "n_words"),
    Feature("n_symbols", "n_words"),
    Feature("n_dup_lines", "n_lines"),
    Feature("n_repeat_words", "n_words"),
    Feature("n_words", "n_lines"),
    Feature("n_upper", "word_chars"),
    Feature("n_nonletter", "word_chars"),
)


@dataclass(frozen=True)
class Condition:
    feature: int
    above: bool
    threshold: float

    def mask(self, matrix: np.ndarray) -> np.ndarray:
        values = matrix[:, self.feature]
        return values >= self.threshold if self.above else values < self.threshold

    def column(self, stats: Column) -> Column:
        value = FEATURES[self.feature].column(stats)
        return value >= F.lit(float(self.threshold)) if self.above else value < F.lit(float(self.threshold))


Rule = tuple[Condition, ...]


def _covers(rule: Rule, matrix: np.ndarray) -> np.ndarray:
    out = np.ones(len(matrix), bool)
    for condition in rule:
        out &= condition.mask(matrix)
    return out


def _best_condition(matrix: np.ndarray, bad: np.ndarray) -> tuple[float, Condition | None]:
    """The threshold with the greatest gain: bad rows covered times the rise of the log share of bad rows."""
    total_bad, total = bad.sum(), len(bad)
    base = np.log2(total_bad / total)
    best: tuple[float, Condition | None] = (1e-9, None)
    for j in range(matrix.shape[1]):
        order = np.argsort(matrix[:, j], kind="stable")
        values, marks = matrix[order, j], bad[order]
        cuts = np.flatnonzero(values[1:] > values[:-1]) + 1
        if not len(cuts):
            continue
        below_bad, below = np.cumsum(marks)[cuts - 1], cuts
        for above, p, n in ((False, below_bad, below), (True, total_bad - below_bad, total - below)):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(p > 0, p * (np.log2(p / n) - base), -1.0)
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (float(gain[k]), Condition(j, above, float((values[cuts[k]] + values[cuts[k] - 1]) / 2)))
    return best


def _grow(matrix: np.ndarray, bad: np.ndarray) -> Rule:
    rule: Rule = ()
    inside = np.ones(len(bad), bool)
    while len(rule) < MAX_CONDITIONS and 0 < bad[inside].sum() < inside.sum():
        _, condition = _best_condition(matrix[inside], bad[inside])
        if condition is None:
            break
        rule += (condition,)
        inside &= condition.mask(matrix)
    return rule


def _worth(rule: Rule, matrix: np.ndarray, bad: np.ndarray) -> float:
    hit = _covers(rule, matrix)
    p, n = (hit & bad).sum(), (hit & ~bad).sum()
    return (p - n) / (p + n) if p + n else -1.0


def _prune(rule: Rule, matrix: np.ndarray, bad: np.ndarray) -> Rule:
    best = max((rule[:k] for k in range(len(rule), 0, -1)), key=lambda r: _worth(r, matrix, bad), default=())
    return best


def learn(table: dict[str, np.ndarray], bad: np.ndarray) -> list[Rule]:
    """The ordered rules, each finding bad rows; empty where there is nothing to learn."""
    matrix = np.column_stack([f.values(table) for f in FEATURES]) if len(bad) else np.zeros((0, len(FEATURES)))
    rules: list[Rule] = []
    rows = np.arange(len(bad))
    while len(rules) < MAX_RULES and 0 < bad[rows].sum() < len(rows):
        grow, prune = rows[np.arange(len(rows)) % 3 != 2], rows[np.arange(len(rows)) % 3 == 2]
        if not 0 < bad[grow].sum() < len(grow):
            break
        rule = _prune(_grow(matrix[grow], bad[grow]), matrix[prune], bad[prune]) if bad[prune].any() else _grow(matrix[grow], bad[grow])
        if not rule:
            break
        hit = _covers(rule, matrix[rows])
        p, n = (hit & bad[rows]).sum(), hit.sum()
        checked = _covers(rule, matrix[prune])
        good_in_prune = (checked & ~bad[prune]).sum()
        if n < MIN_COVER or p < MIN_PRECISION * n or good_in_prune > (1 - MIN_PRECISION) * max(1, checked.sum()):
            break
        rules.append(rule)
        rows = rows[~hit]
    return rules


def verdict(stats: Column, rules: list[Rule]) -> Column:
    """Number of the first rule that fits (from 1), else 0, as one ordered conditional expression."""
    out = None
    for k, rule in enumerate(rules, 1):
        fits = rule[0].column(stats)
        for condition in rule[1:]:
            fits = fits & condition.column(stats)
        out = F.when(fits, F.lit(k)) if out is None else out.when(fits, F.lit(k))
    return F.lit(0) if out is None else out.otherwise(F.lit(0))


def labelled_sample(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Statistics and labels of at most about ``sample_rows`` labelled documents, chosen by hash of the id.

    The chosen ids are few by construction, so they are broadcast and no text is shuffled.
    """
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    usable = usable.groupBy("doc_id").agg(F.min("quality").alias("__quality"))
    share = min(1.0, sample_rows / max(1, usable.count()))
    chosen = usable.where(sampled(F.col("doc_id"), share))
    rows = (
        docs.select("doc_id", "text")
        .join(F.broadcast(chosen), "doc_id")
        .select("doc_id", "__quality", text_statistics("text").alias("s"))
        .select("doc_id", "__quality", "s.*")
        .toPandas()
        .sort_values(["doc_id", *STATISTICS], kind="stable")
    )
    return {name: rows[name].to_numpy(np.int64) for name in STATISTICS}, rows["__quality"].to_numpy() == 0


def judge(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, name: str = "__quality") -> DataFrame:
    """``docs`` with a struct ``name``: the statistics, ``base_failed``, ``rule`` and ``kept``."""
    ship_package(docs.sparkSession)
    rules = learn(*labelled_sample(docs, labels, sample_rows))
    stats = docs.withColumn(name, text_statistics("text"))
    s = F.col(name)
    failed = (s["n_words"] < 20) | (100 * s["n_repeat_words"] > 30 * s["n_words"])
    fields = [s[statistic].alias(statistic) for statistic in STATISTICS]
    rule = verdict(s, rules)
    return stats.withColumn(name, F.struct(*fields, failed.alias("base_failed"), rule.alias("rule"), (~failed & (rule == 0)).alias("kept")))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Only the documents the decision list keeps, with the columns of ``docs``."""
    name = spare(docs, "__quality")
    return judge(docs, labels, name=name).where(F.col(name)["kept"]).select(*columns_of(docs))
