"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.llm import decontaminate, language_id, ngram_lm, packing, quality_rules, secrets, simhash, suffix_dedup, toxicity, url_filter
from heddle.llm.folds import held_out
from heddle.runtime import Scratch, read_table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the documents that are not held out."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fold = held_out(F.col("doc_id"), 4, 2)
    model = language_id.fit(docs.where(~fold))
    found = docs.select("doc_id", fold.alias("held_out"), language_id.identify(docs, model).alias("p"))
    return found.select("doc_id", "held_out", "p.lang_pred", "p.score")


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document, scanned once per distinct text through the blob ledger."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    scratch = Scratch(spark, "secrets")
    found = scratch.table(secrets.scan(docs, scratch), "findings")
    return secrets.digest(secrets.findings_by_path(docs, found))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold at least 0.8 of a benchmark item's five-word shingles."""
    return decontaminate.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log10 probability of every document under an n-gram model of the documents that are not held out."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    learned = ~held_out(F.col("doc_id"), 5, 1) & F.col("doc_id").isNotNull()
    trie, rows = ngram_lm.build(docs, learned, Scratch(spark, "ngram-lm"))
    scored = ngram_lm.score(trie, rows)
    fold = held_out(F.col("doc_id"), 5, 1).alias("held_out")
    return scored.select("doc_id", fold, "n_tokens", "n_known", F.lit(trie.total).cast("long").alias("train_tokens"), "base_score", "score")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page."""
    return url_filter.judge(read_table(spark, sf_dir, "pages").select("page_id", "url"), url_filter.entries(spark))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from labelled documents that are not held out."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "toxic")
    fold = held_out(F.col("doc_id"), 4, 2)
    model = toxicity.fit(docs.where(~fold), labels.where(~fold))
    scored = docs.select("doc_id", fold.alias("held_out"), toxicity.toxicity(docs, model).alias("score"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without strings of 100 bytes that stand earlier."""
    return suffix_dedup.deduplicate(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token pieces and their places in sequences of 4096 tokens."""
    return packing.pack(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of every document and whether the base check and the learned decision list keep it."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = quality_rules.judge(docs, read_table(spark, sf_dir, "labels").select("doc_id", "quality"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
    return judged.select("doc_id", *[F.col(f"__quality.{name}").alias(name) for name in names])


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.components(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_language_id, op2_secret_scans, op3_decontamination, op4_lm_scoring, op5_url_filter, op6_toxicity, op7_suffix_dedup, op8_packing, op9_quality_rules, op10_simhash)
}
