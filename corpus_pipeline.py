"""A corpus pipeline of five stages; each calls one operator of ``heddle.llm`` and hands its documents on as Parquet.

Quality rules drop what they reject; near-dedup keeps the document with the least id of each group of near copies
(five-word shingles, similarity 0.8; the stage keeps its name); benchmark
decontamination drops documents that hold a benchmark item; the secret scan replaces found secrets in the texts; best-fit
packing turns the rest into token pieces with their token ids and places in sequences.

All stages but the last give rows with the columns of ``documents``, whatever those are: extra columns, also under names that
the operators use themselves, pass through. Empty tables give empty tables. The stages say below what they do with nulls,
repeated rows and ties; a very long text is one row everywhere, held whole by one worker at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from heddle.llm import decontaminate, near_copies, packing, quality_rules, secrets
from heddle.runtime import Scratch, read_table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base check and that no learned rule rejects. Null and empty texts fail the base check;
    repeated rows are judged alike; without labels only the base check decides."""
    return quality_rules.keep_good(docs, read_table(spark, sf_dir, "labels").select("doc_id", "quality"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the least id and, of several texts under it, the least hash. Null, empty
    and blank texts are copies of each other; rows equal in id and text are folded; rows with a null id all stay."""
    return near_copies.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. A null text holds none; a repeated row goes or stays with its copies; items
    without words find nothing; null ids are treated like others."""
    return decontaminate.keep_clean(docs, read_table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with found secrets replaced and ``n_chars`` counted anew. A null text stays null; copies are scanned
    once and changed alike; spans that overlap or tie are replaced by one marker."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of all documents, with their ids. A null text is the end token alone; repeated rows are packed
    each; pieces of equal length tie and take places in the order of partitions."""
    return packing.pack(docs, with_ids=True)


STAGES = [
    ("quality_rules", quality),
    ("simhash_dedup", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("packing", pack),
]

#: Learned rules, near-copy components and tokenising have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written to the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.table(stage(spark, docs, sf_dir), f"{k}-{name}")
        if k:
            scratch.drop(f"{k - 1}-{STAGES[k - 1][0]}")  # its only reader is done
    return docs
