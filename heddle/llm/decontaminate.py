"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Test items are short and documents long, so a symmetric similarity says nothing; what counts is the share of an item's
word shingles that a document holds. Items are partitioned by size (shingle counts from 2^k to 2^(k+1)-1), and each
partition is an index of its own. In it an item's MinHash sketch is its s least hashes, where s - 1 is what the partition's
largest item may miss. Containment bound: a document that holds a share c or more of an item of n shingles misses at most
n - ceil(c n) < s of them, hence not all s sketched ones, so the search loses nothing. A document with fewer than c 2^k
shingles of any item can hold no item of partition k, and is not looked up there. Documents are read once, in place, with all
their shingles, since no sketch of a long document says what it lacks. Every (document, item) hit is then decided
on the shingles themselves, as word tuples.

The items are a stated query set. They are sent to the tasks in blocks of at most BLOCK_SHINGLES shingles, one job over
the documents for each block, whose hits are written before the next block is built, so that the driver and each task
hold one block at a time.

Words are maximal runs of letters and digits, lower-cased. An item of fewer than five words has its whole word
sequence as its only shingle; an item without words is never found, and a null text has no words. Ids may be of any type;
items or documents with null ids are searched like others. A repeated item row (same id and text) is searched once, a
repeated document row gives repeated results. Items that overlap or tie are all reported. Without items nothing is found,
and an empty table gives no rows. A very long text is searched whole by one worker, in memory in proportion to its words.
Extra columns are not read by ``contaminated`` and stay as they are in ``keep_clean``, also under this module's names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from heddle.llm.names import columns_of, spare
from heddle.runtime import Scratch, ship_package

SHINGLE = 5
CONTAINMENT = 0.8
#: Shingles of items sent to the tasks at once.
BLOCK_SHINGLES = 500_000
_WORD = re.compile(r"[^\W_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Contaminated rows up to which their list is broadcast instead of shuffling all texts.
BROADCAST_ROWS = 1_000_000


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def shingles_of(words: list[str], width: int = SHINGLE) -> set[tuple[str, ...]]:
    if not words:
        return set()
    width = min(width, len(words))
    return {tuple(words[k : k + width]) for k in range(len(words) - width + 1)}


def least_found(n: int, containment: float = CONTAINMENT) -> int:
    """Shingles of ``n`` a document must hold; integer arithmetic on thousandths, rounded up."""
    return -(-n * round(containment * 1000) // 1000)


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _rolled(ids: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` word numbers."""
    out = np.zeros(len(ids) - width + 1, np.uint64)
    for k in range(width):
        out = out * _MIX + ids[k : k + len(out)]
    return _scramble(out)


class ItemIndex:
    """Word numbers and, for each shingle width and size partition, the sketches of a block of items."""

    def __init__(self, items: list[tuple[Any, str | None]], width: int = SHINGLE, containment: float = CONTAINMENT):
        self.width, self.containment = width, containment
        self.vocabulary: dict[str, int] = {}
        self.items: list[tuple[Any, list[str]]] = []
        sketches: dict[tuple[int, int], list[tuple[np.ndarray, int]]] = {}
        for item_id, text in dict.fromkeys(items):
            words = words_of(text)
            if not words:
                continue
            numbers = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], np.uint64)
            span = min(width, len(words))
            hashes = np.unique(_rolled(numbers, span))
            part = len(hashes).bit_length() - 1
            largest = 2 ** (part + 1) - 1
            sketches.setdefault((span, part), []).append((hashes[: largest - least_found(largest, containment) + 1], len(self.items)))
            self.items.append((item_id, words))
        self.partitions: dict[int, list[tuple[int, np.ndarray, np.ndarray]]] = {}
        for (span, part), parts in sorted(sketches.items()):
            keys = np.concatenate([s for s, _ in parts])
            owners = np.concatenate([np.full(len(s), k, np.int64) for s, k in parts])
            order = np.argsort(keys, kind="stable")
            self.partitions.setdefault(span, []).append((least_found(2**part, containment), keys[order], owners[order]))

    def candidates(self, numbers: np.ndarray) -> dict[int, set[int]]:
        """For each shingle width, the items of which a text (as word numbers, 0 for others) holds a sketched shingle."""
        found: dict[int, set[int]] = {}
        for span, partitions in self.partitions.items():
            if len(numbers) < span:
                continue
            known = np.cumsum(np.concatenate([[0], numbers == 0]))
            usable = np.flatnonzero(known[span:] == known[:-span])  # runs of words that all occur in items
            if not len(usable):
                continue
            hashes = np.unique(_rolled(numbers, span)[usable])
            for least, keys, owners in partitions:
                if len(hashes) < least:
                    break  # nor any larger partition
                low, high = np.searchsorted(keys, hashes), np.searchsorted(keys, hashes, side="right")
                for j in np.flatnonzero(high > low):
                    found.setdefault(span, set()).update(owners[low[j] : high[j]].tolist())
        return found

    def search(self, text: str | None) -> list[tuple[Any, int, int]]:
        """(item_id, its shingles, those found) of every item the text contains."""
        words = words_of(text)
        numbers = np.fromiter(map(self.vocabulary.get, words, [0] * len(words)), np.uint64, len(words))
        out = []
        for span, owners in self.candidates(numbers).items():
            held = shingles_of(words, span)
            for k in sorted(owners):
                item_id, own = self.items[k]
                asked = shingles_of(own, span)
                n = len(asked & held)
                if n >= least_found(len(asked), self.containment):
                    out.append((item_id, len(asked), n))
        return out


def _item_blocks(items: DataFrame, limit: int) -> Iterator[list[tuple[Any, str | None]]]:
    """The items in blocks of bounded size, one partition of them at the driver at a time."""
    block: list[tuple[Any, str | None]] = []
    size = 0
    for row in items.select("item_id", "text").toLocalIterator():
        size += len(words_of(row[1]))
        block.append((row[0], row[1]))
        if size >= limit:
            yield block
            block, size = [], 0
    if block:
        yield block


def _searcher(shared: Broadcast, id_type: T.DataType):
    fields = T.StructType([T.StructField("item_id", id_type), T.StructField("n_item_shingles", T.LongType()), T.StructField("n_found", T.LongType())])
    kind = to_arrow_type(T.ArrayType(fields))

    @F.arrow_udf(T.ArrayType(fields))
    def contained(text: pa.Array) -> pa.Array:
        index: ItemIndex = shared.value
        names = ("item_id", "n_item_shingles", "n_found")
        return pa.array([[dict(zip(names, x)) for x in index.search(t)] for t in text.to_pylist()], kind)

    return contained


def _by_block(docs: DataFrame, columns: list[Column], items: DataFrame, width: int, containment: float, limit: int) -> DataFrame | None:
    """``columns`` and ``found`` of the documents that contain an item, of all blocks; None without items. The hits of each
    block but an only one are written before the next is built."""
    spark = docs.sparkSession
    ship_package(spark)
    id_type = items.schema["item_id"].dataType
    scratch = Scratch(spark, "decontamination")
    parts: list[DataFrame] = []
    blocks = _item_blocks(items, limit)
    block = next(blocks, None)
    while block is not None:
        after = next(blocks, None)
        shared = spark.sparkContext.broadcast(ItemIndex(block, width, containment))
        found = docs.select(*columns, _searcher(shared, id_type)("text").alias("found")).where(F.size("found") > 0)
        if parts or after is not None:
            found = scratch.table(found, f"block-{len(parts)}")
            shared.destroy()
        parts.append(found)
        block = after
    return reduce(DataFrame.unionByName, parts) if parts else None


def contaminated(docs: DataFrame, items: DataFrame, width: int = SHINGLE, containment: float = CONTAINMENT, limit: int = BLOCK_SHINGLES) -> DataFrame:
    """(doc_id, item_id, n_item_shingles, n_found): every item of which a document holds the given share of shingles."""
    found = _by_block(docs.select("doc_id", "text"), [F.col("doc_id")], items, width, containment, limit)
    if found is None:
        none = docs.sparkSession.createDataFrame([], T.StructType([docs.schema["doc_id"], items.schema["item_id"]]))
        return none.select("doc_id", "item_id", F.lit(0).cast("long").alias("n_item_shingles"), F.lit(0).cast("long").alias("n_found"))
    return found.select("doc_id", F.explode("found").alias("f")).select("doc_id", "f.*")


def keep_clean(docs: DataFrame, items: DataFrame, limit: int = BLOCK_SHINGLES) -> DataFrame:
    """The documents that contain no item, with the columns of ``docs``. With several blocks, the texts that hold an item
    are named by their SHA-256 in the written hits and taken out at the end."""
    blocks = 0
    for block in _item_blocks(items, limit):
        blocks += 1
        if blocks > 1:
            break
        only = block
    if not blocks:
        return docs
    if blocks == 1:
        spark = docs.sparkSession
        ship_package(spark)
        name = spare(docs, "__found")
        shared = spark.sparkContext.broadcast(ItemIndex(only))
        marked = docs.withColumn(name, _searcher(shared, items.schema["item_id"].dataType)("text"))
        return marked.where(F.size(name) == 0).select(*columns_of(docs))
    named = F.sha2(F.coalesce("text", F.lit("")), 256)
    hits = _by_block(docs, [named.alias("hit")], items, SHINGLE, CONTAINMENT, limit).select("hit").distinct()
    hits = Scratch(docs.sparkSession, "decontamination").table(hits, "hits")
    hits = F.broadcast(hits) if hits.count() <= BROADCAST_ROWS else hits
    return docs.join(hits, named == F.col("hit"), "left_anti").select(*columns_of(docs))
