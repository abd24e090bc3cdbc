"""SimHash near-duplicates: pigeonring filtering before the full Hamming check, then connected components.

The 64 bits are a ring of four 16-bit segments. Two fingerprints at distance at most 2 have, by the pigeonring
principle, a chain of consecutive segments whose prefixes of 1, 2, 3 segments differ in at most 0, 1, 1 bits
(floor of prefix length * 2 / 4). The first two segments of a chain are the join key (segment i equal, segment i+1 with
at most one flipped bit on the probing side), the third prunes candidates, and the full distance decides.

Buckets with more than HOT distinct fingerprints would pair quadratically. Every fingerprint that is in, or probes, such
a bucket is linked exactly another way: two words are within two bits exactly when they share a word within one bit
of both, so each emits its 65 such words and all that meet at one are linked to the least of them.

Odd input: a null text has no words and so fingerprint zero, like an empty one; rows repeated under one id are one
node; a null id takes part in linking and gets its component's least non-null id (null if there is none).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heddle.llm.near_copies import keep_first, text_node
from heddle.operators.components import connected_components
from heddle.runtime import Scratch, ship_package

SEED = 42
SHINGLE = 3
DISTANCE = 2
SEGMENTS = 4
WIDTH = 64 // SEGMENTS
#: Distinct fingerprints in one bucket beyond which it is linked by shared one-bit neighbours instead of pairs.
HOT = 64
#: Ids of removed documents up to which they are broadcast instead of shuffling all texts by id.
BROADCAST_IDS = 1_000_000


def fingerprint(raw: bytes, width: int = SHINGLE, seed: int = SEED) -> int:
    """The signed 64-bit SimHash of a text's bytes."""
    words = raw.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    first, last = starts[:n].tolist(), ends[len(words) - n :].tolist()
    digests = map(xxhash.xxh64_intdigest, map(line.__getitem__, map(slice, first, last)), [seed] * n)
    hashes = np.fromiter(digests, np.uint64, n)
    counts = np.zeros(64, np.int64)
    for k in range(0, n, 8192):
        block = hashes[k : k + 8192].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<i8")[0])


@F.arrow_udf(T.LongType())
def simhash(text: pa.Array) -> pa.Array:
    return pa.array([fingerprint(raw or b"") for raw in text.cast(pa.binary()).to_pylist()], pa.int64())


def _segment(fp: Column, k: int) -> Column:
    return F.shiftrightunsigned(fp, WIDTH * (k % SEGMENTS)).bitwiseAND(F.lit((1 << WIDTH) - 1))


def _key(fp: Column, k: int) -> Column:
    """Chain start, its segment and the next, in one long."""
    return _segment(fp, k) + _segment(fp, k + 1) * F.lit(1 << WIDTH) + F.lit(k << (2 * WIDTH))


def _keys(fps: DataFrame) -> DataFrame:
    return fps.select("fp", F.explode(F.array(*[_key(F.col("fp"), k) for k in range(SEGMENTS)])).alias("key"))


def _probes(fps: DataFrame) -> DataFrame:
    """Every key a partner of ``fp`` can be filed under: the next segment as it is, or with one bit flipped."""
    flips = [0, *(1 << (WIDTH + b) for b in range(WIDTH))]
    keys = [_key(F.col("fp"), k).bitwiseXOR(F.lit(x).cast("long")) for k in range(SEGMENTS) for x in flips]
    return fps.select("fp", F.explode(F.array(*keys)).alias("key"))


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _chain_holds(a: Column, b: Column, key: Column) -> Column:
    """The prefix of three segments from the chain's start differs in at most one bit."""
    start = F.shiftright(key, 2 * WIDTH)
    diff = a.bitwiseXOR(b)
    outside = F.lit(False)
    for k in range(SEGMENTS):
        three = F.bit_count(_segment(diff, k)) + F.bit_count(_segment(diff, k + 1)) + F.bit_count(_segment(diff, k + 2))
        outside = outside | ((start == k) & (three <= DISTANCE * 3 // SEGMENTS))
    return outside


def links(fps: DataFrame, scratch: Scratch, hot: int = HOT) -> DataFrame:
    """Edges (a, b) among the distinct fingerprints ``fp``: a subset of all pairs within distance 2 that connects
    the same components. Every candidate passes the chain condition and the full Hamming check."""
    index, probes = _keys(fps), _probes(fps)
    crowded = scratch.table(index.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("key"), "crowded")
    some = crowded.count()
    left, right = probes.alias("l"), index.alias("r")
    if some:
        left = probes.join(crowded, "key", "left_anti").alias("l")
    pairs = left.join(right, F.col("l.key") == F.col("r.key")).where(F.col("l.fp") < F.col("r.fp"))
    a, b = F.col("l.fp"), F.col("r.fp")
    pairs = pairs.where(_chain_holds(a, b, F.col("l.key"))).where(distance(a, b) <= DISTANCE).select(a.alias("a"), b.alias("b"))
    if not some:
        return pairs
    touched = probes.join(crowded, "key", "left_semi").select("fp").distinct()
    around = F.concat(F.array(F.col("fp")), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), k))))
    near = touched.select("fp", F.explode(around).alias("hub"))
    least = near.groupBy("hub").agg(F.min("fp").alias("b"), F.max("fp").alias("top")).where(F.col("b") < F.col("top")).select("hub", "b")
    stars = near.join(least, "hub").where(F.col("fp") != F.col("b")).select(F.col("fp").alias("a"), "b")
    return pairs.unionByName(stars)


def components(docs: DataFrame, hot: int = HOT, also: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): ``doc_id``, signed ``fp``, ``component_id`` and, if columns are asked for
    in ``also``, those and ``component`` (one fingerprint of the component, the same for all its rows)."""
    spark = docs.sparkSession
    ship_package(spark)
    scratch = Scratch(spark, "simhash")
    extra = [column.alias(name) for name, column in (also or {}).items()]
    marked = scratch.table(docs.select("doc_id", simhash("text").alias("fp"), *extra), "marked")
    classes = scratch.table(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    edges = scratch.table(links(classes.select("fp"), scratch, hot).distinct(), "edges")
    labels = connected_components(edges.select(F.col("a").alias("src"), F.col("b").alias("dst")), scratch)
    named = classes.join(labels.select(F.col("node").alias("fp"), "component"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
    asked = ["component"] if also else []
    return marked.join(named.join(ids, "component").select("fp", *asked, "component_id"), "fp").select("doc_id", "fp", *(also or {}), *asked, "component_id")


def hex16(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def keep_one(docs: DataFrame) -> DataFrame:
    """The document with the least id of each component, with the columns of ``docs``, decided for each id and text: an id
    that stands for texts of several components stays with those that head theirs. Equal rows are kept once; rows with a
    null id cannot be told apart and all stay."""
    return keep_first(docs, components(docs, also={"node": text_node()}), BROADCAST_IDS)
