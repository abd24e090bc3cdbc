"""URL filters: a blocked Bloom filter of listed canonical URLs, then an exact hash join.

A listed entry is a canonical host and path prefix, such as ``example.org/es/``; it fits its host and all subdomains
and every path that starts with its path. Canonical means: without user, port and trailing dots, the host's A-Z in lower
case, the path's percent-codes resolved. ``canonical_entries`` makes entries of a table of URLs, whatever its size. Rules are
compared with the host and path as they stand, listed entries with the canonical ones.

A URL's candidate keys are its host and parent domains, each with every prefix of its path of a length that occurs in the
list. The Bloom filter keeps each key's bits in one 512-bit block, so a test touches one block; keys that pass go to an
exact join with the list, which removes false positives. The longest fitting rule decides, and of URLs without a rule a
fitting entry of the block list.

The filter is built where the list is: in parts by key hash, PART_KEYS keys each, written as files that the workers map.
Neither keys nor bits pass the driver, and a worker's memory holds the blocks it touches. Work is done on distinct URLs,
so repeated pages cost one look-up, and findings join back apart for URLs that very many pages share.

Odd input: a null URL, or one without ``://``, has an empty host and path, fits nothing and is allowed. Equally long rules
go to the one that sorts first. Rows with null ids are judged like others, repeated rows each. A percent-code that is none
leaves the path as it is. An empty list allows all; an empty table gives no rows. A very long URL costs its labels times the
list's path lengths. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.llm.joins import BROADCAST_ROWS, join_found
from heddle.llm.shards import Store, grouped, mixed, shard_of_hash
from heddle.runtime import Scratch, ship_package

#: The rules (verdict, host and path).
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: The method's own list: canonical entries of hosts that offer nothing to learn from.
LISTED = tuple(f"{name}.example.{top}/" for name in ("adult-x", "casino-win", "free-bets", "spam-farm") for top in ("com", "net", "org"))

BITS_PER_KEY = 16
HASHES = 6
BLOCK_BITS = 512
#: Keys of one part of the filter (8 MB of bits).
PART_KEYS = 1 << 22
SEED = 42
#: Entries up to which the exact join broadcasts the list.
SMALL_LIST = 100_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def canonical_host(host: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", ""), "[.]+$", "")


def canonical_path(path: Column) -> Column:
    return F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)


class BlockedBloom:
    """Bits of 64-bit key hashes; the high half picks a block, the low half its bits by double hashing."""

    def __init__(self, blocks: int, bits: np.ndarray):
        self.blocks, self.bits = blocks, bits

    @classmethod
    def build(cls, hashes: np.ndarray, bits_per_key: int = BITS_PER_KEY) -> BlockedBloom:
        blocks = max(1, -(-len(hashes) * bits_per_key // BLOCK_BITS))
        bloom = cls(blocks, np.zeros(blocks * (BLOCK_BITS // 8), np.uint8))
        for at in bloom._places(hashes):
            np.bitwise_or.at(bloom.bits, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        return bloom

    def _places(self, hashes: np.ndarray):
        block = (mixed(hashes) % np.uint64(self.blocks)).astype(np.int64) * BLOCK_BITS
        first = (hashes & np.uint64(0xFFFF)).astype(np.int64)
        step = ((hashes >> np.uint64(16)) & np.uint64(0xFFFF)).astype(np.int64) | 1
        for k in range(HASHES):
            yield block + (first + k * step) % BLOCK_BITS

    def may_hold(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for at in self._places(hashes):
            out &= (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return out


def key_hashes(keys: list[str]) -> np.ndarray:
    """The hashes that ``F.xxhash64`` gives."""
    return np.fromiter(map(xxhash.xxh64_intdigest, keys, [SEED] * len(keys)), np.uint64, len(keys))


def candidate_keys(host: Column, path: Column, lengths: list[int]) -> Column:
    """Every listed key that could fit: the host and its parent domains, each with the path's prefixes."""
    labels = F.split(host, "[.]")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    prefixes = F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths])
    known = F.filter(prefixes, lambda p: p.isNotNull())
    keys = F.flatten(F.transform(domains, lambda d: F.transform(known, lambda p: F.concat(d, p))))
    return F.when(host != "", keys).otherwise(F.array().cast("array<string>"))


def _filter(listed: DataFrame, n: int, scratch: Scratch, part_keys: int) -> tuple[Store, int]:
    """Writes the filter of ``listed`` in parts by key hash."""
    parts, store = max(1, -(-n // part_keys)), Store(scratch.root)
    high = F.shiftrightunsigned(F.xxhash64("key"), 32)
    hashed = listed.select(F.shiftright(high * F.lit(parts), 32).cast("int").alias("shard"), F.xxhash64("key").alias("h")).distinct()

    def build(shard: int, table: pa.Table) -> list[tuple]:
        bloom = BlockedBloom.build(table.column("h").to_numpy().astype(np.int64).view(np.uint64))
        return [(shard, store.put(f"bloom-{shard}", {"blocks": np.array([bloom.blocks]), "bits": bloom.bits}))]

    scratch.table(grouped(hashed, build, "shard int, file string", parts), "filter")
    return store, parts


def _passing(store: Store, parts: int):
    """Rows (url, keys) to rows (url, key) of the keys that the filter may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(1)
            flat = keys.flatten()
            hashes = key_hashes(flat.to_pylist())
            passed = np.zeros(len(hashes), bool)
            of = shard_of_hash(hashes, parts)
            for part in np.unique(of).tolist():
                arrays = store.open(f"bloom-{part}")
                if arrays:
                    own = np.flatnonzero(of == part) if parts > 1 else slice(None)
                    passed[own] = BlockedBloom(int(arrays["blocks"][0]), arrays["bits"]).may_hold(hashes[own])
            some = pa.array(np.flatnonzero(passed))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pc.list_parent_indices(keys).take(some)), flat.take(some)], names=["url", "key"])

    return run


def entries(spark, rules=RULES, listed=LISTED) -> DataFrame:
    """(key, verdict, is_rule) of the rules and the listed entries."""
    rows = [(key, verdict, True) for verdict, key in rules] + [(key, "block", False) for key in listed]
    return spark.createDataFrame(rows, "key string, verdict string, is_rule boolean")


def canonical_entries(urls: DataFrame, column: str = "url") -> DataFrame:
    """(key, verdict, is_rule) of a block list given as URLs, or as hosts with or without a path; null and empty ones
    are left out."""
    url = F.when(F.instr(F.col(column), "://") > 0, F.col(column)).otherwise(F.concat(F.lit("http://"), F.col(column)))
    host, path = canonical_host(host_of(url)), canonical_path(path_of(url))
    key = F.concat(host, F.when(path == "", F.lit("/")).otherwise(path))
    return urls.where(F.col(column).isNotNull() & (host != "")).select(key.alias("key"), F.lit("block").alias("verdict"), F.lit(False).alias("is_rule")).distinct()


def judge(pages: DataFrame, listed: DataFrame, part_keys: int = PART_KEYS) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page; ``listed`` is (key, verdict, is_rule)."""
    spark = pages.sparkSession
    ship_package(spark)
    scratch = Scratch(spark, "url-filter")
    n, lengths = listed.agg(F.count("*"), F.collect_set(F.length("key") - F.instr("key", "/") + 1)).first()
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rows = pages.select("page_id", "url")
    if not n:
        return rows.select("page_id", host.alias("host"), path.alias("path"), F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"))
    urls = rows.select("url").distinct().select("url", host.alias("host"), path.alias("path"))
    # the keys of the URL as it stands meet rules, those of the canonical one meet listed entries
    plain = candidate_keys(F.col("host"), F.col("path"), sorted(lengths))
    canonical = candidate_keys(canonical_host(F.col("host")), canonical_path(F.col("path")), sorted(lengths))
    keyed = urls.select("url", F.array_union(F.transform(plain, lambda k: F.concat(F.lit("="), k)), F.transform(canonical, lambda k: F.concat(F.lit("~"), k))).alias("keys"))
    listed = listed.withColumn("key", F.concat(F.when(F.col("is_rule"), "=").otherwise("~"), "key"))
    store, parts = _filter(listed, n, scratch, part_keys)
    passing = keyed.mapInArrow(_passing(store, parts), "url string, key string")
    hits = passing.join(F.broadcast(listed) if n <= SMALL_LIST else listed, "key")
    longest = F.min(F.struct((~F.col("is_rule")).alias("other"), (-F.length("key")).alias("size"), "key", "verdict")).alias("best")
    best = hits.groupBy("url").agg(longest)
    best = best.select(F.col("url").alias("__url"), F.col("best.verdict").alias("__verdict"), F.when(~F.col("best.other"), F.substr("best.key", F.lit(2))).alias("rule"))
    best = scratch.table(best, "best")
    joined = join_found(rows, "url", best, "__url", best.count() <= BROADCAST_ROWS)
    return joined.select("page_id", host.alias("host"), path.alias("path"), "rule", F.coalesce("__verdict", F.lit("allow")).alias("verdict"))
