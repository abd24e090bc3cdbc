"""Near-duplicate candidates on 64-bit perceptual hashes: multi-probe bands, comparison, ranking and suppression."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.functions.columns import band, hamming64
from heddle.runtime import ship_package

#: Bits of a band, and the bucket size from which a bucket is dropped whole.
BAND_BITS = 16
BUCKET_CAP = 4096
#: Hashes of one block, two of which meet in a task; from how many on and into how many blocks they are dealt all the same.
BLOCK, SMALL, BLOCKS = 1 << 19, 4000, 8
#: Look-ups made at once, columns of a tile that is compared at once, and rough nanoseconds of a cell of it, of looking a bucket
#: up and of a row in it.
CELLS, TILE, TILE_NS, LOOK_NS, MEET_NS = 1 << 21, 1 << 12, 1, 8, 40


def probe_masks(radius: int, width: int = BAND_BITS) -> list[int]:
    """All masks of a band with at most ``radius`` bits."""
    return [sum(1 << b for b in bits) for n in range(radius + 1) for bits in combinations(range(width), n)]


def _plan(n: int, m: int, threshold: int) -> list[tuple[int, int, int]]:
    """The cheapest bands (shift, width, radius) by which n hashes find those of m others; none where comparing all is cheaper.
    Of hashes at most ``threshold`` bits apart one band differs in at most its radius, as the radii and one more for each
    band add up to more than the threshold."""
    best, cost = [], n * m * TILE_NS
    for parts in range(3, 9):
        room = threshold + 1 - parts
        bands = [(64 * k // parts, 64 * (k + 1) // parts - 64 * k // parts, room // parts + (k < room % parts)) for k in range(parts)]
        bands = [b for b in bands if b[2] >= 0]
        masks = [sum(math.comb(w, r) for r in range(radius + 1)) for _, w, radius in bands]
        spent = sum(n * x * LOOK_NS + n * m * x / 2**w * MEET_NS + (m + 2**w) * MEET_NS for x, (_, w, _) in zip(masks, bands))
        if spent < cost:
            best, cost = bands, spent
    return best


def close_pairs(x: np.ndarray, y: np.ndarray, threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j), each pair once, of 64-bit hashes x[i] and y[j] at most ``threshold`` bits apart: exact, in bounded memory."""
    bands = _plan(len(x), len(y), threshold)
    if not bands:
        wide = max(1, min(len(y), TILE))
        tall = max(1, TILE * TILE // 128 // wide)
        for a in range(0, len(x), tall):
            for b in range(0, len(y), wide):
                near = np.bitwise_count(x[a : a + tall, None] ^ y[None, b : b + wide]) <= threshold
                i, j = np.divmod(np.flatnonzero(near), near.shape[1])
                yield i + a, j + b
        return
    done: list[tuple[np.uint64, int]] = []
    for shift, width, radius in bands:
        ones = np.uint64((1 << width) - 1)
        cut = lambda h: ((h >> np.uint64(shift)) & ones).astype(np.int64)  # noqa: B023, E731
        keys = cut(y)
        order = np.argsort(keys, kind="stable")
        ends = np.concatenate([[0], np.cumsum(np.bincount(keys, minlength=1 << width))])
        masks = np.array(probe_masks(radius, width), np.int64)
        step = max(1, CELLS // len(masks))
        for a in range(0, len(x), step):
            probes = (cut(x[a : a + step])[:, None] ^ masks[None, :]).reshape(-1)
            first, size = ends[probes], ends[probes + 1] - ends[probes]
            hit = np.nonzero(size)[0]
            first, size, who = first[hit], size[hit], hit // len(masks) + a
            upto = np.cumsum(size)
            at = 0
            while at < len(size):  # as many buckets as hold CELLS rows, one at least
                to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + CELLS, "right")))
                n = size[at:to]
                i = np.repeat(who[at:to], n)
                j = order[np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[at:to], n)]
                apart = x[i] ^ y[j]
                good = np.bitwise_count(apart) <= threshold
                for bits, most in done:  # found by an earlier band
                    good &= np.bitwise_count(apart & bits) > most
                yield i[good], j[good]
                at = to
        done.append((ones << np.uint64(shift), radius))


def rows_within(rows: DataFrame, by: list[str], threshold: int) -> DataFrame:
    """(x, y): ids x < y (``id``, a long) of rows of one ``by`` group whose hashes ``h`` are at most ``threshold`` bits apart;
    a pair may come several times if an id has several hashes.

    Rows are dealt into blocks by id, and any two blocks meet in one task, which looks for near hashes by bands or, where
    those select too little, compares all. So no task holds more than two blocks, whatever values are frequent, and only pairs
    that are near leave it.
    """
    ship_package(rows.sparkSession)
    n = max([r["count"] for r in rows.groupBy(*by).count().collect()], default=0) if by else rows.count()
    blocks = max(-(-n // BLOCK), min(BLOCKS, -(-n // SMALL)), 1)
    own = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    dealt = rows.select(*by, "id", "h", own.alias("__own"), other.alias("__other"))
    dealt = dealt.select(*by, "id", "h", "__own", F.least("__own", "__other").alias("__p"), F.greatest("__own", "__other").alias("__q"))

    def run(table: pa.Table) -> pa.Table:
        column = lambda name: table[name].to_numpy()
        ids, hashes, block = column("id"), column("h").view(np.uint64), column("__own")
        p, q = int(column("__p")[0]), int(column("__q")[0])
        left, right = np.nonzero(block == p)[0], np.nonzero(block == q)[0]
        out = []
        for i, j in close_pairs(hashes[left], hashes[right], threshold):
            a, b = ids[left[i]], ids[right[j]]
            keep = a < b if p == q else a != b
            out.append(np.stack([np.minimum(a[keep], b[keep]), np.maximum(a[keep], b[keep])]))
        x, y = np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.int64)
        return pa.table({"x": pa.array(x, pa.int64()), "y": pa.array(y, pa.int64())})

    keys = [*by, "__p", "__q"]
    return dealt.repartition(max(1, blocks * (blocks + 1) // 2) * (4 if by else 1), *keys).groupBy(*keys).applyInArrow(run, "x long, y long")


def hash_classes(df: DataFrame, item: str, value: str) -> DataFrame:
    """(h, first, members): each distinct hash with its least item and how many items have it."""
    return df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("h")).agg(F.min(item).alias("first"), F.count("*").alias("members"))


def _filed(hashes: DataFrame) -> DataFrame:
    bands = [F.struct(F.lit(k).alias("b"), band(F.col("h"), F.lit(k), BAND_BITS).alias("v")) for k in range(64 // BAND_BITS)]
    return hashes.select("h", F.explode(F.array(*bands)).alias("f")).select("h", "f.*")


def near_hashes(hashes: DataFrame, threshold: int, cap: int | None = None, counts: str | None = None) -> DataFrame:
    """(x, y, distance) of distinct hashes ``h`` at most ``threshold`` bits apart, x < y.

    The result is exact (``rows_within``). With ``cap``, 64 bits are four bands; of two such hashes some band differs in at most
    threshold div 4 bits. Which band values lie so near each other is found among the distinct values, 65536 a band at most,
    before any hash is joined, and a bucket of more items (``counts`` is the column that says how many have a hash) is dropped
    whole, which may lose pairs.
    """
    if cap is None:
        found = rows_within(hashes.select(F.col("h").alias("id"), "h"), [], threshold)
        return found.withColumn("distance", hamming64(F.col("x"), F.col("y")))
    filed = _filed(hashes)
    weight = F.sum(counts) if counts else F.count("*")
    large = filed.join(hashes, "h").groupBy("b", "v").agg(weight.alias("n")).where(F.col("n") > cap).select("b", "v")
    asked, filed = filed, filed.join(large, ["b", "v"], "left_anti")
    masks = F.array(*[F.lit(m).cast("long") for m in probe_masks(threshold // (64 // BAND_BITS))])
    values = asked.select("b", "v").distinct()
    neighbours = values.withColumn("w", F.explode(F.transform(masks, lambda m: F.col("v").bitwiseXOR(m))))
    neighbours = neighbours.join(filed.select("b", F.col("v").alias("w")).distinct(), ["b", "w"], "left_semi")
    met = asked.select(F.col("h").alias("x"), "b", "v").join(neighbours, ["b", "v"]).join(filed.select(F.col("h").alias("y"), "b", F.col("v").alias("w")), ["b", "w"])
    # with a cap, a dropped bucket on one side may be asked from the other, so both directions count
    close = met.where(hamming64(F.col("x"), F.col("y")) <= threshold).where("x <> y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    return close.withColumn("distance", hamming64(F.col("x"), F.col("y")))


def near_pairs(df: DataFrame, item: str, value: str, threshold: int, cap: int | None = None) -> DataFrame:
    """(left, right, distance, left_members, right_members): pairs of classes of items with equal hashes, each named by its
    least item, that are at most ``threshold`` bits apart, and a row with distance 0 for each class of several items (left and
    right are its least and its greatest item). Copies are counted, not paired; ``hash_classes`` says which items they are."""
    classes = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("h")).agg(F.min(item).alias("first"), F.max(item).alias("last"), F.count("*").alias("members"))
    close = near_hashes(classes.select("h", "members"), threshold, cap, "members")
    a = classes.select(F.col("h").alias("x"), F.col("first").alias("i"), F.col("members").alias("m"))
    b = classes.select(F.col("h").alias("y"), F.col("first").alias("j"), F.col("members").alias("n"))
    both = close.join(a, "x").join(b, "y")
    swap = F.col("i") > F.col("j")
    pick = lambda name, first, second: F.when(swap, F.col(second)).otherwise(F.col(first)).alias(name)
    apart = both.select(pick("left", "i", "j"), pick("right", "j", "i"), "distance", pick("left_members", "m", "n"), pick("right_members", "n", "m"))
    same = classes.where("members > 1").select(F.col("first").alias("left"), F.col("last").alias("right"), F.lit(0).alias("distance"), F.col("members").alias("left_members"), F.col("members").alias("right_members"))
    return apart.unionByName(same)


def suppressed(pairs: DataFrame, decisions: DataFrame) -> DataFrame:
    """Pairs without those that a decision (left, right, in any order) names."""
    named = decisions.select(F.least("left", "right").alias("left"), F.greatest("left", "right").alias("right")).distinct()
    return pairs.join(named, ["left", "right"], "left_anti")


def compare_static(pairs: DataFrame, thresholds: dict[str, int] | None = None) -> DataFrame:
    """Signals and priority of candidate pairs with one sample a side.

    ``pairs`` has, with suffixes ``_l`` and ``_r``: layout, content, alpha, edge (longs), canonical, shape (digests),
    alpha_mode, color_behavior, low_information, duration_ms, literal. Pairs without a signal are no candidates.
    """
    # Greatest distances of the signals.
    limit = {"primary": 8, "alpha": 12, "high_primary": 4, "high_alpha": 8, "adaptive_alpha": 8, "adaptive_edge": 8} | (thresholds or {})
    c = F.col

    def far(name: str) -> Column:
        return hamming64(c(f"{name}_l"), c(f"{name}_r"))

    primary, alpha, edge = F.least(far("layout"), far("content")), far("alpha"), far("edge")
    informed = ~c("low_information_l") & ~c("low_information_r")
    changing = c("color_behavior_l").isin("platform-adaptive", "mixed") | c("color_behavior_r").isin("platform-adaptive", "mixed")
    seen_through = c("alpha_mode_l").isin("binary", "translucent") | c("alpha_mode_r").isin("binary", "translucent")
    eligible = informed & (changing | seen_through)
    alpha_ok = ((c("alpha_mode_l") == "opaque") & (c("alpha_mode_r") == "opaque")) | (alpha <= limit["alpha"])
    high_alpha_ok = ((c("alpha_mode_l") == "opaque") & (c("alpha_mode_r") == "opaque")) | (alpha <= limit["high_alpha"])
    shape = eligible & (c("shape_l") == c("shape_r"))
    recolor = shape | (eligible & (alpha <= limit["adaptive_alpha"]) & (edge <= limit["adaptive_edge"]))
    speed = F.when((c("duration_ms_l") > 0) & (c("duration_ms_r") > 0), F.greatest("duration_ms_l", "duration_ms_r") / F.least("duration_ms_l", "duration_ms_r")).otherwise(F.lit(1.0))
    texts = (F.coalesce(c("literal_l"), F.lit("")) != "") & (F.coalesce(c("literal_r"), F.lit("")) != "")
    signals = [
        (c("canonical_l") == c("canonical_r"), "canonical-render-match"),
        ((primary <= limit["primary"]) & alpha_ok, "phash-match"),
        (recolor, "possible-recolor"),
        (shape, "shape-match"),
    ]
    found = F.array_compact(F.array(*[F.when(test, F.lit(name)) for test, name in signals]))
    more = F.array_compact(F.array(F.when(speed > 1.15, F.lit("speed-change")), F.when(texts & (c("literal_l") != c("literal_r")), F.lit("possible-variant"))))
    out = pairs.withColumns({"primary_distance": primary, "alpha_distance": alpha, "edge_distance": edge, "speed_ratio": speed, "__found": found, "high_priority": (primary <= limit["high_primary"]) & high_alpha_ok})
    return out.where(F.size("__found") > 0).withColumn("signals", F.array_sort(F.concat("__found", more))).drop("__found")
