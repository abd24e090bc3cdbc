"""Near copies by word shingles: SimHash and MinHash propose, the exact Jaccard similarity decides, components group.

Two texts are near copies when their sets of five-word shingles have a Jaccard similarity of at least 0.8. SimHash with
pigeonring filtering (``simhash.links``) proposes those within two bits. It cannot propose all: at 0.8 about 15 % of the bits
differ, for which pigeonring segments are too short to select anything. So texts that share one of BANDS groups of ROWS
minima are candidates too; a pair at exactly 0.8 shares none with a chance of (1 - 0.8^6)^40, about 5 in a million, and less
above. Every pair that links is verified on the whole sets.

Buckets of minima are linked in two passes. First each member is compared with its bucket's leader, the member that meets
most others in all its buckets. Then, with components known, pairs of one bucket that lie in different components are compared;
a bucket that is already one component costs nothing, however large. In buckets of up to CROWDED members these are all such
pairs. Members of larger ones meet by prefixes instead: sets of n and m shingles that are similar enough share at least
k = 4/9 (n + m), so, with all shingles in one order, the first n - k + 1 of one and the first m - k + 1 of the other have one in
common. The order is rarest first, by counts over these members; a shingle that only one of them has is passed over. Prefixes are
cut for each class of partners' sizes, so that members that differ from all others in too many shingles meet nobody.
No verified pair is left unlinked.

Odd input: words are maximal runs without white space, lower-cased; a text of fewer than five words is one shingle; null
and blank texts have none and are copies of each other. Equal texts are one node, named by their 64-bit hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heddle.llm.names import columns_of, spare
from heddle.operators.components import connected_components
from heddle.runtime import Scratch, ship_package

SHINGLE = 5
#: Least similarity, in fifths: 4 of 5.
SIMILAR, OF = 4, 5
BANDS, ROWS = 40, 6
SEED = 42
#: Members of a bucket beyond which they meet by prefixes.
CROWDED = 16
#: Slots in which shingles of crowded members are counted. Shingles that fall together count as one, which makes prefixes
#: less selective, never wrong.
SLOTS = 1 << 22
#: The least size of each class of sizes: 1, 2, 3, ... and then 5 % more each.
BOUNDS = [1]
while BOUNDS[-1] < 1 << 40:
    BOUNDS.append(max(BOUNDS[-1] + 1, BOUNDS[-1] * 21 // 20))
#: Rows up to which a list of nodes or of removed rows is broadcast instead of shuffling all texts.
BROADCAST_ROWS = 1_000_000
_RND = np.random.default_rng(SEED)
_FACTORS = _RND.integers(0, 2**63, (BANDS * ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1)
_OFFSETS = _RND.integers(0, 2**64, (BANDS * ROWS, 1), np.uint64)


def shingles(raw: bytes, width: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a text's word shingles."""
    words = raw.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    n = max(1, len(words) - width + 1)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    first, last = starts[:n].tolist(), ends[len(words) - n :].tolist()
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, map(line.__getitem__, map(slice, first, last)), [SEED] * n), np.uint64, n))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One signed key for each band of minima."""
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for k in range(0, len(hashes), 512):
        np.minimum(least, (hashes[None, k : k + 512] * _FACTORS + _OFFSETS).min(axis=1), out=least)
    rows = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(rows[k].tobytes(), k) for k in range(BANDS)], np.uint64).view(np.int64)


def set_fingerprint(hashes: np.ndarray) -> int:
    """The signed 64-bit SimHash of a set of shingles: a bit is 1 if set in over half of them."""
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 8192):
        block = hashes[k : k + 8192].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<i8")[0])


@F.arrow_udf(T.ArrayType(T.LongType()))
def _bands(text: pa.Array) -> pa.Array:
    """The keys of all bands, and the fingerprint."""
    sets = map(shingles, (raw or b"" for raw in text.cast(pa.binary()).to_pylist()))
    return pa.array([[*band_keys(x).tolist(), set_fingerprint(x)] for x in sets], pa.list_(pa.int64()))


@F.arrow_udf(T.BinaryType())
def _sets(text: pa.Array) -> pa.Array:
    return pa.array([shingles(raw or b"").tobytes() for raw in text.cast(pa.binary()).to_pylist()], pa.binary())


@F.arrow_udf(T.LongType())
def _common(a: pa.Array, b: pa.Array) -> pa.Array:
    both = zip(a.to_pylist(), b.to_pylist())
    return pa.array([len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True)) for x, y in both], pa.int64())


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(40)).astype(np.int64) % SLOTS


def _counts(batches):
    """(slot, n) of all sets of a partition."""
    found = [np.zeros(0, np.int64)]
    for batch in batches:
        found.append(_slots(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint64)))
    slots, n = np.unique(np.concatenate(found), return_counts=True)
    yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int64()), pa.array(n, pa.int64())], ["slot", "n"])


def prefixes(hashes: np.ndarray, slots: np.ndarray, counts: np.ndarray) -> tuple[int, list[tuple[int, int]]]:
    """The class of a set's size and, for each class of partners' sizes, the shingles (signed) by which they meet."""
    n = len(hashes)
    own = int(np.searchsorted(BOUNDS, n, "right")) - 1
    if not n:
        return own, []
    held = counts[_places(hashes, slots)]
    ordered = hashes[np.lexsort((hashes, held))].view(np.int64).tolist()
    alone = int((held == 1).sum())
    least, most = -(-n * SIMILAR // OF), n * OF // SIMILAR
    out = []
    for other in range(int(np.searchsorted(BOUNDS, least, "right")) - 1, int(np.searchsorted(BOUNDS, most, "right"))):
        share = -(-(n + max(BOUNDS[other], least)) * SIMILAR // (SIMILAR + OF))
        out += [(x, other) for x in ordered[alone : n - share + 1]]
    return own, out


def _places(hashes: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Where the counts of shingles stand: at 0 what has a slot alone, else one behind the slot's place among ``slots``."""
    if not len(slots):
        return np.zeros(len(hashes), np.int64)
    wanted = _slots(hashes)
    at = np.minimum(np.searchsorted(slots, wanted), len(slots) - 1)
    return np.where(slots[at] == wanted, at + 1, 0)


def _prefix_keys(crowd: DataFrame, scratch: Scratch) -> DataFrame:
    """(bucket, node, component, own, other) of crowded members (hashes, node, component)."""
    partial = crowd.select("hashes").mapInArrow(_counts, "slot long, n long")
    shared = partial.groupBy("slot").agg(F.sum("n").alias("n")).where("n > 1")
    table = shared.toArrow()  # at most SLOTS rows
    slots, n = (table.column(c).to_numpy() for c in ("slot", "n"))
    order = np.argsort(slots)
    known = crowd.sparkSession.sparkContext.broadcast((slots[order], np.concatenate([[1], n[order]])))

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def keys(sets: pa.Array) -> pa.Array:
        """The class of the size, then shingles and classes of partners by turns."""
        found = (prefixes(np.frombuffer(x, np.uint64), *known.value) for x in sets.to_pylist())
        return pa.array([[own, *(v for pair in met for v in pair)] for own, met in found], pa.list_(pa.int64()))

    told = scratch.table(crowd.select("node", "component", keys("hashes").alias("k")), "prefixes")
    at = F.explode(F.sequence(F.lit(1), F.size("k") - 1, F.lit(2))).alias("at")
    rows = told.where(F.size("k") > 1).select("node", "component", F.col("k")[0].alias("own"), "k", at)
    rows = rows.select("node", "component", "own", F.col("k")[F.col("at")].alias("shingle"), F.col("k")[F.col("at") + 1].alias("other"))
    return rows.withColumn("bucket", F.xxhash64("shingle", F.least("own", "other"), F.greatest("own", "other"))).drop("shingle")


def _across(told: DataFrame, scratch: Scratch, name: str, on: str = "true") -> DataFrame:
    """Pairs (a, b) of one bucket that lie in different components; ``told`` has bucket, node and component. Each has a member
    outside the bucket's main component."""
    sizes = told.groupBy("bucket", "component").agg(F.count("*").alias("size"))
    main = sizes.groupBy("bucket").agg(F.max_by("component", F.struct("size", "component")).alias("main"), F.count("*").alias("parts")).where("parts > 1")
    split = scratch.table(told.join(main.select("bucket", "main"), "bucket"), f"split-{name}")
    strays, others = split.where("component <> main").alias("s"), split.alias("o")
    met = strays.join(others, (F.col("s.bucket") == F.col("o.bucket")) & (F.col("s.component") != F.col("o.component")) & F.expr(on))
    return met.select(F.least("s.node", "o.node").alias("a"), F.greatest("s.node", "o.node").alias("b")).distinct()


def text_node() -> Column:
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that are similar enough."""
    left, right = sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), sets.select(F.col("node").alias("b"), F.col("hashes").alias("y"))
    n, m = F.length("x"), F.length("y")
    sized = pairs.join(left, "a").join(right, "b").where(F.least(n, m) * OF >= F.greatest(n, m) * SIMILAR)
    common = sized.select("a", "b", ((n + m) / 8).cast("long").alias("total"), _common("x", "y").alias("common"))
    return common.where(F.col("common") * OF >= (F.col("total") - F.col("common")) * SIMILAR).select("a", "b")


def components(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): ``doc_id``, ``node``, ``component`` (its least node) and
    ``component_id`` (its least id); a component joins near copies, directly or through others."""
    from heddle.llm import simhash  # which takes keep_first from here

    spark = docs.sparkSession
    ship_package(spark)
    scratch = Scratch(spark, "near-copies")
    marked = scratch.table(docs.select("doc_id", text_node().alias("node"), _bands("text").alias("bands")), "marked")
    classes = scratch.table(marked.groupBy("node").agg(F.min("doc_id").alias("least"), F.first("bands").alias("bands")), "classes")
    prints = classes.select("node", F.col("bands")[BANDS].alias("fp"))
    heads = scratch.table(prints.groupBy("fp").agg(F.min("node").alias("head")), "heads")
    linked = simhash.links(heads.select("fp"), Scratch(spark, "near-copies-simhash"))
    linked = linked.join(heads.select(F.col("fp").alias("a"), F.col("head").alias("x")), "a").join(heads.select(F.col("fp").alias("b"), F.col("head").alias("y")), "b").select("x", "y")
    alike = prints.join(heads, "fp").where("node <> head").select(F.col("head").alias("x"), F.col("node").alias("y"))
    proposed = scratch.table(linked.unionByName(alike).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "proposed")
    filed = classes.select("node", F.explode(F.slice("bands", 1, BANDS)).alias("bucket"))
    shared = filed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    filed = scratch.table(filed.join(shared, "bucket"), "filed")
    met = filed.join(filed.groupBy("node").agg(F.sum("n").alias("met")), "node")
    leaders = met.groupBy("bucket").agg(F.max_by("node", F.struct("met", "node")).alias("leader"))
    members = scratch.table(filed.join(leaders, "bucket"), "members")
    wanted = members.select("node").unionByName(proposed.select(F.explode(F.array("a", "b")).alias("node")))
    wanted = scratch.table(wanted.distinct(), "wanted")
    texts = docs.select(text_node().alias("node"), "text").join(_few(wanted), "node", "left_semi")
    sets = scratch.table(texts.select("node", _sets("text").alias("hashes")).groupBy("node").agg(F.first("hashes").alias("hashes")), "sets")

    def labelled(edges: DataFrame, name: str) -> DataFrame:
        labels = connected_components(edges.select(F.col("a").alias("src"), F.col("b").alias("dst")), Scratch(spark, f"near-copies-{name}"))
        return scratch.table(labels.select("node", "component"), f"labels-{name}")

    stars = members.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b"))
    edges = scratch.table(_verified(stars.unionByName(proposed).distinct(), sets), "edges")
    labels = labelled(edges, "first")
    # a pair across components has a member outside the bucket's main one; a bucket of two is settled by its star
    told = members.where("n > 2").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    told = scratch.table(told.select("bucket", "node", "leader", "component", "n"), "told")
    rest = _across(told.where(F.col("n") <= CROWDED), scratch, "small", "s.node <> s.leader and o.node <> o.leader")
    crowded = told.where(F.col("n") > CROWDED).select("node", "component").distinct()
    crowd = scratch.table(sets.join(_few(crowded), "node"), "crowd")
    if not crowd.isEmpty():
        rest = rest.unionByName(_across(_prefix_keys(crowd, scratch), scratch, "crowded", "s.own = o.other and s.other = o.own")).distinct()
    more = scratch.table(_verified(rest, sets), "more")
    if more.count():
        labels = labelled(edges.unionByName(more), "all")
    named = classes.select("node", "least").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(ids, "component").select("node", "component", "component_id")
    return marked.select("doc_id", "node").join(named, "node").select("doc_id", "node", "component", "component_id")


def keep_first(docs: DataFrame, found: DataFrame, bound: int = BROADCAST_ROWS) -> DataFrame:
    """One document of each component in ``found`` (doc_id, node, component), with the columns of ``docs``: the least id
    and, where that id stands for several of its texts, the least node. Rows are told apart by id and text and folded only
    where both are equal; rows with a null id cannot be told apart and all stay."""
    scratch = Scratch(docs.sparkSession, "kept-first")
    rows = scratch.table(found.where("doc_id is not null").groupBy("doc_id", "node", "component").agg(F.count("*").alias("n")), "rows")
    heads = rows.groupBy("component").agg(F.min(F.struct("doc_id", "node", "n")).alias("h")).select("h.*")
    heads = scratch.table(heads, "heads")
    gone = scratch.table(rows.join(heads, ["doc_id", "node"], "left_anti").select("doc_id", "node"), "gone")
    repeated = heads.where("n > 1").select("doc_id", "node")
    id_, node = spare(docs, "__id"), spare(docs, "__node")

    def listed(df: DataFrame, few: DataFrame, how: str) -> DataFrame:
        few = few.select(F.col("doc_id").alias(id_), F.col("node").alias(node))
        few = F.broadcast(few) if few.count() <= bound else few
        return df.join(few, (F.col("doc_id") == F.col(id_)) & (text_node() == F.col(node)), how)

    kept = listed(docs, gone, "left_anti")
    if repeated.isEmpty():
        return kept.select(*columns_of(docs))
    once = listed(kept, repeated, "left_semi").withColumn(node, text_node()).dropDuplicates(["doc_id", node])
    return listed(kept, repeated, "left_anti").select(*columns_of(docs)).unionByName(once.select(*columns_of(docs)))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group of near copies."""
    return keep_first(docs, components(docs))
