"""Duplicate detection on documents and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.functions.columns import u64
from heddle.operators.candidates import near_pairs, suppressed
from heddle.operators.components import connected_components
from heddle.operators.grouping import group_members, overlap
from heddle.operators.ranking import top_k
from heddle.plans.catalogue import query
from heddle.runtime import Scratch, read_table


def hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "source", F.sha2("text", 256).alias("text_sha256"), F.octet_length("text").cast("long").alias("n_bytes"))


@query("""
SELECT sha256(text) AS text_sha256, strlen(text)::BIGINT AS n_bytes, count(*) OVER w AS members, min(doc_id) OVER w AS first_member, doc_id
FROM documents WHERE text IS NOT NULL WINDOW w AS (PARTITION BY text) QUALIFY count(*) OVER w > 1""")
def exact_text_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The members of groups of equal texts, a row each, with the group's size and least member."""
    return group_members(hashed(spark, sf_dir), ["text_sha256", "n_bytes"], "doc_id")


@query("""
SELECT sha256(text) AS text_sha256, source, count(*) AS members, min(doc_id) AS first_member
FROM documents WHERE text IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1""")
def exact_pair_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups by a two-part key: equal text in one source."""
    from heddle.operators.grouping import exact_groups

    return exact_groups(hashed(spark, sf_dir), ["text_sha256", "source"], "doc_id")


@query("""
WITH RECURSIVE t AS (SELECT DISTINCT sha256(text) AS h, source FROM documents WHERE text IS NOT NULL AND source IS NOT NULL),
e AS (SELECT DISTINCT a.source AS s, b.source AS d FROM t a JOIN t b USING (h) WHERE a.source <> b.source),
r(node, seen) AS (SELECT DISTINCT s, s FROM e UNION SELECT r.node, e.d FROM r JOIN e ON r.seen = e.s)
SELECT node AS source, min(seen) AS component FROM r GROUP BY 1""")
def source_exact_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources connected by a shared text: each text links its sources to the least of them, a star instead of all pairs."""
    held = hashed(spark, sf_dir).where("source is not null").select("text_sha256", "source").distinct()
    least = held.groupBy("text_sha256").agg(F.min("source").alias("least"), F.count("*").alias("n")).where("n > 1")
    edges = held.join(least, "text_sha256").where("source <> least").select(F.col("source").alias("src"), F.col("least").alias("dst"))
    found = connected_components(edges, Scratch(spark, "sources"))
    return found.select(F.col("node").alias("source"), "component")


@query("""
WITH t AS (SELECT source, sha256(text) AS h, count(*) AS n FROM documents WHERE text IS NOT NULL AND source IS NOT NULL GROUP BY 1, 2),
z AS (SELECT source, sum(n) AS size FROM t GROUP BY 1),
p AS (SELECT a.source AS l, b.source AS r, sum(least(a.n, b.n)) AS matched FROM t a JOIN t b ON a.h = b.h AND a.source < b.source GROUP BY 1, 2)
SELECT l AS "left", r AS "right", matched::BIGINT AS matched, x.size::BIGINT AS left_size, y.size::BIGINT AS right_size,
  CASE WHEN matched >= 2 AND matched * 10 >= x.size * 9 AND matched * 10 >= y.size * 9 THEN 'clone'
    WHEN matched >= 2 AND matched * 10 >= least(x.size, y.size) * 9 AND matched * 10 < greatest(x.size, y.size) * 8 THEN 'subset'
    ELSE 'overlap' END AS class
FROM p JOIN z x ON x.source = l JOIN z y ON y.source = r""")
def source_overlap_clone_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap of sources in equal texts."""
    return overlap(hashed(spark, sf_dir).where("source is not null"), "source", "text_sha256", least_matched=2)


def simhashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64-bit similarity hash over distinct ASCII words: a bit is set if more than half of the words' MD5 prefixes set it."""
    docs = read_table(spark, sf_dir, "documents").where("text is not null")
    words = docs.select("doc_id", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("w"))
    hashes = words.select("doc_id", F.size("w").alias("n"), F.transform("w", lambda x: u64(F.substring(F.md5(x), 1, 16))).alias("h"))
    exploded = hashes.where("n > 0").select("doc_id", "n", F.explode("h").alias("h"))
    bits = [F.sum(F.getbit("h", F.lit(b))).alias(f"b{b}") for b in range(64)]
    sums = exploded.groupBy("doc_id", "n").agg(*bits)
    value = F.lit(0).cast("long")
    for b in range(64):
        value = value.bitwiseOR(F.when(F.col(f"b{b}") * 2 > F.col("n"), F.shiftleft(F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")))
    return sums.select("doc_id", value.alias("h"))


_SIMHASH = """
w AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]+'))) AS w FROM documents WHERE text IS NOT NULL),
x AS (SELECT doc_id, ('0x' || substr(md5(w), 1, 16))::UBIGINT AS v FROM w),
s AS (SELECT doc_id, {bits} AS h FROM x GROUP BY 1),
g AS (SELECT h, min(doc_id) AS doc_id, max(doc_id) AS top, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS l, b.doc_id AS r, bit_count(xor(a.h, b.h))::INTEGER AS distance, a.n AS left_members, b.n AS right_members FROM g a JOIN g b ON a.doc_id < b.doc_id WHERE bit_count(xor(a.h, b.h)) <= 8
  UNION ALL SELECT doc_id, top, 0, n, n FROM g WHERE n > 1)
""".format(bits=" + ".join(f"(CASE WHEN 2 * sum((v >> {b}) & 1) > count(*) THEN {1 << b}::UBIGINT ELSE 0::UBIGINT END)" for b in range(64)))


def _near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_pairs(Scratch(spark, "simhash").table(simhashes(spark, sf_dir), "hashes"), "doc_id", "h", 8)


@query(f'WITH {_SIMHASH} SELECT l AS "left", r AS "right", distance, left_members, right_members FROM c')
def near_simhash_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents with equal similarity hashes, and pairs of classes at most 8 bits apart, by banded multi-probe
    look-ups."""
    return _near(spark, sf_dir)


@query(f"""
WITH {_SIMHASH}, d AS (SELECT l AS item, r AS other, distance FROM c UNION ALL SELECT r, l, distance FROM c),
k AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY distance, other) AS rank, count(*) OVER (PARTITION BY item) AS available FROM d)
SELECT item, other, distance, rank::INTEGER AS rank, available, available > 3 AS overflow FROM k WHERE rank <= 3""")
def candidate_top_k_overflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best partner classes of each class of documents, how many there were, and whether some were left out."""
    pairs = _near(spark, sf_dir)
    both = pairs.select(F.col("left").alias("item"), F.col("right").alias("other"), "distance").unionByName(pairs.select(F.col("right").alias("item"), F.col("left").alias("other"), "distance"))
    return top_k(both, ["item"], [F.col("distance"), F.col("other")], 3).select("item", "other", "distance", "rank", "available", "overflow")


@query(f"""
WITH {_SIMHASH} SELECT l AS "left", r AS "right", distance, left_members, right_members FROM c
WHERE NOT EXISTS (SELECT 1 FROM documents a JOIN documents b ON a.text = b.text WHERE a.doc_id = l AND b.doc_id = r)""")
def suppressed_pairs_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near pairs without those of equal text."""
    docs = hashed(spark, sf_dir).select("doc_id", "text_sha256")
    pairs = _near(spark, sf_dir)
    a, b = docs.select(F.col("doc_id").alias("left"), F.col("text_sha256").alias("x")), docs.select(F.col("doc_id").alias("right"), F.col("text_sha256").alias("y"))
    decided = pairs.join(a, "left").join(b, "right").where("x = y").select("left", "right")
    return suppressed(pairs, decided)


def sign_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    bits = F.transform(F.col("embedding"), lambda x: F.when(x > 0, F.lit("1")).otherwise(F.lit("0")))
    return read_table(spark, sf_dir, "embeddings").where(F.size("embedding") == 64).select("vec_id", F.conv(F.array_join(bits, ""), 2, -10).cast("long").alias("h"))



@query("""
WITH s AS (SELECT vec_id, array_to_string([CASE WHEN x > 0 THEN '1' ELSE '0' END FOR x IN embedding], '')::BIT AS b FROM embeddings WHERE len(embedding) = 64),
g AS (SELECT b, min(vec_id) AS vec_id, max(vec_id) AS top, count(*) AS n FROM s GROUP BY 1)
SELECT a.vec_id AS "left", c.vec_id AS "right", bit_count(xor(a.b, c.b))::INTEGER AS distance, a.n AS left_members, c.n AS right_members
FROM g a JOIN g c ON a.vec_id < c.vec_id WHERE bit_count(xor(a.b, c.b)) <= 16 UNION ALL SELECT vec_id, top, 0, n, n FROM g WHERE n > 1""")
def near_embedding_sign_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of embeddings of 64 dimensions with equal signs, and pairs of classes whose signs differ in at most 16 places."""
    return near_pairs(Scratch(spark, "signs").table(sign_hashes(spark, sf_dir), "hashes"), "vec_id", "h", 16)


@query()
def dtw_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of hash sequences: 16 four-dimensional slices of an embedding against the next one of its label."""
    from heddle.media.operators import aligned_distances
    from pyspark.sql import Window

    vectors = read_table(spark, sf_dir, "embeddings").where(F.size("embedding") == 64)
    samples = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: F.xxhash64(F.transform(F.slice(F.col("embedding"), k * 4 + 1, F.lit(4)), lambda x: x > 0)))
    rows = vectors.select("vec_id", "label", samples.alias("seq"))
    after = rows.withColumn("other", F.lead("vec_id").over(Window.partitionBy("label").orderBy("vec_id"))).withColumn("next", F.lead("seq").over(Window.partitionBy("label").orderBy("vec_id")))
    found = after.where("other is not null").select("vec_id", "other", aligned_distances("seq", "next").alias("d"))
    return found.select("vec_id", "other", F.size("d").alias("steps"), F.aggregate("d", F.lit(0), lambda a, x: a + x).alias("total"))
