"""Merges, diffs and withdrawals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.operators.merging import additive_sync, diff, preview, takedown, three_way, upsert_members
from heddle.plans.catalogue import query
from heddle.runtime import read_table

AT = "2026-01-01T00:00:00Z"
BEFORE = "2025-01-01T00:00:00Z"


@query("""
WITH b AS (SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 11 <> 0),
c AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'N' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 7 <> 0),
v AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'M' WHEN o_orderkey % 15 = 3 THEN 'N' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 13 <> 0),
j AS (SELECT coalesce(b.o_orderkey, c.o_orderkey, v.o_orderkey) AS k, b.o_orderstatus AS bs, c.o_orderstatus AS cs, v.o_orderstatus AS vs,
  b.o_orderkey IS NULL AS bn, c.o_orderkey IS NULL AS cn, v.o_orderkey IS NULL AS vn
  FROM b FULL JOIN c ON b.o_orderkey = c.o_orderkey FULL JOIN v ON coalesce(b.o_orderkey, c.o_orderkey) = v.o_orderkey),
r AS (SELECT *, CASE WHEN bs IS NOT DISTINCT FROM cs AND bn = cn THEN 'latest' WHEN bs IS NOT DISTINCT FROM vs AND bn = vn THEN 'candidate'
  WHEN cs IS NOT DISTINCT FROM vs AND cn = vn THEN 'both' ELSE 'conflict' END AS resolution FROM j)
SELECT k AS o_orderkey, resolution, CASE WHEN resolution = 'candidate' THEN cn ELSE vn END AS deleted,
  CASE WHEN resolution = 'candidate' THEN cs ELSE vs END AS o_orderstatus FROM r""")
def three_way_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three derived versions of orders merged per key."""
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    k, s = F.col("o_orderkey"), F.col("o_orderstatus")
    base = orders.where(k % 11 != 0)
    candidate = orders.where(k % 7 != 0).withColumn("o_orderstatus", F.when(k % 3 == 0, "N").otherwise(s))
    latest = orders.where(k % 13 != 0).withColumn("o_orderstatus", F.when(k % 5 == 0, "M").when(k % 15 == 3, "N").otherwise(s))
    return three_way(base, candidate, latest, "o_orderkey", ["o_orderstatus"])


@query(f"""
WITH o AS (SELECT conv_id, turn, turn AS position, 'active' AS status FROM conversations WHERE (conv_id + turn) % 4 <> 0),
c AS (SELECT conv_id, turn, CASE WHEN conv_id % 5 = 0 THEN turn + 1 ELSE turn END AS position FROM conversations WHERE (conv_id + turn) % 5 <> 0)
SELECT coalesce(c.conv_id, o.conv_id) AS conv_id, coalesce(c.turn, o.turn) AS turn, coalesce(c.position, o.position) AS position,
  CASE WHEN c.turn IS NULL THEN 'removed' ELSE 'active' END AS status,
  CASE WHEN c.turn IS NOT NULL AND o.turn IS NOT NULL AND c.position = o.position THEN '{BEFORE}' ELSE '{AT}' END AS changed_at
FROM o FULL JOIN c ON o.conv_id = c.conv_id AND o.turn = c.turn""")
def membership_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old against current members of conversations."""
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn")
    both = F.col("conv_id") + F.col("turn")
    old = turns.where(both % 4 != 0).withColumns({"position": F.col("turn"), "status": F.lit("active"), "changed_at": F.lit(BEFORE)})
    moved = F.when(F.col("conv_id") % 5 == 0, F.col("turn") + 1).otherwise(F.col("turn"))
    current = turns.where(both % 5 != 0).withColumns({"position": moved, "status": F.lit("active"), "changed_at": F.lit(AT)})
    return upsert_members(old, current, ["conv_id", "turn"], AT)


@query("""
WITH m AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem), t AS (SELECT s_suppkey FROM supplier WHERE s_suppkey % 10 = 3),
k AS (SELECT * FROM m WHERE l_suppkey NOT IN (SELECT s_suppkey FROM t)),
o AS (SELECT DISTINCT l_partkey FROM m WHERE l_suppkey IN (SELECT s_suppkey FROM t) AND l_partkey NOT IN (SELECT l_partkey FROM k))
SELECT 'collection' AS kind, s_suppkey::VARCHAR AS target_id, 0 AS item_count FROM t
UNION ALL SELECT 'item', l_partkey::VARCHAR, 0 FROM o
UNION ALL SELECT 'left', s_suppkey::VARCHAR, count(l_partkey) FROM supplier LEFT JOIN k ON l_suppkey = s_suppkey WHERE s_suppkey NOT IN (SELECT s_suppkey FROM t) GROUP BY 2""")
def takedown_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some suppliers withdrawn with the parts that only they deliver; the others counted anew."""
    members = read_table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("s_suppkey"), F.col("l_partkey").alias("p_partkey")).distinct()
    suppliers, parts = read_table(spark, sf_dir, "supplier").select("s_suppkey"), read_table(spark, sf_dir, "part").select("p_partkey")
    done = takedown(suppliers, members, parts, suppliers.where("s_suppkey % 10 = 3"), "s_suppkey", "p_partkey")
    gone = done["tombstones"].select("kind", "target_id", F.lit(0).cast("long").alias("item_count"))
    return gone.unionByName(done["collections"].select(F.lit("left").alias("kind"), F.col("s_suppkey").cast("string").alias("target_id"), "item_count"))


_PARTS = "CASE WHEN p_partkey % 6 = 0 THEN p_size + 1 ELSE p_size END"


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 10 = 1 THEN 'removed' WHEN p_partkey % 10 = 2 THEN 'added' ELSE 'changed' END AS change
FROM part WHERE p_partkey % 10 IN (1, 2) OR p_partkey % 6 = 0""")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts against a version with some removed, added and changed."""
    parts = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    k = F.col("p_partkey")
    after = parts.where(k % 10 != 1).withColumn("p_size", F.when(k % 6 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")))
    return diff(parts.where(k % 10 != 2), after, "p_partkey", ["p_name", "p_size"])


@query("""
SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 AND s_suppkey % 5 = 0 THEN NULL ELSE s_name END AS s_name, s_nationkey,
  CASE WHEN s_suppkey % 4 <> 0 THEN 'kept' ELSE 'added' END AS origin
FROM supplier WHERE s_suppkey % 4 <> 0 OR s_suppkey % 8 <> 0""")
def additive_sync_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A candidate fills nulls and adds what is neither there nor withdrawn."""
    suppliers = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    k = F.col("s_suppkey")
    base = suppliers.where(k % 4 != 0).withColumn("s_name", F.when(k % 3 == 0, F.lit(None)).otherwise(F.col("s_name")))
    candidate = suppliers.withColumn("s_name", F.when((k % 3 == 0) & (k % 5 == 0), F.lit(None)).otherwise(F.col("s_name"))).withColumn("s_nationkey", F.when(k % 4 == 0, F.col("s_nationkey")).otherwise(F.lit(-1)))
    return additive_sync(base, candidate, "s_suppkey", ["s_name", "s_nationkey"], suppliers.where(k % 8 == 0))


@query(f"""
WITH j AS (SELECT p_partkey % 10 <> 2 AS was, p_partkey % 10 <> 1 AS now, p_size = {_PARTS} AS same FROM part)
SELECT count(*) FILTER (WHERE NOT was AND now) AS added, count(*) FILTER (WHERE was AND now AND NOT same) AS updated,
  count(*) FILTER (WHERE was AND now AND same) AS unchanged, count(*) FILTER (WHERE was AND NOT now) AS disappeared FROM j""")
def merge_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dry-run counters of the same change."""
    parts = read_table(spark, sf_dir, "part").select("p_partkey", "p_size")
    k = F.col("p_partkey")
    after = parts.where(k % 10 != 1).withColumn("p_size", F.when(k % 6 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")))
    return preview(parts.where(k % 10 != 2), after, "p_partkey", ["p_size"])
