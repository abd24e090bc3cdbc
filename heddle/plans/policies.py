"""Picks, trust, incremental state and assembled layouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heddle.operators import evaluation, integrity, policy
from heddle.operators.ranking import latest
from heddle.plans.catalogue import query
from heddle.runtime import Scratch, read_table
from heddle.streaming import incremental


@query("""
SELECT event_type, user_id, event_id FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 ELSE 2 END, ts DESC, event_id DESC) AS k FROM events) WHERE k = 1""")
def best_saved_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run to resume for each user: best tier, then newest, then greatest id."""
    events = read_table(spark, sf_dir, "events").select("event_type", "user_id", "event_id", "ts")
    tier = F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "click", 1).otherwise(2)
    return latest(events, ["user_id"], [tier, F.desc("ts"), F.desc("event_id")]).select("event_type", "user_id", "event_id")


@query("""
SELECT doc_id, CASE WHEN quality = 1 THEN CASE WHEN lang IN ('en', 'de') THEN 'human-approved' ELSE 'approved' END WHEN toxic = 1 THEN 'rejected'
  WHEN lang = 'en' THEN 'human-unreviewed' ELSE 'machine-unreviewed' END AS trust FROM labels JOIN documents USING (doc_id)""")
def trust_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trust from review state and origin, with labels standing in for both."""
    rows = read_table(spark, sf_dir, "labels").join(read_table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    review = F.when(F.col("quality") == 1, "approved").when(F.col("toxic") == 1, "rejected").otherwise("unreviewed")
    origin = F.when(F.col("lang") == "en", "human").when(F.col("lang") == "de", "mixed").otherwise("ai")
    return rows.select("doc_id", policy.trust(review, origin).alias("trust"))


@query("""
SELECT p_partkey, p_partkey % 9 = 0 OR (p_partkey % 4 <> 0 AND (p_size > 25 OR p_partkey % 7 = 0)) AS needed FROM part""")
def descriptions_to_make(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which records need their text made anew: new ones, and unprotected ones whose media or context changed."""
    k = F.col("p_partkey")
    current = F.when(k % 9 != 0, F.lit("text"))
    needed = policy.needs_description(current, F.col("p_size") > 25, k % 7 == 0, k % 4 == 0, F.lit(False))
    return read_table(spark, sf_dir, "part").select("p_partkey", needed.alias("needed"))


@query("""
WITH s AS (SELECT DISTINCT p_partkey, p_brand, p_type FROM part), a AS (SELECT p_brand, list_sort(list(DISTINCT p_type)) AS t FROM s WHERE p_partkey % 2 = 0 GROUP BY 1),
b AS (SELECT p_brand, p_partkey % 3 AS option, list_sort(list(DISTINCT p_type)) AS t FROM s GROUP BY 1, 2),
c AS (SELECT p_brand, b.t AS allowed, len(list_intersect(a.t, b.t)) AS n, len(a.t) + len(b.t) AS d FROM a JOIN b USING (p_brand)),
f AS (SELECT p_brand, allowed, CASE WHEN d = 0 THEN 10000 ELSE (2 * 2 * n * 10000 + d) // (2 * d) END AS f1 FROM c)
SELECT p_brand, array_to_string(arg_min(allowed, (-f1, allowed)), ',') AS best_set, max(f1)::BIGINT AS f1_bp FROM f GROUP BY 1""")
def best_allowed_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The allowed set that fits a brand's chosen types best."""
    parts = read_table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    chosen = parts.where("p_partkey % 2 = 0").groupBy("p_brand").agg(F.sort_array(F.collect_set("p_type")).alias("chosen"))
    options = parts.groupBy("p_brand", (F.col("p_partkey") % 3).alias("option")).agg(F.sort_array(F.collect_set("p_type")).alias("allowed"))
    best = evaluation.best_allowed(options.join(chosen, "p_brand"), "p_brand", "allowed", "chosen")
    return best.select("p_brand", F.array_join("best_set", ",").alias("best_set"), "f1_bp")


@query("""
WITH n AS (SELECT s_suppkey AS k, s_nationkey AS g FROM supplier), c AS (SELECT k FROM n WHERE k % 6 = 0),
p AS (SELECT min(k) OVER (PARTITION BY g) AS l, k AS r FROM n QUALIFY l <> r)
SELECT k AS item FROM c UNION SELECT r FROM p JOIN c ON l = k UNION SELECT l FROM p JOIN c ON r = k""")
def incremental_affected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an index must scan again: items whose digest changed, and their neighbours."""
    rows = read_table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("item"), "s_nationkey", "s_name")
    state = incremental.changed(rows, None, "item", ["s_name", "s_nationkey"])
    now = rows.withColumn("s_name", F.when(F.col("item") % 6 == 0, F.concat("s_name", F.lit("!"))).otherwise(F.col("s_name")))
    moved = incremental.changed(now, state, "item", ["s_name", "s_nationkey"])
    first = rows.groupBy("s_nationkey").agg(F.min("item").alias("left"))  # near pairs: each item with the first of its nation
    pairs = rows.select(F.col("item").alias("right"), "s_nationkey").join(first, "s_nationkey").where("left <> right").select("left", "right")
    return incremental.affected(moved.select("item"), pairs, pairs.limit(0))


@query("""
SELECT page_id, lower(regexp_extract(url, '://([^/?#:]+)', 1)) AS host, regexp_extract(url, '^[^?#]*/([A-Za-z0-9_]+?)(?:[.]html)?/?(?:[?#].*)?$', 1) AS name FROM pages""")
def source_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The host and the short name in a source URL."""
    pages = read_table(spark, sf_dir, "pages")
    host = F.lower(F.regexp_extract("url", "://([^/?#:]+)", 1))
    name = F.regexp_extract("url", "^[^?#]*/([A-Za-z0-9_]+?)(?:[.]html)?/?(?:[?#].*)?$", 1)
    return pages.select("page_id", host.alias("host"), name.alias("name"))


@query("""
WITH RECURSIVE e AS (SELECT n_nationkey AS s, (n_nationkey * 3 + 1) % 25 AS d FROM nation WHERE n_nationkey % 4 <> 0),
r(a, b) AS (SELECT s, d FROM e UNION SELECT a, d FROM r JOIN e ON b = s),
c AS (SELECT a FROM r WHERE a = b) SELECT b AS node FROM r WHERE a IN (SELECT a FROM c) UNION SELECT a FROM c""")
def cyclic_registry_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes on a cycle of a registry, or behind one."""
    k = F.col("n_nationkey")
    edges = read_table(spark, sf_dir, "nation").where(k % 4 != 0).select(k.alias("src"), ((k * 3 + 1) % 25).alias("dst"))
    return integrity.cyclic_nodes(edges, Scratch(spark, "registry"))


@query()
def seam_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grids found from matching sides: each six vectors of a label stand for a 3 by 2 cut of one texture, whose blocks
    reach over the cuts."""
    from heddle.media.operators import layouts, mutual_best, seams

    side, block = 12, 4
    nth = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    cells = read_table(spark, sf_dir, "embeddings").select("vec_id", "label", nth.alias("n"))
    cells = cells.select(F.concat_ws("-", "label", F.floor(F.col("n") / 6)).alias("collection"), F.col("vec_id").alias("tile"), (F.col("n") % 3).alias("gx"), F.floor(F.col("n") % 6 / 3).alias("gy"))

    def shade(i: Column, channel: int) -> Column:
        x, y = F.col("gx") * side + i % side, F.col("gy") * side + F.floor(i / side)
        value = F.pmod(F.xxhash64("collection", F.floor((x + 1) / block), F.floor((y + 1) / block), F.lit(channel)), F.lit(256))
        return F.lpad(F.hex(value), 2, "0")

    pixels = F.transform(F.sequence(F.lit(0), F.lit(side * side - 1)), lambda i: F.concat(shade(i, 0), shade(i, 1), shade(i, 2), F.lit("FF")))
    tiles = cells.select("collection", "tile", F.lit(side).alias("side"), F.unhex(F.array_join(pixels, "")).alias("rgba"))
    return layouts(mutual_best(seams(tiles), ["collection", "axis"]))
