"""Histograms, facets, roots and identities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.functions.columns import uuid5
from heddle.operators.grouping import closed_histogram, count_map, facets, table_root
from heddle.plans.catalogue import query
from heddle.runtime import read_table

#: A namespace of our own for the example identities.
NAMESPACE = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"
STATUSES = ["F", "O", "P", "X"]


@query("""
WITH v(o_orderstatus) AS (VALUES ('F'), ('O'), ('P'), ('X'))
SELECT v.o_orderstatus, count(o.o_orderkey) AS n FROM v LEFT JOIN orders o USING (o_orderstatus) GROUP BY 1""")
def closed_domain_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by status over a closed domain, one value of which does not occur."""
    return closed_histogram(read_table(spark, sf_dir, "orders"), "o_orderstatus", STATUSES)


@query("""
SELECT user_id, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS counts
FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1""")
def status_histogram_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each user by type, as an ordered map."""
    return count_map(read_table(spark, sf_dir, "events"), ["user_id"], "event_type")


@query("""
WITH j AS (SELECT c_mktsegment AS segment, o_orderstatus, o_orderpriority FROM customer JOIN orders ON c_custkey = o_custkey),
p AS (SELECT segment, 'o_orderstatus' AS facet, o_orderstatus AS value, count(*) AS n FROM j GROUP BY ALL
  UNION ALL SELECT segment, 'o_orderpriority', o_orderpriority, count(*) FROM j GROUP BY ALL)
SELECT segment, facet, string_agg(value || '=' || n, ',' ORDER BY value) AS map,
  round_even(max(n)::DECIMAL(18,0) * 10000 / sum(n)::DECIMAL(18,0), 0)::BIGINT AS top_share_bp
FROM p GROUP BY 1, 2""")
def facet_counts_by_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of each market segment by status and by priority, with the share of the most common."""
    orders, customers = read_table(spark, sf_dir, "orders"), read_table(spark, sf_dir, "customer")
    joined = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_mktsegment").alias("segment"), "o_orderstatus", "o_orderpriority")
    return facets(joined, "segment", ["o_orderstatus", "o_orderpriority"])


def _root(table: str, key: str, fields: list[str]) -> str:
    text = " || '|' || ".join(f"{f}::VARCHAR" for f in fields)
    return f"SELECT '{table}' AS table_name, count(*) AS n_rows, sha256(string_agg({key}::VARCHAR || ':' || sha256({text}), chr(10) ORDER BY {key}::VARCHAR)) AS root FROM {table}"


@query(_root("region", "r_regionkey", ["r_regionkey", "r_name"]) + " UNION ALL " + _root("nation", "n_nationkey", ["n_nationkey", "n_name", "n_regionkey"]))
def table_root_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roots of two small tables over their key-sorted record digests."""
    out = []
    for table, key, fields in (("region", "r_regionkey", ["r_regionkey", "r_name"]), ("nation", "n_nationkey", ["n_nationkey", "n_name", "n_regionkey"])):
        record = F.concat_ws("|", *[F.col(f).cast("string") for f in fields])
        out.append(table_root(read_table(spark, sf_dir, table), [key], record).select(F.lit(table).alias("table_name"), "n_rows", "root"))
    return out[0].unionByName(out[1])


@query(f"""
WITH h AS (SELECT n_nationkey, sha1(unhex('{NAMESPACE.replace("-", "")}') || encode('nation' || chr(0) || n_name)) AS h FROM nation)
SELECT n_nationkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' ||
  substr('89ab', (strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS id
FROM h""")
def uuid5_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name-based identities of nations."""
    return read_table(spark, sf_dir, "nation").select("n_nationkey", uuid5(NAMESPACE, F.lit("nation"), F.col("n_name")).alias("id"))


#: Part keys that share a frame, and so its most pixels; pixels in a row of it.
FRAME_KEYS, FRAME_WIDTH = 4096, 16


def part_frames(parts: DataFrame) -> DataFrame:
    """One media per brand with each of its parts as a pixel, in frames of FRAME_KEYS part keys; the last row of a frame is
    filled up with transparent pixels."""
    pixel = F.concat(*[F.lpad(F.hex(F.pmod(F.xxhash64("p_partkey", F.lit(k)), F.lit(256))), 2, "0") for k in range(3)], F.lit("FF"))
    pixels = F.array_sort(F.collect_list(F.struct("p_partkey", pixel.alias("px"))))
    frames = parts.groupBy(F.col("p_brand").alias("media_id"), F.floor(F.col("p_partkey") / FRAME_KEYS).cast("int").alias("frame_index")).agg(pixels.alias("ps"))
    height = F.ceil(F.size("ps") / FRAME_WIDTH).cast("int")
    rgba = F.unhex(F.rpad(F.array_join("ps.px", ""), height * (8 * FRAME_WIDTH), F.lit("0")))
    return frames.select("media_id", "frame_index", F.lit(FRAME_WIDTH).alias("width"), height.alias("height"), F.lit("once").alias("loop_mode"), rgba.alias("rgba"))


@query()
def palette_apportion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals of frames drawn from parts: one media per brand, all its parts as pixels."""
    from heddle.media.operators import analyse

    return analyse(part_frames(read_table(spark, sf_dir, "part")))
