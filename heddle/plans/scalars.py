"""Scalar families: JSON pointers, colours, tags, versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.functions.columns import color_family, json_pointer, language_tag, semver_key
from heddle.plans.catalogue import query
from heddle.runtime import read_table


@query("""
WITH d AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN '{"a":{"k":null}}' WHEN 1 THEN '{"a":{}}' WHEN 2 THEN '{"a":{"k":"x' || event_id || '"}}' ELSE '{"a":{"k":[1,{"b":2}]}}' END AS doc, props FROM events)
SELECT event_id, json_extract_string(props, '$.k') AS k, event_id % 4 <> 1 AS present, CASE event_id % 4 WHEN 2 THEN 'x' || event_id WHEN 3 THEN '[1,{"b":2}]' END AS value FROM d""")
def json_pointer_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value from each event's JSON, and one that may be absent, null, a text or a list."""
    k = F.col("event_id")
    doc = F.when(k % 4 == 0, '{"a":{"k":null}}').when(k % 4 == 1, '{"a":{}}').when(k % 4 == 2, F.concat(F.lit('{"a":{"k":"x'), k, F.lit('"}}'))).otherwise('{"a":{"k":[1,{"b":2}]}}')
    found = read_table(spark, sf_dir, "events").select("event_id", json_pointer(F.col("props"), "/k")["value"].alias("k"), json_pointer(doc, "/a/k").alias("p"))
    return found.select("event_id", "k", "p.present", "p.value")


@query("""
WITH c AS (SELECT p_partkey, (p_partkey * 37) % 256 AS r, (p_partkey * 101) % 256 AS g, (p_partkey * 197) % 256 AS b FROM part),
m AS (SELECT *, greatest(r, g, b) AS mx, greatest(r, g, b) - least(r, g, b) AS d FROM c),
v AS (SELECT *, (2 * mx * 10000 + 255) // 510 AS val, CASE WHEN mx = 0 THEN 0 ELSE (2 * d * 10000 + mx) // (2 * mx) END AS sat,
  CASE WHEN mx = r THEN CASE WHEN 60 * (g - b) < 0 THEN 60 * (g - b) + 360 * d ELSE 60 * (g - b) END WHEN mx = g THEN 60 * (b - r) + 120 * d ELSE 60 * (r - g) + 240 * d END AS h FROM m)
SELECT p_partkey, CASE WHEN val <= 1500 THEN 'black' WHEN sat <= 1200 THEN CASE WHEN val >= 9000 THEN 'white' ELSE 'gray' END
  WHEN h >= 15 * d AND h < 55 * d AND val < 6500 AND sat > 2500 THEN 'brown' WHEN h >= 25 * d AND h < 60 * d AND val >= 6500 AND sat > 1000 AND sat <= 4500 THEN 'beige'
  WHEN h < 15 * d OR h >= 345 * d THEN 'red' WHEN h < 45 * d THEN 'orange' WHEN h < 70 * d THEN 'yellow' WHEN h < 165 * d THEN 'green' WHEN h < 200 * d THEN 'cyan'
  WHEN h < 255 * d THEN 'blue' WHEN h < 290 * d THEN 'purple' ELSE 'pink' END AS family FROM v""")
def color_family_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colour families of colours derived from part keys."""
    k = F.col("p_partkey")
    return read_table(spark, sf_dir, "part").select("p_partkey", color_family(k * 37 % 256, k * 101 % 256, k * 197 % 256).alias("family"))


@query("""
SELECT doc_id, lang || '-' || CASE WHEN doc_id % 2 = 0 THEN 'Latn-' ELSE '' END || upper(substr(lang, 1, 2)) AS tag FROM documents""")
def canonical_language_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical case of badly cased tags."""
    raw = F.concat(F.upper("lang"), F.when(F.col("doc_id") % 2 == 0, F.lit("_lATN-")).otherwise(F.lit("-")), F.lower("lang"))
    return read_table(spark, sf_dir, "documents").select("doc_id", language_tag(raw).alias("tag"))


@query("""
WITH v AS (SELECT p_brand, p_size // 10 AS a, p_size % 10 AS b, p_partkey % 20 AS c, p_partkey % 3 AS kind, p_partkey % 13 AS n FROM part),
r AS (SELECT *, a || '.' || b || '.' || c || CASE kind WHEN 0 THEN '' WHEN 1 THEN '-rc.' || n ELSE '-rc.' || n || '.x' END AS version,
  CASE kind WHEN 0 THEN 1 ELSE 0 END AS release, CASE kind WHEN 0 THEN 0 ELSE n END AS pre, kind AS more FROM v)
SELECT p_brand, arg_min(version, (a, b, c, release, pre, more)) AS least, arg_max(version, (a, b, c, release, pre, more)) AS greatest FROM r GROUP BY 1""")
def least_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least and the greatest of each brand's made-up versions, in semantic order; some are pre-releases."""
    k = F.col("p_partkey")
    pre = F.when(k % 3 == 0, "").when(k % 3 == 1, F.concat(F.lit("-rc."), k % 13)).otherwise(F.concat(F.lit("-rc."), k % 13, F.lit(".x")))
    version = F.concat(F.concat_ws(".", F.floor(F.col("p_size") / 10), F.col("p_size") % 10, k % 20), pre)
    rows = read_table(spark, sf_dir, "part").select("p_brand", version.alias("version"))
    return rows.groupBy("p_brand").agg(F.min_by("version", semver_key(F.col("version"))).alias("least"), F.max_by("version", semver_key(F.col("version"))).alias("greatest"))
