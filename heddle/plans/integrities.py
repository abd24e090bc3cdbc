"""Integrity checks and policy decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.operators import integrity, policy
from heddle.plans.catalogue import query
from heddle.runtime import read_table


@query("""
SELECT 'DANGLING' AS code, o_orderkey::VARCHAR AS path, 'o_orderkey has no l_orderkey' AS message FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
UNION ALL SELECT 'DANGLING', l_orderkey::VARCHAR, 'l_orderkey has no o_orderkey' FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'DANGLING', o_custkey::VARCHAR, 'o_custkey has no c_custkey' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)""")
def orphans_and_dangling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders without lines, and references without a target."""
    orders, lines, customers = (read_table(spark, sf_dir, t) for t in ("orders", "lineitem", "customer"))
    checks = [(orders, "o_orderkey", lines, "l_orderkey"), (lines, "l_orderkey", orders, "o_orderkey"), (orders, "o_custkey", customers, "c_custkey")]
    found = [integrity.dangling(*c) for c in checks]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query("""
SELECT 'POSITION_DUPLICATE' AS code, l_orderkey || '/' || l_linenumber AS path, 'occurs more than once' AS message
FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""")
def duplicate_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line numbers that occur twice in an order."""
    return integrity.duplicates(read_table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], "POSITION_DUPLICATE")


@query("""
WITH c AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)
SELECT 'ITEM_COUNT' AS code, o_orderkey::VARCHAR AS path, 'stored differs from the number of members' AS message
FROM orders LEFT JOIN c ON l_orderkey = o_orderkey WHERE coalesce(n, 0) <> o_orderkey % 7""")
def item_count_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose (made-up) stored count is not the number of their lines."""
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 7).alias("stored"))
    return integrity.miscounted(orders, "o_orderkey", "stored", read_table(spark, sf_dir, "lineitem"), "l_orderkey")


@query("""
SELECT code, doc_id::VARCHAR AS path, 'rule does not hold' AS message FROM (
  SELECT doc_id, unnest(list_filter([CASE WHEN NOT length(text) >= 50 THEN 'TEXT_SHORT' END, CASE WHEN NOT length(text) = n_chars THEN 'LENGTH' END,
    CASE WHEN NOT (lang IN ('de', 'en', 'es')) THEN 'LANGUAGE' END, CASE WHEN NOT regexp_matches(source, '^src[0-9]$') THEN 'SOURCE' END], lambda x: x IS NOT NULL)) AS code FROM documents)""")
def document_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A battery of per-row rules in one pass."""
    docs = read_table(spark, sf_dir, "documents")
    rules = {"TEXT_SHORT": F.length("text") >= 50, "LENGTH": F.length("text") == F.col("n_chars"), "LANGUAGE": F.col("lang").isin("de", "en", "es"), "SOURCE": F.col("source").rlike("^src[0-9]$")}
    return integrity.row_rules(docs, F.col("doc_id"), rules)


@query(r"""
SELECT doc_id, array_to_string(list_filter([CASE WHEN length(text) < 100 THEN 'short' END, CASE WHEN contains(text, '###') THEN 'junk' END,
  CASE WHEN contains(text, '|') THEN 'table' END, CASE WHEN lang <> 'en' THEN 'language' END], lambda x: x IS NOT NULL), ',') AS reasons,
  CASE WHEN contains(text, '###') THEN 1 WHEN length(text) < 100 THEN 2 WHEN contains(text, '|') THEN 3 WHEN lang <> 'en' THEN 4 END AS priority FROM documents""")
def routing_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons to route a document to review, and the most urgent of them."""
    rules = {"short": F.length("text") < 100, "junk": F.contains("text", F.lit("###")), "table": F.contains("text", F.lit("|")), "language": F.col("lang") != "en"}
    marked = read_table(spark, sf_dir, "documents").select("doc_id", policy.reasons(rules).alias("r"))
    ranked = policy.priority(F.col("r"), {"junk": 1, "short": 2, "table": 3, "language": 4})
    return marked.select("doc_id", F.array_join("r", ",").alias("reasons"), ranked.alias("priority"))


@query("""
SELECT sha256(text) AS signature, count(DISTINCT source) AS descriptions, count(*) AS members FROM documents GROUP BY 1 HAVING count(DISTINCT source) > 1""")
def conflicting_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal texts that are said to come from different sources."""
    docs = read_table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("signature"), "source")
    return policy.conflicting(docs, "signature", "source")


@query("""
WITH r AS (SELECT DISTINCT p_brand, CASE WHEN p_type = 'ECONOMY' THEN NULL ELSE p_type END AS p_type FROM part),
q AS (SELECT p_brand, p_type, p_brand || '-a' AS q, 0 AS f, 30 AS u FROM r UNION ALL SELECT p_brand, p_type, p_brand || '-b', 20, NULL FROM r),
s AS (SELECT p_partkey, p_brand, CASE WHEN p_type = 'ECONOMY' THEN NULL ELSE p_type END AS p_type, p_size FROM part),
m AS (SELECT p_partkey, count(q) AS n, min(q) AS one FROM s LEFT JOIN q ON s.p_brand IS NOT DISTINCT FROM q.p_brand AND s.p_type IS NOT DISTINCT FROM q.p_type AND f <= p_size AND (u IS NULL OR p_size < u) GROUP BY 1)
SELECT p_partkey, CASE WHEN n = 0 THEN 'unmatched' WHEN n = 1 THEN 'matched' ELSE 'ambiguous' END AS status, CASE WHEN n = 1 THEN one END AS qualification FROM m""")
def qualification_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts against a registry with null keys and overlapping validity."""
    kind = F.when(F.col("p_type") != "ECONOMY", F.col("p_type"))
    parts = read_table(spark, sf_dir, "part").select("p_partkey", "p_brand", kind.alias("p_type"), "p_size")
    known = parts.select("p_brand", "p_type").distinct()
    first = known.select("*", F.concat("p_brand", F.lit("-a")).alias("qualification"), F.lit(0).alias("valid_from"), F.lit(30).alias("valid_until"))
    second = known.select("*", F.concat("p_brand", F.lit("-b")).alias("qualification"), F.lit(20).alias("valid_from"), F.lit(None).cast("int").alias("valid_until"))
    return policy.qualification(parts, first.unionByName(second), ["p_brand", "p_type"], "p_size", "p_partkey")


@query("""
SELECT n_nationkey, CASE WHEN NOT (r_regionkey <= 3 AND (r_regionkey = 0 OR 3 < r_regionkey + 3)) THEN 'unknown' WHEN n_nationkey % 7 = 0 THEN 'withdrawn'
  WHEN n_nationkey % 5 IN (1, 3) OR r_regionkey = 2 THEN 'restricted' WHEN n_nationkey % 5 IN (2, 4) THEN 'unknown' ELSE 'allowed' END AS decision
FROM nation JOIN region ON n_regionkey = r_regionkey""")
def rights_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ladder of rights decisions on nations with made-up profiles; some are outside their interval and withdrawn as well."""
    rows = read_table(spark, sf_dir, "nation").join(F.broadcast(read_table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    k, r = F.col("n_nationkey"), F.col("r_regionkey")
    own = F.when(k % 5 == 1, "deny").when(k % 5 == 3, "conditional").when(k % 5 == 0, "allow").when(k % 5 == 2, "unknown")  # or none
    regional = F.when(r == 2, "not-granted").otherwise("allow")
    decided = policy.rights_decision(F.lit("active"), r, F.when(r != 0, r + 3), F.lit(3), k % 7 == 0, [own, regional])
    return rows.select("n_nationkey", decided.alias("decision"))
