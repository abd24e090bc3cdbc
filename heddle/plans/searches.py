"""Filters, lexical scores and look-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.operators.search import filter_column, inverted_index, lexical_score, lookup_prefixes, resolve, similar
from heddle.plans.catalogue import query
from heddle.plans.duplicates import hashed
from heddle.runtime import read_table

PHRASE = "the and"
TERMS = ["th", "an"]


@query("""
SELECT o_orderkey, c_custkey, o_orderstatus, o_orderpriority FROM orders JOIN customer ON o_custkey = c_custkey
WHERE o_orderstatus IN ('F', 'P') AND c_mktsegment IN ('BUILDING', 'HOUSEHOLD')
  AND o_totalprice >= 200000 AND o_totalprice < 300000 AND NOT o_orderpriority IN ('1-URGENT', '5-LOW')
ORDER BY o_totalprice DESC, o_orderkey LIMIT 100""")
def filtered_search_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filtered, ordered first page: scalar lists, a range and a negated overlap."""
    orders, customers = read_table(spark, sf_dir, "orders"), read_table(spark, sf_dir, "customer")
    rows = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    filters = {"availability": ["F", "P"], "platform": ["BUILDING", "HOUSEHOLD"], "exclude_warning": ["1-URGENT", "5-LOW"]}
    columns = {"availability": F.col("o_orderstatus"), "platform": F.col("c_mktsegment"), "warnings": F.array("o_orderpriority")}
    priced = (F.col("o_totalprice") >= 200000) & (F.col("o_totalprice") < 300000)
    return rows.where(filter_column(filters, columns) & priced).orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100).select("o_orderkey", "c_custkey", "o_orderstatus", "o_orderpriority")


@query(f"""
WITH f AS (SELECT doc_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS t, lower(lang) AS l, lower(source) AS s FROM documents),
x AS (SELECT doc_id, 100 * (CASE WHEN t = '{PHRASE}' THEN 400 WHEN contains(t, '{PHRASE}') THEN 300 ELSE 0 END)
  + 90 * (CASE WHEN l = '{PHRASE}' OR s = '{PHRASE}' THEN 400 WHEN contains(l, '{PHRASE}') OR contains(s, '{PHRASE}') THEN 300 ELSE 0 END) AS score FROM f)
SELECT doc_id, score::INTEGER AS score FROM x WHERE score > 0""")
def lexical_score_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical score of a phrase over text and tags."""
    fields = {"text": F.array("text"), "tags": F.array("lang", "source")}
    scored = read_table(spark, sf_dir, "documents").select("doc_id", lexical_score(PHRASE, fields).cast("int").alias("score"))
    return scored.where("score > 0")


def _words() -> Column:
    return F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))


@query(f"""
WITH t AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents),
c AS (SELECT doc_id, {", ".join(f"count(*) FILTER (WHERE starts_with(w, '{t}')) AS h{k}" for k, t in enumerate(TERMS))} FROM t GROUP BY 1)
SELECT doc_id, {" + ".join(f"h{k}" for k in range(len(TERMS)))} AS score FROM c WHERE {" AND ".join(f"h{k} > 0" for k in range(len(TERMS)))}""")
def lookup_prefix_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a token for each prefix, scored by the tokens hit."""
    return lookup_prefixes(inverted_index(read_table(spark, sf_dir, "documents"), "doc_id", _words()), "doc_id", TERMS)


@query("""
WITH r AS (SELECT l_suppkey, l_partkey AS target, epoch_us(l_shipdate) AS f, CASE WHEN l_linestatus = 'O' THEN 'active' ELSE 'inactive' END AS status FROM lineitem),
x AS (SELECT l_suppkey, count(*) FILTER (WHERE f <= 820454400000000 AND 820454400000000 < f + 259200000000) AS visible,
  min(CASE WHEN f <= 820454400000000 AND 820454400000000 < f + 259200000000 THEN lpad(target::VARCHAR, 12, '0') || status END) AS one FROM r GROUP BY 1)
SELECT l_suppkey, CASE WHEN visible = 0 THEN 'not_found' WHEN visible > 1 THEN 'ambiguous' WHEN substr(one, 13) = 'active' THEN 'current' ELSE 'former' END AS resolution,
  CASE WHEN visible = 1 THEN substr(one, 1, 12)::BIGINT END AS target FROM x""")
def resolve_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each supplier's identity resolves to at an instant, with references that hold for three days."""
    lines = read_table(spark, sf_dir, "lineitem")
    begin = F.unix_micros(F.col("l_shipdate").cast("timestamp"))
    status = F.when(F.col("l_linestatus") == "O", "active").otherwise("inactive")
    references = lines.select("l_suppkey", F.col("l_partkey").alias("target"), begin.alias("observed_from"), (begin + 259200000000).alias("observed_until"), status.alias("status"), F.lit(0).alias("identity_epoch"))
    return resolve(references, ["l_suppkey"], "target", F.lit(820454400000000))


@query("""
WITH g AS (SELECT sha256(text) AS h, doc_id FROM documents WHERE text IS NOT NULL),
m AS (SELECT h, doc_id FROM g WHERE h IN (SELECT h FROM g GROUP BY 1 HAVING count(*) > 1)),
s AS (SELECT min(doc_id) AS d FROM m)
SELECT m.doc_id, 10 AS rank, m.h AS evidence FROM m JOIN m x ON x.h = m.h JOIN s ON x.doc_id = s.d WHERE m.doc_id <> s.d""")
def similar_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that share an exact group with the least grouped document."""
    from heddle.operators.grouping import group_members

    members = group_members(hashed(spark, sf_dir), ["text_sha256"], "doc_id").select(F.col("text_sha256").alias("group_id"), F.lit("binary-exact").alias("group_type"), "doc_id")
    start = members.agg(F.min("doc_id")).first()[0]
    return similar(members, "doc_id", start if start is not None else -1)
