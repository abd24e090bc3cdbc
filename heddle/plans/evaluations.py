"""Evaluation reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.operators import evaluation as E
from heddle.plans.catalogue import query
from heddle.operators.ranking import ordinals
from heddle.runtime import Scratch, read_table


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return read_table(spark, sf_dir, "labels").join(docs, "doc_id")


_J = "j AS (SELECT lang, source, quality = 1 AS e, n_chars >= 600 AS o, quality, toxic, n_chars, doc_id FROM labels JOIN documents USING (doc_id))"
_BP = "CASE WHEN {d} > 0 THEN (2 * {n} * 10000 + {d}) // (2 * {d}) ELSE 0 END::BIGINT"


@query(f"""
WITH {_J}, c AS (SELECT count(*) FILTER (WHERE e AND o) AS tp, count(*) FILTER (WHERE NOT e AND o) AS fp, count(*) FILTER (WHERE e AND NOT o) AS fn, count(*) FILTER (WHERE NOT e AND NOT o) AS tn FROM j),
w AS (SELECT *, greatest(tp + fp, 1)::DOUBLE AS n, 1.959963984540054::DOUBLE AS z FROM c), p AS (SELECT *, tp / n AS p FROM w)
SELECT tp, fp, fn, tn, {_BP.format(n='tp', d='(tp + fp)')} AS precision_bp, {_BP.format(n='tp', d='(tp + fn)')} AS recall_bp,
  round(10000 * (p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n))::BIGINT AS low_bp,
  round(10000 * (p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n))::BIGINT AS high_bp FROM p""")
def label_confusion_wilson(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A length rule against quality labels, with the Wilson interval of its precision."""
    counts = E.confusion(judged(spark, sf_dir), F.col("quality") == 1, F.col("n_chars") >= 600)
    low, high = E.wilson(F.col("tp"), F.col("tp") + F.col("fp"))
    return counts.withColumns({"low_bp": F.round(low * 10000).cast("long"), "high_bp": F.round(high * 10000).cast("long")})


_F1 = f"""l AS (SELECT lang, count(*) FILTER (WHERE e AND o) AS tp, count(*) FILTER (WHERE NOT e AND o) AS fp, count(*) FILTER (WHERE e AND NOT o) AS fn FROM j GROUP BY 1),
f AS (SELECT *, tp + fn AS support, CASE WHEN tp + fp + fn = 0 THEN 10000 ELSE {_BP.format(n='(2 * tp)', d='(2 * tp + fp + fn)')} END AS f1_bp FROM l)"""


@query(f"""
WITH {_J}, {_F1}
SELECT floor((2 * sum(f1_bp) FILTER (WHERE support > 0) + count(*) FILTER (WHERE support > 0)) / (2 * count(*) FILTER (WHERE support > 0)))::BIGINT AS macro_f1_bp,
  {_BP.format(n='(2 * sum(tp))', d='(2 * sum(tp) + sum(fp) + sum(fn))')} AS micro_f1_bp FROM f""")
def macro_micro_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 of the length rule over languages."""
    return E.macro_micro(E.f1_by_label(judged(spark, sf_dir), "lang", F.col("quality") == 1, F.col("n_chars") >= 600))


@query(f"""
WITH {_J}, s AS (SELECT *, unnest(['lang:' || lang, 'source:' || source]) AS stratum FROM j),
c AS (SELECT stratum, count(*) FILTER (WHERE e AND o) AS tp, count(*) FILTER (WHERE NOT e AND o) AS fp, count(*) FILTER (WHERE e AND NOT o) AS fn, count(*) FILTER (WHERE NOT e AND NOT o) AS tn FROM s GROUP BY 1)
SELECT *, {_BP.format(n='tp', d='(tp + fp)')} AS precision_bp, {_BP.format(n='tp', d='(tp + fn)')} AS recall_bp FROM c""")
def stratum_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same counts for each stratum a document belongs to."""
    strata = F.explode(F.array(F.concat(F.lit("lang:"), "lang"), F.concat(F.lit("source:"), "source")))
    return E.confusion(judged(spark, sf_dir).withColumn("stratum", strata), F.col("quality") == 1, F.col("n_chars") >= 600, [F.col("stratum")])


@query(f"""
WITH x AS (SELECT sum(levenshtein(b.text, d.text))::BIGINT AS edits, sum(length(b.text))::BIGINT AS reference_length
  FROM (SELECT item_id, regexp_replace(coalesce(text, ''), '[^ -~]', '?', 'g') AS text FROM benchmark) b
  JOIN (SELECT doc_id, regexp_replace(coalesce(text, ''), '[^ -~]', '?', 'g') AS text FROM documents) d ON doc_id = item_id)
SELECT *, {_BP.format(n='edits', d='reference_length')} AS cer_bp FROM x""")
def levenshtein_cer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Character error rate of benchmark items against the whole documents of the same number; a null text is an empty one,
    and characters beyond ASCII count as one and the same (the oracle's distance counts bytes)."""

    def plain(text: Column) -> Column:
        return F.regexp_replace(F.coalesce(text, F.lit("")), "[^ -~]", "?")

    items = read_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), plain(F.col("text")).alias("reference"))
    docs = read_table(spark, sf_dir, "documents").select("doc_id", plain(F.col("text")).alias("hypothesis"))
    return E.error_rate(items.join(docs, "doc_id"), F.col("reference"), F.col("hypothesis"))


@query("""
WITH x AS (SELECT l_returnflag, (l_extendedprice * 100)::BIGINT AS cents, row_number() OVER (PARTITION BY l_returnflag ORDER BY (l_extendedprice * 100)::BIGINT) AS k, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem)
SELECT l_returnflag, p AS p_milli, cents AS value FROM x, (VALUES (500), (900), (950)) AS v(p) WHERE k = greatest((p * n + 999) // 1000, 1)""")
def nearest_rank_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of prices by flag."""
    lines = read_table(spark, sf_dir, "lineitem").select("l_returnflag", F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"))
    return E.percentiles(lines, ["l_returnflag"], "cents", [0.5, 0.9, 0.95], Scratch(spark, "percentiles"))


@query("""
WITH v AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS ordinal, toxic FROM labels),
n AS (SELECT count(*) AS n FROM v), d AS (SELECT r, k, n, (('0x' || substr(sha256('ci:' || r || ':' || k), 1, 16))::UBIGINT % n)::BIGINT AS ordinal FROM n, range(128) AS a(r), range(n) AS b(k)),
m AS (SELECT r, floor((2 * 1000 * sum(toxic) + any_value(n)) / (2 * any_value(n)))::BIGINT AS m, any_value(n) AS n FROM d JOIN v USING (ordinal) GROUP BY r),
o AS (SELECT list_sort(list(m)) AS l, any_value(n) AS n FROM m)
SELECT n, l[4] AS low_milli, l[125] AS high_milli FROM o""")
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval of the share of toxic documents over all labelled rows, from 128 deterministic resamples."""
    rows = ordinals(read_table(spark, sf_dir, "labels").select("doc_id", "toxic"), [F.col("doc_id")], Scratch(spark, "bootstrap"))
    return E.bootstrap(rows, "toxic", "ci")


@query(f"""
WITH e AS (SELECT o_custkey AS k, o_orderpriority AS v, count(*) AS n FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1, 2),
o AS (SELECT o_custkey AS k, o_orderpriority AS v, count(*) AS n FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1, 2),
s AS (SELECT coalesce(e.k, o.k) AS o_custkey, sum(least(coalesce(e.n, 0), coalesce(o.n, 0)))::BIGINT AS common, sum(coalesce(e.n, 0))::BIGINT AS expected, sum(coalesce(o.n, 0))::BIGINT AS observed
  FROM e FULL JOIN o ON e.k = o.k AND e.v = o.v GROUP BY 1)
SELECT *, {_BP.format(n='common', d='observed')} AS precision_bp, {_BP.format(n='common', d='expected')} AS recall_bp FROM s""")
def multiset_precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Priorities of a customer's odd orders against those of the even ones, as multisets."""
    orders = read_table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority")
    return E.literal_overlap(orders.where("o_orderkey % 2 = 0"), orders.where("o_orderkey % 2 = 1"), ["o_custkey"], "o_orderpriority")
