"""Scalar functions, measures of models, policies and picks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.functions import columns as X
from heddle.operators import evaluation as E
from heddle.operators import policy, ranking
from heddle.plans import canonical as C
from heddle.plans.catalogue import query
from heddle.plans.canonical import FACTS
from heddle.runtime import Scratch, read_table, ship_package

_BP = "CASE WHEN {d} > 0 THEN (2 * ({n}) * 10000 + ({d})) // (2 * ({d})) ELSE 0 END"


@query("SELECT p_partkey, 'strasse ' || lower(p_name) || ' x1' AS folded, len(regexp_extract_all('é' || p_name || ' б-' || p_partkey, '[\\w\\p{L}]+')) AS tokens, regexp_replace(regexp_replace(lower(p_brand || ' / ' || p_type || '!'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, '&lt;b&gt;' || p_name || '&amp;&#x27;' AS escaped FROM part")
def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compatibility folding, Unicode tokens, slugs and escapes."""
    ship_package(spark)
    parts = read_table(spark, sf_dir, "part")
    folded = X.nfkc_fold(F.concat(F.lit("  Ｓtraße \t"), F.upper("p_name"), F.lit(" x①")))
    return parts.select(
        "p_partkey", folded.alias("folded"), F.size(X.tokens(F.concat(F.lit("é"), "p_name", F.lit(" б-"), "p_partkey"))).cast("long").alias("tokens"), X.slug(F.concat("p_brand", F.lit(" / "), "p_type", F.lit("!"))).alias("slug"),
        X.escape_html(F.concat(F.lit("<b>"), "p_name", F.lit("&'"))).alias("escaped"),
    )


@query("""WITH x AS (SELECT s_suppkey AS k, sha256('i' || s_suppkey) AS h FROM supplier)
SELECT k, substr(h, 1, 2) || '/' || substr(h, 3, 6) || '/' || h AS shard, sha256('analysis|' || length('i' || k) || ':i' || k || '|0:') AS key, rtrim(replace(replace(base64(unhex(substr(h, 1, 32))), '+', '-'), '/', '_'), '=') AS packed, true AS same, sha256('{"a":' || k || ',"b":"x"}') AS digest FROM x""")
def identity_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard paths, cache keys, packed hashes there and back, canonical digests."""
    k = F.col("s_suppkey")
    name = F.concat(F.lit("i"), k.cast("string"))
    h = F.sha2(name, 256)
    words = F.array(X.u64(F.substring(h, 1, 16)), X.u64(F.substring(h, 17, 16)))
    packed = X.encode_hashes(words)
    return read_table(spark, sf_dir, "supplier").select(k.alias("k"), X.shard_path(name, 2, 6).alias("shard"), X.named_key("analysis", name, F.lit(None).cast("string")).alias("key"), packed.alias("packed"), (X.decode_hashes(packed) == words).alias("same"), X.canonical_digest(k.alias("a"), F.lit("x").alias("b")).alias("digest"))


@query("""
SELECT event_id, epoch(date_trunc('second', ts))::BIGINT AS seconds, NULL::BIGINT AS bad, floor(event_id * 1.0000005 * 1000000 + 0.5)::BIGINT AS us, (2 * event_id + 7) // 14 AS half_up, (CASE WHEN event_id % 9 > 0 THEN (2 * (event_id % 9) * 10000 + event_id % 9 + 0) // (2 * (event_id % 9)) ELSE 0 END) // 10 AS milli FROM events""")
def numeric_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instants, microseconds, halves up, means in thousandths."""
    k = F.col("event_id")
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return read_table(spark, sf_dir, "events").select("event_id", X.instant(text).alias("seconds"), X.instant(F.concat(text, F.lit(" "))).alias("bad"), X.seconds_to_us((k.cast("decimal(20,0)") * F.lit("1.0000005").cast("decimal(12,7)")).cast("string")).alias("us"), X.half_up(k, F.lit(7)).alias("half_up"), X.mean_milli(k % 9, k % 9).alias("milli"))


@query("""
WITH x AS (SELECT p_partkey AS k, [p_partkey * 7 % 31, p_partkey * 3 % 17, p_size, p_partkey % 5] || CASE WHEN p_partkey % 2 = 0 THEN [p_size + 1] ELSE [] END AS v FROM part)
SELECT k, (list_sort(v)[(len(v) - 1) // 2 + 1] + list_sort(v)[len(v) // 2 + 1]) // 2 AS median, list_sort(v)[ceil(len(v) * 9 / 10)::INTEGER] AS p90, regexp_replace(regexp_replace(printf('%.6f', v[3] / 8.0), '0+$', ''), '[.]$', '') AS shown FROM x""")
def array_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truncated medians, nearest ranks and trimmed decimals."""
    k = F.col("p_partkey")
    v = F.concat(F.array((k * 7 % 31).cast("long"), (k * 3 % 17).cast("long"), F.col("p_size").cast("long"), (k % 5).cast("long")), F.when(k % 2 == 0, F.array(F.col("p_size").cast("long") + 1)).otherwise(F.array().cast("array<long>")))
    return read_table(spark, sf_dir, "part").select(k.alias("k"), X.truncated_median(v).alias("median"), X.nearest_rank(v, 90).alias("p90"), X.trimmed_decimal(F.col("p_size") / 8).alias("shown"))


@query("SELECT o_orderstatus, CASE WHEN bool_or(o_orderkey % 400 = 3) THEN NULL ELSE sum(o_orderkey) END::BIGINT AS total FROM orders GROUP BY 1")
def sums_of_optionals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums that are unknown if any part is."""
    orders = read_table(spark, sf_dir, "orders")
    value = F.when(F.col("o_orderkey") % 400 != 3, F.col("o_orderkey"))
    return orders.groupBy("o_orderstatus").agg(X.sum_of_all(value).alias("total"))


_CASES = """
b AS (SELECT p_partkey AS k, p_partkey % 8 <> 3 AS answered, p_partkey % 2 = 0 AS present, p_partkey % 3 <> 0 AS seen, p_partkey % 4 = 0 AS readable, p_size, p_type, p_brand, p_retailprice FROM part),
x AS (SELECT *, [p_type, p_brand] AS el, CASE WHEN answered THEN CASE WHEN k % 5 = 0 THEN [p_type] WHEN k % 5 = 1 THEN [p_brand, p_type] ELSE [p_type, p_brand] END ELSE [] END AS ol, ['a', ['b', 'c', 'd'][k % 3 + 1]] AS et, CASE WHEN answered THEN CASE WHEN k % 2 = 0 THEN ['a'] ELSE ['a', 'b'] END ELSE [] END AS ot, k % 3 + 1 AS weight FROM b)"""


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    answered = k % 8 != 3
    told = lambda value: F.when(answered, value)
    literals = F.when(k % 5 == 0, F.array("p_type")).when(k % 5 == 1, F.array("p_brand", "p_type")).otherwise(F.array("p_type", "p_brand"))
    return read_table(spark, sf_dir, "part").select(
        k.alias("case_id"), (k % 3 + 1).alias("weight"), answered.alias("answered"), told(k % 11 == 0).alias("hallucinated"), told(k % 13 == 0).alias("brand_false"), (k % 2 == 0).alias("text_present"), told(k % 3 != 0).alias("text_observed"), (k % 4 == 0).alias("text_readable"), (k % 5 == 2).alias("ambiguous"),
        told(k % 7 != 0).alias("uncertainty_ok"), told(k % 3 == 1).alias("uncertain"), told(k % 6 != 1).alias("motion_ok"), told(k % 9 != 2).alias("consistent"), F.array("p_type", "p_brand").alias("expected_literals"), told(literals).alias("observed_literals"), F.lit(2).alias("facts"), told(k % 3).alias("facts_found"),
        F.array(F.lit("a"), F.element_at(F.array(F.lit("b"), F.lit("c"), F.lit("d")), (k % 3 + 1).cast("int"))).alias("expected_types"), told(F.when(k % 2 == 0, F.array(F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b")))).alias("observed_types"), F.array(F.lit("s")).alias("expected_styles"), told(F.array(F.lit("s"))).alias("observed_styles"),
        told(F.array((k % 5 + 1).cast("int"), F.lit(4))).alias("scores"), F.col("p_size").cast("long").alias("latency_ms"), (k % 2 + 1).alias("requests"), F.lit(5).alias("tokens"), F.when(k != 2, F.lit("0.25")).alias("cost"),
    )


def _f1(tp: str, fp: str, fn: str) -> str:
    return f"CASE WHEN {tp} + {fp} + {fn} = 0 THEN 10000 ELSE {_BP.format(n=f'2 * ({tp})', d=f'2 * ({tp}) + {fp} + {fn}')} END"


@query(f"""WITH {_CASES},
l AS (SELECT x.k, v, len(list_filter(el, lambda y : y = v)) AS e, len(list_filter(ol, lambda y : y = v)) AS o FROM x, unnest(list_distinct(list_concat(el, ol))) AS t(v) WHERE readable),
t AS (SELECT v, sum(CASE WHEN list_contains(et, v) AND list_contains(ot, v) THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN NOT list_contains(et, v) AND list_contains(ot, v) THEN 1 ELSE 0 END) AS fp, sum(CASE WHEN list_contains(et, v) AND NOT list_contains(ot, v) THEN 1 ELSE 0 END) AS fn,
  sum(CASE WHEN list_contains(et, v) AND list_contains(ot, v) THEN weight ELSE 0 END) AS wtp, sum(CASE WHEN NOT list_contains(et, v) AND list_contains(ot, v) THEN weight ELSE 0 END) AS wfp, sum(CASE WHEN list_contains(et, v) AND NOT list_contains(ot, v) THEN weight ELSE 0 END) AS wfn FROM x, unnest(list_distinct(list_concat(et, ot))) AS t(v) GROUP BY 1),
p AS (SELECT p_size, row_number() OVER (ORDER BY p_size) AS r, count(*) OVER () AS n FROM x)
SELECT count(*) AS cases, {_BP.format(n="count(*) FILTER (WHERE answered)", d="count(*)")} AS schema_success_bp, count(*) FILTER (WHERE NOT answered OR k % 11 = 0) AS hallucination_count, {_BP.format(n="count(*) FILTER (WHERE NOT answered OR k % 11 = 0)", d="count(*)")} AS hallucination_bp,
  count(*) FILTER (WHERE answered AND k % 13 = 0) AS brand_identity_false_claim_count, {_BP.format(n="sum(CASE WHEN answered THEN k % 3 ELSE 0 END)::BIGINT", d="2 * count(*)")} AS required_fact_recall_bp,
  {_f1("count(*) FILTER (WHERE present AND answered AND seen)", "count(*) FILTER (WHERE NOT present AND answered AND seen)", "count(*) FILTER (WHERE present AND NOT (answered AND seen))")} AS text_presence_f1_bp, count(*) FILTER (WHERE readable) AS literal_readable_case_count,
  {_BP.format(n="count(*) FILTER (WHERE readable AND el = ol)", d="count(*) FILTER (WHERE readable)")} AS literal_exact_bp,
  {_BP.format(n="sum(CASE WHEN readable THEN levenshtein(array_to_string(el, chr(1)), array_to_string(ol, chr(1))) ELSE 0 END)::BIGINT", d="sum(CASE WHEN readable THEN length(p_type) + 1 + length(p_brand) ELSE 0 END)::BIGINT")} AS literal_cer_bp,
  {_BP.format(n="count(*) FILTER (WHERE answered AND k % 6 <> 1)", d="count(*)")} AS motion_accuracy_bp, {_BP.format(n="count(*) FILTER (WHERE answered AND k % 7 <> 0)", d="count(*)")} AS uncertainty_exact_bp, {_BP.format(n="count(*) FILTER (WHERE k % 5 = 2 AND answered AND k % 3 = 1 AND k % 7 <> 0)", d="count(*) FILTER (WHERE k % 5 = 2)")} AS ambiguity_uncertainty_appropriate_bp,
  {_BP.format(n="count(*) FILTER (WHERE answered AND k % 9 <> 2)", d="count(*)")} AS consistency_bp, ({_BP.format(n="sum(CASE WHEN answered THEN k % 5 + 5 ELSE 0 END)::BIGINT", d="2 * count(*) FILTER (WHERE answered)")}) // 10 AS mean_score_milli, sum(k % 2 + 1)::BIGINT AS requests_used, sum(k % 2)::BIGINT AS retries, 5 * count(*) AS tokens, NULL::VARCHAR AS cost,
  (SELECT {_BP.format(n="sum(least(e, o))::BIGINT", d="sum(o)::BIGINT")} FROM l) AS literal_precision_bp, (SELECT {_BP.format(n="sum(least(e, o))::BIGINT", d="sum(e)::BIGINT")} FROM l) AS literal_coverage_bp,
  (SELECT {_BP.format(n="sum(" + _f1("tp", "fp", "fn") + ") FILTER (WHERE tp + fn > 0)::BIGINT", d="10000 * count(*) FILTER (WHERE tp + fn > 0)")} FROM t) AS types_macro_f1_bp, (SELECT {_f1("sum(wtp)::BIGINT", "sum(wfp)::BIGINT", "sum(wfn)::BIGINT")} FROM t) AS types_micro_f1_bp,
  {_f1("count(*) FILTER (WHERE answered)", "0", "count(*) FILTER (WHERE NOT answered)")} AS styles_macro_f1_bp, {_f1("sum(weight) FILTER (WHERE answered)::BIGINT", "0", "coalesce(sum(weight) FILTER (WHERE NOT answered), 0)::BIGINT")} AS styles_micro_f1_bp,
  (SELECT any_value(p_size) FROM p WHERE r = (n * 500 + 999) // 1000)::BIGINT AS latency_ms_median, (SELECT any_value(p_size) FROM p WHERE r = (n * 950 + 999) // 1000)::BIGINT AS latency_ms_p95 FROM x""")
def model_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's figures over adjudicated cases."""
    return E.model_metrics(_cases(spark, sf_dir), Scratch(spark, "metrics"))


@query("""
WITH c AS (SELECT p_partkey AS case_id FROM part), o AS (SELECT p_partkey AS case_id, a AS attempt, 'r' || p_partkey || '-' || a AS response FROM part, range(1, 4) AS t(a) WHERE p_partkey % 5 <> 0 AND NOT (p_partkey % 2 = 0 AND a = 1)),
f AS (SELECT case_id, min(attempt) AS attempt, arg_min(response, attempt) AS response FROM o GROUP BY 1)
SELECT c.case_id, f.attempt, CASE WHEN f.attempt = 2 THEN 'good' END AS verdict FROM c LEFT JOIN f USING (case_id)""")
def adjudicated_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases with their first observation and the judgement of exactly that response."""
    k = F.col("p_partkey")
    parts = read_table(spark, sf_dir, "part").select(k.alias("case_id"))
    seen = parts.withColumn("attempt", F.explode(F.array(F.lit(3), F.lit(1), F.lit(2)))).where("case_id % 5 <> 0 and not (case_id % 2 = 0 and attempt = 1)")
    seen = seen.withColumn("response", F.concat(F.lit("r"), "case_id", F.lit("-"), "attempt"))
    judged = parts.select("case_id", F.sha2(F.concat(F.lit("r"), "case_id", F.lit("-2")), 256).alias("response_sha256"), F.lit("good").alias("verdict"))
    bound = E.bound_cases(parts, seen, judged)
    return bound.select("case_id", "o.attempt", "a.verdict")


@query("""WITH l AS (SELECT p_partkey AS k FROM part), n AS (SELECT k, k + 1 AS j, k % 7 AS rank FROM l WHERE k % 3 = 0)
SELECT k AS "right", k + 1 AS "left", CASE WHEN k % 3 = 0 THEN k % 7 END AS rank, k % 3 = 0 AS found FROM l""")
def labelled_pairs_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled pairs with the rank at which a scan found them."""
    k = F.col("p_partkey")
    parts = read_table(spark, sf_dir, "part")
    cases = parts.select((k + 1).alias("left"), k.alias("right"))
    found = parts.where(k % 3 == 0).select(k.alias("left"), (k + 1).alias("right"), (k % 7).alias("rank"))
    return E.near_lookup(cases, found)


@query("SELECT p_brand, count(DISTINCT CASE WHEN p_partkey % 40 = 1 THEN 'test' ELSE 'train' END) AS splits, count(*) AS cases FROM part GROUP BY 1 HAVING splits > 1")
def split_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Isolation groups with cases in several splits."""
    parts = read_table(spark, sf_dir, "part").select("p_brand", F.when(F.col("p_partkey") % 40 == 1, "test").otherwise("train").alias("split"))
    return E.leaks(parts, "p_brand", "split")


@query("""WITH x AS (SELECT count(*) FILTER (WHERE quality = 1) AS good, count(*) AS n, count(*) FILTER (WHERE toxic = 1) AS bad FROM labels) SELECT n >= 100 AS enough, 10 * good >= 5 * n AS mostly_good, CASE WHEN bad >= 0 THEN bad = 0 END AS harmless, n >= 100 AND 10 * good >= 5 * n AND bad = 0 AS passed FROM x""")
def gate_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named gates over one row of counts, and whether all hold."""
    row = read_table(spark, sf_dir, "labels").agg(F.count_if(F.col("quality") == 1).alias("good"), F.count("*").alias("n"), F.count_if(F.col("toxic") == 1).alias("bad"))
    return E.gates(row, {"enough": F.col("n") >= 100, "mostly_good": 10 * F.col("good") >= 5 * F.col("n"), "harmless": F.col("bad") == 0})


@query(f"""WITH {FACTS} SELECT id, concat_ws(',', CASE WHEN k % 4 = 1 AND k % 5 <> 0 THEN 'complex-motion' END, CASE WHEN k % 31 = 0 THEN 'low-visibility' END) AS before, concat_ws(',', CASE WHEN k % 6 = 0 THEN 'character-or-brand' END, CASE WHEN k % 10 = 0 THEN 'facet-conflict' END, CASE WHEN k % 7 = 0 THEN 'partial-text' END) AS after,
  k % 4 = 1 AND k % 5 <> 0 OR k % 31 = 0 AS escalated FROM f""")
def routing_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why items go to a stronger model, before and after they are described."""
    k = F.substring("id", 2, 8).cast("long")
    early = policy.deterministic_reasons(F.when(k % 4 == 1, "webm").otherwise("png"), F.lit(16), k % 5, F.col("fingerprints.items")[0]["perceptual"]["low_information"])
    unsure = F.array_compact(F.array(F.when(k % 6 == 0, F.lit("character-or-brand")), F.when(k % 10 == 0, F.lit("style"))))
    late = policy.semantic_reasons(F.when(k % 7 == 0, "unreadable").otherwise("none"), unsure)
    rows = C.items(spark, sf_dir).select("id", early.alias("b"), late.alias("a"))
    labelled = F.concat(F.col("b"), F.array(F.lit("sensitive-content")))
    return rows.select("id", F.array_join("b", ",").alias("before"), F.array_join("a", ",").alias("after"), policy.should_escalate("rules", labelled, "strong").alias("escalated"))


@query(f"""WITH {FACTS} SELECT id, CASE WHEN k % 14 = 13 THEN NULL WHEN k % 10 = k % 7 THEN 'REPEATED' WHEN k % 10 > k % 7 THEN 'UNSORTED' WHEN k % 10 = 9 OR k % 7 = 9 THEN 'UNKNOWN' END AS fault FROM f""")
def concept_selections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with items' selections of concepts."""
    active = F.array(*[F.lit(f"c{k}") for k in range(9)])
    return C.items(spark, sf_dir).select("id", policy.concept_selection(F.col("concept_ids"), active).alias("fault"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 4 <> 0 THEN 'include' WHEN s_suppkey = 4 THEN 'include' ELSE 'ask' END AS choice FROM supplier")
def official_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which packs are taken, and which official ones must be asked about."""
    packs = read_table(spark, sf_dir, "supplier").select("s_suppkey")
    return policy.official_choice(packs, packs.where("s_suppkey % 4 = 0"), "s_suppkey", "ask", [4])


@query("""WITH r AS (SELECT user_id AS pack, event_id AS run_id, CASE event_type WHEN 'purchase' THEN 'paused' WHEN 'click' THEN 'described' ELSE 'failed' END AS state, epoch_us(ts) AS updated_at FROM events WHERE NOT (event_type = 'purchase' AND user_id % 5 = 0)),
k AS (SELECT *, row_number() OVER (PARTITION BY pack ORDER BY state = 'paused' DESC, updated_at DESC, run_id DESC) AS n FROM r) SELECT pack, run_id, state, state <> 'paused' AS fallback FROM k WHERE n = 1""")
def saved_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run to resume for each pack, the newest of all where none is paused."""
    state = F.when(F.col("event_type") == "purchase", "paused").when(F.col("event_type") == "click", "described").otherwise("failed")
    runs = read_table(spark, sf_dir, "events").where("not (event_type = 'purchase' and user_id % 5 = 0)").select(F.col("user_id").alias("pack"), F.col("event_id").alias("run_id"), state.alias("state"), F.unix_micros(F.col("ts").cast("timestamp")).alias("updated_at"))
    return policy.saved_run(runs, "resume")


@query("""WITH x AS (SELECT user_id AS media, event_id, epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id) AS start FROM events), d AS (SELECT DISTINCT media, start FROM x), n AS (SELECT media, start, lead(start) OVER (PARTITION BY media ORDER BY start) AS stop, max(start) OVER (PARTITION BY media) + 1000000 AS finish FROM d),
f AS (SELECT media, start, coalesce(stop, finish) AS stop, finish, row_number() OVER (PARTITION BY media ORDER BY start) - 1 AS frame FROM n)
SELECT f.media, i AS sample, frame FROM f, range(16) AS t(i) WHERE (2 * i + 1) * finish >= 32 * start AND (2 * i + 1) * finish < 32 * stop""")
def held_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frame that is held at each of sixteen midpoints of a presentation."""
    from heddle.operators.intervals import held_at, presented

    events = read_table(spark, sf_dir, "events").select(F.col("user_id").alias("media"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    first = events.groupBy("media").agg(F.min("t").alias("t0"))
    starts = events.join(first, "media").select("media", (F.col("t") - F.col("t0")).alias("start")).distinct()
    finish = starts.groupBy("media").agg((F.max("start") + 1_000_000).alias("finish"))
    return held_at(presented(starts, finish), 16)


@query("""SELECT user_id AS media, 'FIRST_NOT_ZERO' AS code FROM events WHERE user_id % 3 = 1 GROUP BY 1 UNION ALL SELECT user_id, 'NOT_INCREASING' FROM events WHERE user_id % 3 = 2 GROUP BY 1 HAVING count(*) > 0""")
def frame_order_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Presentations that do not begin at 0 or whose frames do not follow each other."""
    from heddle.operators.intervals import frame_issues

    media = read_table(spark, sf_dir, "events").select(F.col("user_id").alias("media")).distinct()
    frames = media.withColumn("f", F.explode(F.array(*[F.struct(F.lit(k).alias("index"), F.lit(10 * k).alias("start")) for k in range(3)]))).select("media", "f.*")
    start = F.when(F.col("media") % 3 == 1, F.col("start") + 5).when((F.col("media") % 3 == 2) & (F.col("index") == 2), F.lit(10)).otherwise(F.col("start"))
    return frame_issues(frames.withColumn("start", start))


@query("""WITH x AS (SELECT l_orderkey AS k, list(l_partkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS v FROM lineitem GROUP BY 1)
SELECT k, array_to_string(list_transform(list_sort(list_distinct(list_transform(v, lambda y, i : [list_position(v, y), y]))), lambda p : p[2]), ',') AS first_seen, len(list_filter(list_distinct(v), lambda y : y % 2 = 0)) AS even FROM x""")
def order_preserving_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of each order without repeats, in order of first mention, and set algebra on them."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))), lambda x: x["l_partkey"])
    grouped = read_table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(rows.alias("v"))
    kept = F.array_distinct("v")
    odd = F.filter(kept, lambda x: x % 2 == 1)
    return grouped.select("k", F.array_join(kept, ",").alias("first_seen"), F.size(F.array_except(kept, odd)).cast("long").alias("even"))


@query("""WITH RECURSIVE x AS (SELECT p_partkey AS k, 3 + p_partkey % 3 AS n, [[(p_partkey * i * 7 + j * 13 + i * j) % 50 FOR j IN range(3 + p_partkey % 3)] FOR i IN range(1, 4 + p_partkey % 3)] AS cost FROM part WHERE p_partkey % 5 <> 0),
r AS (SELECT k, n, cost, 0::BIGINT AS i, 0::BIGINT AS used, 0::BIGINT AS total FROM x UNION ALL SELECT k, n, cost, i + 1, used | (1 << j), total + cost[i + 1][j + 1] FROM r, range(5) AS t(j) WHERE i < n AND j < n AND used & (1 << j) = 0)
SELECT k, n::INTEGER AS n, min(total) AS total FROM r WHERE i = n GROUP BY ALL""")
def media_bijections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least cost of pairing the media of two items one to one."""
    from heddle.operators.alignment import media_bijection

    ship_package(spark)
    k = F.col("p_partkey")
    n = (k % 3 + 3).cast("int")
    cost = F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(0), n - 1), lambda j: ((k * i * 7 + j * 13 + i * j) % 50).cast("int")))
    rows = read_table(spark, sf_dir, "part").where(k % 5 != 0).select(k.alias("k"), n.alias("n_left"), n.alias("n_right"), cost.alias("cost"))
    rows = Scratch(spark, "bijections").table(rows, "costs")
    whole = media_bijection(rows, "k").where(F.size("pairing") == F.size(F.array_distinct("pairing")))
    return rows.join(whole, "k").select("k", F.col("n_left").alias("n"), "total")


@query("SELECT o_custkey, o_orderkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1) AS ordinal FROM orders")
def grouped_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contiguous numbers within groups of any size."""
    orders = read_table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return ranking.ordinals(orders, [F.col("o_orderdate"), F.col("o_orderkey")], Scratch(spark, "ordinals"), by=["o_custkey"]).drop("o_orderdate")
