"""Evaluation: confusion, Wilson intervals, F1, character error rate, percentiles, bootstrap intervals, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.functions.columns import ratio_bp
from heddle.operators.ranking import running
from heddle.runtime import Scratch

#: 97.5 % point of the normal distribution.
Z = 1.959963984540054


def confusion(df: DataFrame, expected: Column, observed: Column, by: list[Column] | None = None) -> DataFrame:
    """tp, fp, fn, tn with precision and recall in basis points."""
    counts = df.groupBy(*(by or [])).agg(
        F.count_if(expected & observed).alias("tp"), F.count_if(~expected & observed).alias("fp"), F.count_if(expected & ~observed).alias("fn"), F.count_if(~expected & ~observed).alias("tn")
    )
    c = F.col
    return counts.withColumns({"precision_bp": ratio_bp(c("tp"), c("tp") + c("fp")), "recall_bp": ratio_bp(c("tp"), c("tp") + c("fn"))})


def wilson(hits: Column, n: Column, z: float = Z) -> tuple[Column, Column]:
    """The Wilson score interval, as shares."""
    n = F.greatest(n, F.lit(1)).cast("double")
    p = hits / n
    middle, spread = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return (middle - spread) / (1 + z * z / n), (middle + spread) / (1 + z * z / n)


def f1_bp(tp: Column, fp: Column, fn: Column) -> Column:
    """F1 in basis points; without any support it is 10000."""
    return F.when(tp + fp + fn == 0, F.lit(10_000).cast("long")).otherwise(ratio_bp(2 * tp, 2 * tp + fp + fn))


def f1_by_label(df: DataFrame, label: str, expected: Column, observed: Column) -> DataFrame:
    """Support, counts and F1 of each label."""
    counts = confusion(df, expected, observed, [F.col(label)])
    c = F.col
    return counts.select(label, (c("tp") + c("fn")).alias("support"), "tp", "fp", "fn", f1_bp(c("tp"), c("fp"), c("fn")).alias("f1_bp"))


def macro_micro(labels: DataFrame) -> DataFrame:
    """Macro F1 over labels with support and micro F1 over all; 10000 without any."""
    c = F.col
    return labels.agg(
        F.coalesce(F.floor((2 * F.sum(F.when(c("support") > 0, c("f1_bp"))) + F.count_if(c("support") > 0)) / (2 * F.count_if(c("support") > 0))), F.lit(10_000)).cast("long").alias("macro_f1_bp"),
        f1_bp(F.coalesce(F.sum("tp"), F.lit(0)), F.coalesce(F.sum("fp"), F.lit(0)), F.coalesce(F.sum("fn"), F.lit(0))).alias("micro_f1_bp"),
    )


def percentiles(df: DataFrame, by: list[str], value: str, points: list[float], scratch: Scratch) -> DataFrame:
    """Nearest-rank percentiles (the value at rank ceil(n * p)), from counts of distinct values.

    Values are counted first and ranked by running counts over ranges, so equal values cost one row and a group of any
    size is dealt over many tasks.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__n"))
    ranked = running(counted, by, [F.col(value)], F.col("__n"), scratch, "__below")
    totals = counted.groupBy(*by).agg(F.sum("__n").alias("__all"))
    wanted = ranked.join(totals, by) if by else ranked.withColumn("__all", F.lit(totals.first()[0]))
    wanted = wanted.select(*by, value, "__n", "__below", "__all", F.explode(F.array(*[F.lit(int(round(p * 1000))) for p in points])).alias("p_milli"))
    rank = F.greatest(F.floor((F.col("p_milli") * F.col("__all") + 999) / 1000), F.lit(1))
    return wanted.where((rank > F.col("__below")) & (rank <= F.col("__below") + F.col("__n"))).select(*by, "p_milli", F.col(value).alias("value"))


def bootstrap(values: DataFrame, value: str, seed: str, rounds: int = 128, low: int = 3, high: int = 124) -> DataFrame:
    """Mean interval (in thousandths) from deterministic resamples: draw k of round r takes the row whose ordinal is
    the first 8 bytes of SHA-256(seed:r:k) modulo n. ``values`` has ``ordinal`` 0..n-1; it is a bounded evaluation set."""
    n = values.count()
    if not n:
        return values.sparkSession.createDataFrame([], "n long, low_milli long, high_milli long")
    draws = values.sparkSession.range(rounds * n).select((F.col("id") / n).cast("long").alias("r"), (F.col("id") % n).alias("k"))
    digest = F.sha2(F.concat_ws(":", F.lit(seed), "r", "k"), 256)
    draws = draws.select("r", (F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)") % F.lit(n).cast("decimal(20,0)")).cast("long").alias("ordinal"))
    means = draws.join(values.select("ordinal", F.col(value).alias("v")), "ordinal").groupBy("r").agg(F.floor((2 * 1000 * F.sum("v") + n) / F.lit(2 * n)).cast("long").alias("m"))
    ordered = means.agg(F.array_sort(F.collect_list("m")).alias("m"))
    return ordered.select(F.lit(n).cast("long").alias("n"), F.col("m")[low].alias("low_milli"), F.col("m")[high].alias("high_milli"))


def error_rate(df: DataFrame, reference: Column, hypothesis: Column) -> DataFrame:
    """Summed edit distance, reference length and character error rate in basis points."""
    summed = df.agg(F.sum(F.levenshtein(reference, hypothesis)).cast("long").alias("edits"), F.sum(F.length(reference)).cast("long").alias("reference_length"))
    return summed.withColumn("cer_bp", ratio_bp(F.col("edits"), F.col("reference_length")))


def literal_overlap(expected: DataFrame, observed: DataFrame, key: list[str], value: str) -> DataFrame:
    """Multiset precision and recall of values per key: common copies against those observed and expected."""
    e = expected.groupBy(*key, value).agg(F.count("*").alias("e"))
    o = observed.groupBy(*key, value).agg(F.count("*").alias("o"))
    both = e.join(o, [*key, value], "full_outer").na.fill(0, ["e", "o"])
    sums = both.groupBy(*key).agg(F.sum(F.least("e", "o")).alias("common"), F.sum("e").alias("expected"), F.sum("o").alias("observed"))
    return sums.withColumns({"precision_bp": ratio_bp(F.col("common"), F.col("observed")), "recall_bp": ratio_bp(F.col("common"), F.col("expected"))})


def best_allowed(df: DataFrame, case: str, allowed: str, chosen: str) -> DataFrame:
    """Per case the allowed set with the best F1 against the chosen set; ties go to the least set."""
    common, size = F.size(F.array_intersect(allowed, chosen)), F.size(allowed) + F.size(chosen)
    score = F.when(size == 0, F.lit(10_000).cast("long")).otherwise(ratio_bp(2 * common, size))
    best = F.min(F.struct((-score).alias("minus"), F.array_sort(allowed).alias("set"))).alias("b")
    return df.groupBy(case).agg(best).select(case, F.col("b.set").alias("best_set"), (-F.col("b.minus")).alias("f1_bp"))


def gates(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Each named check over one row of metrics, and whether all pass."""
    return df.select(*[check.alias(name) for name, check in checks.items()]).withColumn("passed", F.forall(F.array(*[F.coalesce(F.col(name), F.lit(False)) for name in checks]), lambda x: x))


def bound_cases(cases: DataFrame, observations: DataFrame, adjudications: DataFrame) -> DataFrame:
    """Cases with the first observation of each (least ``attempt``) and the adjudication of exactly that response, found by the
    response's digest; a case without either keeps nulls."""
    first = observations.groupBy("case_id").agg(F.min_by(F.struct(*observations.columns), "attempt").alias("o"))
    rows = cases.join(first, "case_id", "left").withColumn("__digest", F.sha2("o.response", 256))
    judged = adjudications.groupBy("case_id", "response_sha256").agg(F.first(F.struct(*adjudications.columns)).alias("a"))
    on = (F.col("c.case_id") == F.col("j.case_id")) & (F.col("c.__digest") == F.col("j.response_sha256"))
    return rows.alias("c").join(judged.alias("j"), on, "left").select("c.*", "j.a").drop("__digest")


def near_lookup(cases: DataFrame, pairs: DataFrame) -> DataFrame:
    """Labelled pairs (left, right in any order) with whether a scan found them, and its rank."""
    found = pairs.select(F.least("left", "right").alias("x"), F.greatest("left", "right").alias("y"), "rank").groupBy("x", "y").agg(F.min("rank").alias("rank"))
    joined = cases.join(found, (F.least("left", "right") == F.col("x")) & (F.greatest("left", "right") == F.col("y")), "left")
    return joined.drop("x", "y").withColumn("found", F.col("rank").isNotNull())


def leaks(cases: DataFrame, group: str, split: str) -> DataFrame:
    """Isolation groups with cases in more than one split."""
    return cases.groupBy(group).agg(F.count_distinct(split).alias("splits"), F.count("*").alias("cases")).where("splits > 1")


def set_f1(pairs: DataFrame, expected: str, observed: str, weight: str) -> DataFrame:
    """(macro_f1_bp, micro_f1_bp) of label sets: macro over labels that are expected somewhere, micro weighted by case. Without
    pairs macro is 0, without labels 10000."""
    labels = F.explode(F.array_union(expected, observed)).alias("label")
    rows = pairs.select(expected, observed, weight, labels)
    hit, asked = F.array_contains(observed, F.col("label")), F.array_contains(expected, F.col("label"))
    counts = rows.groupBy("label").agg(*[F.sum(F.when(test, w).otherwise(0)).alias(name) for name, test, w in (
        ("tp", hit & asked, F.lit(1)), ("fp", hit & ~asked, F.lit(1)), ("fn", ~hit & asked, F.lit(1)), ("wtp", hit & asked, F.col(weight)), ("wfp", hit & ~asked, F.col(weight)), ("wfn", ~hit & asked, F.col(weight)),
    )])
    c = F.col
    scored = counts.withColumn("support", c("tp") + c("fn")).withColumn("f1_bp", f1_bp(c("tp"), c("fp"), c("fn")))
    n = F.count_if(c("support") > 0)
    macro = F.when(n > 0, ratio_bp(F.sum(F.when(c("support") > 0, c("f1_bp"))), n * 10_000)).otherwise(F.lit(10_000))
    summed = [F.coalesce(F.sum(x), F.lit(0)) for x in ("wtp", "wfp", "wfn")]
    some = pairs.limit(1).count() > 0
    return scored.agg((macro if some else F.lit(0)).cast("long").alias("macro_f1_bp"), f1_bp(*summed).alias("micro_f1_bp"))


def model_metrics(cases: DataFrame, scratch: Scratch) -> DataFrame:
    """One row of a model's figures over adjudicated cases.

    ``cases`` has case_id, weight, answered, hallucinated, brand_false, text_present, text_observed, text_readable, ambiguous,
    uncertainty_ok, uncertain, motion_ok, consistent, expected_literals, observed_literals, facts, facts_found, expected_types,
    observed_types, expected_styles, observed_styles, scores (array), latency_ms, requests, tokens (may be null), cost (may be
    null). A case that was not answered has nulls where an answer would tell.
    """
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    n = F.count("*")
    share = lambda c, of=None: ratio_bp(F.count_if(yes(c) & (of if of is not None else F.lit(True))), n if of is None else F.count_if(of))
    readable, joined = yes("text_readable"), lambda c: F.array_join(F.coalesce(c, F.array().cast("array<string>")), "\0")
    edits, length = F.levenshtein(joined("expected_literals"), joined("observed_literals")), F.greatest(F.length(joined("expected_literals")), F.lit(1))
    tp, fp, fn = F.count_if(yes("text_present") & yes("text_observed")), F.count_if(~yes("text_present") & yes("text_observed")), F.count_if(yes("text_present") & ~yes("text_observed"))
    scores = F.aggregate(F.coalesce("scores", F.array().cast("array<int>")), F.lit(0), lambda s, x: s + x)
    metrics = cases.agg(
        n.alias("cases"), share("answered").alias("schema_success_bp"), F.count_if(yes("hallucinated") | ~yes("answered")).alias("hallucination_count"), ratio_bp(F.count_if(yes("hallucinated") | ~yes("answered")), n).alias("hallucination_bp"), F.count_if(yes("brand_false")).alias("brand_identity_false_claim_count"),
        ratio_bp(F.sum(F.coalesce("facts_found", F.lit(0))), F.sum("facts")).alias("required_fact_recall_bp"), f1_bp(tp, fp, fn).alias("text_presence_f1_bp"), F.count_if(readable).alias("literal_readable_case_count"),
        ratio_bp(F.count_if(readable & (joined("expected_literals") == joined("observed_literals"))), F.count_if(readable)).alias("literal_exact_bp"), ratio_bp(F.sum(F.when(readable, edits).otherwise(0)), F.sum(F.when(readable, length).otherwise(0))).alias("literal_cer_bp"),
        share("motion_ok").alias("motion_accuracy_bp"), share("uncertainty_ok").alias("uncertainty_exact_bp"), ratio_bp(F.count_if(yes("ambiguous") & yes("uncertain") & yes("uncertainty_ok")), F.count_if(yes("ambiguous"))).alias("ambiguity_uncertainty_appropriate_bp"), share("consistent").alias("consistency_bp"),
        F.floor(ratio_bp(F.sum(scores), F.sum(F.coalesce(F.size("scores"), F.lit(0)))) / 10).cast("long").alias("mean_score_milli"), F.sum("requests").alias("requests_used"), F.sum(F.greatest(F.col("requests") - 1, F.lit(0))).alias("retries"),
        F.when(F.count("tokens") == n, F.sum("tokens")).alias("tokens"), F.when(F.count("cost") == n, F.sum(F.col("cost").cast("decimal(38,6)"))).cast("string").alias("cost"),
    )
    literals = literal_overlap(
        cases.where(readable).select(F.lit(1).alias("one"), F.col("case_id"), F.explode("expected_literals").alias("v")), cases.where(readable).select(F.lit(1).alias("one"), F.col("case_id"), F.explode("observed_literals").alias("v")), ["one", "case_id"], "v"
    ).agg(ratio_bp(F.sum("common"), F.sum("observed")).alias("literal_precision_bp"), ratio_bp(F.sum("common"), F.sum("expected")).alias("literal_coverage_bp"))
    sets = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    styled = cases.withColumns({c: sets(c) for c in ("expected_types", "observed_types", "expected_styles", "observed_styles")})
    row = metrics.first().asDict() | literals.first().asDict()
    for name in ("types", "styles"):
        row |= {f"{name}_{k}": v for k, v in set_f1(styled, f"expected_{name}", f"observed_{name}", "weight").first().asDict().items()}
    ranks = {r["p_milli"]: r["value"] for r in percentiles(cases, [], "latency_ms", [0.5, 0.95], scratch).collect()} if row["cases"] else {}
    row |= {"latency_ms_median": ranks.get(500), "latency_ms_p95": ranks.get(950)}
    fields = ", ".join(f"{k} {'string' if k == 'cost' else 'long'}" for k in row)
    return cases.sparkSession.createDataFrame([tuple(row.values())], fields)


def report_digest(report: dict) -> dict:
    """The report with the digest of its canonical JSON."""
    import hashlib
    import json

    body = json.dumps({k: v for k, v in report.items() if k != "report_sha256"}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return report | {"report_sha256": hashlib.sha256(body.encode()).hexdigest()}
