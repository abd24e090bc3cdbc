"""Search: filters, lexical scoring, inverted-index look-up, identity resolution, similar items."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.functions.columns import ascii_fold

#: Field weights and tier scores of the lexical profile.
WEIGHTS = {"text": 100, "motion": 60, "usage": 80, "concepts": 120, "tags": 90, "literal": 110}
EXACT_ID, NATIVE_ID, CONCEPT_ID = 1_000_000, 900_000, 800_000
TIER_EXACT, TIER_PHRASE = 400, 300
ALIAS_BONUS = 120
#: Rank of a group type for similar items.
GROUP_RANK = {"binary-exact": 10, "decoded-exact": 20}

SCALAR_FILTERS = ("platform", "availability", "rating", "rights", "review")
OVERLAP_FILTERS = ("media_kind", "color_behavior", "color_family", "content_type", "style", "suggested_use", "uncertainty", "concept")


def filter_column(filters: dict, columns: dict[str, Column]) -> Column:
    """The conjunction of a closed filter dictionary; an empty list is no constraint, an unknown key an error.

    A review status ``qualified-ai`` may be asked for and never matches, as rows hold literal states only.
    """
    known = {*SCALAR_FILTERS, *OVERLAP_FILTERS, "exclude_warning", "animated", "contains_text", "require_no_warnings"}
    if unknown := set(filters) - known:
        raise ValueError(f"unknown filters: {sorted(unknown)}")
    tests = [F.lit(True)]
    for name in SCALAR_FILTERS:
        if wanted := filters.get(name):
            tests.append(columns[name].isin([w for w in wanted if w != "qualified-ai"] or [""]))
    for name in OVERLAP_FILTERS:
        if wanted := filters.get(name):
            tests.append(F.arrays_overlap(columns[name], F.array(*[F.lit(w) for w in wanted])))
    if unwanted := filters.get("exclude_warning"):
        tests.append(~F.arrays_overlap(columns["warnings"], F.array(*[F.lit(w) for w in unwanted])))
    for name in ("animated", "contains_text"):
        if (state := filters.get(name, "any")) != "any":
            tests.append(columns[name] == F.lit(state == "yes"))
    if filters.get("require_no_warnings"):
        tests.append(F.size(columns["warnings"]) == 0)
    return reduce(lambda a, b: a & b, tests)


def tier(values: Column, query: str, fold=ascii_fold) -> Column:
    """Best tier of an array of texts: equal to the query, or holding it. (Prefix and token tiers can never be best: a
    token that begins with the query makes the value hold it.)"""
    scores = F.transform(values, lambda v: F.when(fold(v) == query, TIER_EXACT).when(F.contains(fold(v), F.lit(query)), TIER_PHRASE).otherwise(0))
    return F.coalesce(F.array_max(scores), F.lit(0))


def lexical_score(query: str, fields: dict[str, Column], item_id: Column | None = None, native_ids: Column | None = None, concept_ids: Column | None = None, aliases: Column | None = None, weights: dict[str, int] | None = None) -> Column:
    """Identity matches outrank all; else the weighted sum of each field's best tier, and a bonus for an equal alias."""
    weights = weights or WEIGHTS
    total = sum((F.lit(weights[name]) * tier(values, query) for name, values in fields.items()), F.lit(0))
    if aliases is not None:
        total = total + F.when(F.exists(aliases, lambda a: ascii_fold(a) == query), weights["concepts"] * ALIAS_BONUS).otherwise(0)
    out = F.when(F.lit(False), 0)
    if item_id is not None:
        out = out.when(ascii_fold(item_id) == query, EXACT_ID)
    if native_ids is not None:
        out = out.when(F.exists(native_ids, lambda x: ascii_fold(x) == query), NATIVE_ID)
    if concept_ids is not None:
        out = out.when(F.exists(concept_ids, lambda x: ascii_fold(x) == query), CONCEPT_ID)
    return out.otherwise(total)


def inverted_index(df: DataFrame, key: str, words: Column) -> DataFrame:
    """(token, key, n) of every token of every row."""
    return df.select(key, F.explode(words).alias("token")).groupBy("token", key).agg(F.count("*").alias("n"))


def lookup_prefixes(index: DataFrame, key: str, terms: list[str]) -> DataFrame:
    """Rows in which every term is the prefix of a token; the score is the number of distinct tokens hit, over all terms."""
    if not 1 <= len(terms) <= 32:
        raise ValueError("1 to 32 terms")
    hits = [F.count_if(F.startswith(F.col("token"), F.lit(t))) for t in terms]
    wanted = reduce(lambda a, b: a | b, [F.startswith(F.col("token"), F.lit(t)) for t in terms])
    scored = index.where(wanted).groupBy(key).agg(*[h.alias(f"h{k}") for k, h in enumerate(hits)])
    names = [F.col(f"h{k}") for k in range(len(terms))]
    return scored.where(reduce(lambda a, b: a & b, [n > 0 for n in names])).select(key, sum(names, F.lit(0)).cast("long").alias("score"))


def bm25(index: DataFrame, key: str, terms: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Okapi BM25 over an inverted index, for rank-only use."""
    lengths = index.groupBy(key).agg(F.sum("n").alias("length"))
    docs, mean = lengths.agg(F.count("*"), F.avg("length")).first()
    hits = index.where(F.col("token").isin(terms))
    df_counts = hits.groupBy("token").agg(F.count("*").alias("df"))  # at most one row per term
    joined = hits.join(F.broadcast(df_counts), "token").join(lengths, key)
    idf = F.log(1 + (F.lit(docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.col("n") * (k1 + 1) / (F.col("n") + k1 * (1 - b + b * F.col("length") / F.lit(mean or 1.0)))
    return joined.groupBy(key).agg(F.sum(idf * weight).alias("score"))


def resolve(references: DataFrame, identity: list[str], target: str, as_of: Column | None = None, epoch: Column | None = None) -> DataFrame:
    """Per identity the visible targets' status: ``not_found``, ``ambiguous``, ``current`` or ``former``.

    References hold ``identity_epoch``, ``observed_from``, ``observed_until`` (half-open, null is open) and ``status``.
    """
    seen = F.lit(True)
    if as_of is not None:
        seen = seen & (F.col("observed_from") <= as_of) & (F.col("observed_until").isNull() | (as_of < F.col("observed_until")))
    if epoch is not None:
        seen = seen & (F.col("identity_epoch") == epoch)
    found = references.groupBy(*identity).agg(
        F.count_if(seen).alias("visible"), F.min(F.when(seen, F.struct(F.col(target).alias("t"), F.col("status").alias("s")))).alias("one")
    )
    status = F.when(F.col("visible") == 0, "not_found").when(F.col("visible") > 1, "ambiguous").when(F.col("one.s") == "active", "current").otherwise("former")
    return found.select(*identity, status.alias("resolution"), F.when(F.col("visible") == 1, F.col("one.t")).alias(target))


def similar(members: DataFrame, item: str, start, ranks: dict[str, int] | None = None) -> DataFrame:
    """Items that share an exact group with ``start``, with the best (least) rank and its evidence.

    ``members`` has group_id, group_type and the item; only the groups of one item are joined.
    """
    ranks = ranks or GROUP_RANK
    mine = members.where(F.col(item) == F.lit(start)).select("group_id").distinct()
    order = F.coalesce(*[F.when(F.col("group_type") == name, rank) for name, rank in ranks.items()])
    others = members.join(mine, "group_id", "left_semi").where(F.col(item) != F.lit(start)).withColumn("rank", order).where(F.col("rank").isNotNull())
    best = F.min(F.struct("rank", "group_id")).alias("b")
    return others.groupBy(item).agg(best).select(item, F.col("b.rank").alias("rank"), F.col("b.group_id").alias("evidence"))
