"""Policy: routing reasons, review priority, qualification matches, rights decisions, trust."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reasons(rules: dict[str, Column]) -> Column:
    """Names of the rules that hold, in the order given."""
    return F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))


def priority(reason_array: Column, ranks: dict[str, int]) -> Column:
    """Least rank of the reasons; null without any."""
    table = F.create_map(*[F.lit(x) for pair in ranks.items() for x in pair])
    return F.array_min(F.transform(reason_array, lambda r: table[r]))


def conflicting(df: DataFrame, signature: str, description: str) -> DataFrame:
    """Signatures of exact groups whose members are described differently, with the number of descriptions."""
    return df.where(F.col(signature).isNotNull()).groupBy(signature).agg(F.count_distinct(description).alias("descriptions"), F.count("*").alias("members")).where("descriptions > 1")


def qualification(subjects: DataFrame, registry: DataFrame, keys: list[str], instant: str, subject: str) -> DataFrame:
    """Null-safe match of key tuples with registry rows valid at the instant (half-open): unmatched, matched or ambiguous."""
    s, r = subjects.alias("s"), registry.alias("r")
    on = (F.col("r.valid_from") <= F.col(f"s.{instant}")) & (F.col("r.valid_until").isNull() | (F.col(f"s.{instant}") < F.col("r.valid_until")))
    for k in keys:
        on = on & F.col(f"s.{k}").eqNullSafe(F.col(f"r.{k}"))
    found = s.join(r, on, "left").groupBy(F.col(f"s.{subject}").alias(subject)).agg(F.count("r.qualification").alias("n"), F.min("r.qualification").alias("one"))
    status = F.when(F.col("n") == 0, "unmatched").when(F.col("n") == 1, "matched").otherwise("ambiguous")
    return found.select(subject, status.alias("status"), F.when(F.col("n") == 1, F.col("one")).alias("qualification"))


#: Decisions that restrict distribution, and the one that allows it.
RESTRICTING, ALLOWING = ("deny", "conditional", "not-granted"), "allow"


def rights_decision(profile_status: Column, effective_from: Column, effective_until: Column, at: Column, withdrawn: Column, decisions: list[Column]) -> Column:
    """Outside the profile's half-open interval ``unknown``; else ``withdrawn``; else ``restricted`` if any decision restricts,
    ``unknown`` if any is unclear or missing, and ``allowed`` if all allow. A profile that is not active fails the query."""
    valid = (effective_from <= at) & (effective_until.isNull() | (at < effective_until))
    of = F.array(*[F.coalesce(d, F.lit("unknown")) for d in decisions])
    decided = (
        F.when(~F.coalesce(valid, F.lit(False)), "unknown")
        .when(F.coalesce(withdrawn, F.lit(False)), "withdrawn")
        .when(F.exists(of, lambda d: d.isin(*RESTRICTING)), "restricted")
        .when(F.exists(of, lambda d: d != ALLOWING), "unknown")
        .otherwise("allowed")
    )
    return F.when(profile_status == "active", decided).otherwise(F.raise_error(F.lit("rights selector does not resolve to an active profile")).cast("string"))


def selected_profile(default: Column, inherits: Column, project_default: Column) -> Column:
    """A platform's rights profile: its own default or the project's, exactly one of which it must name."""
    own, other = default.isNotNull(), F.coalesce(inherits, F.lit(False))
    return F.when(own & ~other, default).when(~own & other, project_default).otherwise(F.raise_error(F.lit("a platform must choose exactly one rights default")).cast("string"))


def content_guard(rating: Column, warnings: Column, include_sensitive: bool, row_rights: Column, expected_rights: Column) -> Column:
    """What stands against showing a record: sensitive content without opt-in, or rights that differ from the effective ones;
    null if nothing does."""
    sensitive = F.lit(not include_sensitive) & ((rating != "general") | (F.size(warnings) > 0))
    return F.when(sensitive, "CONTENT_POLICY_BLOCKED").when(~row_rights.eqNullSafe(expected_rights), "RIGHTS_MISMATCH")


def safe_record(release_states: list[Column], availability: Column, rating: Column, warnings: Column, rights: Column, tombstoned: Column, review: Column, attested: Column, in_active_collection: Column) -> Column:
    """Whether a record may be shown to an agent: every release state verified and every condition of the record met."""
    out = F.lit(True)
    for state in release_states:
        out = out & (state == "verified")
    return out & (availability == "active") & (rating == "general") & (F.size(warnings) == 0) & (rights == "allowed") & ~tombstoned & (review == "approved") & attested & in_active_collection


def trust(review: Column, origin: Column) -> Column:
    """Trust of a record from its review state and the origin of its text."""
    return F.when(review == "approved", F.when(origin.isin("human", "mixed"), "human-approved").otherwise("approved")).when(review == "rejected", "rejected").when(origin == "human", "human-unreviewed").otherwise("machine-unreviewed")


def runtime_trust(review: Column, attested: Column, hash_profile: Column, origin: Column) -> Column:
    """What a reader without control data can say about a record: state of the attestation, of the hash profile, and of the
    model's qualification and the generation's attestation, which only machine text needs."""
    signed, waiting = F.coalesce(attested, F.lit(False)), F.coalesce(review, F.lit("unreviewed")) == "unreviewed"
    profiled = F.coalesce(hash_profile, F.lit("")) != ""
    attestation = F.when(signed, "unverified").when(waiting | profiled, "legacy-unattested").otherwise("legacy-unprofiled")
    profile = F.when(signed | (profiled & ~waiting), "valid").when(waiting, "not-applicable").otherwise("legacy-unprofiled")
    machine = F.when(origin == "ai", "missing").otherwise("not-applicable")
    return F.struct(
        F.lit("offline-unknown").alias("control_state"), attestation.alias("review_attestation"), profile.alias("review_hash_profile"),
        machine.alias("model_qualification"), machine.alias("generation_attestation"), F.lit(False).alias("safe_eligible"),
    )


def needs_description(current: Column, media_changed: Column, context_changed: Column, protected: Column, missing_language: Column, mode: str = "changed") -> Column:
    """Whether a description must be made again: new rows always; ``all`` forces unless protected; ``missing`` asks only for
    languages that are absent; else a change of media or context decides."""
    if mode == "all":
        return current.isNull() | ~protected
    if mode == "missing":
        return current.isNull() | missing_language
    return current.isNull() | (~protected & (media_changed | context_changed))


def deterministic_reasons(media_format: Column, samples: Column, energy_bp: Column, low_information: Column) -> Column:
    """Why a medium should go to a stronger model before it is described: complex motion, low visibility."""
    moving = media_format.isin("tgs", "webm") & (samples == 16) & (energy_bp > 0)
    return reasons({"complex-motion": F.coalesce(moving, F.lit(False)), "low-visibility": F.coalesce(low_information, F.lit(False))})


def semantic_reasons(text_status: Column, uncertainties: Column) -> Column:
    """Why a description should be made again: a brand or character, facets in doubt, text that was not read whole."""
    unsure = lambda name: F.coalesce(F.array_contains(uncertainties, name), F.lit(False))
    return reasons({"character-or-brand": unsure("character-or-brand"), "facet-conflict": unsure("content-type") | unsure("style"), "partial-text": F.coalesce(text_status.isin("partially-recognized", "unreadable"), F.lit(False))})


def should_escalate(mode: str, found: Column, model: str | None) -> Column:
    """Whether the reasons ask for the stronger model; a sensitive label alone no longer does. Rules need a model to go to."""
    if mode not in ("off", "rules"):
        raise ValueError("mode is off or rules")
    if mode == "off":
        return F.lit(False)
    if not model:
        raise ValueError("rules need a model to escalate to")
    return F.size(F.array_remove(found, "sensitive-content")) > 0


def routing_binding(config: dict) -> str:
    """The digest that a routing configuration is known by."""
    import hashlib
    import json

    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


#: Fixed value: most concepts of an item.
MOST_CONCEPTS = 16


def concept_selection(selected: Column, active: Column) -> Column:
    """What is wrong with a selection of concepts; null if it is sorted, distinct, not too long and all active."""
    return (
        F.when(F.size(selected) > MOST_CONCEPTS, "TOO_MANY").when(F.size(F.array_distinct(selected)) < F.size(selected), "REPEATED").when(F.array_sort(selected) != selected, "UNSORTED").when(F.size(F.array_except(selected, active)) > 0, "UNKNOWN")
    )


def official_choice(packs: DataFrame, official: DataFrame, key: str, mode: str, approved: list) -> DataFrame:
    """Packs with ``choice``: official ones are skipped, included, or asked about unless the caller approved them; others are
    included."""
    if mode not in ("skip", "ask", "include"):
        raise ValueError("mode is skip, ask or include")
    marked = packs.join(official.select(key).distinct().withColumn("__official", F.lit(True)), key, "left")
    known = F.coalesce("__official", F.lit(False))
    choice = F.when(~known | F.lit(mode == "include"), "include").when(F.lit(mode == "skip"), "skip").when(F.col(key).isin(approved or [None]), "include").otherwise("ask")
    return marked.withColumn("choice", choice).drop("__official")


def saved_run(runs: DataFrame, purpose: str) -> DataFrame:
    """One saved run per pack (pack, run_id, state, updated_at): the newest whose state suits the purpose, else for ``resume``
    the newest of all, with ``fallback``."""
    wanted = {"resume": ["paused", "running"], "publish": ["described", "published"]}
    if purpose not in wanted:
        raise ValueError(f"purpose is one of {sorted(wanted)}")
    suits = F.col("state").isin(wanted[purpose])
    rows = runs if purpose == "resume" else runs.where(suits)
    best = rows.groupBy("pack").agg(F.max(F.struct(F.when(suits, 1).otherwise(0).alias("fit"), "updated_at", "run_id", "state")).alias("b"))
    return best.select("pack", "b.run_id", "b.state", (F.col("b.fit") == 0).alias("fallback"))
