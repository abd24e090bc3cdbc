"""Changes to a snapshot of canonical records: merging sources, scoped and additive changes, availability, withdrawal.

A snapshot is a dictionary of frames: collections, items, memberships, relations, tombstones. Nothing is changed in place; every
operator gives new frames, and ``affected`` lists what differs between two snapshots.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heddle.operators.grouping import tree_depth, tree_root
from heddle.operators.merging import diff

Snapshot = dict[str, DataFrame]
ENTITIES = ("collections", "items", "memberships", "relations")
#: What a person's review or authorship protects on an item whose media stayed the same.
SEMANTIC = ("descriptions", "facets", "concept_ids", "concept_mapping_status", "semantic_tags", "content", "review")
#: States that need a reason and a reviewer, and those that carry no reason.
GUARDED, PLAIN = ("private", "deleted"), ("active", "unknown")


def media_digest(media: Column) -> Column:
    return F.sha2(F.to_json(F.array_sort(media)), 256)


def _merged(old, new):
    if isinstance(old, dict) and isinstance(new, dict):
        return {k: _merged(old[k], new[k]) if k in old and k in new else new.get(k, old.get(k)) for k in {**old, **new}}
    return new


@F.arrow_udf(T.StringType())
def deep_merge(old: pa.Array, new: pa.Array) -> pa.Array:
    """JSON objects merged at every level, the new side winning; null is an empty object."""
    pairs = zip(old.to_pylist(), new.to_pylist())
    return pa.array([json.dumps(_merged(json.loads(a or "{}"), json.loads(b or "{}")), sort_keys=True, separators=(",", ":"), ensure_ascii=False) for a, b in pairs], pa.string())


def continuity(previous: DataFrame, current: DataFrame, key: str, native: str) -> DataFrame:
    """(key, continuity) of every collection that a source now gives: ``new`` without former members, ``same`` if any native id
    is in both, else ``conflict``."""
    was = previous.select(key, native).distinct().withColumn("__was", F.lit(True))
    joined = current.select(key, native).distinct().join(was, [key, native], "left").groupBy(key).agg(F.bool_or("__was").alias("common"))
    any_before = previous.select(key).distinct().withColumn("__before", F.lit(True))
    state = F.when(F.col("__before").isNull(), "new").when(F.coalesce("common", F.lit(False)), "same").otherwise("conflict")
    return joined.join(any_before, key, "left").select(key, state.alias("continuity"))


def identity_epochs(found: DataFrame, epochs: DataFrame, key: str, chosen_new: list) -> DataFrame:
    """(key, identity_epoch): the epoch to write under. The same identity keeps its greatest epoch, a new one begins with 1, and a
    conflict fails unless the caller chose to begin the next epoch for it."""
    top = epochs.groupBy(key).agg(F.max("identity_epoch").alias("top"))
    rows = found.join(top, key, "left")
    conflict = F.when(F.col(key).isin(chosen_new), F.col("top") + 1).otherwise(F.raise_error(F.concat(F.lit("identity conflict: "), F.col(key).cast("string"))).cast("int"))
    epoch = F.when(F.col("continuity") == "new", F.lit(1)).when(F.col("continuity") == "same", F.col("top")).otherwise(conflict)
    return rows.select(key, "continuity", epoch.alias("identity_epoch"))


def merge_items(existing: DataFrame, incoming: DataFrame, overwrite_reviewed: bool = False) -> DataFrame:
    """Items of both sides with ``outcome``. The first sighting stays. On an item whose media stayed and that a person approved
    or wrote (``origin`` human or mixed) all semantic columns stay (``protected``); else the incoming ones count, and the review
    starts anew if media or semantic content changed (``reset``). Items of one side are ``kept`` or ``added``."""
    columns = existing.columns
    e, i = existing.alias("e"), incoming.alias("i")
    joined = e.join(i, F.col("e.id") == F.col("i.id"), "full_outer")
    old, new = F.col("e.id").isNotNull(), F.col("i.id").isNotNull()
    same_media = media_digest(F.col("e.media")) == media_digest(F.col("i.media"))
    written = F.coalesce(F.col("e.origin").isin("human", "mixed"), F.lit(False)) if "origin" in columns else F.lit(False)
    protected = old & new & same_media & (F.coalesce(F.col("e.review.status") == "approved", F.lit(False)) | written) & F.lit(not overwrite_reviewed)
    payload = lambda side: F.to_json(F.struct(*[F.col(f"{side}.{c}").alias(c) for c in SEMANTIC if c != "review" and c in columns]))
    reset = old & new & ~protected & (~same_media | (payload("e") != payload("i")))
    review = existing.schema["review"].dataType
    unreviewed = F.struct(*[(F.lit("unreviewed") if f.name == "status" else F.lit(None).cast(f.dataType)).alias(f.name) for f in review.fields])

    def column(name: str) -> Column:
        mine, theirs = F.col(f"e.{name}"), F.col(f"i.{name}")
        merged = theirs
        if name == "availability":
            merged = theirs.withField("first_seen_at", mine["first_seen_at"])
        elif name == "review":
            merged = F.when(reset, unreviewed).otherwise(F.when(protected, mine).otherwise(theirs))
        elif name in SEMANTIC or name == "origin":
            merged = F.when(protected, mine).otherwise(theirs)
        return F.when(old & new, merged).when(old, mine).otherwise(theirs).alias(name)

    outcome = F.when(~new, "kept").when(~old, "added").when(protected, "protected").when(reset, "reset").otherwise("merged")
    return joined.select(*[column(c) for c in columns], outcome.alias("outcome"))


def merge_collections(existing: DataFrame, incoming: DataFrame, explicit: bool = False) -> DataFrame:
    """Collections of both sides; the first sighting stays, and the last verification too where nothing else changed, unless
    the caller verified on purpose."""
    columns = existing.columns
    joined = existing.alias("e").join(incoming.alias("i"), F.col("e.id") == F.col("i.id"), "full_outer")
    old, new = F.col("e.id").isNotNull(), F.col("i.id").isNotNull()
    plain = [c for c in columns if c != "availability"]
    whole = lambda side: F.to_json(F.struct(*[F.col(f"{side}.{c}") for c in plain], F.col(f"{side}.availability").dropFields("first_seen_at", "last_verified_at").alias("a")))
    unchanged = whole("e") == whole("i")
    verified = F.when(unchanged & F.lit(not explicit), F.col("e.availability.last_verified_at")).otherwise(F.col("i.availability.last_verified_at"))
    availability = F.col("i.availability").withField("first_seen_at", F.col("e.availability.first_seen_at")).withField("last_verified_at", verified)
    pick = lambda c: F.when(old & new, availability if c == "availability" else F.col(f"i.{c}")).when(old, F.col(f"e.{c}")).otherwise(F.col(f"i.{c}")).alias(c)
    return joined.select(*[pick(c) for c in columns])


def recount(collections: DataFrame, memberships: DataFrame) -> DataFrame:
    """Collections with ``item_count``, the number of their active memberships."""
    counts = memberships.where("status = 'active'").groupBy(F.col("collection_id").alias("id")).agg(F.count("*").cast("int").alias("__n"))
    joined = collections.join(counts, "id", "left").withColumn("item_count", F.coalesce("__n", F.lit(0)))
    return joined.select(*collections.columns)


def affected(before: Snapshot, after: Snapshot) -> DataFrame:
    """(entity, id, change) of everything that differs."""
    out = None
    for name in (*ENTITIES, "tombstones"):
        key = "target_id" if name == "tombstones" else "id"
        rows = diff(before[name], after[name], key, before[name].columns).select(F.lit(name).alias("entity"), F.col(key).alias("id"), "change")
        out = rows if out is None else out.unionByName(rows)
    return out


def snapshot_digest(snapshot: Snapshot) -> str:
    """A digest of all records; two snapshots with the same records have the same one, however they are stored."""
    import hashlib

    parts = []
    for name in (*ENTITIES, "tombstones"):
        df = snapshot[name]
        n = df.count()
        row = tree_root(df, ["target_id" if name == "tombstones" else "id"], F.to_json(F.struct(*sorted(df.columns))), tree_depth(n)).first()
        parts.append(f"{name}:{n}:{row['root'] if row else ''}")
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()


class ChangedError(ValueError):
    """The snapshot is not the one that was looked at."""


def withdraw(snapshot: Snapshot, target: str, reason: str, at: str, expected: str | None = None) -> tuple[Snapshot, str]:
    """(new snapshot, kind of target). An item goes with its memberships and relations; a collection with its memberships and
    the items that no other membership, removed ones included, refers to; a membership alone. Counts are made anew, and a
    tombstone stays. A target that is withdrawn already changes nothing (``noop``); an unknown one is an error, as is a snapshot
    whose digest is not the expected one."""
    if expected is not None and snapshot_digest(snapshot) != expected:
        raise ChangedError("the snapshot changed since it was previewed")
    done = snapshot["tombstones"].where(F.col("target_id") == target)
    if not done.isEmpty():
        return snapshot, "noop"
    kind = next((name for name in ("items", "collections", "memberships") if not snapshot[name].where(F.col("id") == target).isEmpty()), None)
    if kind is None:
        raise KeyError(target)
    after = dict(snapshot)
    links = snapshot["memberships"]
    gone = snapshot["items"].select("id").limit(0)
    if kind == "items":
        gone = snapshot["items"].where(F.col("id") == target).select("id")
        after["memberships"] = links.where(F.col("item_id") != target)
    elif kind == "collections":
        after["collections"] = snapshot["collections"].where(F.col("id") != target)
        after["memberships"] = links.where(F.col("collection_id") != target)
        hit = links.where(F.col("collection_id") == target).select(F.col("item_id").alias("id")).distinct()
        gone = hit.join(after["memberships"].select(F.col("item_id").alias("id")).distinct(), "id", "left_anti")
    else:
        after["memberships"] = links.where(F.col("id") != target)
    after["items"] = snapshot["items"].join(gone, "id", "left_anti")
    for end in ("subject_id", "object_id"):
        after["relations"] = after["relations"].join(gone.select(F.col("id").alias(end)), end, "left_anti").select(*snapshot["relations"].columns)
    after["collections"] = recount(after["collections"], after["memberships"])
    stone = {"target_entity_type": kind.rstrip("s"), "target_id": target, "reason_code": reason, "withheld_at": at}
    schema = snapshot["tombstones"].schema
    after["tombstones"] = snapshot["tombstones"].unionByName(links.sparkSession.createDataFrame([tuple(stone.get(f.name) for f in schema.fields)], schema))
    return after, kind.rstrip("s")


def scoped(base: Snapshot, candidate: Snapshot, collections: list[str]) -> Snapshot:
    """The base with only the candidate's changes to some collections: they and their memberships come from the candidate, and
    their items too unless a collection that was not selected has them and the base knows them; relations only between
    items of the result of which one at least is editable."""
    if candidate["collections"].where(F.col("id").isin(collections)).isEmpty():
        raise KeyError("the candidate has none of the selected collections")
    chosen = F.col("collection_id").isin(collections)
    picked = candidate["memberships"].where(chosen)
    theirs = base["memberships"].where(~chosen).select("item_id").unionByName(candidate["memberships"].where(~chosen).select("item_id")).distinct()
    shared = theirs.join(base["items"].select(F.col("id").alias("item_id")), "item_id", "left_semi")
    editable = picked.select("item_id").distinct().join(shared, "item_id", "left_anti").select(F.col("item_id").alias("id"))
    items = base["items"].join(editable, "id", "left_anti").unionByName(candidate["items"].join(editable, "id", "left_semi"))
    present, mine = items.select("id"), editable.withColumn("__mine", F.lit(True))

    def ends(relations: DataFrame) -> DataFrame:
        for end in ("subject_id", "object_id"):
            relations = relations.join(mine.select(F.col("id").alias(end), F.col("__mine").alias(f"__{end}")), end, "left")
        one, other = F.coalesce("__subject_id", F.lit(False)), F.coalesce("__object_id", F.lit(False))
        return relations.withColumns({"__any": one | other, "__both": one & other})

    here = candidate["relations"]
    for end in ("subject_id", "object_id"):
        here = here.join(present.select(F.col("id").alias(end)), end, "left_semi")
    old = base["relations"].select("id", F.lit(True).alias("__old"))
    taken = ends(here).join(old, "id", "left").where(F.col("__any") & (F.col("__old").isNull() | F.col("__both"))).select(*base["relations"].columns)
    dropped = ends(base["relations"]).where("__both").select("id").join(candidate["relations"].select("id"), "id", "left_anti")
    kept = base["relations"].join(taken.select("id"), "id", "left_anti").join(dropped, "id", "left_anti")
    of = F.col("id").isin(collections)
    return {
        "collections": base["collections"].where(~of).unionByName(candidate["collections"].where(of)),
        "items": items,
        "memberships": base["memberships"].where(~chosen).unionByName(picked),
        "relations": kept.unionByName(taken),
        "tombstones": base["tombstones"],
    }


def add_missing(latest: Snapshot, candidate: Snapshot) -> dict[str, DataFrame]:
    """What an additive sync would add, never overwriting or bringing back: ``collections`` (id, outcome ``added``, ``extended`` or
    ``skipped``), ``memberships`` to add with free positions, and ``descriptions`` (item_id, language) that the latest items lack
    and may take because their media are the same.

    A withdrawn collection is skipped, and so is a new one that refers to anything withdrawn.
    """
    gone = latest["tombstones"].select(F.col("target_id").alias("id")).distinct()
    have = latest["collections"].select("id", F.lit(True).alias("__have"))
    links = candidate["memberships"].join(latest["memberships"].select("id", F.lit(True).alias("__there")), "id", "left")
    stones = gone.withColumn("__gone", F.lit(True))
    links = links.join(stones, "id", "left").join(stones.select(F.col("id").alias("item_id"), F.col("__gone").alias("__item_gone")), "item_id", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    links = links.withColumn("__lost", yes("__gone") | yes("__item_gone")).withColumn("__missing", ~yes("__there") & ~F.col("__lost"))
    told = lambda df, name: df.select("id", media_digest(F.col("media")).alias(f"__{name}_media"), F.explode(F.map_keys("descriptions")).alias("language"))
    known = latest["items"].join(gone, "id", "left_anti").select("id", media_digest(F.col("media")).alias("__media"))
    lacking = told(candidate["items"], "new").join(known, "id").where(F.col("__media") == F.col("__new_media")).select("id", "language").join(told(latest["items"], "old").select("id", "language"), ["id", "language"], "left_anti")
    per = links.groupBy(F.col("collection_id").alias("id")).agg(F.bool_or("__missing").alias("some"), F.bool_or("__lost").alias("lost"))
    described = links.select(F.col("collection_id").alias("cid"), "item_id").join(lacking.select(F.col("id").alias("item_id")).distinct(), "item_id", "left_semi").select(F.col("cid").alias("id")).distinct().withColumn("__told", F.lit(True))
    rows = candidate["collections"].select("id").join(have, "id", "left").join(stones, "id", "left").join(per, "id", "left").join(described, "id", "left")
    new = F.col("__have").isNull()
    outcome = F.when(yes("__gone"), "skipped").when(~new & ~yes("some") & ~yes("__told"), "skipped").when(new & yes("lost"), "skipped").when(new, "added").otherwise("extended")
    decided = rows.select("id", outcome.alias("outcome"))
    open_ = decided.where("outcome <> 'skipped'").select(F.col("id").alias("collection_id"))
    missing = links.where("__missing").join(open_, "collection_id", "left_semi").select(*candidate["memberships"].columns)
    taken = latest["memberships"].where("status = 'active'").join(open_, "collection_id", "left_semi").select("collection_id", F.col("position"))
    fill = links.select("collection_id", F.col("item_id").alias("id")).join(open_, "collection_id", "left_semi").select("id").distinct()
    return {"collections": decided, "memberships": placed(missing, taken), "descriptions": lacking.join(fill, "id", "left_semi").select(F.col("id").alias("item_id"), "language")}


def placed(missing: DataFrame, taken: DataFrame) -> DataFrame:
    """Memberships to add with positions: in order of position and id, one whose position is taken goes behind the last. Where a
    member lands depends on all before it, so the members of one collection are placed one after another, in one task."""
    columns = missing.columns
    schema = missing.schema

    def run(key: tuple, new: pa.Table, old: pa.Table) -> pa.Table:
        occupied = set(old.column("position").to_pylist())
        rows = sorted(new.to_pylist(), key=lambda r: (r["position"], r["id"]))
        last = max(occupied, default=-1)
        for row in rows:
            if row["status"] == "active":
                if row["position"] in occupied:
                    row["position"] = last + 1
                occupied.add(row["position"])
                last = max(last, row["position"])
        return pa.Table.from_pylist(rows, schema=new.schema)

    there = taken.select(F.col("collection_id").alias("__in"), F.col("position").alias("position"))
    return missing.groupBy("collection_id").cogroup(there.groupBy("__in")).applyInArrow(run, schema).select(*columns)


def set_availability(old: Column, status: str, at: str, reason: str | None = None, reviewer: str | None = None) -> Column:
    """An availability struct in a new state: the change is dated only if the state differs, a verification unless the state is
    unknown; only guarded states name a reviewer, and they need a reason too."""
    if status in GUARDED and not (reason and reviewer):
        raise ValueError(f"{status} needs a reason and a reviewer")
    changed = F.when(old["status"] == status, old["last_changed_at"]).otherwise(F.lit(at))
    out = old.withField("status", F.lit(status)).withField("last_changed_at", changed).withField("last_verified_at", F.lit(None if status == "unknown" else at).cast("string"))
    out = out.withField("reason_code", F.lit(None if status in PLAIN else reason).cast("string"))
    return out.withField("set_by", F.lit(reviewer if status in GUARDED else None).cast("string"))


#: What a reviewer can do, and the state it leads to.
REVIEW_ACTIONS = {"approve": "approved", "request-changes": "changes_requested", "reject": "rejected"}


def set_review(items: DataFrame, target: str, action: str, reviewer: str, at: str, profile: str) -> DataFrame:
    """Items with one of them reviewed: state, time, reviewer, digest of what was reviewed."""
    if action not in REVIEW_ACTIONS:
        raise ValueError(f"one of {sorted(REVIEW_ACTIONS)}")
    content = F.sha2(F.to_json(F.struct(*[c for c in SEMANTIC if c != "review"], "media")), 256)
    made = F.struct(F.lit(REVIEW_ACTIONS[action]).alias("status"), F.lit(at).alias("reviewed_at"), F.lit(reviewer).alias("reviewer"), content.alias("reviewed_content_sha256"), F.lit(profile).alias("review_hash_profile_id"))
    return items.withColumn("review", F.when(F.col("id") == target, made).otherwise(F.col("review")))


def refresh_availability(items: DataFrame, checked: DataFrame, at: str) -> DataFrame:
    """Items with the availability that a check of native ids found (platform, native_id, available); others stay."""
    joined = items.join(checked.select("platform", "native_id", "available"), ["platform", "native_id"], "left")
    old = F.col("availability")
    state = F.when(F.col("available"), set_availability(old, "active", at)).when(~F.col("available"), set_availability(old, "inactive", at)).otherwise(old)
    return joined.withColumn("availability", state).select(*items.columns)
