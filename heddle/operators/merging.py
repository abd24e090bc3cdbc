"""Merge operators: membership upsert, three-way merge, additive sync, snapshot diff, takedown cascade, dry-run counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _same(columns: list[str], left: str, right: str) -> Column:
    out = F.lit(True)
    for name in columns:
        out = out & F.col(f"{left}.{name}").eqNullSafe(F.col(f"{right}.{name}"))
    return out


def upsert_members(old: DataFrame, current: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Members of both: new ones start now, vanished ones stay as removed, unchanged ones keep their last change.

    Both sides have ``keys``, ``position``, ``status`` and ``changed_at``; ``at`` is the time of the merge.
    """
    o, c = old.alias("o"), current.withColumn("__here", F.lit(True)).alias("c")
    on = F.lit(True)
    for k in keys:
        on = on & (F.col(f"o.{k}") == F.col(f"c.{k}"))
    joined = o.join(c, on, "full_outer")
    gone = F.col("c.__here").isNull()
    kept = ~gone & (F.col("o.status") == "active") & F.col("o.position").eqNullSafe(F.col("c.position"))
    still_gone = gone & (F.col("o.status") == "removed")
    return joined.select(
        *[F.coalesce(F.col(f"c.{k}"), F.col(f"o.{k}")).alias(k) for k in keys],
        F.coalesce("c.position", "o.position").alias("position"),
        F.when(gone, "removed").otherwise("active").alias("status"),
        F.when(kept | still_gone, F.col("o.changed_at")).otherwise(F.lit(at)).alias("changed_at"),
    )


def three_way(base: DataFrame, candidate: DataFrame, latest: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Per key whether the candidate's or the latest state holds: only one side changed, both changed alike, or a conflict."""
    b, c, v = (df.select(key, *columns).withColumn("__here", F.lit(True)) for df in (base, candidate, latest))
    joined = b.alias("b").join(c.alias("c"), key, "full_outer").join(v.alias("v"), key, "full_outer")
    names = [*columns, "__here"]
    mine, theirs, alike = _same(names, "b", "c"), _same(names, "b", "v"), _same(names, "c", "v")
    state = F.when(mine, "latest").when(theirs, "candidate").when(alike, "both").otherwise("conflict")
    own = (state == "candidate")
    gone = F.when(own, F.col("c.__here").isNull()).otherwise(F.col("v.__here").isNull())
    return joined.select(key, state.alias("resolution"), gone.alias("deleted"), *[F.when(own, F.col(f"c.{x}")).otherwise(F.col(f"v.{x}")).alias(x) for x in columns])


def additive_sync(base: DataFrame, candidate: DataFrame, key: str, columns: list[str], tombstones: DataFrame | None = None) -> DataFrame:
    """Base rows as they are, their nulls filled from the candidate, and the candidate's new rows that were never withdrawn."""
    b, c = base.withColumn("__base", F.lit(True)).alias("b"), candidate.alias("c")
    joined = b.join(c, F.col(f"b.{key}") == F.col(f"c.{key}"), "full_outer")
    out = joined.select(F.coalesce(f"b.{key}", f"c.{key}").alias(key), *[F.coalesce(f"b.{x}", f"c.{x}").alias(x) for x in columns], F.when(F.col("b.__base"), "kept").otherwise("added").alias("origin"))
    if tombstones is not None:
        out = out.join(tombstones.select(key).withColumn("__gone", F.lit(True)), key, "left").where(F.col("__gone").isNull() | (F.col("origin") == "kept")).drop("__gone")
    return out


def diff(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, change) of rows that were added, removed or changed, by digest of the row's columns."""
    digest = F.sha2(F.to_json(F.struct(*sorted(columns))), 256)
    b, a = before.select(key, digest.alias("b")), after.select(key, digest.alias("a"))
    joined = b.join(a, key, "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))
    return joined.select(key, F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").otherwise("changed").alias("change"))


def takedown(collections: DataFrame, memberships: DataFrame, items: DataFrame, targets: DataFrame, collection: str, item: str) -> dict[str, DataFrame]:
    """Withdraws collections: their memberships go, items that no other collection refers to go, counts are made anew."""
    left = collections.join(targets.select(collection), collection, "left_anti")
    kept = memberships.join(targets.select(collection), collection, "left_anti")
    hit = memberships.join(targets.select(collection), collection, "left_semi").select(item).distinct()
    orphans = hit.join(kept.select(item).distinct(), item, "left_anti")
    counts = kept.groupBy(collection).agg(F.count("*").alias("item_count"))
    return {
        "collections": left.join(counts, collection, "left").withColumn("item_count", F.coalesce("item_count", F.lit(0))),
        "memberships": kept,
        "items": items.join(orphans, item, "left_anti"),
        "tombstones": targets.select(F.lit("collection").alias("kind"), F.col(collection).cast("string").alias("target_id")).unionByName(
            orphans.select(F.lit("item").alias("kind"), F.col(item).cast("string").alias("target_id"))
        ),
    }


def preview(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row of dry-run counters: added, updated, unchanged, disappeared."""
    o, n = (df.select(key, *columns).withColumn("__here", F.lit(True)) for df in (old, new))
    joined = o.alias("o").join(n.alias("n"), key, "full_outer")
    was, now, same = F.col("o.__here").isNotNull(), F.col("n.__here").isNotNull(), _same(columns, "o", "n")
    tests = {"added": ~was & now, "updated": was & now & ~same, "unchanged": was & now & same, "disappeared": was & ~now}
    return joined.agg(*[F.count_if(test).alias(name) for name, test in tests.items()])
