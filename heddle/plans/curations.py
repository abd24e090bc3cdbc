"""Changes to snapshots of canonical records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.operators import curation, merging
from heddle.plans import canonical as C
from heddle.plans.catalogue import query
from heddle.plans.canonical import FACTS
from heddle.runtime import Scratch

AT = "2024-05-01T00:00:00Z"
def K() -> Column:
    """The part key in an item's id."""
    return F.substring("id", 2, 8).cast("long")


def snapshot(spark: SparkSession, sf_dir: str) -> curation.Snapshot:
    """The canonical snapshot, written once so that each frame is one scan."""
    scratch = Scratch(spark, "snapshot")
    makers = {"collections": C.collections, "items": C.items, "memberships": C.memberships, "relations": C.relations, "tombstones": C.tombstones}
    found = {name: scratch.table(make(spark, sf_dir), name) for name, make in makers.items()}
    found["collections"] = curation.recount(found["collections"], found["memberships"])
    return found


def _other_media(items: DataFrame, changed) -> DataFrame:
    return items.withColumn("media", F.when(changed, F.transform("media", lambda m: m.withField("sha256", F.lit("new")))).otherwise(F.col("media")))


def _reworded(items: DataFrame, changed) -> DataFrame:
    return items.withColumn("semantic_tags", F.when(changed, F.array(F.lit("reworded"))).otherwise(F.col("semantic_tags")))


@query(f"""WITH {FACTS}, x AS (SELECT *, k % 10 <> 9 AS incoming, k % 3 = 0 AS moved, k % 5 = 1 AS reworded, review = 'approved' OR k % 4 = 2 AS guarded FROM f),
o AS (SELECT *, CASE WHEN NOT incoming THEN 'kept' WHEN NOT moved AND guarded THEN 'protected' WHEN moved OR reworded THEN 'reset' ELSE 'merged' END AS outcome FROM x)
SELECT id, outcome, CASE WHEN outcome = 'reset' THEN 'unreviewed' ELSE review END AS review, reworded AND outcome NOT IN ('kept', 'protected') AS tagged_anew, moved AND incoming AS media_anew, '2023-01-01T00:00:00Z' AS first_seen FROM o
UNION ALL SELECT 'n' || substr(id, 2), 'added', review, false, false, '2024-05-01T00:00:00Z' FROM f WHERE k % 20 = 0""")
def merge_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source's items merged into those that are there: protected, reset, merged, kept or added."""
    existing = C.items(spark, sf_dir).withColumn("origin", F.when(K() % 4 == 2, "human").otherwise("ai"))
    later = existing.withColumn("availability", F.col("availability").withField("first_seen_at", F.lit(AT)))
    incoming = _reworded(_other_media(later.where(K() % 10 != 9), K() % 3 == 0), K() % 5 == 1)
    fresh = later.where(K() % 20 == 0).withColumn("id", F.concat(F.lit("n"), F.substring("id", 2, 8)))
    merged = curation.merge_items(existing, incoming.unionByName(fresh))
    return merged.select("id", "outcome", F.col("review.status").alias("review"), (F.col("semantic_tags")[0] == "reworded").alias("tagged_anew"), (F.col("media")[0]["sha256"] == "new").alias("media_anew"), F.col("availability.first_seen_at").alias("first_seen"))


@query(f"""WITH {FACTS} SELECT id, CASE WHEN s % 4 = 0 THEN 'renamed' ELSE title END AS title, '2023-01-01' AS first_seen, CASE WHEN s % 4 = 0 THEN '2024' ELSE '2023' END AS verified FROM c""")
def merge_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collections seen again: verified anew only where something changed."""
    seen = lambda first, last: F.struct(F.col("availability.status").alias("status"), F.lit(first).alias("first_seen_at"), F.lit(None).cast("string").alias("last_changed_at"), F.lit(last).alias("last_verified_at"), F.lit(None).cast("string").alias("reason_code"), F.lit(None).cast("string").alias("set_by"))
    rows = C.collections(spark, sf_dir)
    old = rows.withColumn("availability", seen("2023-01-01", "2023"))
    renamed = F.when(F.substring("id", 2, 6).cast("int") % 4 == 0, F.lit("renamed")).otherwise(F.col("title"))
    merged = curation.merge_collections(old, rows.withColumn("title", renamed).withColumn("availability", seen("2024-01-01", "2024")))
    return merged.select("id", "title", F.col("availability.first_seen_at").alias("first_seen"), F.col("availability.last_verified_at").alias("verified"))


@query(f"""WITH {FACTS}, z AS (SELECT id, CASE WHEN s % 5 = 0 THEN 'new' WHEN s % 5 = 1 THEN 'conflict' ELSE 'same' END AS continuity, s FROM c WHERE s IN (SELECT s FROM m))
SELECT id AS collection, continuity, CASE continuity WHEN 'new' THEN 1 WHEN 'same' THEN 3 ELSE 4 END AS identity_epoch FROM z""")
def collection_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a source's collection is the one that is known by its name, and the epoch to write it under."""
    links = C.memberships(spark, sf_dir).select(F.col("collection_id").alias("collection"), "item_id")
    s = F.substring("collection", 2, 6).cast("int")
    current = links.select("collection", F.when(s % 5 == 1, F.concat("item_id", F.lit("x"))).otherwise(F.col("item_id")).alias("native"))
    previous = links.where(s % 5 != 0).select("collection", F.col("item_id").alias("native"))
    found = curation.continuity(previous, current, "collection", "native")
    epochs = previous.select("collection").distinct().select("collection", F.explode(F.array(F.lit(1), F.lit(3), F.lit(2))).alias("identity_epoch"))
    chosen = [r[0] for r in found.where("continuity = 'conflict'").select("collection").collect()]
    return curation.identity_epochs(found, epochs, "collection", chosen)


@query("""
SELECT event_id, '{"a":{"x":' || event_id || ',"y":2},"b":[1],"c":"new"}' AS merged FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, '{"a":{"x":1},"c":"old"}' FROM events WHERE event_id % 2 = 1""")
def deep_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON objects merged at every level."""
    from heddle.runtime import read_table, ship_package

    ship_package(spark)
    k = F.col("event_id")
    new = F.when(k % 2 == 0, F.concat(F.lit('{"a":{"y":2,"x":'), k, F.lit('},"b":[1],"c":"new"}')))
    return read_table(spark, sf_dir, "events").select("event_id", curation.deep_merge(F.lit('{"c":"old","a":{"x":1}}'), new).alias("merged"))


@query(f"""WITH {FACTS}, gone AS (SELECT DISTINCT k FROM m WHERE s = 2 AND k NOT IN (SELECT k FROM m WHERE s <> 2))
SELECT 'collections' AS entity, 's000002' AS id, 'removed' AS change UNION ALL SELECT 'memberships', id, 'removed' FROM m WHERE s = 2 UNION ALL SELECT 'items', id, 'removed' FROM f WHERE k IN (SELECT k FROM gone)
UNION ALL SELECT 'relations', id, 'removed' FROM r WHERE k IN (SELECT k FROM gone) OR k + 1 IN (SELECT k FROM gone) UNION ALL SELECT 'tombstones', 's000002', 'added'""")
def withdraw_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything that changes when a collection is withdrawn; a second withdrawal would change nothing."""
    before = snapshot(spark, sf_dir)
    after, _ = curation.withdraw(before, "s000002", "rights", AT, expected=curation.snapshot_digest(before))
    return curation.affected(before, after)


@query(f"""WITH {FACTS}, hit AS (SELECT s, id FROM m WHERE k = 13)
SELECT 'items' AS entity, 'e00000013' AS id, 'removed' AS change UNION ALL SELECT 'memberships', id, 'removed' FROM hit UNION ALL SELECT 'relations', id, 'removed' FROM r WHERE k = 12
UNION ALL SELECT DISTINCT 'collections', c.id, 'changed' FROM m JOIN c ON c.s = m.s WHERE m.k = 13 AND m.active UNION ALL SELECT 'tombstones', 'e00000013', 'added'""")
def withdraw_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything that changes when an item is withdrawn: memberships, relations, counts."""
    before = snapshot(spark, sf_dir)
    after, _ = curation.withdraw(before, "e00000013", "request", AT)
    again, kind = curation.withdraw(after, "e00000013", "request", AT)
    assert kind == "noop" and again is after
    return curation.affected(before, after)


@query(f"""WITH {FACTS}, sel AS (SELECT DISTINCT k FROM m WHERE s IN (1, 3)), oth AS (SELECT DISTINCT k FROM m WHERE s NOT IN (1, 3)), ed AS (SELECT k FROM sel WHERE k NOT IN (SELECT k FROM oth))
SELECT 'collections' AS entity, id, 'changed' AS change FROM c WHERE s IN (1, 3) UNION ALL SELECT 'items', id, 'changed' FROM f WHERE k IN (SELECT k FROM ed) UNION ALL SELECT 'memberships', id, 'changed' FROM m WHERE s IN (1, 3)""")
def scoped_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of a candidate that changed everything reaches the base if only two collections are selected."""
    base = snapshot(spark, sf_dir)
    new = dict(base)
    new["collections"] = base["collections"].withColumn("title", F.lit("x"))
    new["items"] = base["items"].withColumn("native_id", F.concat("native_id", F.lit("x")))
    new["memberships"] = base["memberships"].withColumn("position", F.col("position") + 1)
    return curation.affected(base, curation.scoped(base, new, ["s000001", "s000003"]))


@query(f"""WITH {FACTS}, l AS (SELECT s, k, id, k AS position, active, k % 5 <> 2 AS there FROM m),
o AS (SELECT c.id, c.s, CASE WHEN c.gone THEN 'skipped' WHEN c.s % 4 = 0 AND EXISTS (SELECT 1 FROM m WHERE m.s = c.s AND (m.gone OR m.k % 29 = 0)) THEN 'skipped' WHEN c.s % 4 = 0 THEN 'added'
  WHEN EXISTS (SELECT 1 FROM l JOIN m USING (s, k) WHERE l.s = c.s AND NOT l.there AND NOT m.gone AND l.k % 29 <> 0) OR EXISTS (SELECT 1 FROM m WHERE m.s = c.s AND m.k % 2 = 0 AND m.k % 6 = 4 AND m.k % 29 <> 0) THEN 'extended' ELSE 'skipped' END AS outcome FROM c)
SELECT 'collection' AS what, id, outcome AS detail FROM o
UNION ALL SELECT 'membership', l.id, (CASE WHEN NOT l.active THEN l.position ELSE l.position + 100000 END)::VARCHAR FROM l JOIN m ON m.s = l.s AND m.k = l.k JOIN o ON o.s = l.s WHERE outcome <> 'skipped' AND (NOT l.there OR o.s % 4 = 0) AND NOT m.gone AND l.k % 29 <> 0
UNION ALL SELECT DISTINCT 'description', f.id, 'ru' FROM f JOIN m ON m.k = f.k JOIN o ON o.s = m.s WHERE outcome <> 'skipped' AND f.k % 2 = 0 AND f.k % 6 = 4 AND f.k % 29 <> 0""")
def additive_sync_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an additive sync would add: collections, memberships, and descriptions in languages that are missing."""
    candidate = snapshot(spark, sf_dir)
    s, p = F.substring_index("collection_id", "s", -1).cast("int"), F.col("position")
    candidate["memberships"] = candidate["memberships"].withColumn("position", F.when(F.col("status") == "active", p + 100_000).otherwise(p))
    latest = dict(candidate)
    latest["collections"] = candidate["collections"].where(F.substring("id", 2, 6).cast("int") % 4 != 0)
    own = F.substring_index("id", "-", -1).cast("int")
    latest["memberships"] = candidate["memberships"].where((own % 5 != 2) & (s % 4 != 0)).withColumn("position", own)
    latest["items"] = candidate["items"].withColumn("descriptions", F.when(K() % 6 == 4, F.map_filter("descriptions", lambda k, _: k != "ru")).otherwise(F.col("descriptions")))
    found = curation.add_missing(latest, candidate)
    packs = found["collections"].select(F.lit("collection").alias("what"), "id", F.col("outcome").alias("detail"))
    links = found["memberships"].select(F.lit("membership").alias("what"), "id", F.col("position").cast("string").alias("detail"))
    told = found["descriptions"].select(F.lit("description").alias("what"), F.col("item_id").alias("id"), F.col("language").alias("detail"))
    return packs.unionByName(links).unionByName(told)


@query(f"""WITH {FACTS}, t AS (SELECT s, k, id, 100 AS base FROM m WHERE k % 3 <> 0), n AS (SELECT s, k, id, CASE WHEN k % 2 = 0 THEN 100 ELSE 10 * k + 200 END AS position FROM m WHERE k % 3 = 0),
u AS (SELECT s, id, position, row_number() OVER (PARTITION BY s ORDER BY position, id) AS nth FROM n)
SELECT id, CASE WHEN position = 100 THEN 100 + nth ELSE position END AS position FROM u""")
def colliding_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members to add of which some ask for a taken position."""
    links = C.memberships(spark, sf_dir).withColumn("status", F.lit("active"))
    k = F.col("position")
    missing = links.where(k % 3 == 0).withColumn("position", F.when(k % 2 == 0, F.lit(100)).otherwise(10 * k + 200))
    taken = links.select("collection_id", F.lit(100).alias("position")).distinct()
    return curation.placed(missing, taken).select("id", "position")


@query(f"""WITH {FACTS}, x AS (SELECT *, CASE k % 5 WHEN 0 THEN 'inactive' WHEN 1 THEN 'active' END AS checked FROM f)
SELECT id, coalesce(checked, CASE WHEN active THEN 'active' ELSE 'inactive' END) AS status, CASE WHEN checked IS NOT NULL AND (checked = 'active') <> active THEN '{AT}' END AS changed, CASE WHEN checked IS NOT NULL THEN '{AT}' END AS verified FROM x""")
def refreshed_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Availability after a check of some native ids."""
    items = C.items(spark, sf_dir)
    checked = items.where(K() % 5 < 2).select("platform", "native_id", (K() % 5 == 1).alias("available"))
    found = curation.refresh_availability(items, checked, AT)
    return found.select("id", "availability.status", F.col("availability.last_changed_at").alias("changed"), F.col("availability.last_verified_at").alias("verified"))


@query(f"""WITH {FACTS} SELECT id, CASE WHEN k = 5 THEN 'rejected' ELSE review END AS review, k = 5 AS signed, CASE WHEN k = 7 THEN 'private' WHEN active THEN 'active' ELSE 'inactive' END AS availability, CASE WHEN k = 7 THEN 'reviewer' END AS set_by FROM f WHERE k < 12""")
def guarded_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One item reviewed and one made private by a reviewer."""
    items = C.items(spark, sf_dir).where(K() < 12)
    reviewed = curation.set_review(items, "e00000005", "reject", "reviewer", AT, "profile")
    hidden = F.when(F.col("id") == "e00000007", curation.set_availability(F.col("availability"), "private", AT, "rights", "reviewer")).otherwise(F.col("availability"))
    rows = reviewed.withColumn("availability", hidden)
    return rows.select("id", F.col("review.status").alias("review"), F.col("review.reviewed_content_sha256").isNotNull().alias("signed"), F.col("availability.status").alias("availability"), F.col("availability.set_by").alias("set_by"))


@query(f"""WITH {FACTS}, cur AS (SELECT s, k, id FROM m WHERE s = 4 AND k % 7 <> 3)
SELECT 'membership' AS what, id, CASE WHEN k % 7 = 3 AND active THEN 'vanished' WHEN k % 7 <> 3 AND NOT active THEN 'returned' ELSE 'unchanged' END AS change FROM m WHERE s = 4
UNION ALL SELECT 'collection', 's000004', (SELECT count(*) FROM cur)::VARCHAR""")
def planned_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What merging a source's view of one collection would do to its memberships, and the count it would leave."""
    old = C.memberships(spark, sf_dir).where("collection_id = 's000004'")
    current = old.where(F.col("position") % 7 != 3).withColumn("status", F.lit("active"))
    shape = lambda df, name: df.select("collection_id", "item_id", "position", F.col(name).alias("status"), F.col("last_changed_at").alias("changed_at"))
    merged = merging.upsert_members(shape(old, "status"), shape(current, "status"), ["collection_id", "item_id"], AT)
    was = old.select("collection_id", "item_id", "id", F.col("status").alias("was"))
    change = F.when((F.col("was") == "active") & (F.col("status") == "removed"), "vanished").when((F.col("was") != "active") & (F.col("status") == "active"), "returned").otherwise("unchanged")
    links = merged.join(was, ["collection_id", "item_id"]).select(F.lit("membership").alias("what"), "id", change.alias("change"))
    packs = curation.recount(C.collections(spark, sf_dir).where("id = 's000004'"), merged)
    return links.unionByName(packs.select(F.lit("collection").alias("what"), "id", F.col("item_count").cast("string").alias("change")))
