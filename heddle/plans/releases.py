"""What a release derives from canonical records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.operators import policy, records, release, search
from heddle.plans import canonical as C
from heddle.plans.catalogue import query
from heddle.plans.canonical import FACTS
from heddle.runtime import Scratch, read_table

NAMESPACE = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"


def uuid5_sql(*parts: str) -> str:
    """A name-based UUID of SQL expressions."""
    h = f"sha1(unhex('{NAMESPACE.replace('-', '')}') || encode({' || chr(0) || '.join(parts)}))"
    variant = f"substr('89ab', (strpos('0123456789abcdef', substr({h}, 17, 1)) - 1) % 4 + 1, 1)"
    return f"substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || {variant} || substr({h}, 18, 3) || '-' || substr({h}, 21, 12)"


REFS = f"""{FACTS},
refs AS (
  SELECT k, id, profile, gone, 'primary' AS role, '' AS variant, sha256('m' || (k // 2)) AS media, (k // 2) % 50 + 100 AS size, sha256('x' || (k // 3)) AS decoded, sha256('c' || (k // 5)) AS canonical, sha256('s' || (k // 4)) AS shape FROM f WHERE active AND complete
  UNION ALL SELECT k, id, profile, gone, 'variant', 'dark', sha256('v' || k), 77, sha256('y' || k), sha256('z' || k), sha256('w' || k) FROM f WHERE active AND complete AND k % 5 = 0)"""


@query(f"""WITH {REFS}
SELECT id AS item_id, profile, role, CASE WHEN variant <> '' THEN variant END AS variant_id, media AS media_sha256, size::INTEGER AS byte_size, role = 'primary' AND k % 4 = 1 AS animated,
  CASE WHEN role = 'primary' AND k % 4 = 1 THEN (1000 + k % 5 * 100)::INTEGER END AS duration_ms, decoded AS decoded_sha256, k % 31 = 0 AS low_information FROM refs""")
def fingerprint_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each fingerprint of an active item, with its media."""
    refs = records.references(C.items(spark, sf_dir))
    return refs.select("item_id", "profile", "role", "variant_id", "media_sha256", "byte_size", "animated", "duration_ms", "decoded_sha256", "perceptual.low_information")


GROUPS = f"""{REFS},
live AS (SELECT * FROM refs WHERE NOT gone),
whole AS (SELECT id, sha256(string_agg(role || '|' || variant || '|' || media || '|' || size, chr(10) ORDER BY role || '|' || variant || '|' || media || '|' || size)) AS b,
  sha256(string_agg(role || '|' || variant || '|' || profile || '|' || decoded, chr(10) ORDER BY role || '|' || variant || '|' || profile || '|' || decoded)) AS d FROM live GROUP BY 1),
keyed AS (SELECT DISTINCT 'binary-exact' AS group_type, 'media' AS scope, media || '|' || size AS group_key, id AS item_id FROM live
  UNION ALL SELECT DISTINCT 'decoded-exact', 'media', profile || '|' || decoded, id FROM live
  UNION ALL SELECT 'binary-exact', 'entity', b, id FROM whole UNION ALL SELECT 'decoded-exact', 'entity', d, id FROM whole),
exact AS (SELECT *, count(*) OVER (PARTITION BY group_type, scope, group_key) AS members FROM keyed QUALIFY members > 1),
edges AS (SELECT k, subject_id AS a, object_id AS b FROM r WHERE approved AND fresh AND relation_type = 'same-artwork' AND k % 29 <> 0 AND (k + 1) % 29 <> 0 AND k + 1 IN (SELECT k FROM f)),
reviewed AS (SELECT 'reviewed-same-artwork' AS group_type, 'entity' AS scope, a AS group_key, unnest([a, b]) AS item_id, 2 AS members FROM edges),
allg AS (SELECT * FROM exact UNION ALL SELECT * FROM reviewed),
g AS (SELECT *, sha256(group_key) AS content_digest, {uuid5_sql("'duplicate-group'", "group_type", "scope", "sha256(group_key)")} AS group_id FROM allg)"""


@query(f"WITH {GROUPS} SELECT group_type, scope, item_id, members, content_digest, group_id FROM g")
def release_duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of all duplicate groups of a release: exact ones by stored and by decoded content, of media and of whole items,
    and reviewed ones."""
    found = _groups(spark, sf_dir)
    return found.select("group_type", "scope", "item_id", "members", "content_digest", "group_id")


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return release.release_groups(C.items(spark, sf_dir), C.relations(spark, sf_dir), C.tombstones(spark, sf_dir), NAMESPACE, Scratch(spark, "release"))


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.active_links(C.memberships(spark, sf_dir), C.collections(spark, sf_dir), C.items(spark, sf_dir), C.tombstones(spark, sf_dir))


@query(f"WITH {FACTS} SELECT collection_id, item_id, position::INTEGER AS position FROM links")
def active_star_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active memberships of active ends, none of the three withdrawn."""
    return _links(spark, sf_dir)


ROWS = f"""{GROUPS},
packs AS (SELECT k, list_sort(list(DISTINCT collection_id)) AS l FROM links GROUP BY 1), owned AS (SELECT item_id, list_sort(list(DISTINCT group_id)) AS l FROM g GROUP BY 1),
s AS (SELECT f.*, p.l AS packs, coalesce(o.l, []) AS grouped FROM f JOIN packs p ON p.k = f.k LEFT JOIN owned o ON o.item_id = f.id
  WHERE review IN ('approved', 'unreviewed') AND f.k % 18 <> 17 AND f.k % 14 <> 13 AND f.k % 7 <> 0)"""


@query(f"""WITH {ROWS}
SELECT id AS item_id, native_id, p_name || ' of ' || p_brand AS text, 'greeting; size ' || p_size AS usage, animated, CASE WHEN k % 5 = 0 AND k % 4 IN (1, 3) THEN 'image,' ELSE '' END || ['image', 'video', 'image', 'vector'][k % 4 + 1] AS media_kinds, behaviour AS color_behaviors,
  CASE WHEN behaviour = 'platform-adaptive' THEN '' ELSE CASE k % 3 WHEN 0 THEN 'black,red' WHEN 1 THEN 'black,blue' ELSE 'black,green' END END AS color_families, k % 3 = 0 AS contains_text,
  CASE WHEN k % 3 = 0 THEN 't' || (k % 7) || '/' || ['symbol', 'word', 'mixed', 'symbol'][k % 4 + 1] ELSE '' END AS literal, rating, review, len(packs) AS collection_count, array_to_string(packs[1:64], ',') AS collections, len(packs) > 64 AS collections_truncated,
  len(grouped) AS group_count, array_to_string(grouped[1:32], ',') AS groups, array_to_string(CASE WHEN k % 10 = k % 7 THEN ['c' || k % 10, 'c' || k % 10] ELSE ['c' || k % 10, 'c' || k % 7] END, ',') AS concepts FROM s""")
def search_rows_en(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search rows of the items that English describes."""
    rows = _search_rows(spark, sf_dir)
    joined = lambda c: F.array_join(c, ",")
    literal = F.array_join(F.transform("literal_text", lambda t: F.concat_ws("/", t["value"], t["kind"])), ",")
    return rows.select(
        "item_id", "native_id", "text", F.array_join("usage", "; ").alias("usage"), "facets.animated", joined("facets.media_kinds").alias("media_kinds"), joined("facets.color_behaviors").alias("color_behaviors"), joined("facets.color_families").alias("color_families"),
        "facets.contains_text", literal.alias("literal"), "rating", "review", "collection_count", joined("collection_ids").alias("collections"), "collections_truncated", "group_count", joined("group_ids").alias("groups"), joined("concept_ids").alias("concepts"),
    )


def _search_rows(spark: SparkSession, sf_dir: str, rights: DataFrame | None = None) -> DataFrame:
    groups = _groups(spark, sf_dir).select("item_id", F.col("group_id").alias("group_key"))
    return records.search_rows(C.items(spark, sf_dir), _links(spark, sf_dir), groups, "en", rights)


_MAP = "(SELECT string_agg(v || '=' || n, ',' ORDER BY v) FROM p WHERE p.cid = c.id AND p.facet = '{0}')"


@query(f"""WITH {GROUPS},
e AS (SELECT l.collection_id AS cid, f.* FROM links l JOIN f ON f.k = l.k),
x AS (SELECT cid, 'media_kinds' AS facet, ['image', 'video', 'image', 'vector'][k % 4 + 1] AS v FROM e
  UNION ALL SELECT cid, 'content_types', ['animal', 'number', 'object'][k % 3 + 1] FROM e UNION ALL SELECT cid, 'content_types', 'number' FROM e WHERE k % 8 = 0
  UNION ALL SELECT cid, 'styles', ['flat', 'outline'][k % 2 + 1] FROM e UNION ALL SELECT cid, 'suggested_uses', 'reply' FROM e WHERE k % 6 = 0
  UNION ALL SELECT cid, 'color_families', unnest([['red', 'blue', 'green'][k % 3 + 1], 'black']) FROM e WHERE behaviour <> 'platform-adaptive'
  UNION ALL SELECT cid, 'color_families', unnest([['red', 'blue', 'green'][k % 3 + 1], 'black']) FROM e WHERE behaviour <> 'platform-adaptive' AND k % 5 = 0),
p AS (SELECT cid, facet, v, count(*) AS n FROM x GROUP BY ALL),
t AS (SELECT cid, count(*) AS n, count(*) FILTER (WHERE behaviour IN ('mixed', 'platform-adaptive')) AS adaptive, count(*) FILTER (WHERE behaviour = 'fixed') AS fixed, count(*) FILTER (WHERE k % 3 = 0) AS recognized, count(*) FILTER (WHERE k % 3 = 1 OR k % 8 = 0) AS numbers FROM e GROUP BY 1),
h AS (SELECT collection_id AS cid, count(DISTINCT group_id) FILTER (WHERE group_type <> 'reviewed-same-artwork') AS exact_groups, count(DISTINCT group_id) FILTER (WHERE group_type = 'reviewed-same-artwork') AS reviewed_groups FROM links JOIN g USING (item_id) GROUP BY 1)
SELECT c.id AS collection_id, coalesce(t.n, 0) AS active_memberships, {", ".join(f"coalesce({_MAP.format(x)}, '') AS {x}" for x in ("media_kinds", "content_types", "styles", "suggested_uses", "color_families"))},
  coalesce(round_even(adaptive * 10000.0 / t.n, 0), 0)::BIGINT AS adaptive_share_bp, coalesce(round_even(fixed * 10000.0 / t.n, 0), 0)::BIGINT AS fixed_share_bp, coalesce(recognized, 0) AS recognized_text_count, coalesce(numbers, 0) AS number_count,
  coalesce(exact_groups, 0) AS exact_groups, coalesce(reviewed_groups, 0) AS reviewed_groups FROM c LEFT JOIN t ON t.cid = c.id LEFT JOIN h ON h.cid = c.id""")
def collection_facet_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequencies, shares and group counts of every collection."""
    scratch = Scratch(spark, "facets")
    links = scratch.table(_links(spark, sf_dir), "links")
    return release.collection_facets(C.collections(spark, sf_dir), links, C.items(spark, sf_dir), _groups(spark, sf_dir))


@query(f"""WITH {FACTS} SELECT unnest(['en', 'ru', 'xx']) AS language, unnest([count(*) FILTER (WHERE k % 7 <> 0), count(*) FILTER (WHERE k % 2 = 0), 0]) AS described, count(*) AS total FROM f""")
def language_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many items each language describes."""
    return release.language_coverage(C.items(spark, sf_dir), ["en", "ru", "xx"])


@query(f"""WITH {FACTS} SELECT id, subject_id, object_id, relation_type FROM r WHERE approved AND fresh AND k % 29 <> 0 AND (k + 1) % 29 <> 0 AND k + 1 IN (SELECT k FROM f)""")
def current_relation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approved relations whose ends are there and have the media that the evidence names."""
    return records.current_relations(C.relations(spark, sf_dir), C.items(spark, sf_dir), C.tombstones(spark, sf_dir)).select("id", "subject_id", "object_id", "relation_type")


def _rights(spark: SparkSession) -> DataFrame:
    """Effective rights of three platforms."""
    profiles = spark.createDataFrame([("own", 0, None, False, "allow", "allow"), ("project", 0, C.BUILD_TIME, False, "allow", "allow"), ("closed", 0, C.BUILD_TIME + 1, False, "allow", "conditional")], "profile string, a long, b long, withdrawn boolean, metadata string, annotations string")
    platforms = spark.createDataFrame([("alpha", "own", False), ("beta", None, True), ("gamma", "closed", False)], "platform string, default_profile string, inherits boolean")
    chosen = platforms.select("platform", policy.selected_profile(F.col("default_profile"), F.col("inherits"), F.lit("project")).alias("profile"))
    decided = policy.rights_decision(F.lit("active"), F.col("a"), F.col("b"), F.lit(C.BUILD_TIME), F.col("withdrawn"), [F.col("metadata"), F.col("annotations")])
    return chosen.join(profiles, "profile").select("platform", decided.alias("distribution_status"))


@query(f"""WITH {ROWS}
SELECT id AS item_id, CASE platform WHEN 'alpha' THEN 'allowed' WHEN 'beta' THEN 'unknown' ELSE 'restricted' END AS rights, CASE WHEN rating <> 'general' OR warned THEN 'CONTENT_POLICY_BLOCKED' WHEN platform = 'gamma' THEN 'RIGHTS_MISMATCH' END AS blocked,
  platform = 'alpha' AND rating = 'general' AND NOT warned AND review = 'approved' AS safe FROM s""")
def guarded_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Effective rights of every search row, what stands against showing it, and whether it is safe for agents in a fully
    verified release."""
    rights = _rights(spark)
    rows = _search_rows(spark, sf_dir, rights)
    expected = F.when(F.col("platform") == "gamma", F.lit("allowed")).otherwise(F.col("rights"))  # what gamma's rows claimed when they were built
    blocked = policy.content_guard(F.col("rating"), F.col("warnings"), False, F.col("rights"), expected)
    gone = C.tombstones(spark, sf_dir).select(F.col("target_id").alias("item_id"), F.lit(True).alias("gone"))
    states = [F.lit("verified")] * 5
    safe = policy.safe_record(states, F.col("availability"), F.col("rating"), F.col("warnings"), F.col("rights"), F.coalesce("gone", F.lit(False)), F.col("review"), F.lit(True), F.size("collection_ids") > 0)
    return rows.join(gone, "item_id", "left").select("item_id", "rights", blocked.alias("blocked"), safe.alias("safe"))


@query(f"""WITH {ROWS} SELECT id AS item_id, native_id, 'moves ' || p_type AS motion, 'greeting; size ' || p_size AS usage, animated, len(packs[1:64]) AS packs FROM s""")
def agent_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search rows in the projection for agents."""
    return records.agent_view(_search_rows(spark, sf_dir)).select("item_id", "native_id", "motion", "usage", "animated", F.size("collection_ids").cast("long").alias("packs"))


@query(f"""WITH {FACTS}
SELECT id, 'offline-unknown' AS control_state, CASE WHEN k % 10 = 0 THEN 'unverified' WHEN review = 'unreviewed' OR k % 12 = 0 THEN 'legacy-unattested' ELSE 'legacy-unprofiled' END AS review_attestation,
  CASE WHEN k % 10 = 0 THEN 'valid' WHEN review = 'unreviewed' THEN 'not-applicable' WHEN k % 12 = 0 THEN 'valid' ELSE 'legacy-unprofiled' END AS review_hash_profile,
  CASE WHEN k % 3 = 0 THEN 'missing' ELSE 'not-applicable' END AS model_qualification, CASE WHEN k % 3 = 0 THEN 'missing' ELSE 'not-applicable' END AS generation_attestation, false AS safe_eligible FROM f""")
def runtime_trust_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reader can say about each item's review and origin without control data."""
    k = F.substring("id", 2, 8).cast("long")
    rows = C.items(spark, sf_dir)
    told = policy.runtime_trust(F.col("review.status"), k % 10 == 0, F.col("review.review_hash_profile_id"), F.when(k % 3 == 0, "ai").otherwise("human"))
    return rows.select("id", told.alias("t")).select("id", "t.*")


@query(f"""WITH {FACTS}, t AS (SELECT k, string_agg(DISTINCT title, ' ' ORDER BY title) AS titles FROM links JOIN c ON c.id = links.collection_id GROUP BY 1)
SELECT f.id AS item_id, native_id, concat_ws(' ', CASE WHEN f.k % 7 <> 0 THEN concat_ws(' ', p_name || ' of ' || p_brand, 'moves ' || p_type, 'greeting', 'size ' || p_size) END, CASE WHEN f.k % 2 = 0 THEN 'деталь ' || p_name || ' ' END) AS told,
  lower(p_type) || ' ' || lower(substr(p_name, 1, 3)) || ' ' || lower(p_type) || ' ' || titles AS rest FROM f JOIN t ON t.k = f.k WHERE review NOT IN ('rejected', 'changes_requested')""")
def lookup_document_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text that an item is looked up by: descriptions, tags and titles, without refused items."""
    rows = records.lookup_documents(C.items(spark, sf_dir), _links(spark, sf_dir), C.collections(spark, sf_dir))
    return rows.select("item_id", "native_id", F.col("told"), F.col("rest"))


@query(f"""WITH {FACTS}, x AS (SELECT review, CASE WHEN gone THEN 'tombstoned' WHEN NOT active THEN 'inactive' WHEN review IN ('rejected', 'changes_requested') THEN 'refused' WHEN k NOT IN (SELECT k FROM links) THEN 'packless' ELSE 'indexed' END AS state FROM f)
SELECT count(*) FILTER (WHERE state = 'indexed') AS indexed, 0 AS invalid, count(*) FILTER (WHERE state = 'tombstoned') AS tombstoned, count(*) FILTER (WHERE state = 'inactive') AS inactive, count(*) FILTER (WHERE state = 'refused') AS refused,
  count(*) FILTER (WHERE state = 'packless') AS packless, count(*) FILTER (WHERE state = 'indexed' AND review = 'unreviewed') AS pending FROM x""")
def lookup_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a look-up index takes and leaves."""
    return release.lookup_statistics(C.items(spark, sf_dir), _links(spark, sf_dir), C.tombstones(spark, sf_dir))


@query(f"""WITH {FACTS} SELECT collection_id, sha256(string_agg(f.native_id || '|' || f.digest, chr(10) ORDER BY f.native_id || '|' || f.digest)) AS fingerprint FROM links JOIN f ON f.k = links.k GROUP BY 1""")
def set_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of each collection's members and their media."""
    return records.set_fingerprint(_links(spark, sf_dir), C.items(spark, sf_dir))


@query(f"""WITH {FACTS}, t AS (SELECT k // 4 AS group_id, id, k, k % 12 <> 5 AS same FROM f), w AS (SELECT group_id FROM t GROUP BY 1 HAVING bool_and(same)) SELECT group_id, id AS item_id FROM t JOIN w USING (group_id)""")
def complete_fragment_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of four tiles all of which still have the media they were verified for."""
    items = C.items(spark, sf_dir)
    k = F.substring("id", 2, 8).cast("long")
    digest = F.when(k % 12 != 5, F.col("fingerprints.input_media_digest")).otherwise("old")
    tiles = items.select(F.floor(k / 4).alias("group_id"), F.col("id").alias("item_id"), digest.alias("media_digest"))
    return records.complete_fragments(tiles, items).select("group_id", "item_id")


@query(f"""WITH {FACTS}, n AS (SELECT collection_id, count(*) AS n FROM links GROUP BY 1)
SELECT c.id, title, native_id, coalesce(n, 0) AS members, row_number() OVER (ORDER BY lower(title), lower(native_id), c.id) - 1 AS ordinal FROM c LEFT JOIN n ON n.collection_id = c.id""")
def catalogue_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collections by title, with their counts and ordinals."""
    return records.catalog(C.collections(spark, sf_dir), _links(spark, sf_dir), Scratch(spark, "catalogue"))


@query(f"""WITH {FACTS} SELECT id, array_to_string(list_sort(list_distinct(CASE WHEN k % 14 <> 13 THEN ['c' || k % 10, 'c' || k % 7] ELSE [] END)), ',') AS concepts, array_to_string(list_sort(list_distinct([lower(p_type), lower(substr(p_name, 1, 3))])), ',') AS tags,
  CASE WHEN k % 69 = 0 THEN 'blood,flashing' WHEN k % 23 = 0 THEN 'flashing' ELSE '' END AS warnings FROM f""")
def normalised_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with their set-like arrays sorted and without repeats."""
    return records.normalised(C.items(spark, sf_dir)).select("id", F.array_join("concept_ids", ",").alias("concepts"), F.array_join("semantic_tags", ",").alias("tags"), F.array_join("content.warnings", ",").alias("warnings"))


@query(f"""WITH {FACTS} SELECT id, 'review' AS field FROM f WHERE k % 50 = 3 UNION ALL SELECT id, 'first_seen' FROM f WHERE k % 70 = 9""")
def future_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that were reviewed or first seen after the build."""
    k = F.substring("id", 2, 8).cast("long")
    seen = F.when(k % 70 == 9, "2031-01-01T00:00:00Z").otherwise(F.col("availability.first_seen_at"))
    reviewed = F.when(k % 50 == 3, "2030-06-01T12:00:00Z").when(k % 2 == 0, "2022-01-01T00:00:00Z")
    return release.future_evidence(C.items(spark, sf_dir), {"first_seen": seen, "review": reviewed}, F.lit(C.BUILD_TIME))
