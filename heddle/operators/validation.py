"""Checks of canonical records as queries: every set of checks gives issues (code, path, message), and ``validate`` all of them.

Rules that look at one row are evaluated in one pass; references are anti joins, unique keys are groups. Nothing is gathered.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heddle.functions.columns import uuid5
from heddle.operators.curation import Snapshot
from heddle.operators.integrity import cyclic_nodes, dangling, duplicates, miscounted, row_rules, tombstone_conflicts

#: Closed enumerations of records.
STATUSES = {"availability": ("active", "inactive", "private", "deleted", "unknown"), "review": ("unreviewed", "approved", "rejected", "changes_requested"), "rating": ("general", "sensitive"), "fingerprints": ("complete", "pending", "partial", "unavailable")}
#: What a manifest must say.
MANIFEST = {"format": "records", "schema_major": 1, "encoding": "utf-8", "ordering": "utf8-bytes"}
TIMESTAMP = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z$"
SHA256 = "^[0-9a-f]{64}$"
SYMMETRIC = ("same-artwork", "not-duplicate", "related-series")
#: Shapes of secrets and local paths that no record may hold.
FORBIDDEN = (r"AKIA[0-9A-Z]{16}", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", r"\bgh[oprsu]_[A-Za-z0-9]{36}", r"(?:^|\s)(?:/home/|/Users/|[A-Z]:\\)")


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def manifest_issues(spark, manifest: dict) -> DataFrame:
    """MANIFEST for every constant that is absent or differs, and for a schema of another major version."""
    found = [("MANIFEST", name, f"must be {want}") for name, want in MANIFEST.items() if manifest.get(name) != want]
    return spark.createDataFrame(found, "code string, path string, message string")


def schema_issues(items: DataFrame) -> DataFrame:
    """SCHEMA rules of items that a typed reader cannot state: required values, closed enumerations, patterns, bounds."""
    c = F.col
    rules = {
        "SCHEMA_ID": c("id").isNotNull() & (c("id") != ""),
        "SCHEMA_AVAILABILITY": c("availability.status").isin(*STATUSES["availability"]),
        "SCHEMA_REVIEW": c("review.status").isin(*STATUSES["review"]),
        "SCHEMA_RATING": c("content.rating").isin(*STATUSES["rating"]),
        "SCHEMA_TIMESTAMP": c("availability.first_seen_at").isNull() | c("availability.first_seen_at").rlike(TIMESTAMP),
        "SCHEMA_MEDIA": (F.size("media") > 0) & F.forall("media", lambda m: m["sha256"].rlike(SHA256) & m["byte_size"].between(1, 20 << 20) & (m["width"].cast("long") * m["height"] <= 16_000_000) & (m["duration_ms"].isNull() | m["duration_ms"].between(1, 10_000))),
        "SCHEMA_DESCRIPTION": F.forall(F.map_values("descriptions"), lambda d: clean_text(d["text"])),
    }
    return row_rules(items, c("id"), rules)


def clean_text(text: Column) -> Column:
    """No control characters, no markup, no white space at the ends; null is clean."""
    return text.isNull() | (~text.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]") & ~text.rlike(r"(?i)</?[a-z][^>]*>") & (text == F.trim(text)))


def identity_issues(df: DataFrame, expected: Column, natural: list[str]) -> DataFrame:
    """ID where an id is not the one that its natural key gives, IDENTITY_DUPLICATE where several rows share a natural key."""
    wrong = df.where(~F.col("id").eqNullSafe(expected))
    ids = wrong.select(F.lit("ID").alias("code"), F.col("id").alias("path"), F.concat(F.lit("must be "), expected).alias("message"))
    return ids.unionByName(duplicates(df, natural, "IDENTITY_DUPLICATE"))


def record_id(prefix: str, namespace: str, *parts: Column) -> Column:
    """The name-based id of a record's natural key."""
    return F.concat(F.lit(prefix), uuid5(namespace, F.lit(prefix), *parts))


def relation_id(namespace: str, relation_type: Column, subject: Column, object_: Column) -> Column:
    """The id of an edge; the ends of a symmetric one count in their order."""
    symmetric = relation_type.isin(*SYMMETRIC)
    first, second = F.when(symmetric, F.least(subject, object_)).otherwise(subject), F.when(symmetric, F.greatest(subject, object_)).otherwise(object_)
    return record_id("r-", namespace, relation_type, first, second)


def integrity_issues(snapshot: Snapshot) -> DataFrame:
    """DANGLING, MEMBERSHIP_DUPLICATE, POSITION_DUPLICATE, ITEM_COUNT and TOMBSTONE_CONFLICT."""
    links = snapshot["memberships"]
    active = links.where("status = 'active'")
    parts = [
        dangling(links, "collection_id", snapshot["collections"], "id"), dangling(links, "item_id", snapshot["items"], "id"), duplicates(links, ["collection_id", "item_id"], "MEMBERSHIP_DUPLICATE"),
        duplicates(active, ["collection_id", "position"], "POSITION_DUPLICATE"), miscounted(snapshot["collections"], "id", "item_count", active, "collection_id"),
        *[tombstone_conflicts(snapshot[name], "id", snapshot["tombstones"]) for name in ("collections", "items", "memberships")],
    ]
    return _all(parts)


def relation_issues(snapshot: Snapshot, profile: str) -> DataFrame:
    """The rules of edges: ends there and not withdrawn, approved, evidence on current media and the current profile, media
    pairs that exist and, for whole items, cover both sides one to one, order of symmetric ends, no conflict of texts."""
    gone = snapshot["tombstones"].select(F.col("target_id").alias("id")).distinct().withColumn("gone", F.lit(True))
    keys = F.array_sort(F.transform("media", lambda m: F.concat_ws("/", m["role"], F.coalesce(m["variant_id"], F.lit("")))))
    texts = F.array_sort(F.array_distinct(F.transform(F.coalesce("facets.text_content.items", F.array().cast(snapshot["items"].schema["facets"].dataType["text_content"].dataType["items"].dataType)), lambda t: t["value"])))
    ends = snapshot["items"].select("id", F.lit(True).alias("here"), F.col("fingerprints.input_media_digest").alias("digest"), F.col("fingerprints.profile").alias("profile"), keys.alias("keys"), texts.alias("texts"), (F.col("review.status") == "approved").alias("approved"))
    rows = snapshot["relations"]
    for side in ("subject", "object"):
        own = ends.join(gone, "id", "full_outer").select(F.col("id").alias(f"{side}_id"), F.struct("here", "digest", "profile", "keys", "texts", "approved", "gone").alias(side))
        rows = rows.join(own, f"{side}_id", "left")
    c = F.col
    both = F.coalesce(c("subject.here") & c("object.here"), F.lit(False))
    pairs = F.coalesce("evidence.media_pairs", F.array().cast(snapshot["relations"].schema["evidence"].dataType["media_pairs"].dataType))
    named = lambda side: F.transform(pairs, lambda p: F.concat_ws("/", p[f"{side}_role"], F.coalesce(p[f"{side}_variant_id"], F.lit(""))))
    whole = (F.array_sort(named("subject")) == c("subject.keys")) & (F.array_sort(named("object")) == c("object.keys"))
    present = (F.size(F.array_except(named("subject"), "subject.keys")) == 0) & (F.size(F.array_except(named("object"), "object.keys")) == 0)
    conflict = (c("relation_type") == "same-artwork") & c("subject.approved") & c("object.approved") & (c("subject.texts") != c("object.texts"))
    yes = lambda x: F.coalesce(x, F.lit(False))
    rules = {
        "RELATION_DANGLING": both, "RELATION_TOMBSTONE": ~yes(c("subject.gone")) & ~yes(c("object.gone")), "RELATION_REVIEW": c("review.status") == "approved",
        "RELATION_STALE": ~both | ((c("evidence.subject_media_digest") == c("subject.digest")) & (c("evidence.object_media_digest") == c("object.digest"))),
        "RELATION_PROFILE": ~both | ((c("subject.profile") == c("object.profile")) & (c("subject.profile") == profile)),
        "RELATION_MEDIA": ~both | present, "RELATION_SCOPE": ~both | F.when(c("scope") == "entity", whole).otherwise(F.size(pairs) == 1),
        "RELATION_ORDER": ~c("relation_type").isin(*SYMMETRIC) | (c("subject_id") < c("object_id")), "RELATION_TEXT_CONFLICT": ~both | ~yes(conflict),
    }
    return row_rules(rows, c("id"), rules)


def item_issues(items: DataFrame, profile: str, style_conflicts: list[tuple[str, str]] | None = None) -> DataFrame:
    """The policy of single items: sorted and distinct sets, tags that repeat no facet, renderings and fingerprints that cover
    the media, palettes in order and within their sum, references of texts, content types that texts ask for, motion."""
    c = F.col
    key = lambda m: F.concat_ws("/", m["role"], F.coalesce(m["variant_id"], F.lit("")))
    media = F.transform("media", key)
    ordered = lambda a: a.isNull() | (a == F.array_sort(F.array_distinct(a)))
    facets = [c(f"facets.{name}") for name in ("content_types", "styles", "suggested_uses", "uncertainties")]
    empty = F.array().cast("array<string>")
    drawn = F.col("facets.rendering.items")
    prints = F.col("fingerprints.items")
    texts = F.coalesce("facets.text_content.items", F.array().cast(items.schema["facets"].dataType["text_content"].dataType["items"].dataType))
    colour_key = lambda d: F.transform(d["dominant_colors"], lambda x: F.struct((-x["coverage_bp"]).alias("n"), x["family"].alias("f"), x["hex"].alias("h")))
    moving = F.exists("media", lambda m: F.coalesce(m["animated"], F.lit(False)))
    clashes = reduce(lambda a, b: a | b, [F.array_contains("facets.styles", x) & F.array_contains("facets.styles", y) for x, y in style_conflicts or []], F.lit(False))
    rules = {
        "SORT": ordered(c("semantic_tags")) & ordered(c("concept_ids")) & ordered(c("content.warnings")) & (media == F.array_sort(media)),
        "FACET_ORDER": reduce(lambda a, b: a & b, [ordered(f) for f in facets]),
        "FACET_TAG_DUPLICATE": F.size(F.array_intersect(F.coalesce("semantic_tags", empty), F.array_union(F.coalesce(facets[0], empty), F.coalesce(facets[1], empty)))) == 0,
        "RENDERING_BINDING": F.array_sort(F.transform(drawn, key)) == F.array_sort(media),
        "FINGERPRINT_BINDING": F.when(c("fingerprints.status") == "complete", F.array_sort(F.transform(prints, key)) == F.array_sort(media)).when(c("fingerprints.status") == "unavailable", F.size(prints) == 0).otherwise(True),
        "FINGERPRINT_AVAILABILITY": (c("availability.status") != "active") | (c("fingerprints.status") == "complete"),
        "DEDUPE_PROFILE": c("fingerprints.profile") == profile,
        "PALETTE_ORDER": F.forall(drawn, lambda d: d["dominant_colors"].isNull() | (colour_key(d) == F.array_sort(colour_key(d)))),
        "PALETTE_COVERAGE": F.forall(drawn, lambda d: d["dominant_colors"].isNull() | (F.aggregate(d["dominant_colors"], F.lit(0), lambda s, x: s + x["coverage_bp"]) <= 10_000)),
        "TEXT_MEDIA_REFS": F.forall(texts, lambda t: F.size(F.array_except(F.transform(t["media_refs"], key), media)) == 0),
        "TEXT_DYNAMICS": moving | (F.coalesce(c("facets.text_content.dynamics"), F.lit("static")) == "static"),
        "TEXT_CONTENT_TYPE": ~F.exists(texts, lambda t: t["value"].rlike("^[0-9]+$")) | F.array_contains(F.coalesce(facets[0], empty), "number"),
        "MOTION_STATUS": F.forall(F.map_values("descriptions"), lambda d: moving | (F.coalesce(d["motion_status"], F.lit("none")) != "known")),
        "STYLE_CONFLICT": ~clashes,
        "DUPLICATE": F.forall(F.map_values("descriptions"), lambda d: F.size(F.array_distinct(F.coalesce(d["usage"], empty))) == F.size(F.coalesce(d["usage"], empty))),
    }
    return row_rules(items, c("id"), rules)


def registry_issues(concepts: DataFrame, scratch) -> DataFrame:
    """A concept tree (id, parent, status): unknown parents, parents that are not active, cycles."""
    known = concepts.select(F.col("id").alias("parent"), F.col("status").alias("__status"))
    joined = concepts.where("parent is not null").join(known, "parent", "left")
    unknown = joined.where("__status is null").select(F.lit("CONCEPT_PARENT").alias("code"), F.col("id").alias("path"), F.lit("parent does not exist").alias("message"))
    inactive = joined.where("__status <> 'active' and status = 'active'").select(F.lit("CONCEPT_STATUS").alias("code"), F.col("id").alias("path"), F.lit("parent is not active").alias("message"))
    cycle = cyclic_nodes(concepts.where("parent is not null").select(F.col("parent").alias("src"), F.col("id").alias("dst")), scratch)
    rows = cycle.select(F.lit("CONCEPT_CYCLE").alias("code"), F.col("node").alias("path"), F.lit("is on or behind a cycle").alias("message"))
    return unknown.unionByName(inactive).unionByName(rows)


def platform_issues(collections: DataFrame, fingerprints: DataFrame, extension: str) -> DataFrame:
    """Rules of a platform's extension (JSON text under its name): present, nothing of another platform, and a set fingerprint
    that equals the recomputed one (collection_id, fingerprint)."""
    joined = collections.join(fingerprints.select(F.col("collection_id").alias("id"), F.col("fingerprint").alias("__real")), "id", "left")
    held = F.col("extensions")[extension]
    rules = {
        "EXTENSION_MISSING": held.isNotNull(),
        "EXTENSION_FOREIGN": F.size(F.array_except(F.map_keys("extensions"), F.array(F.lit(extension)))) == 0,
        "FINGERPRINT": F.get_json_object(held, "$.set_fingerprint_sha256").eqNullSafe(F.col("__real")),
    }
    return row_rules(joined, F.col("id"), rules)


def forbidden_values(df: DataFrame, key: str = "id") -> DataFrame:
    """(code, path, message) of rows any text of which looks like a secret or a local path."""
    text = F.to_json(F.struct(*[c for c in df.columns if c != key])).alias("t")
    found = F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(f"FORBIDDEN_{k}")) for k, p in enumerate(FORBIDDEN)]))
    return df.select(F.explode(found).alias("code"), F.col(key).cast("string").alias("path"), F.lit("holds what no record may").alias("message"))


def redacted(text: Column) -> Column:
    return reduce(lambda t, p: F.regexp_replace(t, p, "[redacted]"), FORBIDDEN, text)


@F.udf(T.BooleanType())
def _nfc(text):
    import unicodedata

    return text is None or unicodedata.is_normalized("NFC", text)


def nfc_issues(df: DataFrame, key: str, texts: list[str]) -> DataFrame:
    """NFC for texts that are not in normal form; only texts beyond ASCII are looked at in Python."""
    plain = lambda c: F.col(c).isNull() | ~F.col(c).rlike(r"[^\x00-\x7f]")
    odd = df.where(reduce(lambda a, b: a | b, [~plain(c) for c in texts]))
    return row_rules(odd, F.col(key), {f"NFC_{c.upper()}": _nfc(F.col(c)) for c in texts})


def release_issues(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """Differences of the files that are there (file, size, sha256) and those a manifest names: MISSING, UNEXPECTED, CHANGED."""
    here, named = found.select("file", F.struct("size", "sha256").alias("f")), manifest.select("file", F.struct("size", "sha256").alias("m"))
    joined = here.join(named, "file", "full_outer").where(~F.col("f").eqNullSafe(F.col("m")))
    code = F.when(F.col("f").isNull(), "MISSING").when(F.col("m").isNull(), "UNEXPECTED").otherwise("CHANGED")
    return joined.select(code.alias("code"), F.col("file").alias("path"), F.lit("differs from the manifest").alias("message"))


def validate(snapshot: Snapshot, profile: str) -> DataFrame:
    """All issues of a snapshot's records."""
    return _all([schema_issues(snapshot["items"]), integrity_issues(snapshot), relation_issues(snapshot, profile), item_issues(snapshot["items"], profile), *[forbidden_values(snapshot[n]) for n in ("collections", "items")]])

