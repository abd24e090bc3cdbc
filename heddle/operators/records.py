"""Operators on the canonical records (``heddle.sources.schemas``): references, groups, derived rows, normal forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heddle.operators.ranking import ordinals
from heddle.runtime import Scratch

#: Most collections and groups listed in a search row.
MAX_COLLECTIONS, MAX_GROUPS = 64, 32


def _variant(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def references(items: DataFrame) -> DataFrame:
    """One row per fingerprint of each active item with complete fingerprints, with its media and rendering.

    The three arrays of a record are exploded and joined on (item, role, variant), so nothing leaves the record.
    """
    ready = items.where((F.col("availability.status") == "active") & (F.col("fingerprints.status") == "complete"))
    prints = ready.select("id", F.col("fingerprints.profile").alias("profile"), F.explode("fingerprints.items").alias("f"), "media", "facets.rendering.items")
    media = F.filter("media", lambda m: (m["role"] == F.col("f.role")) & (F.coalesce(m["variant_id"], F.lit("")) == _variant("f.variant_id")))[0]
    drawn = F.filter("items", lambda r: (r["role"] == F.col("f.role")) & (F.coalesce(r["variant_id"], F.lit("")) == _variant("f.variant_id")))[0]
    rows = prints.select("id", "profile", "f", media.alias("m"), drawn.alias("r")).where("m is not null")
    return rows.select(
        F.col("id").alias("item_id"), "profile", F.col("f.role").alias("role"), F.col("f.variant_id").alias("variant_id"), F.col("m.sha256").alias("media_sha256"), "m.byte_size", "m.duration_ms", "m.animated",
        "r.alpha_mode", "r.color_behavior", F.col("f.decoded_payload_sha256").alias("decoded_sha256"), F.col("f.canonical_render_sha256").alias("canonical_sha256"), F.col("f.shape_sha256").alias("shape_sha256"), "f.perceptual",
    )


def set_root(references_of: DataFrame, value: Column, name: str) -> DataFrame:
    """Digest of the sorted multiset of an item's values; an item has few media, so they are gathered per item."""
    lines = F.array_join(F.array_sort(F.collect_list(F.concat_ws("|", "role", F.coalesce("variant_id", F.lit("")), value))), "\n")
    return references_of.groupBy("item_id").agg(F.sha2(lines, 256).alias(name))


def group_families(items: DataFrame) -> DataFrame:
    """(group_type, scope, group_key, item_id): exact groups of two or more by stored bytes and by decoded content, of
    single media and of whole items. Whole items compare decoded content only within one profile."""
    refs = references(items)
    binary = F.concat_ws("|", "media_sha256", "byte_size")
    decoded = F.concat_ws("|", "profile", "decoded_sha256")
    media = [("binary-exact", "media", refs.select(binary.alias("group_key"), "item_id")), ("decoded-exact", "media", refs.select(decoded.alias("group_key"), "item_id"))]
    one_profile = refs.groupBy("item_id").agg(F.count_distinct("profile").alias("n")).where("n = 1").select("item_id")
    whole = [("binary-exact", "entity", set_root(refs, binary, "group_key")), ("decoded-exact", "entity", set_root(refs.join(one_profile, "item_id", "left_semi"), decoded, "group_key"))]
    out = None
    for kind, scope, rows in media + whole:
        members = rows.distinct()
        shared = members.groupBy("group_key").agg(F.count("*").alias("members")).where("members > 1")
        family = members.join(shared, "group_key").select(F.lit(kind).alias("group_type"), F.lit(scope).alias("scope"), "group_key", "item_id", "members")
        out = family if out is None else out.unionByName(family)
    return out


def active_links(memberships: DataFrame, collections: DataFrame, items: DataFrame, tombstones: DataFrame) -> DataFrame:
    """(collection_id, item_id, position) of active memberships; neither they nor their ends may be withdrawn or inactive."""
    gone = tombstones.select(F.col("target_id").alias("id")).distinct()
    live = lambda df: df.where(F.col("availability.status") == "active").join(gone, "id", "left_anti").select("id")
    rows = memberships.where("status = 'active'").join(gone, "id", "left_anti").select("collection_id", "item_id", "position")
    rows = rows.join(live(collections).withColumnRenamed("id", "collection_id"), "collection_id", "left_semi")
    return rows.join(live(items).withColumnRenamed("id", "item_id"), "item_id", "left_semi")


def _capped(column: Column, most: int, name: str) -> list[Column]:
    values = F.coalesce(column, F.array().cast("array<string>"))
    return [F.size(values).alias(f"{name}_count"), F.slice(values, 1, most).alias(f"{name}_ids"), (F.size(values) > most).alias(f"{name}s_truncated")]


def _sorted_set(values: Column) -> Column:
    return F.array_sort(F.array_distinct(F.coalesce(values, F.array().cast("array<string>"))))


def search_rows(items: DataFrame, links: DataFrame, groups: DataFrame | None, language: str, rights: DataFrame | None = None) -> DataFrame:
    """One nested row per publishable item that is described in the language, with sorted sets, capped lists and their true
    counts. Eligible are items with a complete concept mapping whose review is open or approved and that an active
    collection holds. Colours are those of fixed and mixed renderings only. ``groups`` has item_id and group_key
    (without it the rows have no columns of groups), ``rights`` platform and distribution_status."""
    packs = links.groupBy("item_id").agg(F.array_sort(F.collect_set("collection_id")).alias("collections"))
    eligible = F.col("review.status").isin("approved", "unreviewed") & (F.col("concept_mapping_status") == "complete") & (F.size("concept_ids") > 0)
    rows = items.where((F.col("availability.status") == "active") & eligible).join(packs, F.col("id") == packs["item_id"]).drop("item_id")
    if groups is not None:
        member = groups.groupBy("item_id").agg(F.array_sort(F.collect_set("group_key")).alias("groups"))
        rows = rows.join(member, F.col("id") == member["item_id"], "left").drop("item_id")
    rows = rows.join(F.broadcast(rights), "platform", "left") if rights is not None else rows.withColumn("distribution_status", F.lit("unknown"))
    told = F.col("descriptions")[language]
    drawn = F.coalesce(F.col("facets.rendering.items"), F.array().cast(T.ArrayType(items.schema["facets"].dataType["rendering"].dataType["items"].dataType.elementType)))
    coloured = F.filter(drawn, lambda r: r["color_behavior"].isin("fixed", "mixed") & r["dominant_colors"].isNotNull())
    facets = F.struct(
        F.exists("media", lambda m: F.coalesce(m["animated"], F.lit(False))).alias("animated"), _sorted_set(F.transform("media", lambda m: m["kind"])).alias("media_kinds"),
        _sorted_set(F.transform(drawn, lambda r: r["color_behavior"])).alias("color_behaviors"), _sorted_set(F.flatten(F.transform(coloured, lambda r: F.transform(r["dominant_colors"], lambda c: c["family"])))).alias("color_families"),
        (F.coalesce(F.col("facets.text_content.status"), F.lit("none")) != "none").alias("contains_text"), "facets.content_types", "facets.styles", "facets.suggested_uses", "facets.uncertainties",
    )
    native = F.struct("platform", "native_namespace", "scope_id", "native_id", "identity_epoch", F.lit("current").alias("status"))
    return rows.where(told.isNotNull()).select(
        F.col("id").alias("item_id"), F.lit(language).alias("language"), F.sha2(F.to_json(F.struct(*sorted(items.columns))), 256).alias("record_sha256"), "platform", "native_id",
        F.lit(1).alias("native_reference_count"), F.array(native).alias("native_references"), told["text"].alias("text"), told["motion"].alias("motion"), told["usage"].alias("usage"), "concept_ids", "semantic_tags",
        facets.alias("facets"), literal_text().alias("literal_text"), F.col("availability.status").alias("availability"), "content.rating", "content.warnings", F.col("review.status").alias("review"),
        F.col("distribution_status").alias("rights"), *_capped(F.col("collections"), MAX_COLLECTIONS, "collection"), *(_capped(F.col("groups"), MAX_GROUPS, "group") if groups is not None else []),
    )


def literal_text(items: str = "facets.text_content.items") -> Column:
    """Values of recognised text with the kind as search rows spell it."""
    kind = lambda k: F.when(k.isin("letter", "punctuation"), "symbol").when(k.isin("code", "other"), "mixed").otherwise(k)
    return F.transform(F.coalesce(F.col(items), F.array().cast("array<struct<value:string,kind:string,script:string,language:string,temporal_scope:string,media_refs:array<struct<role:string,variant_id:string>>>>")), lambda t: F.struct(t["value"].alias("value"), kind(t["kind"]).alias("kind")))


def agent_view(rows: DataFrame) -> DataFrame:
    """Search rows in the narrow projection for agents."""
    return rows.select("item_id", "record_sha256", "native_id", "language", "text", "motion", F.array_join("usage", "; ").alias("usage"), "concept_ids", "semantic_tags", "facets.animated", "literal_text", "rating", "rights", "collection_ids", "group_ids")


def lookup_documents(items: DataFrame, links: DataFrame, collections: DataFrame) -> DataFrame:
    """One text document per item for the inverted index; items that were rejected or sent back are left out."""
    titles = links.join(collections.select(F.col("id").alias("collection_id"), "title"), "collection_id").groupBy("item_id").agg(F.array_sort(F.collect_set("title")).alias("titles"))
    rows = items.where(~F.coalesce(F.col("review.status").isin("rejected", "changes_requested"), F.lit(False))).join(titles, F.col("id") == F.col("item_id"))
    told = F.flatten(F.transform(F.map_values("descriptions"), lambda d: F.concat(F.array(d["text"], d["motion"]), F.coalesce(d["usage"], F.array().cast("array<string>")))))
    words, rest = F.array_join(told, " "), F.concat_ws(" ", F.array_join("semantic_tags", " "), F.array_join("titles", " "))
    return rows.select("item_id", "native_id", words.alias("told"), rest.alias("rest"), F.concat_ws(" ", words, rest).alias("document"))


def current_relations(relations: DataFrame, items: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Approved relations whose ends are present, not withdrawn, and still have the media the evidence was given for."""
    gone = tombstones.select(F.col("target_id").alias("id")).distinct()
    present = items.join(gone, "id", "left_anti").select("id", F.col("fingerprints.input_media_digest").alias("digest"))
    rows = relations.where(F.col("review.status") == "approved")
    for end in ("subject", "object"):
        rows = rows.join(present.select(F.col("id").alias(f"{end}_id"), F.col("digest").alias("__digest")), f"{end}_id").where(F.col("__digest") == F.col(f"evidence.{end}_media_digest")).drop("__digest")
    return rows


def normalised(items: DataFrame) -> DataFrame:
    """Set-like arrays sorted and without repeats; ordered lists stay."""
    return items.withColumns({c: F.array_sort(F.array_distinct(c)) for c in ("concept_ids", "semantic_tags")}).withColumn("content", F.col("content").withField("warnings", F.array_sort(F.array_distinct("content.warnings"))))


def primary_references(refs: Column) -> Column:
    """References to a variant become references to the primary, without repeats and in order of first mention."""
    return F.array_distinct(F.transform(refs, lambda r: F.struct(r["role"].alias("role"), F.lit(None).cast("string").alias("variant_id"))))


def set_fingerprint(links: DataFrame, items: DataFrame) -> DataFrame:
    """Per collection, the digest of its sorted (native id, media digest) pairs."""
    pairs = links.join(items.select(F.col("id").alias("item_id"), "native_id", F.col("fingerprints.input_media_digest").alias("digest")), "item_id")
    lines = F.array_join(F.array_sort(F.collect_list(F.concat_ws("|", "native_id", "digest"))), "\n")
    return pairs.groupBy("collection_id").agg(F.sha2(lines, 256).alias("fingerprint"))


def complete_fragments(fragments: DataFrame, items: DataFrame) -> DataFrame:
    """Groups of tiles whose members are all present with the media they were verified for.

    ``fragments`` has group_id, item_id and media_digest."""
    now = items.select(F.col("id").alias("item_id"), F.col("fingerprints.input_media_digest").alias("__now"))
    joined = fragments.join(now, "item_id", "left")
    whole = joined.groupBy("group_id").agg(F.bool_and(F.coalesce(F.col("__now") == F.col("media_digest"), F.lit(False))).alias("whole")).where("whole")
    return fragments.join(whole.select("group_id"), "group_id", "left_semi")


def catalog(collections: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """The catalogue page: collections by title, with their counts and the running ordinal."""
    counts = links.groupBy("collection_id").agg(F.count("*").alias("members"))
    rows = collections.join(counts, F.col("id") == F.col("collection_id"), "left").select("id", "title", "native_id", F.coalesce("members", F.lit(0)).alias("members"))
    return ordinals(rows, [F.lower("title"), F.lower("native_id"), F.col("id")], scratch)
