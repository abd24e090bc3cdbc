"""What a release derives from canonical records: duplicate groups with ids, facets of collections, coverage, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heddle.functions.columns import share_bp, uuid5
from heddle.operators.components import connected_components
from heddle.operators.records import current_relations, group_families
from heddle.runtime import Scratch

EXACT_TYPES = ("binary-exact", "decoded-exact")
REVIEWED_TYPE = "reviewed-same-artwork"


def with_group_ids(families: DataFrame, namespace: str) -> DataFrame:
    """Group members with ``content_digest`` of the group's key and ``group_id``, a name-based UUID of type, scope and digest."""
    digested = families.withColumn("content_digest", F.sha2("group_key", 256))
    return digested.withColumn("group_id", uuid5(namespace, F.lit("duplicate-group"), F.col("group_type"), F.col("scope"), F.col("content_digest")))


def reviewed_groups(relations: DataFrame, items: DataFrame, tombstones: DataFrame, scratch: Scratch) -> DataFrame:
    """Members of the components that current, approved same-artwork relations make, as families of type REVIEWED_TYPE. The
    key is the component's least item, so a component of any size is never gathered."""
    current = current_relations(relations, items, tombstones).where("relation_type = 'same-artwork'")
    found = connected_components(current.select(F.col("subject_id").alias("src"), F.col("object_id").alias("dst")), scratch)
    sizes = found.groupBy("component").agg(F.count("*").alias("members"))
    joined = found.join(sizes, "component")
    return joined.select(F.lit(REVIEWED_TYPE).alias("group_type"), F.lit("entity").alias("scope"), F.col("component").alias("group_key"), F.col("node").alias("item_id"), "members")


def release_groups(items: DataFrame, relations: DataFrame, tombstones: DataFrame, namespace: str, scratch: Scratch) -> DataFrame:
    """Members of all groups that a release lists: exact ones of items that are not withdrawn, and reviewed ones."""
    gone = tombstones.select(F.col("target_id").alias("id")).distinct()
    exact = group_families(items.join(gone, "id", "left_anti"))
    return with_group_ids(exact.unionByName(reviewed_groups(relations, items, tombstones, scratch)), namespace)


def _values(facet: str, values: Column) -> Column:
    return F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.struct(F.lit(facet).alias("facet"), v.alias("value")))


def collection_facets(collections: DataFrame, links: DataFrame, items: DataFrame, groups: DataFrame) -> DataFrame:
    """A row for each collection: its members, five frequency maps (``value=count`` in order of the values), two shares in basis
    points, conditional counts, and the distinct groups that its members are in, by type. ``links`` has the members that
    count; ``groups`` has group_id, group_type and item_id.

    All frequencies are counted in one pass over exploded (facet, value) pairs, which holds one row for each value of a
    closed enumeration.
    """
    drawn = F.col("facets.rendering.items")
    kind_type = T.ArrayType(T.StringType())
    coloured = F.flatten(F.transform(F.filter(drawn, lambda r: r["color_behavior"].isin("fixed", "mixed") & r["dominant_colors"].isNotNull()), lambda r: F.transform(r["dominant_colors"], lambda c: c["family"])))
    primary = F.transform(F.slice(F.filter("media", lambda m: m["role"] == "primary"), 1, 1), lambda m: m["kind"]).cast(kind_type)
    facets = {"media_kinds": primary, "content_types": F.col("facets.content_types"), "styles": F.col("facets.styles"), "suggested_uses": F.col("facets.suggested_uses"), "color_families": coloured}
    behaviours = F.transform(drawn, lambda r: r["color_behavior"])
    marks = items.select(
        F.col("id").alias("item_id"), F.concat(*[_values(name, values) for name, values in facets.items()]).alias("pairs"),
        F.arrays_overlap(behaviours, F.array(F.lit("platform-adaptive"), F.lit("mixed"))).alias("adaptive"), F.array_contains(behaviours, "fixed").alias("fixed"),
        F.col("facets.text_content.status").isin("recognized", "partially-recognized").alias("recognized"), F.array_contains("facets.content_types", "number").alias("numbers"),
    )
    members = links.select("collection_id", "item_id").join(marks, "item_id")
    counts = members.groupBy("collection_id").agg(F.count("*").alias("n"), *[F.count_if(F.col(c)).alias(c) for c in ("adaptive", "fixed", "recognized", "numbers")])
    counted = members.select("collection_id", F.explode("pairs").alias("p")).groupBy("collection_id", "p.facet", "p.value").agg(F.count("*").alias("n"))
    listed = F.array_sort(F.collect_list(F.struct("value", "n")))
    text = F.array_join(F.transform(listed, lambda p: F.concat_ws("=", p["value"], p["n"])), ",")
    maps = counted.groupBy("collection_id", "facet").agg(text.alias("map")).groupBy("collection_id").pivot("facet", list(facets)).agg(F.first("map"))
    held = members.select("collection_id", "item_id").join(groups.select("item_id", "group_id", "group_type"), "item_id").select("collection_id", "group_id", "group_type").distinct()
    kinds = held.groupBy("collection_id").agg(F.count_if(F.col("group_type").isin(*EXACT_TYPES)).alias("exact_groups"), F.count_if(F.col("group_type") == REVIEWED_TYPE).alias("reviewed_groups"))
    rows = collections.select(F.col("id").alias("collection_id")).join(counts, "collection_id", "left").join(maps, "collection_id", "left").join(kinds, "collection_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return rows.select(
        "collection_id", zero("n").alias("active_memberships"), *[F.coalesce(name, F.lit("")).alias(name) for name in facets], share_bp(zero("adaptive"), zero("n")).alias("adaptive_share_bp"), share_bp(zero("fixed"), zero("n")).alias("fixed_share_bp"),
        zero("recognized").alias("recognized_text_count"), zero("numbers").alias("number_count"), zero("exact_groups").alias("exact_groups"), zero("reviewed_groups").alias("reviewed_groups"),
    )


def language_coverage(items: DataFrame, languages: list[str]) -> DataFrame:
    """(language, described, total): how many items each language describes; one row for each language asked for."""
    described = [F.count_if(F.col("descriptions")[language].isNotNull()).alias(language) for language in languages]
    row = items.agg(F.count("*").alias("total"), *described)
    pairs = F.explode(F.array(*[F.struct(F.lit(x).alias("language"), F.col(f"`{x}`").alias("described")) for x in languages]))
    return row.select("total", pairs.alias("p")).select("p.language", "p.described", "total")


def lookup_statistics(items: DataFrame, links: DataFrame, tombstones: DataFrame, invalid: Column | None = None) -> DataFrame:
    """One row of what a look-up index takes and leaves: indexed, excluded by reason, pending reviews."""
    gone = tombstones.select(F.col("target_id").alias("id"), F.lit(True).alias("__gone")).distinct()
    held = links.select(F.col("item_id").alias("id"), F.lit(True).alias("__held")).distinct()
    rows = items.join(gone, "id", "left").join(held, "id", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    bad = F.coalesce(invalid, F.lit(True)) if invalid is not None else F.lit(False)
    refused = F.coalesce(F.col("review.status").isin("rejected", "changes_requested"), F.lit(False))
    state = (
        F.when(bad, "invalid").when(yes("__gone"), "tombstoned").when(F.coalesce(F.col("availability.status") != "active", F.lit(True)), "inactive").when(refused, "refused").when(~yes("__held"), "packless").otherwise("indexed")
    )
    names = ("indexed", "invalid", "tombstoned", "inactive", "refused", "packless")
    return rows.select(state.alias("state"), "review.status").agg(*[F.count_if(F.col("state") == name).alias(name) for name in names], F.count_if((F.col("state") == "indexed") & (F.col("status") == "unreviewed")).alias("pending"))


def future_evidence(df: DataFrame, instants: dict[str, Column], built_at: Column) -> DataFrame:
    """(field, id) of timestamps that lie after the build; a release with any is refused."""
    late = F.array_compact(F.array(*[F.when(F.unix_timestamp(F.to_timestamp(value)) > built_at, F.lit(name)) for name, value in instants.items()]))
    return df.select(F.explode(late).alias("field"), "id")
