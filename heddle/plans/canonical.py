"""Canonical records made from the driver's tables, and the same facts as SQL for the oracles.

Items come from parts, collections from suppliers, memberships from the parts that suppliers shipped. Every property is a
small function of the keys, so that the SQL states it without looking at the records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.runtime import read_table
from heddle.sources.schemas import SCHEMAS

#: When the snapshot is built, in seconds.
BUILD_TIME = 1_700_000_000


def _hash64(label: str, group: Column) -> Column:
    """16 hex digits."""
    return F.substring(F.sha2(F.concat(F.lit(label), group), 256), 1, 16)


def _flipped(digits: Column, mask: Column) -> Column:
    return F.lower(F.lpad(F.hex(F.conv(digits, 16, -10).cast("long").bitwiseXOR(mask)), 16, "0"))


def _packed(*digits: Column) -> Column:
    """Base64url text of big-endian words."""
    return F.rtrim(F.translate(F.base64(F.unhex(F.concat(*digits))), "+/", "-_"), F.lit("="))


def _pick(k: Column, values: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (k % len(values) + 1).cast("int"))


def _strings(*columns: Column) -> Column:
    return F.array_compact(F.array(*columns)).cast("array<string>")


def items(spark: SparkSession, sf_dir: str, ids: DataFrame | None = None) -> DataFrame:
    """The records of all items, or of those in ``ids`` (item_id) only; no others are then made."""
    k = F.col("p_partkey")
    item_id = F.concat(F.lit("e"), F.lpad(k.cast("string"), 8, "0"))
    parts = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    if ids is not None:
        parts = parts.join(ids, item_id == F.col("item_id"), "left_semi")
    half, six = F.floor(k / 2).cast("string"), F.floor(k / 6).cast("string")
    low = F.call_function("shiftleft", F.lit(1).cast("long"), (k % 6).cast("int")) - 1  # k % 6 low bits
    animated = k % 4 == 1
    null = F.lit(None).cast("string")
    media = F.array_compact(
        F.array(
            F.struct(F.lit("primary").alias("role"), null.alias("variant_id"), _pick(k, ["image", "video", "image", "vector"]).alias("kind"), F.sha2(F.concat(F.lit("m"), half), 256).alias("sha256"), (F.floor(k / 2) % 50 + 100).cast("int").alias("byte_size"), F.lit(512).alias("width"), F.lit(512).alias("height"), animated.alias("animated"), F.when(animated, (1000 + k % 5 * 100).cast("int")).alias("duration_ms")),
            F.when(k % 5 == 0, F.struct(F.lit("variant").alias("role"), F.lit("dark").alias("variant_id"), F.lit("image").alias("kind"), F.sha2(F.concat(F.lit("v"), k), 256).alias("sha256"), F.lit(77).alias("byte_size"), F.lit(512).alias("width"), F.lit(512).alias("height"), F.lit(False).alias("animated"), F.lit(None).cast("int").alias("duration_ms"))),
        )
    )

    def words(label: str, double: bool) -> Column:
        mask = low.bitwiseOR(F.shiftleft(low, 16)) if double else low
        one = _flipped(_hash64(label, six), mask)
        return F.when(animated, _packed(one, _flipped(_hash64(label + "2", six), mask))).otherwise(_packed(one))

    perceptual = F.struct(F.lit("u64be").alias("encoding"), F.when(animated, 2).otherwise(1).alias("sample_count"), words("l", True).alias("layout_phash64"), words("o", True).alias("content_phash64"), words("a", False).alias("alpha_phash64"), words("e", False).alias("edge_phash64"), (k % 31 == 0).alias("low_information"))
    prints = F.array_compact(
        F.array(
            F.struct(F.lit("primary").alias("role"), null.alias("variant_id"), F.sha2(F.concat(F.lit("x"), F.floor(k / 3)), 256).alias("decoded_payload_sha256"), F.sha2(F.concat(F.lit("c"), F.floor(k / 5)), 256).alias("canonical_render_sha256"), F.sha2(F.concat(F.lit("s"), F.floor(k / 4)), 256).alias("shape_sha256"), perceptual.alias("perceptual")),
            F.when(k % 5 == 0, F.struct(F.lit("variant").alias("role"), F.lit("dark").alias("variant_id"), F.sha2(F.concat(F.lit("y"), k), 256).alias("decoded_payload_sha256"), F.sha2(F.concat(F.lit("z"), k), 256).alias("canonical_render_sha256"), F.sha2(F.concat(F.lit("w"), k), 256).alias("shape_sha256"), perceptual.alias("perceptual"))),
        )
    )
    colours = F.array(F.struct(F.lit("#ff0000").alias("hex"), _pick(k, ["red", "blue", "green"]).alias("family"), F.lit(6000).alias("coverage_bp")), F.struct(F.lit("#000000").alias("hex"), F.lit("black").alias("family"), F.lit(4000).alias("coverage_bp")))
    behaviour = _pick(k, ["fixed", "fixed", "mixed", "platform-adaptive"])
    drawing = lambda role, variant: F.struct(F.lit(role).alias("role"), variant.alias("variant_id"), behaviour.alias("color_behavior"), _pick(k, ["opaque", "binary", "translucent"]).alias("alpha_mode"), (k % 100 * 100).cast("int").alias("visible_area_bp"), F.when(behaviour != "platform-adaptive", colours).alias("dominant_colors"))
    rendering = F.array_compact(F.array(drawing("primary", null), F.when(k % 5 == 0, drawing("variant", F.lit("dark")))))
    texts = F.when(k % 3 == 0, F.array(F.struct(F.concat(F.lit("t"), k % 7).alias("value"), _pick(k, ["letter", "word", "code", "punctuation"]).alias("kind"), F.lit("Latn").alias("script"), F.lit("en").alias("language"), F.lit("static").alias("temporal_scope"), F.array(F.struct(F.lit("primary").alias("role"), null.alias("variant_id"))).alias("media_refs")))).otherwise(F.array())
    told = F.when(k % 7 != 0, F.struct(F.concat("p_name", F.lit(" of "), "p_brand").alias("text"), F.lit("known").alias("motion_status"), F.concat(F.lit("moves "), "p_type").alias("motion"), F.array(F.lit("greeting"), F.concat(F.lit("size "), "p_size")).alias("usage")))
    russian = F.when(k % 2 == 0, F.struct(F.concat(F.lit("деталь "), "p_name").alias("text"), F.lit("known").alias("motion_status"), F.lit("").alias("motion"), F.array().cast("array<string>").alias("usage")))
    described = F.map_filter(F.map_from_arrays(F.array(F.lit("en"), F.lit("ru")), F.array(told, russian)), lambda _, d: d.isNotNull())
    content = F.struct(F.when(k % 19 == 0, "sensitive").otherwise("general").alias("rating"), _strings(F.when(k % 23 == 0, F.lit("flashing")), F.when(k % 46 == 0, F.lit("flashing")), F.when(k % 69 == 0, F.lit("blood"))).alias("warnings"))
    availability = F.struct(F.when(k % 11 == 0, "inactive").otherwise("active").alias("status"), F.lit("2023-01-01T00:00:00Z").alias("first_seen_at"))
    review = F.struct(_pick(k, ["approved", "unreviewed", "approved", "rejected", "changes_requested", "unreviewed"]).alias("status"), F.when(k % 12 == 0, F.lit("p1")).alias("review_hash_profile_id"))
    made = parts.select(
        F.lit("1.0.0").alias("schema_version"), F.lit("item").alias("entity_type"), item_id.alias("id"), _pick(k, ["alpha", "beta", "gamma"]).alias("platform"), F.lit("custom").alias("native_namespace"),
        F.lit("").alias("scope_id"), (500_000 + k).cast("string").alias("native_id"), (k % 2 + 1).cast("int").alias("identity_epoch"), availability.alias("availability"), media.alias("media"),
        F.struct(F.when(k % 13 == 0, "pending").otherwise("complete").alias("status"), F.when(k % 17 == 0, "p2").otherwise("p1").alias("profile"), F.sha2(F.concat(F.lit("g"), half), 256).alias("input_media_digest"), prints.alias("items")).alias("fingerprints"), described.alias("descriptions"),
        F.struct(
            F.lit("1").alias("taxonomy_version"), F.struct(F.lit("r1").alias("profile"), rendering.alias("items")).alias("rendering"), F.struct(F.when(k % 3 == 0, "recognized").otherwise("none").alias("status"), F.lit("static").alias("dynamics"), texts.alias("items")).alias("text_content"),
            _strings(_pick(k, ["animal", "number", "object"]), F.when(k % 8 == 0, F.lit("number"))).alias("content_types"), _strings(_pick(k, ["flat", "outline"])).alias("styles"), _strings(F.when(k % 6 == 0, F.lit("reply"))).alias("suggested_uses"), _strings(F.when(k % 9 == 0, F.lit("identity"))).alias("uncertainties"),
        ).alias("facets"),
        _strings(F.when(k % 14 != 13, F.concat(F.lit("c"), k % 10)), F.when(k % 14 != 13, F.concat(F.lit("c"), k % 7))).alias("concept_ids"), F.when(k % 18 == 17, "pending").otherwise("complete").alias("concept_mapping_status"), _strings(F.lower("p_type"), F.lower(F.substring("p_name", 1, 3)), F.lower("p_type")).alias("semantic_tags"), content.alias("content"), review.alias("review"),
    )
    return _shaped(made, "items")


def collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    made = read_table(spark, sf_dir, "supplier").select(
        F.lit("1.0.0").alias("schema_version"), F.lit("collection").alias("entity_type"), F.concat(F.lit("s"), F.lpad(k.cast("string"), 6, "0")).alias("id"), _pick(k, ["alpha", "beta", "gamma"]).alias("platform"), F.lit("pack").alias("native_namespace"),
        F.concat(F.lit("pack_"), k).alias("native_id"), F.lit(1).alias("identity_epoch"), F.col("s_name").alias("title"), F.struct(F.when(k % 10 == 9, "inactive").otherwise("active").alias("status")).alias("availability"),
    )
    return _shaped(made, "collections")


def memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, p = F.col("l_suppkey"), F.col("l_partkey")
    made = read_table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct().select(
        F.concat(F.lit("b"), s, F.lit("-"), p).alias("id"), F.concat(F.lit("s"), F.lpad(s.cast("string"), 6, "0")).alias("collection_id"), F.concat(F.lit("e"), F.lpad(p.cast("string"), 8, "0")).alias("item_id"),
        F.when((s + p) % 9 == 0, "removed").otherwise("active").alias("status"), p.cast("int").alias("position"), F.lit("2023-01-01T00:00:00Z").alias("last_changed_at"),
    )
    return _shaped(made, "memberships")


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edge from each part whose key is divisible by three to the next one; some evidence is out of date."""
    k = F.col("p_partkey")
    digest = lambda x: F.sha2(F.concat(F.lit("g"), F.floor(x / 2).cast("string")), 256)
    made = read_table(spark, sf_dir, "part").where(k % 3 == 0).select(
        F.concat(F.lit("r"), k).alias("id"), F.concat(F.lit("e"), F.lpad(k.cast("string"), 8, "0")).alias("subject_id"), F.concat(F.lit("e"), F.lpad((k + 1).cast("string"), 8, "0")).alias("object_id"), F.lit("entity").alias("scope"),
        F.when(k % 2 == 0, "same-artwork").otherwise("not-duplicate").alias("relation_type"),
        F.struct(F.when(k % 15 == 0, "old").otherwise(digest(k)).alias("subject_media_digest"), digest(k + 1).alias("object_media_digest")).alias("evidence"), F.struct(F.when(k % 4 == 3, "unreviewed").otherwise("approved").alias("status")).alias("review"),
    )
    return _shaped(made, "relations")


def tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("s_suppkey")
    of_items = read_table(spark, sf_dir, "part").where(k % 29 == 0).select(F.lit("item").alias("target_entity_type"), F.concat(F.lit("e"), F.lpad(k.cast("string"), 8, "0")).alias("target_id"))
    of_packs = read_table(spark, sf_dir, "supplier").where(s % 37 == 5).select(F.lit("collection").alias("target_entity_type"), F.concat(F.lit("s"), F.lpad(s.cast("string"), 6, "0")).alias("target_id"))
    of_links = memberships(spark, sf_dir).where(F.col("position") % 41 == 7).select(F.lit("membership").alias("target_entity_type"), F.col("id").alias("target_id"))
    return _shaped(of_items.unionByName(of_packs).unionByName(of_links), "tombstones")


def _shaped(made: DataFrame, name: str) -> DataFrame:
    """The columns of the named schema in its order; what was not made is null, also inside structs."""
    from pyspark.sql import types as T

    def fill(column: Column, have: T.DataType, want: T.DataType) -> Column:
        if isinstance(want, T.StructType):
            there = {f.name: f for f in have.fields}
            parts = [fill(column[f.name], there[f.name].dataType, f.dataType).alias(f.name) if f.name in there else F.lit(None).cast(f.dataType).alias(f.name) for f in want.fields]
            return F.when(column.isNotNull(), F.struct(*parts))
        if isinstance(want, T.ArrayType) and isinstance(want.elementType, T.StructType) and isinstance(have.elementType, T.StructType):
            return F.transform(column, lambda x: fill(x, have.elementType, want.elementType))
        if isinstance(want, T.MapType) and isinstance(want.valueType, T.StructType):
            return F.transform_values(column, lambda _, x: fill(x, have.valueType, want.valueType))
        return column.cast(want)

    have = {f.name: f.dataType for f in made.schema.fields}
    schema = T._parse_datatype_string(SCHEMAS[name])
    return made.select(*[(fill(F.col(f.name), have[f.name], f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields])


#: The facts as SQL: f has a row for each item, m for each membership, c for each collection, r for each relation.
FACTS = """
f AS (SELECT p_partkey AS k, p_name, p_brand, p_type, p_size, 'e' || lpad(p_partkey::VARCHAR, 8, '0') AS id, (500000 + p_partkey)::VARCHAR AS native_id, ['alpha', 'beta', 'gamma'][k % 3 + 1] AS platform, k % 11 <> 0 AS active,
  k % 29 = 0 AS gone, k % 13 <> 0 AS complete, CASE WHEN k % 17 = 0 THEN 'p2' ELSE 'p1' END AS profile, k % 4 = 1 AS animated, sha256('g' || (k // 2)) AS digest,
  ['fixed', 'fixed', 'mixed', 'platform-adaptive'][k % 4 + 1] AS behaviour, ['opaque', 'binary', 'translucent'][k % 3 + 1] AS alpha_mode, CASE WHEN k % 19 = 0 THEN 'sensitive' ELSE 'general' END AS rating, k % 23 = 0 AS warned,
  ['approved', 'unreviewed', 'approved', 'rejected', 'changes_requested', 'unreviewed'][k % 6 + 1] AS review FROM part),
c AS (SELECT s_suppkey AS s, 's' || lpad(s_suppkey::VARCHAR, 6, '0') AS id, s_name AS title, 'pack_' || s_suppkey AS native_id, ['alpha', 'beta', 'gamma'][s % 3 + 1] AS platform, s % 10 <> 9 AS active, s % 37 = 5 AS gone FROM supplier),
m AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS k, (s + k) % 9 <> 0 AS active, k % 41 = 7 AS gone, 'b' || s || '-' || k AS id FROM lineitem),
links AS (SELECT c.id AS collection_id, f.id AS item_id, m.k AS position, m.s, m.k FROM m JOIN c ON c.s = m.s JOIN f ON f.k = m.k WHERE m.active AND NOT m.gone AND c.active AND NOT c.gone AND f.active AND NOT f.gone),
r AS (SELECT a.k, 'r' || a.k AS id, a.id AS subject_id, 'e' || lpad((a.k + 1)::VARCHAR, 8, '0') AS object_id, CASE WHEN a.k % 2 = 0 THEN 'same-artwork' ELSE 'not-duplicate' END AS relation_type, a.k % 4 <> 3 AS approved, a.k % 15 <> 0 AS fresh FROM f a WHERE a.k % 3 = 0)"""
