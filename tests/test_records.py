import json

import pytest
from pyspark.sql import functions as F

from heddle.operators import records as R
from heddle.runtime import Scratch
from heddle.sources.schemas import SCHEMAS


def item(k, media="m", decoded="d", status="active", review="unreviewed", text="A cat"):
    prints = [{"role": "primary", "decoded_payload_sha256": decoded, "canonical_render_sha256": f"c{k}", "shape_sha256": f"s{k}", "perceptual": {"low_information": False}}]
    rendering = {"items": [{"role": "primary", "color_behavior": "fixed", "alpha_mode": "opaque", "dominant_colors": [{"hex": "#ff0000", "family": "red", "coverage_bp": 9000}]}]}
    return {
        "id": f"i{k}", "platform": "p", "native_id": str(k), "availability": {"status": status}, "review": {"status": review},
        "media": [{"role": "primary", "kind": "image", "sha256": media, "byte_size": 9, "animated": False}],
        "fingerprints": {"status": "complete", "profile": "v1", "input_media_digest": f"dig{k}", "items": prints},
        "descriptions": {"en": {"text": text, "usage": ["hello"]}}, "semantic_tags": ["b", "a", "b"], "concept_ids": ["z", "y"], "concept_mapping_status": "complete", "content": {"rating": "general", "warnings": []},
        "facets": {"rendering": rendering, "text_content": {"items": [{"value": "OK", "kind": "letter"}]}},
    }


@pytest.fixture(scope="module")
def data(spark):
    def table(name, rows):
        return spark.createDataFrame([(json.dumps(r),) for r in rows] or [("{}",)], "value string").select(F.from_json("value", SCHEMAS[name]).alias("r")).select("r.*").where(F.lit(bool(rows)))

    items = table("items", [item(1), item(2), item(3, media="x"), item(4, media="y", decoded="e", status="inactive"), item(5, media="w", decoded="f", review="rejected")])
    collections = table("collections", [{"id": "c1", "title": "Beta", "native_id": "b", "availability": {"status": "active"}}, {"id": "c2", "title": "alpha", "native_id": "a", "availability": {"status": "active"}}])
    members = table("memberships", [{"id": f"m{k}", "collection_id": c, "item_id": i, "status": s, "position": k} for k, (c, i, s) in enumerate([("c1", "i1", "active"), ("c1", "i2", "active"), ("c2", "i1", "active"), ("c2", "i3", "removed"), ("c1", "i4", "active"), ("c1", "i5", "active"), ("c2", "gone", "active")])])
    tombstones = table("tombstones", [{"target_entity_type": "item", "target_id": "i2"}])
    return {"items": items, "collections": collections, "members": members, "tombstones": tombstones, "links": R.active_links(members, collections, items, tombstones)}


def test_links_follow_status_and_tombstones(data):
    assert {(r["collection_id"], r["item_id"]) for r in data["links"].collect()} == {("c1", "i1"), ("c2", "i1"), ("c1", "i5")}


def test_group_families(data):
    got = {(r["group_type"], r["scope"], r["item_id"]) for r in R.group_families(data["items"]).collect()}
    assert got == {("binary-exact", s, i) for s in ("media", "entity") for i in ("i1", "i2")} | {("decoded-exact", s, i) for s in ("media", "entity") for i in ("i1", "i2", "i3")}


def test_search_rows(data):
    groups = R.group_families(data["items"])
    rows = {r["item_id"]: r for r in R.search_rows(data["items"], data["links"], groups, "en").collect()}
    assert set(rows) == {"i1"}  # a rejected item is not eligible
    row = rows["i1"]
    assert row["collection_ids"] == ["c1", "c2"] and row["collection_count"] == 2 and not row["collections_truncated"]
    assert row["group_count"] == 4
    assert row["facets"]["color_families"] == ["red"] and row["literal_text"][0]["kind"] == "symbol" and row["text"] == "A cat"
    assert R.search_rows(data["items"], data["links"], groups, "ru").count() == 0
    assert R.agent_view(R.search_rows(data["items"], data["links"], groups, "en")).where("usage = 'hello'").count() == 1


def test_lookup_documents_leave_out_rejected(data):
    rows = {r["item_id"]: r["document"] for r in R.lookup_documents(data["items"], data["links"], data["collections"]).collect()}
    assert set(rows) == {"i1"} and "A cat" in rows["i1"] and "alpha" in rows["i1"]


def test_relations_need_current_media(spark, data):
    rows = [("ok", "i1", "i3", "dig1", "dig3", "approved"), ("stale", "i1", "i3", "old", "dig3", "approved"), ("gone", "i1", "i2", "dig1", "dig2", "approved"), ("draft", "i1", "i3", "dig1", "dig3", "unreviewed")]
    df = spark.createDataFrame(rows, "id string, subject_id string, object_id string, a string, b string, s string")
    df = df.select("id", "subject_id", "object_id", F.struct(F.col("a").alias("subject_media_digest"), F.col("b").alias("object_media_digest")).alias("evidence"), F.struct(F.col("s").alias("status")).alias("review"))
    assert [r["id"] for r in R.current_relations(df, data["items"], data["tombstones"]).collect()] == ["ok"]


def test_normal_forms(spark, data):
    row = R.normalised(data["items"]).where("id = 'i1'").first()
    assert row["semantic_tags"] == ["a", "b"] and row["concept_ids"] == ["y", "z"]
    refs = spark.sql("select array(named_struct('role', 'primary', 'variant_id', 'x'), named_struct('role', 'primary', 'variant_id', cast(null as string))) as r")
    assert len(refs.select(R.primary_references(F.col("r")).alias("p")).first()["p"]) == 1
    assert [r["title"] for r in R.catalog(data["collections"], data["links"], Scratch(data["items"].sparkSession, "t")).orderBy("ordinal").collect()] == ["alpha", "Beta"]
    assert R.set_fingerprint(data["links"], data["items"]).count() == 2


def test_fragments_need_all_their_members(spark, data):
    fragments = spark.createDataFrame([("g", "i1", "dig1"), ("g", "i3", "dig3"), ("h", "i1", "dig1"), ("h", "i3", "old"), ("k", "nobody", "d")], "group_id string, item_id string, media_digest string")
    assert {r["group_id"] for r in R.complete_fragments(fragments, data["items"]).collect()} == {"g"}
