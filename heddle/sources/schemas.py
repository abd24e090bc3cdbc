"""Explicit schemas of the canonical records; readers never infer."""

from __future__ import annotations

AVAILABILITY = "struct<status:string,first_seen_at:string,last_changed_at:string,last_verified_at:string,reason_code:string,set_by:string>"
REVIEW = "struct<status:string,reviewed_at:string,reviewer:string,reviewed_content_sha256:string,review_hash_profile_id:string>"
MEDIA = "array<struct<role:string,variant_id:string,kind:string,format:string,mime_type:string,sha256:string,byte_size:int,width:int,height:int,animated:boolean,duration_ms:int>>"
PERCEPTUAL = "struct<encoding:string,sample_count:int,layout_phash64:string,content_phash64:string,alpha_phash64:string,edge_phash64:string,temporal_energy_bp:int,low_information:boolean>"
FINGERPRINTS = f"struct<status:string,profile:string,input_media_digest:string,items:array<struct<role:string,variant_id:string,decoded_payload_sha256:string,canonical_render_sha256:string,shape_sha256:string,perceptual:{PERCEPTUAL}>>>"
RENDERING = "struct<profile:string,items:array<struct<role:string,variant_id:string,color_behavior:string,palette_dynamics:string,alpha_mode:string,visible_area_bp:int,dominant_colors:array<struct<hex:string,family:string,coverage_bp:int>>,adaptive_mask_source:string,adaptive_mask_sha256:string>>>"
TEXT = "struct<status:string,dynamics:string,items:array<struct<value:string,kind:string,script:string,language:string,temporal_scope:string,media_refs:array<struct<role:string,variant_id:string>>>>>"
FACETS = f"struct<taxonomy_version:string,rendering:{RENDERING},text_content:{TEXT},content_types:array<string>,styles:array<string>,suggested_uses:array<string>,uncertainties:array<string>>"
IDENTITY = "schema_version string, entity_type string, id string, platform string, native_namespace string, scope_id string, native_id string, identity_epoch int"

SCHEMAS = {
    "collections": f"{IDENTITY}, kind string, title string, canonical_url string, availability {AVAILABILITY}, item_count int, extensions map<string,string>",
    "items": f"{IDENTITY}, availability {AVAILABILITY}, media {MEDIA}, fingerprints {FINGERPRINTS}, descriptions map<string,struct<text:string,motion_status:string,motion:string,usage:array<string>>>, facets {FACETS}, concept_ids array<string>, concept_mapping_status string, semantic_tags array<string>, content struct<rating:string,warnings:array<string>>, review {REVIEW}, extensions map<string,string>",
    "memberships": "schema_version string, entity_type string, id string, collection_id string, item_id string, status string, position int, first_seen_at string, last_changed_at string",
    "relations": f"id string, identity_epoch int, subject_id string, object_id string, scope string, relation_type string, evidence struct<dedupe_profile:string,subject_media_digest:string,object_media_digest:string,media_pairs:array<struct<subject_role:string,subject_variant_id:string,object_role:string,object_variant_id:string>>,signals:array<string>>, review {REVIEW}",
    "tombstones": "target_entity_type string, target_id string, reason_code string, withheld_at string, public_note string",
}
