"""The catalog's tables as schemas, in DDL form, with their keys and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

VERSION = 8
BOX = "latitude double, longitude double, min_latitude double, max_latitude double, min_longitude double, max_longitude double"
TABLES: dict[str, str] = {
    "catalog_info": "catalog_id int, catalog_path string, schema_version int, created_at timestamp",
    "catalog_roots": "root_id string, root_type string, path string, is_active boolean",
    "assets": "asset_id string, asset_type string, path string, stem string, stem_key string, extension string, fingerprint string, file_size long, modified_time timestamp, exists_on_disk boolean, metadata_json string, app_rating int, created_at timestamp, updated_at timestamp",
    "asset_files": "file_id string, asset_id string, path string, role string",
    "asset_links": "link_id string, parent_asset_id string, child_asset_id string, relation_type string, confidence double, confirmed_by string, recipe_json string",
    "raw_metadata_cache": "raw_asset_id string, path string, stem string, stem_key string, capture_time timestamp, camera_model string, lens_model string, aspect_ratio double, metadata_level string, fingerprint_level string, enrichment_status string, updated_at timestamp",
    "image_lookup_registry": "image_path string, image_asset_id string, raw_asset_id string, status string, score double, features_json string, candidates_json string, confirmed_at timestamp, created_at timestamp, updated_at timestamp",
    "jobs": "job_id string, job_type string, status string, payload_json string, result_json string, progress double, priority int, pause_requested boolean, cancel_requested boolean, resume_cursor string, attempt_count int, error_text string, created_at timestamp, updated_at timestamp",
    "app_settings": "setting_key string, value_json string, updated_at timestamp",
    "preview_entries": "cache_key string, asset_id string, kind string, relative_path string, width int, height int, status string",
    "resource_sets": "set_id string, primary_asset_id string, raw_asset_id string, created_at timestamp",
    "resource_set_items": "set_id string, asset_id string, role string, version_kind string, parent_asset_id string, sort_order int",
    "collections": "collection_id string, name string, kind string, rules_json string, sort_order int, created_at timestamp",
    "collection_items": "collection_id string, asset_id string, added_at timestamp",
    "asset_ai_annotations": "asset_id string, caption string, tags_json string, location_json string, detected_text string, provider string, model string, updated_at timestamp",
    "asset_tags": "asset_id string, tag string, source string",
    "face_models": "model_id string, model_version string, kind string, manifest_hash string, status string",
    "people_asset_index": "asset_id string, model_id string, model_version string, input_hash string, status string, face_count int, error_text string, file_size long, file_mtime timestamp",
    "asset_faces": "face_id string, asset_id string, model_id string, model_version string, bbox array<double>, landmarks array<double>, quality string, confidence double, embedding array<float>",
    "person_groups": "group_id string, name string, state string, cover_face_id string, created_at timestamp",
    "person_group_faces": "group_id string, face_id string, membership_state string, source string",
    "deleted_files": "path string, file_size long, modified_time timestamp",
    "asset_locations": f"location_id string, asset_id string, {BOX}, source string, precision_level string, place_id string",
}
KEYS: dict[str, list[str]] = {
    "assets": ["asset_id"], "asset_files": ["path"], "asset_links": ["parent_asset_id", "child_asset_id", "relation_type"], "image_lookup_registry": ["image_path"],
    "jobs": ["job_id"], "app_settings": ["setting_key"], "preview_entries": ["cache_key"], "resource_sets": ["set_id"], "resource_set_items": ["set_id", "asset_id"],
    "collections": ["collection_id"], "collection_items": ["collection_id", "asset_id"], "asset_ai_annotations": ["asset_id"], "asset_tags": ["asset_id", "tag"],
    "face_models": ["model_id", "model_version"], "people_asset_index": ["asset_id", "model_id", "model_version"], "asset_faces": ["face_id"], "person_groups": ["group_id"],
    "person_group_faces": ["face_id"], "deleted_files": ["path"], "asset_locations": ["asset_id"], "catalog_roots": ["path"], "raw_metadata_cache": ["raw_asset_id"],
}
ENUMS: dict[str, dict[str, tuple[str, ...]]] = {
    "collections": {"kind": ("manual", "smart")},
    "person_groups": {"state": ("candidate", "confirmed", "ignored")},
    "person_group_faces": {"membership_state": ("candidate", "confirmed", "rejected")},
    "asset_locations": {"source": ("manual", "exif", "ai"), "precision_level": ("exact", "locality", "admin1", "country")},
}


def schema(table: str) -> StructType:
    return StructType.fromDDL(TABLES[table])


def _broken(table: str) -> Column:
    out = F.lit(False)
    for column, allowed in ENUMS.get(table, {}).items():
        out = out | ~F.coalesce(F.col(column).isin(*allowed), F.lit(False))
    for key in KEYS.get(table, []):
        out = out | F.col(key).isNull()
    return out


def violations(table: str, df: DataFrame) -> DataFrame:
    """Rows with a null key, a value outside an enumeration, or a key twice."""
    keys = KEYS.get(table, [])
    bad = df.filter(_broken(table))
    if keys:
        twice = df.groupBy(*keys).count().filter("count > 1").select(*keys)
        bad = bad.unionByName(df.join(twice, keys, "left_semi").select(*df.columns))
    return bad
