"""Assets, collections, tags, annotations and settings as pure changes of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import CJK, hashed_id, normalize_tag
from .generic import cascade_delete, delete_keys, insert_ignore, partial_update, update_where, upsert
from .versions import remove_members

Tables = dict[str, DataFrame]


# assets


def upsert_assets(assets: DataFrame, rows: DataFrame) -> DataFrame:
    """By path: a path keeps the id it has, and a rating survives a null one."""
    known = assets.select("path", F.col("asset_id").alias("known_id"))
    named = rows.join(known, "path", "left").withColumn("asset_id", F.coalesce("known_id", "asset_id")).drop("known_id")
    return upsert(assets, named, ["path"], keep=["app_rating", "created_at"])


def files_of(assets: DataFrame, role: str = "primary") -> DataFrame:
    return assets.select(hashed_id("file", F.col("asset_id"), F.col("path")).alias("file_id"), "asset_id", "path", F.lit(role).alias("role"))


def upsert_registry(registry: DataFrame, decisions: DataFrame, as_of) -> DataFrame:
    """By path; confirmed_at is set when a picture gets bound, else kept."""
    bound = F.col("status").isin("auto_bound", "manual_confirmed")
    rows = decisions.withColumn("confirmed_at", F.when(bound, F.lit(as_of).cast("timestamp")))
    return upsert(registry, rows, ["image_path"], keep=["confirmed_at"])


def upsert_previews(previews: DataFrame, rows: DataFrame) -> DataFrame:
    return upsert(previews, rows.withColumn("cache_key", F.sha1(F.concat_ws(":", "asset_id", "kind"))), ["cache_key"])


def set_rating(assets: DataFrame, ids: DataFrame, rating: int | None) -> DataFrame:
    """Sets a rating within 0 to 5; 0 and None clear it."""
    value = None if not rating else max(0, min(5, int(rating)))
    hit = ids.select("asset_id").distinct().withColumn("__hit", F.lit(True))
    out = assets.join(hit, "asset_id", "left").withColumn("app_rating", F.when(F.col("__hit"), F.lit(value).cast("int")).otherwise(F.col("app_rating")))
    return out.select(*assets.columns)


def relink(assets: DataFrame, asset_id: str, path: str, fingerprint: str, force: bool = False) -> DataFrame:
    """Moves an asset to another path, if the file there is the same or ``force``."""
    ok = F.col("asset_id") == asset_id
    if not force:
        ok = ok & (F.col("fingerprint") == fingerprint)
    return update_where(assets, ok, path=F.lit(path), exists_on_disk=F.lit(True))


def record_tombstones(tombstones: DataFrame, files: DataFrame) -> DataFrame:
    """Notes size and time of deleted entries whose files are still there."""
    return upsert(tombstones, files.select("path", "file_size", "modified_time"), ["path"])


def delete_assets(tables: Tables, ids: DataFrame) -> Tables:
    """Everything about the asset_ids goes; stacks get a new primary or go."""
    ids = ids.select("asset_id").distinct()
    faces = tables["asset_faces"].join(ids, "asset_id", "left_semi").select("face_id")
    refs = {"assets": ["asset_id"], "asset_files": ["asset_id"], "asset_links": ["parent_asset_id", "child_asset_id"], "image_lookup_registry": ["image_asset_id"], "preview_entries": ["asset_id"], "collection_items": ["asset_id"], "asset_ai_annotations": ["asset_id"], "asset_tags": ["asset_id"], "people_asset_index": ["asset_id"], "asset_faces": ["asset_id"], "asset_locations": ["asset_id"]}
    out = cascade_delete(tables, ids, {k: v for k, v in refs.items() if k in tables})
    out["person_group_faces"] = delete_keys(tables["person_group_faces"], faces, "face_id")
    out["resource_sets"], out["resource_set_items"] = remove_members(tables["resource_sets"], tables["resource_set_items"], ids)
    return out


def orphan_pairs(assets: DataFrame, files: DataFrame) -> DataFrame:
    """path, orphan_id and active_id: pictures without a file row that share
    their path with one that has a file row (of several the smallest id)."""
    pictures = assets.filter(F.col("asset_type") == "image").select("asset_id", "path")
    held = files.select("asset_id").distinct()
    active = pictures.join(held, "asset_id", "left_semi").groupBy("path").agg(F.min("asset_id").alias("active_id"))
    return pictures.join(held, "asset_id", "left_anti").join(active, "path").select("path", F.col("asset_id").alias("orphan_id"), "active_id")


def clean_orphans(tables: Tables) -> Tables:
    """Their previews move to the active asset where it has none; then they go."""
    pairs = orphan_pairs(tables["assets"], tables["asset_files"])
    previews = tables["preview_entries"]
    own = previews.select("asset_id", "kind")
    moved = previews.join(pairs, previews["asset_id"] == pairs["orphan_id"]).withColumn("asset_id", F.col("active_id")).select(*previews.columns)
    moved = moved.join(own, ["asset_id", "kind"], "left_anti").select(*previews.columns).dropDuplicates(["asset_id", "kind"])
    out = delete_assets(tables, pairs.select(F.col("orphan_id").alias("asset_id")))
    out["preview_entries"] = out["preview_entries"].unionByName(moved)
    return out


def verify(assets: DataFrame, listing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Presence from a listing (path): the changed table, and one row of counts."""
    there = listing.select("path").distinct().withColumn("there", F.lit(True))
    rows = assets.join(there, "path", "left").withColumn("there", F.coalesce("there", F.lit(False)))
    counts = rows.agg(F.count_if("there").alias("present"), F.count_if(~F.col("there")).alias("missing"), F.count_if(~F.col("there") & F.col("exists_on_disk")).alias("newly_missing"), F.count_if(F.col("there") & ~F.col("exists_on_disk")).alias("recovered"))
    return rows.withColumn("exists_on_disk", F.col("there")).select(*assets.columns), counts


# collections


def list_collections(collections: DataFrame, items: DataFrame) -> DataFrame:
    counts = items.groupBy("collection_id").agg(F.count("*").alias("item_count"))
    return collections.join(counts, "collection_id", "left").withColumn("item_count", F.coalesce("item_count", F.lit(0))).orderBy("sort_order", "name", "collection_id")


def create_collection(collections: DataFrame, row: DataFrame) -> DataFrame:
    return collections.unionByName(row, allowMissingColumns=True)


def update_collection(collections: DataFrame, collection_id: str, **values: object) -> DataFrame:
    return partial_update(collections, "collection_id", collection_id, **values)


def delete_collection(collections: DataFrame, items: DataFrame, collection_id: str) -> tuple[DataFrame, DataFrame]:
    rest = F.col("collection_id") != collection_id
    return collections.filter(rest), items.filter(rest)


def add_items(items: DataFrame, rows: DataFrame) -> DataFrame:
    return insert_ignore(items, rows, ["collection_id", "asset_id"])


def remove_items(items: DataFrame, collection_id: str, ids: DataFrame) -> DataFrame:
    gone = ids.select(F.lit(collection_id).alias("collection_id"), "asset_id").distinct()
    return items.join(gone, ["collection_id", "asset_id"], "left_anti").select(*items.columns)


# tags and annotations


def merge_tags(raw: DataFrame, tags: DataFrame) -> DataFrame:
    """asset_id, position, tag: each raw tag in the spelling that the library
    has for it (of several the greatest), each once, at its first position."""
    known = tags.groupBy(normalize_tag(F.col("tag")).alias("norm")).agg(F.max("tag").alias("known"))
    rows = raw.withColumn("norm", normalize_tag(F.col("tag"))).filter("norm <> ''").join(known, "norm", "left")
    return rows.groupBy("asset_id", F.coalesce("known", F.trim("tag")).alias("tag")).agg(F.min("position").alias("position")).select("asset_id", "position", "tag")


def tags_in_languages(tags: DataFrame, languages: list[str]) -> DataFrame:
    """Without tags of a script that no chosen language uses; no choice keeps all."""
    zh, other = any(x.startswith("zh") for x in languages), any(not x.startswith("zh") for x in languages)
    if not languages or (zh and other):
        return tags
    return tags.filter(F.col("tag").rlike(CJK) if zh else ~F.col("tag").rlike(CJK))


def save_annotations(tables: Tables, rows: DataFrame, tags: DataFrame) -> Tables:
    """Upserts annotations; their ``ai`` tags are replaced, a user's stay."""
    notes = upsert(tables["asset_ai_annotations"], rows, ["asset_id"])
    old = tables["asset_tags"]
    replaced = rows.select("asset_id").distinct().withColumn("__hit", F.lit(True))
    kept = old.join(replaced, "asset_id", "left").filter(~(F.col("__hit").isNotNull() & (F.col("source") == "ai"))).select(*old.columns)
    new = merge_tags(tags, old).select("asset_id", "tag", F.lit("ai").alias("source"))
    return tables | {"asset_ai_annotations": notes, "asset_tags": insert_ignore(kept, new, ["asset_id", "tag"])}


def add_tag(tables: Tables, asset_id: str, tag: str, source: str = "user") -> Tables:
    """Adds a tag once and keeps the annotation's list in step."""
    spark = tables["asset_tags"].sparkSession
    row = spark.createDataFrame([(asset_id, tag.strip(), source)], "asset_id string, tag string, source string")
    return _with_lists(tables | {"asset_tags": insert_ignore(tables["asset_tags"], row, ["asset_id", "tag"])})


def remove_tag(tables: Tables, asset_id: str, tag: str) -> Tables:
    same = normalize_tag(F.col("tag")) == normalize_tag(F.lit(tag))
    return _with_lists(tables | {"asset_tags": tables["asset_tags"].filter(~((F.col("asset_id") == asset_id) & same))})


def _with_lists(tables: Tables) -> Tables:
    """Annotations whose list mirrors the tags; tagged assets without one get a row."""
    lists = tables["asset_tags"].groupBy("asset_id").agg(F.to_json(F.sort_array(F.collect_set("tag"))).alias("list"))
    notes = tables["asset_ai_annotations"]
    both = notes.join(lists, "asset_id", "full_outer").withColumn("tags_json", F.coalesce("list", F.lit("[]")))
    return tables | {"asset_ai_annotations": both.select(*notes.columns)}


def list_tags(tags: DataFrame, limit: int = 200) -> DataFrame:
    return tags.groupBy("tag").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "tag").limit(limit)


# settings and roots


def get_setting(settings: DataFrame, key: str) -> DataFrame:
    return settings.filter(F.col("setting_key") == key).select("setting_key", F.try_parse_json("value_json").alias("value"), "value_json")


def set_setting(settings: DataFrame, rows: DataFrame) -> DataFrame:
    return upsert(settings, rows, ["setting_key"])


def delete_setting(settings: DataFrame, key: str) -> DataFrame:
    return settings.filter(F.col("setting_key") != key)


def upsert_roots(roots: DataFrame, rows: DataFrame) -> DataFrame:
    return upsert(roots, rows, ["path"])


def active_roots(roots: DataFrame) -> DataFrame:
    return roots.filter("is_active").orderBy("root_type", "path")


def collapse_roots(roots: DataFrame) -> DataFrame:
    """Roots that lie in no other root: a root is looked up by each of its own
    ancestors, so roots aren't compared pairwise."""
    own = roots.select(F.rtrim(F.col("path"), F.lit("/")).alias("path")).distinct()
    parts = F.split("path", "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    inside = own.filter(F.size(parts) > 1).select("path", F.explode(ancestors).alias("up")).join(own.select(F.col("path").alias("up")), "up", "left_semi").select("path")
    return own.join(inside, "path", "left_anti")

