"""Browsing: a scope, a search, facets, an order and a page over the catalog.

Tables come as a dict of DataFrames by name (``sources.schemas`` has the
names). Catalyst sees one plan: facets become filters that are pushed to the
scans, EXISTS conditions semi and anti joins, and the page a top-k.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import json_number, like_pattern, normal_extension
from .generic import largest_per_group

Tables = dict[str, DataFrame]
SCOPES = ("all", "matched", "unmatched", "rated", "recent")
MATCHED = ("auto_bound", "manual_confirmed")
OPEN = ("unmatched", "pending_confirmation")
#: facet → (JSON path, type): what a view derives from the metadata column
JSON_FACETS = {
    "camera_model": ("$.camera_model", "string"),
    "lens_model": ("$.lens_model", "string"),
    "iso": ("$.iso", "int"),
    "aperture": ("$.aperture", "double"),
    "shutter_speed": ("$.shutter_speed", "double"),
    "focal_length": ("$.focal_length", "double"),
    "capture_time": ("$.capture_time", "timestamp"),
    "width": ("$.width", "int"),
    "height": ("$.height", "int"),
}
RANGES = {"iso": "iso", "aperture": "aperture", "focal": "focal_length", "shutter": "shutter_speed"}


@dataclass(frozen=True)
class BrowseSpec:
    status: str = "all"
    search: str | None = None
    filters: dict[str, Any] = field(default_factory=dict)
    sort: str | None = None
    limit: int = 120
    offset: int = 0
    as_of: dt.datetime | None = None


def with_facets(assets: DataFrame) -> DataFrame:
    """Adds the typed facet columns that the table doesn't already hold."""
    missing = {name: json_number(F.col("metadata_json"), path, kind) for name, (path, kind) in JSON_FACETS.items() if name not in assets.columns}
    return assets.withColumns(missing)


def scope(status: str, as_of: dt.datetime | None = None, registry_status: str = "match_status", rating: str = "app_rating", created: str = "created_at") -> Column:
    """The condition of a scope. ``recent``: created in the seven days to ``as_of``."""
    if status == "all":
        return F.lit(True)
    if status == "matched":
        return F.col(registry_status).isin(*MATCHED)
    if status == "unmatched":
        return F.col(registry_status).isin(*OPEN)
    if status == "rated":
        return F.col(rating) > 0
    if status == "recent":
        now = F.lit(as_of) if as_of else F.current_timestamp()
        return F.col(created) >= now - F.expr("INTERVAL 7 DAYS")
    raise ValueError(f"no such scope: {status}")


def search_columns(search: str | None, *columns: str) -> Column:
    """Substring search, without regard to case, in any of the columns."""
    if not search:
        return F.lit(True)
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.col(c).ilike(like_pattern(search)), F.lit(False))
    return out


def search(assets: DataFrame, tables: Tables, text: str | None) -> DataFrame:
    """Rows whose name, path, camera, lens, caption, text or tag contains ``text``."""
    if not text:
        return assets
    notes = tables["asset_ai_annotations"].filter(search_columns(text, "caption", "detected_text")).select("asset_id")
    tags = tables["asset_tags"].filter(search_columns(text, "tag")).select("asset_id")
    found = notes.unionByName(tags).distinct().withColumn("__found", F.lit(True))
    return assets.join(found, "asset_id", "left").filter(search_columns(text, "stem", "path", "camera_model", "lens_model") | F.col("__found").isNotNull()).drop("__found")


def _day(value: str) -> Column:
    return F.try_to_timestamp(F.lit(value)).cast("date")


def facet_condition(filters: dict[str, Any]) -> Column:
    """The conditions on columns of one row; unknown keys are ignored."""
    out = F.lit(True)
    for key, column in (("camera", "camera_model"), ("lens", "lens_model")):
        if filters.get(key):
            out = out & (F.col(column) == filters[key])
    for key, column in RANGES.items():
        if filters.get(f"{key}_min") is not None:
            out = out & (F.col(column) >= float(filters[f"{key}_min"]))
        if filters.get(f"{key}_max") is not None:
            out = out & (F.col(column) <= float(filters[f"{key}_max"]))
    if filters.get("date_from"):
        out = out & (F.col("capture_time").cast("date") >= _day(filters["date_from"]))
    if filters.get("date_to"):
        out = out & (F.col("capture_time").cast("date") <= _day(filters["date_to"]))
    if filters.get("rating_min") is not None:
        out = out & (F.col("app_rating") >= int(filters["rating_min"]))
    if filters.get("orientation"):
        out = out & orientation(filters["orientation"])
    if filters.get("extension"):
        out = out & (normal_extension(F.col("extension")) == filters["extension"].strip(".").lower())
    return out


def orientation(which: str, width: str = "width", height: str = "height") -> Column:
    w, h = F.col(width), F.col(height)
    return {"portrait": h > w, "landscape": w > h, "square": w == h}.get(which, F.lit(True))


def semi_facets(assets: DataFrame, tables: Tables, filters: dict[str, Any]) -> DataFrame:
    """Facets that ask whether rows of another table exist."""
    if filters.get("tag"):
        assets = assets.join(tables["asset_tags"].filter(F.col("tag") == filters["tag"]).select("asset_id"), "asset_id", "left_semi")
    for key, table in (("people", "asset_faces"), ("annotated", "asset_ai_annotations")):
        if filters.get(key) is not None:
            assets = assets.join(tables[table].select("asset_id"), "asset_id", "left_semi" if filters[key] else "left_anti")
    if filters.get("person_group"):
        members = tables["person_group_faces"].filter((F.col("group_id") == filters["person_group"]) & (F.col("membership_state") != "rejected")).select("face_id")
        assets = assets.join(tables["asset_faces"].join(members, "face_id", "left_semi").select("asset_id"), "asset_id", "left_semi")
    if filters.get("geo"):
        from .locations import filter_geo

        assets = filter_geo(assets, tables, filters["geo"])
    return assets


ORDERS: dict[str, tuple[str, bool]] = {"name-asc": ("stem", True), "name-desc": ("stem", False), "imported-asc": ("created_at", True), "imported-desc": ("created_at", False), "captured-asc": ("capture_time", True), "captured-desc": ("capture_time", False), "rating-desc": ("app_rating", False)}


def order_by(sort: str | None, tie: str = "path") -> list[Column]:
    """A named order; unknown names mean name-asc. Rated rows precede unrated
    (null or 0) ones; elsewhere nulls are least. ``tie`` makes it total."""
    column, up = ORDERS.get(sort or "", ORDERS["name-asc"])
    if column == "app_rating":
        return [F.coalesce(F.col(column), F.lit(0)).desc(), F.lower("stem").asc_nulls_first(), F.col(tie).asc_nulls_first()]
    key = F.lower(column) if column == "stem" else F.col(column)
    return [key.asc_nulls_first() if up else key.desc_nulls_last(), F.col(tie).asc_nulls_first()]


def page(df: DataFrame, order: list[Column], limit: int = 120, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def version_counts(tables: Tables) -> DataFrame:
    return tables["resource_set_items"].groupBy("set_id").agg(F.count("*").alias("version_count"))


def shared_columns(rows: DataFrame, tables: Tables) -> DataFrame:
    """Left joins that browse, detail and collections share: the bound RAW, the
    version stack with its size and primary, ready previews, the annotation,
    and whether there is a face. Each right side is reduced before its join."""
    raw = tables["assets"].select(F.col("asset_id").alias("raw_asset_id"), F.col("path").alias("raw_path"), F.col("stem").alias("raw_stem"), F.col("extension").alias("raw_extension"))
    items = tables["resource_set_items"].select("set_id", "asset_id", "role", "version_kind")
    sets = tables["resource_sets"].select("set_id", "primary_asset_id")
    primary = tables["assets"].select(F.col("asset_id").alias("primary_asset_id"), F.col("path").alias("primary_path"))
    ready = lambda kind, name: tables["preview_entries"].filter((F.col("kind") == kind) & (F.col("status") == "ready")).select("asset_id", F.col("relative_path").alias(name)).dropDuplicates(["asset_id"])
    notes = tables["asset_ai_annotations"].select("asset_id", "caption", "tags_json", "location_json")
    faces = tables["asset_faces"].select("asset_id").distinct().withColumn("has_face", F.lit(True))
    out = rows.join(raw, "raw_asset_id", "left").join(items, "asset_id", "left").join(sets, "set_id", "left").join(primary, "primary_asset_id", "left").join(version_counts(tables), "set_id", "left")
    out = out.join(ready("preview", "preview_path"), "asset_id", "left").join(ready("hd", "hd_path"), "asset_id", "left").join(notes, "asset_id", "left").join(faces, "asset_id", "left")
    return out.withColumns({"has_face": F.coalesce("has_face", F.lit(False)), "version_count": F.coalesce("version_count", F.lit(0))})


def registered(tables: Tables) -> DataFrame:
    """The universe of browsing: registry rows with their picture. An asset that
    two registry rows share comes twice."""
    registry = tables["image_lookup_registry"].select(F.col("image_asset_id").alias("asset_id"), "raw_asset_id", "image_path", F.col("status").alias("match_status"), F.col("score").alias("match_score"))
    return registry.join(with_facets(tables["assets"]), "asset_id")


def filtered(tables: Tables, spec: BrowseSpec) -> DataFrame:
    rows = registered(tables).filter(scope(spec.status, spec.as_of) & facet_condition(spec.filters))
    return search(semi_facets(rows, tables, spec.filters), tables, spec.search)


def browse(tables: Tables, spec: BrowseSpec = BrowseSpec()) -> DataFrame:
    """One page. The page is cut before the shared left joins, which then serve
    ``limit`` rows; their keys are unique, so they neither add nor drop any."""
    order = order_by(spec.sort, "image_path")
    return shared_columns(page(filtered(tables, spec), order, spec.limit, spec.offset), tables).orderBy(*order)


def count(tables: Tables, spec: BrowseSpec = BrowseSpec()) -> int:
    return filtered(tables, spec).count()


def browse_collection(tables: Tables, collection_id: str, limit: int = 120, offset: int = 0) -> DataFrame:
    """A page of a collection, latest additions first, then by name."""
    members = tables["collection_items"].filter(F.col("collection_id") == collection_id).select("asset_id", "added_at")
    order = [F.col("added_at").desc_nulls_last(), F.lower("stem").asc_nulls_first(), F.col("image_path").asc_nulls_first()]
    return shared_columns(page(registered(tables).join(members, "asset_id"), order, limit, offset), tables).orderBy(*order)


def latest_registry(registry: DataFrame) -> DataFrame:
    """The one registry row of each picture: last updated, created, greatest path."""
    return largest_per_group(registry, ["image_asset_id"], [F.col("updated_at"), F.col("created_at"), F.col("image_path")])


def detail(tables: Tables, asset_id: str) -> DataFrame:
    """One row about a picture; it need not be registered."""
    one = with_facets(tables["assets"]).filter(F.col("asset_id") == asset_id)
    last = latest_registry(tables["image_lookup_registry"].filter(F.col("image_asset_id") == asset_id)).select(F.col("image_asset_id").alias("asset_id"), "raw_asset_id", "image_path", F.col("status").alias("match_status"), F.col("score").alias("match_score"))
    return shared_columns(one.join(last, "asset_id", "left"), tables)


def detail_by_path(tables: Tables, path: str) -> DataFrame:
    last = tables["image_lookup_registry"].filter(F.col("image_path") == path).select(F.col("image_asset_id").alias("asset_id"), "raw_asset_id", "image_path", F.col("status").alias("match_status"), F.col("score").alias("match_score"))
    pictures = with_facets(tables["assets"]).filter(F.col("asset_type") == "image")
    return shared_columns(pictures.join(last, "asset_id"), tables)


def version_siblings(tables: Tables, set_id: str, exclude: str) -> DataFrame:
    """The other members of a version stack, in its order, with ready previews."""
    members = tables["resource_set_items"].filter((F.col("set_id") == set_id) & (F.col("asset_id") != exclude))
    previews = tables["preview_entries"].filter((F.col("kind") == "preview") & (F.col("status") == "ready")).select("asset_id", F.col("relative_path").alias("preview_path")).dropDuplicates(["asset_id"])
    return members.join(tables["assets"].select("asset_id", "path", "stem"), "asset_id").join(previews, "asset_id", "left").orderBy("sort_order", "asset_id")


def duplicates_of(assets: DataFrame, asset_id: str) -> DataFrame:
    """Other pictures with the same fingerprint."""
    own = assets.filter(F.col("asset_id") == asset_id).select("fingerprint")
    return assets.filter((F.col("asset_type") == "image") & (F.col("asset_id") != asset_id)).join(own, "fingerprint", "left_semi").orderBy("path")


def duplicate_sets(assets: DataFrame, key: str, member: str) -> DataFrame:
    """Members of every key that several rows have, with their number: the
    self-join on equal keys without its pairs."""
    groups = assets.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("copies")).filter("copies > 1")
    return assets.join(groups, key).select(member, key, "copies")


def previews_to_make(assets: DataFrame, previews: DataFrame, kind: str = "preview", asset_type: str | None = None, under: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Present assets (of a type, at or under given paths), those without a ready preview first."""
    rows = assets.filter("exists_on_disk")
    if asset_type:
        rows = rows.filter(F.col("asset_type") == asset_type)
    if under is not None:
        rows = rows.filter(at_or_under(F.col("path"), under))
    state = previews.filter(F.col("kind") == kind).select("asset_id", F.col("status").alias("preview_status")).dropDuplicates(["asset_id"])
    rows = with_facets(rows).join(state, "asset_id", "left")
    out = rows.orderBy(F.when(F.col("preview_status") == "ready", 1).otherwise(0), "asset_type", F.lower("stem"), "path")
    return out.limit(limit) if limit is not None else out


def at_or_under(path: Column, roots: list[str]) -> Column:
    """Whether a path is one of the roots or lies below one; no roots: false."""
    out = F.lit(False)
    for root in roots:
        bare = root.rstrip("/")
        out = out | (path == bare) | path.startswith(bare + "/")
    return out


def to_annotate(tables: Tables, asset_type: str = "image", only_missing: bool = True, asset_ids: list[str] | None = None, collection_id: str | None = None, limit: int | None = None) -> DataFrame:
    """What an annotation run covers; an empty list of ids covers nothing."""
    kinds = ["raw"] if asset_type == "raw" else ["image", "video"]
    rows = tables["assets"].filter(F.col("exists_on_disk") & F.col("asset_type").isin(*kinds))
    if asset_ids is not None:
        rows = rows.filter(F.col("asset_id").isin(*asset_ids)) if asset_ids else rows.filter(F.lit(False))
    if collection_id:
        rows = rows.join(tables["collection_items"].filter(F.col("collection_id") == collection_id).select("asset_id"), "asset_id", "left_semi")
    if only_missing:
        rows = rows.join(tables["asset_ai_annotations"].select("asset_id"), "asset_id", "left_anti")
    out = rows.orderBy("created_at", "asset_id")
    return out.limit(limit) if limit is not None else out


def to_enrich(cache: DataFrame, roots: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """RAW rows without full metadata, oldest first."""
    rows = cache.filter((F.col("metadata_level") != "full") | (F.col("enrichment_status") != "done"))
    if roots:
        rows = rows.filter(at_or_under(F.col("path"), roots))
    out = rows.orderBy(F.col("updated_at").asc_nulls_first(), "path")
    return out.limit(limit) if limit is not None else out


def pending(registry: DataFrame) -> DataFrame:
    return registry.filter(F.col("status") == "pending_confirmation").orderBy(F.col("updated_at").desc_nulls_last(), "image_path")
