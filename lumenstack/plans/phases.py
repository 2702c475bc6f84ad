"""Import as a sequence of phases over a catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import stable_id
from ..operators import library, matching, versions
from ..sources import embedded, listing
from ..sources.store import Catalog


def import_phases(mode: str, has_raws: bool, has_images: bool, hd: bool = True) -> list[str]:
    """Which phases an import runs."""
    out = ["scan_raw"] if has_raws and mode in ("combined", "raw") else []
    if has_images and mode in ("combined", "images"):
        out += ["match_images", "preview", *(["hd"] if hd else [])]
    return out


def as_assets(rows: DataFrame, kind: str) -> DataFrame:
    """Extracted files in the columns of assets."""
    meta = F.to_json(F.struct("camera_make", "camera_model", "lens_model", "iso", "aperture", "shutter_speed", "focal_length", "capture_time", "width", "height", "gps_latitude", "gps_longitude", "rating"))
    return rows.withColumns({"asset_id": stable_id(kind, F.col("fingerprint"), F.col("path")), "asset_type": F.lit(kind), "exists_on_disk": F.lit(True), "metadata_json": meta, "app_rating": F.col("rating")})


def run_import(catalog: Catalog, raw_dirs: list[str], image_dirs: list[str], mode: str = "combined", respect_tombstones: bool = False) -> dict[str, int]:
    """Scan, match, attach to stacks; one publication at the end. Previews are
    pixels and not made here."""
    tables, spark = catalog.tables(), catalog.spark
    known = tables["assets"]
    changed: dict[str, DataFrame] = {}
    counts: dict[str, int] = {}
    phases = import_phases(mode, bool(raw_dirs), bool(image_dirs), hd=False)
    raws = known.filter(F.col("asset_type") == "raw")
    if "scan_raw" in phases:
        files = listing.list_files(spark, *raw_dirs)
        files = files.filter(listing.raw_format(F.col("path"), F.col("content")).isNotNull())
        new = as_assets(embedded.scan(files, raws), "raw").cache()
        counts["scanned"] = new.count()
        known = library.upsert_assets(known, new)
        changed["assets"] = known
    if "match_images" in phases:
        files = listing.named(listing.list_files(spark, *image_dirs)).filter(F.col("extension").isin(*listing.IMAGES) & listing.ready(F.col("path"), F.col("file_size"), F.col("content")))
        if respect_tombstones:
            hidden, _ = listing.split_tombstoned(files, tables["deleted_files"])
            files = files.join(hidden.select("path"), "path", "left_anti")
        images = as_assets(embedded.scan(files, known.filter(F.col("asset_type") == "image"), profile="full", mode="head-tail"), "image").cache()
        counts["images"] = images.count()
        known = library.upsert_assets(known, images).cache()
        facet = lambda c, t="string": F.get_json_object("metadata_json", f"$.{c}").try_cast(t)
        typed = known.select("asset_id", "asset_type", "path", "stem", facet("capture_time", "timestamp").alias("capture_time"), facet("camera_model").alias("camera_model"), facet("lens_model").alias("lens_model"), (facet("width", "double") / F.nullif(facet("height", "double"), F.lit(0))).alias("aspect_ratio"))
        i = typed.filter(F.col("asset_type") == "image").join(images.select("path"), "path", "left_semi").withColumnRenamed("asset_id", "image_id")
        r = typed.filter(F.col("asset_type") == "raw").withColumnRenamed("asset_id", "raw_id")
        decided = matching.resolve(i.drop("asset_type"), r.drop("asset_type", "path")).join(i.select("image_id", F.col("path").alias("image_path")), "image_id").cache()
        counts |= {x["status"]: x["count"] for x in matching.status_counts(decided).collect()}
        registry = decided.select("image_path", F.col("image_id").alias("image_asset_id"), F.col("raw_id").alias("raw_asset_id"), "status", "score", F.to_json("candidates").alias("candidates_json"))
        changed["assets"] = known
        changed["image_lookup_registry"] = library.upsert_registry(tables["image_lookup_registry"], registry, None)
        changed["resource_sets"], changed["resource_set_items"] = versions.create_sets(tables["resource_sets"], tables["resource_set_items"], versions.without_set(known, tables["resource_set_items"]))
    catalog.write(changed)
    return counts
