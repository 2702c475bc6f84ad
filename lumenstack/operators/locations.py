"""Effective locations, the map, and how locations are kept.

A picture's effective location is its RAW's, as a whole row, if that has one,
else its own."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import RANKS, SOURCE_RANK, at_least_precise, overlaps, valid_coordinates
from .browse import BrowseSpec, Tables, facet_condition, latest_registry, scope, search, semi_facets, with_facets
from .generic import delete_keys, largest_per_group

FIELDS = ("latitude", "longitude", "min_latitude", "max_latitude", "min_longitude", "max_longitude", "source", "precision_level", "place_id")


def effective(pairs: DataFrame, locations: DataFrame, asset: str = "asset_id", raw: str = "raw_asset_id") -> DataFrame:
    """``pairs`` with the fields of the effective location (null without one) and
    ``from_raw``. Two left joins on unique keys."""
    packed = locations.select(F.col("asset_id").alias("__id"), F.struct(*FIELDS).alias("__loc"))
    out = pairs
    for key, name in ((raw, "__raw"), (asset, "__own")):
        side = packed.select(F.col("__id").alias(f"{name}_id"), F.col("__loc").alias(name))
        out = out.join(side, out[key] == side[f"{name}_id"], "left").drop(f"{name}_id")
    chosen = F.coalesce("__raw", "__own")
    return out.withColumns({**{f: chosen[f] for f in FIELDS}, "from_raw": F.col("__raw").isNotNull()}).drop("__raw", "__own")


def location_of(tables: Tables, asset_id: str) -> DataFrame:
    """The effective location of one picture; no row without one."""
    raw = latest_registry(tables["image_lookup_registry"]).select(F.col("image_asset_id").alias("asset_id"), "raw_asset_id")
    one = tables["assets"].filter(F.col("asset_id") == asset_id).select("asset_id").join(raw, "asset_id", "left")
    return effective(one, tables["asset_locations"]).filter("latitude is not null")


def geo_condition(geo: dict[str, Any]) -> Column | None:
    """The condition on a location row; None (no filter) if ``geo`` is malformed."""
    if not isinstance(geo, dict):
        return None
    if geo.get("mode") == "place" and geo.get("place_id"):
        out = F.col("place_id") == geo["place_id"]
    elif geo.get("mode") == "bounds":
        try:
            out = overlaps(*(float(geo[k]) for k in ("west", "south", "east", "north")))
        except (KeyError, TypeError, ValueError):
            return None
    else:
        return None
    for source in ("exif", "ai"):
        if not geo.get(f"include_{source}", True):
            out = out & (F.col("source") != source)
    if geo.get("min_precision") in RANKS:
        out = out & at_least_precise(F.col("precision_level"), geo["min_precision"])
    return out


def filter_geo(assets: DataFrame, tables: Tables, geo: dict[str, Any]) -> DataFrame:
    """Pictures one of whose RAWs lies there or, if no RAW has a location, that
    lie there themselves. The condition is pushed into the location scans."""
    condition = geo_condition(geo)
    if condition is None:
        return assets
    locations, raws = tables["asset_locations"], tables["image_lookup_registry"].select("image_asset_id", "raw_asset_id").filter("raw_asset_id is not null")
    by_raw = raws.join(locations.select(F.col("asset_id").alias("raw_asset_id")), "raw_asset_id", "left_semi").select(F.col("image_asset_id").alias("asset_id"))
    hit_raw = raws.join(locations.filter(condition).select(F.col("asset_id").alias("raw_asset_id")), "raw_asset_id", "left_semi").select(F.col("image_asset_id").alias("asset_id"))
    hit_own = locations.filter(condition).select("asset_id").join(by_raw, "asset_id", "left_anti")
    return assets.join(hit_raw.unionByName(hit_own), "asset_id", "left_semi")


def map_points(tables: Tables, spec: BrowseSpec = BrowseSpec(limit=100_000), min_precision: str = "locality", collection_id: str | None = None) -> DataFrame:
    """A point for each picture of the scope with a location precise enough; of
    a picture's registry rows the one with the least path counts."""
    registry = tables["image_lookup_registry"].select(F.col("image_asset_id").alias("asset_id"), "raw_asset_id", "image_path", F.col("status").alias("match_status"))
    rows = registry.join(with_facets(tables["assets"]), "asset_id").filter(scope(spec.status, spec.as_of) & facet_condition(spec.filters))
    if collection_id:
        rows = rows.join(tables["collection_items"].filter(F.col("collection_id") == collection_id).select("asset_id"), "asset_id", "left_semi")
    rows = search(semi_facets(rows, tables, spec.filters), tables, spec.search)
    placed = effective(rows.select("asset_id", "raw_asset_id", "image_path", "stem", "capture_time", "app_rating"), tables["asset_locations"])
    placed = placed.filter(F.col("latitude").isNotNull() & at_least_precise(F.col("precision_level"), min_precision))
    one = placed.groupBy("asset_id").agg(F.min_by(F.struct(*(c for c in placed.columns if c != "asset_id")), F.struct("image_path", "raw_asset_id")).alias("x"))
    return one.select("asset_id", "x.*").orderBy("asset_id").limit(spec.limit)


def cover_order() -> list[Column]:
    """Which picture stands for a cluster: rating, capture time, id."""
    return [F.coalesce("app_rating", F.lit(0)).desc(), F.col("capture_time").desc_nulls_last(), F.col("asset_id").asc()]


def map_clusters(points: DataFrame, zoom: int, max_zoom: int = 13) -> DataFrame:
    """Cells of a grid as wide as a marker at this zoom; past ``max_zoom`` each
    point is alone. An approximation of radius clustering."""
    size = 360.0 / (1 << zoom) * 52 / 256
    cell = [F.floor((F.col(c) + shift) / size).alias(name) for c, shift, name in (("longitude", 180.0, "cell_x"), ("latitude", 90.0, "cell_y"))]
    if zoom > max_zoom:
        cell = [F.col("longitude").alias("cell_x"), F.col("latitude").alias("cell_y")]
    best = F.max_by("asset_id", F.struct(F.coalesce("app_rating", F.lit(0)), "capture_time", "asset_id"))
    return points.groupBy(*cell).agg(F.count("*").alias("points"), F.avg("latitude").alias("latitude"), F.avg("longitude").alias("longitude"), best.alias("cover"))


# keeping locations


def merge_locations(current: DataFrame, found: DataFrame) -> DataFrame:
    """``found`` rows enter where nothing of a higher rank is: manual is never
    replaced, EXIF replaces AI and older EXIF, AI only AI."""
    rank = F.lit(0)
    for source, r in SOURCE_RANK.items():
        rank = F.when(F.col("source") == source, r).otherwise(rank)
    both = current.withColumn("__new", F.lit(0)).unionByName(found.select(*current.columns).withColumn("__new", F.lit(1)))
    manual_first = F.when((F.col("source") == "manual") & (F.col("__new") == 0), 2).otherwise(F.col("__new"))
    return largest_per_group(both.withColumn("__rank", rank), ["asset_id"], [F.col("__rank"), manual_first]).drop("__rank", "__new")


def exif_locations(assets: DataFrame) -> DataFrame:
    """Points from metadata with valid coordinates, in the columns of locations."""
    lat, lon = (F.get_json_object("metadata_json", f"$.gps_{k}").try_cast("double") for k in ("latitude", "longitude"))
    rows = assets.select("asset_id", lat.alias("latitude"), lon.alias("longitude")).filter(valid_coordinates(F.col("latitude"), F.col("longitude")))
    box = {f"{m}_{c}": F.col(c) for m in ("min", "max") for c in ("latitude", "longitude")}
    return rows.withColumns(box | {"location_id": F.concat(F.lit("loc_"), "asset_id"), "source": F.lit("exif"), "precision_level": F.lit("exact"), "place_id": F.lit(None).cast("string")})


def drop_stale_exif(locations: DataFrame, assets: DataFrame) -> DataFrame:
    """Without EXIF points of scanned assets whose metadata no longer has one."""
    stale = assets.select("asset_id").join(exif_locations(assets).select("asset_id"), "asset_id", "left_anti").withColumn("__stale", F.lit(True))
    return locations.join(stale, "asset_id", "left").filter(~((F.col("source") == "exif") & F.col("__stale").isNotNull())).drop("__stale")


def clear_ai_location(tables: Tables, asset_id: str) -> Tables:
    """Vetoes a guessed place: the annotation's place becomes null, an AI point goes."""
    notes = tables["asset_ai_annotations"]
    out = dict(tables)
    out["asset_ai_annotations"] = notes.withColumn("location_json", F.when(F.col("asset_id") == asset_id, F.lit(None)).otherwise(F.col("location_json")))
    out["asset_locations"] = tables["asset_locations"].filter(~((F.col("asset_id") == asset_id) & (F.col("source") == "ai")))
    return out


def delete_locations(locations: DataFrame, ids: DataFrame) -> DataFrame:
    return delete_keys(locations, ids.select("asset_id"), "asset_id")
