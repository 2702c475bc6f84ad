"""Schema versions: steps that turn a catalog's tables into the next version's."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.locations import exif_locations
from ..sources.schemas import TABLES, VERSION, schema

Tables = dict[str, DataFrame]


class MigrationError(RuntimeError):
    """The catalog's version is none that can be brought up to date."""


def _with_tables(tables: Tables, *names: str) -> Tables:
    spark = next(iter(tables.values())).sparkSession
    return tables | {n: spark.createDataFrame([], schema(n)) for n in names if n not in tables}


def _with_column(tables: Tables, name: str, column: str, kind: str) -> Tables:
    df = tables[name]
    return tables if column in df.columns else tables | {name: df.withColumn(column, F.lit(None).cast(kind))}


def to_3(t: Tables) -> Tables:
    return _with_column(_with_tables(t, "collections", "collection_items"), "assets", "app_rating", "int")


def to_4(t: Tables) -> Tables:
    return _with_tables(t, "asset_ai_annotations", "asset_tags", "resource_sets", "resource_set_items")


def to_5(t: Tables) -> Tables:
    return _with_column(_with_column(_with_tables(t, "deleted_files"), "jobs", "cancel_requested", "boolean"), "jobs", "pause_requested", "boolean")


def to_6(t: Tables) -> Tables:
    """The export registry becomes the image registry; types follow."""
    if "export_lookup_registry" in t:
        if "image_lookup_registry" in t and not t["image_lookup_registry"].isEmpty():
            raise MigrationError("both registries have rows")
        old = t["export_lookup_registry"].withColumnsRenamed({"export_path": "image_path", "export_asset_id": "image_asset_id"})
        t = {k: v for k, v in t.items() if k != "export_lookup_registry"} | {"image_lookup_registry": old}
    assets = t["assets"].withColumn("asset_type", F.when(F.col("asset_type") == "export", "image").otherwise(F.col("asset_type")))
    return t | {"assets": assets}


def to_7(t: Tables) -> Tables:
    return _with_tables(t, "face_models", "people_asset_index", "asset_faces", "person_groups", "person_group_faces")


def to_8(t: Tables) -> Tables:
    """Locations from the coordinates in metadata; those that are there stay."""
    t = _with_tables(t, "asset_locations")
    new = exif_locations(t["assets"]).join(t["asset_locations"].select("asset_id"), "asset_id", "left_anti")
    return t | {"asset_locations": t["asset_locations"].unionByName(new.select(*t["asset_locations"].columns))}


STEPS: dict[int, Callable[[Tables], Tables]] = {3: to_3, 4: to_4, 5: to_5, 6: to_6, 7: to_7, 8: to_8}


def migrate(tables: Tables, current: int, target: int = VERSION) -> Tables:
    """Applies the steps in order. Nothing is written: the caller publishes the
    result as a whole, or not at all."""
    if current > target:
        raise MigrationError(f"version {current} is newer than {target}")
    if current < 2:
        raise MigrationError(f"version {current} is too old")
    for version in range(current + 1, target + 1):
        tables = STEPS[version](tables)
    return {k: v for k, v in tables.items() if k in TABLES}
