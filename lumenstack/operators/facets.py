"""Facet values: counts of categories, ranges of numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import normal_extension
from .browse import Tables, with_facets
from .generic import min_max, value_counts

CATEGORIES = {"camera": "camera_model", "lens": "lens_model"}
NUMBERS = ("iso", "aperture", "focal_length", "shutter_speed", "capture_time")
SEARCHABLE = {**CATEGORIES, "tag": "tag", "extension": "extension"}
TAGS = 60


def tag_counts(tags: DataFrame, limit: int = TAGS) -> DataFrame:
    return value_counts(tags, "tag", limit)


def extension_counts(assets: DataFrame) -> DataFrame:
    return value_counts(assets.select(normal_extension(F.col("extension")).alias("extension")), "extension")


def ranges(assets: DataFrame, *columns: str) -> DataFrame:
    """All ranges in one pass: one row."""
    return min_max(assets, *columns)


def facet_values(tables: Tables) -> dict[str, DataFrame]:
    """Categories as value and count, and one row of ranges, of the pictures."""
    pictures = with_facets(tables["assets"].filter(F.col("asset_type") == "image"))
    out = {name: value_counts(pictures, column) for name, column in CATEGORIES.items()}
    return out | {"tag": tag_counts(tables["asset_tags"]), "extension": extension_counts(pictures), "ranges": ranges(pictures, *NUMBERS)}


def search_facet(tables: Tables, facet: str, text: str = "", limit: int = 50) -> DataFrame | None:
    """Counts of the values that contain ``text``; None for an unknown facet."""
    if facet not in SEARCHABLE:
        return None
    if facet == "tag":
        return value_counts(tables["asset_tags"], "tag", limit, text)
    pictures = with_facets(tables["assets"].filter(F.col("asset_type") == "image"))
    if facet == "extension":
        pictures = pictures.withColumn("extension", normal_extension(F.col("extension")))
    return value_counts(pictures, SEARCHABLE[facet], limit, text)
