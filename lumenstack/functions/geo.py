"""Coordinates, precision ranks and viewports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RANKS = {"exact": 3, "locality": 2, "admin1": 1, "country": 0}
HALF_SIZES = {"exact": 0.0, "locality": 0.15, "admin1": 1.5, "country": 4.0}
SOURCE_RANK = {"manual": 3, "exif": 2, "ai": 1}


def valid_coordinates(lat: Column, lon: Column) -> Column:
    """Numbers in range, and not the null island; never null."""
    lat, lon = lat.try_cast("double"), lon.try_cast("double")
    return F.coalesce(lat.between(-90, 90) & lon.between(-180, 180) & ~((lat == 0) & (lon == 0)), F.lit(False))


def gps_degrees(parts: Column, reference: Column) -> Column:
    """Degrees, minutes and seconds with a hemisphere letter, as signed degrees."""
    d = parts[0].cast("double") + parts[1].cast("double") / 60 + parts[2].cast("double") / 3600
    return F.when(F.size(parts) >= 3, F.when(F.upper(reference).isin("S", "W"), -d).otherwise(d))


def precision_rank(level: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, rank in RANKS.items():
        out = F.when(level == name, rank).otherwise(out)
    return out


def at_least_precise(level: Column, least: str) -> Column:
    return level.isin(*(n for n, r in RANKS.items() if r >= RANKS[least]))


def degrees_apart(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Equirectangular distance in degrees."""
    dlon = (lon1 - lon2) * F.cos(F.radians((lat1 + lat2) / 2))
    return F.sqrt((lat1 - lat2) ** 2 + dlon**2)


def box_around(lat: Column, lon: Column, half: Column) -> dict[str, Column]:
    return {"min_latitude": F.greatest(F.lit(-90.0), lat - half), "max_latitude": F.least(F.lit(90.0), lat + half), "min_longitude": F.greatest(F.lit(-180.0), lon - half), "max_longitude": F.least(F.lit(180.0), lon + half)}


def overlaps(west: float, south: float, east: float, north: float, prefix: str = "") -> Column:
    """Whether a row's box meets the viewport; one with west > east crosses the
    antimeridian. Plain comparisons, so that they reach the scan."""
    c = lambda n: F.col(prefix + n)
    lat = (c("max_latitude") >= south) & (c("min_latitude") <= north)
    if west <= east:
        return lat & (c("max_longitude") >= west) & (c("min_longitude") <= east)
    return lat & ((c("max_longitude") >= west) | (c("min_longitude") <= east))
