"""Feature scores that compare a picture with a source file."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

WEIGHTS = {"exact_stem_key": 0.62, "alnum_stem_key": 0.14, "stem_similarity": 0.12, "capture_time": 0.06, "camera_model": 0.03, "lens_model": 0.01, "aspect_ratio": 0.02}


def _gestalt(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x.lower(), y.lower()).ratio() for x, y in zip(a, b)], dtype="float64")


def stem_similarity(a: Column, b: Column) -> Column:
    """Ratcliff-Obershelp ratio of lower-cased names. There is no built-in for
    it; of equal names nothing is sent to Python but nulls."""
    same = F.lower(a) == F.lower(b)
    return F.when(same, 1.0).otherwise(F.pandas_udf(_gestalt, "double")(F.when(~same, a), F.when(~same, b)))


def seconds_apart(a: Column, b: Column) -> Column:
    return F.abs(F.unix_micros(a) - F.unix_micros(b)) / 1e6


def timestamp_score(a: Column, b: Column) -> Column:
    d = seconds_apart(a, b)
    return F.when(d <= 5, 1.0).when(d <= 60, 0.85).when(d <= 300, 0.6).when(d <= 3600, 0.3).otherwise(0.0)


def same_text_score(a: Column, b: Column) -> Column:
    """1 if both are there and equal but for case (cameras, lenses)."""
    return F.when((a != "") & (b != "") & (F.lower(a) == F.lower(b)), 1.0).otherwise(0.0)


def aspect_ratio(width: Column, height: Column) -> Column:
    return F.when((width != 0) & (height != 0), width / height)


def aspect_score(a: Column, b: Column) -> Column:
    d = F.abs(a - b)
    return F.when(d <= 0.01, 1.0).when(d <= 0.05, 0.6).otherwise(0.0)


def equal_score(a: Column, b: Column) -> Column:
    return F.when((a != "") & (b != "") & (a == b), 1.0).otherwise(0.0)


def weighted(features: dict[str, Column]) -> Column:
    """The weighted sum, to four digits."""
    total = F.lit(0.0)
    for name, weight in WEIGHTS.items():
        total = total + F.lit(weight) * features[name]
    return F.round(total, 4)
