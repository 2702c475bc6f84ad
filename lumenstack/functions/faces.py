"""Vectors and face geometry."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DIMENSIONS = 512


def _floats(blob: pd.Series) -> pd.Series:
    return pd.Series([None if b is None or len(b) % 4 else np.frombuffer(b, "<f4") for b in blob])


def decode_embedding(blob: Column) -> Column:
    """Little-endian 32-bit floats as an array; a blob of another form gives null."""
    return F.pandas_udf(_floats, "array<float>")(blob)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """The vector at length 1; the zero vector stays."""
    n = F.greatest(norm(a), F.lit(float(np.finfo(np.float32).eps)))
    return F.transform(a, lambda x: x.cast("double") / n)


def face_problems(bbox: Column, landmarks: Column, embedding: Column, confidence: Column, dimensions: int = DIMENSIONS) -> Column:
    """What is wrong with a face row; empty for a valid one."""
    checks = [
        ("bbox", F.coalesce(F.size(bbox) == 4, F.lit(False))),
        ("landmarks", F.coalesce(F.size(landmarks) == 10, F.lit(False))),
        ("embedding", F.coalesce(F.size(embedding) == dimensions, F.lit(False))),
        ("confidence", F.coalesce(confidence.between(0, 1), F.lit(False))),
        ("norm", F.coalesce(F.abs(norm(embedding) - 1) <= 0.01, F.lit(False))),
    ]
    return F.array_compact(F.array(*(F.when(~ok, name) for name, ok in checks)))


def face_quality(width: Column, height: Column, least: int = 56) -> Column:
    return F.when(F.least(width, height) < least, "low").otherwise("standard")


def plausible_face(confidence: Column, width: Column, height: Column, landmarks: Column) -> Column:
    """Confident and large enough, eyes level and apart, nose and mouth below
    them. Landmarks: x and y of both eyes, nose, both mouth corners."""
    x, y = [landmarks[2 * i] for i in range(5)], [landmarks[2 * i + 1] for i in range(5)]
    eye = (y[0] + y[1]) / 2
    mouth = (y[3] + y[4]) / 2
    apart = F.abs(x[1] - x[0])
    shape = (apart >= 0.15 * width) & (F.abs(y[1] - y[0]) <= apart) & (eye < mouth) & y[2].between(eye - 0.1 * height, mouth + 0.1 * height)
    return (confidence >= 0.65) & (F.least(width, height) >= 48) & F.coalesce(shape, F.lit(False))
