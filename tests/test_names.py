import datetime as dt

import pytest
from pyspark.sql import functions as F

from lumenstack.functions import faces, geo, names, scores


def one(spark, column, *values, schema="v string"):
    rows = spark.createDataFrame([v if isinstance(v, tuple) else (v,) for v in values], schema)
    return [r[0] for r in rows.select(column).collect()]


def test_stem_keys(spark):
    got = one(spark, names.stem_key(F.col("v")), "IMG_0412-2", "B0023524-2", "cover-final", "0Y1A6139-Edit", "img-12-3456", " A b.c_v2 (3)", "final", "ab-123-456-7", None)
    assert got == ["img-0412", "b0023524", "cover-final", "0y1a6139", "img", "a-b-c", "final", "ab-123", None]


def test_camera_tokens(spark):
    got = one(spark, names.camera_token(F.col("v")), "IMG_0412-2", "0Y1A6139-Edit", "B0023524", "DJI_20240101", "holiday", "")
    assert got == ["img-0412", "0y1a6139", "b0023524", "dji-20240101", None, None]


def test_origins(spark):
    stems = ["a_edited_crop", "b_ai-repaint_1", "plain", "_crop"]
    assert one(spark, names.origin_stem(F.col("v")), *stems) == ["a", "b", None, None]
    assert one(spark, names.origin_kind(F.col("v")), *stems) == ["crop", "ai_repaint", "import", "crop"]


def test_capture_times_and_replies(spark):
    got = one(spark, names.iso_time(names.capture_time(F.col("v"))), "2026:05:01 10:00:00", "2026-05-01 10:00:00", "nonsense", None)
    assert got == ["2026-05-01T10:00:00+00:00"] * 2 + [None, None]
    assert one(spark, names.json_in_reply(F.col("v")), '```json\n{"a": 1}\n```', 'so: {"a": {"b": 2}} done', "none") == ['{"a": 1}', '{"a": {"b": 2}}', None]


def test_paths(spark):
    assert one(spark, names.stem_of(F.col("v")), "/a/b.c.jpg", "/a/.hidden", "x") == ["b.c", ".hidden", "x"]
    assert one(spark, names.extension_of(F.col("v")), "/a/b.c.JPG", "/a.d/x", "x.") == ["jpg", "", ""]


@pytest.mark.parametrize(("seconds", "score"), [(5, 1.0), (60, 0.85), (300, 0.6), (3600, 0.3), (3601, 0.0)])
def test_timestamp_score(spark, seconds, score):
    t = dt.datetime(2026, 1, 1)
    rows = spark.createDataFrame([(t, t + dt.timedelta(seconds=seconds))], "a timestamp, b timestamp")
    assert rows.select(scores.timestamp_score(F.col("b"), F.col("a"))).first()[0] == score


def test_coordinates(spark):
    rows = spark.createDataFrame([("48.8", "2.3"), ("0", "0"), ("91", "0"), ("x", "1"), (None, "1")], "a string, b string")
    assert [r[0] for r in rows.select(geo.valid_coordinates(F.col("a"), F.col("b"))).collect()] == [True, False, False, False, False]


def test_face_checks(spark):
    good = ([0.0] * 4, [0.0] * 10, [1.0] + [0.0] * 511, 0.9)
    bad = ([0.0] * 3, None, [0.5] * 512, 1.2)
    rows = spark.createDataFrame([good, bad], "b array<double>, l array<double>, e array<float>, c double")
    got = [r[0] for r in rows.select(faces.face_problems(F.col("b"), F.col("l"), F.col("e"), F.col("c"))).collect()]
    assert got == [[], ["bbox", "landmarks", "confidence", "norm"]]
