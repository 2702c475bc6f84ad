"""Operators on small catalogs: matching, browsing, places, people, jobs, stacks."""

import datetime as dt
import struct

import numpy as np
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from lumenstack.operators import browse, facets, generic, jobs, library, locations, matching, people, places, reports, vectors, versions
from lumenstack.plans import migrations, phases, verbs
from lumenstack.sources import embedded, listing, schemas
from lumenstack.sources.store import Catalog

T0 = dt.datetime(2026, 5, 1, 10)


def rows(spark, table, *values):
    """Rows of a catalog table from dicts; what isn't given is null."""
    kind = schemas.schema(table)
    return spark.createDataFrame([tuple(v.get(f.name) for f in kind) for v in values], kind)


def empty_tables(spark):
    return {name: rows(spark, name) for name in schemas.TABLES}


def files(spark, prefix, *values):
    names = ("stem", "capture_time", "camera_model", "lens_model", "aspect_ratio")
    data = [(f"{prefix}{i}", *(v.get(n) for n in names)) for i, v in enumerate(values)]
    key = "image_id" if prefix == "i" else "raw_id"
    return spark.createDataFrame(data, f"{key} string, stem string, capture_time timestamp, camera_model string, lens_model string, aspect_ratio double")


def decisions(spark, images, raws, **kw):
    out = matching.resolve(files(spark, "i", *images), files(spark, "r", *raws), **kw)
    return {r.image_id: r for r in out.collect()}


def test_matching_rules(spark):
    got = decisions(
        spark,
        [{"stem": "B0023524-2"}, {"stem": "cover-final"}, {"stem": "IMG_4274"}],
        [{"stem": "B0023524"}, {"stem": "IMG_3746"}],
    )
    assert (got["i0"].status, got["i0"].score, got["i0"].raw_id) == ("pending_confirmation", 0.88, "r0")
    assert (got["i1"].status, got["i1"].raw_id) == ("unmatched", None)
    assert got["i2"].status == "unmatched" and got["i2"].candidates == []


def test_matching_vetoes_and_sticky(spark):
    image, raw = {"stem": "IMG_1001", "camera_model": "R6", "capture_time": T0}, {"stem": "IMG_1001", "camera_model": "x100", "capture_time": T0}
    assert decisions(spark, [image], [raw])["i0"].status == "unmatched"
    late = raw | {"camera_model": "r6", "capture_time": T0 + dt.timedelta(hours=7)}
    assert decisions(spark, [image], [late])["i0"].status == "unmatched"
    previous = spark.createDataFrame([("i0", "manual_confirmed", "r9", 0.7)], "image_id string, status string, raw_id string, score double")
    assert decisions(spark, [image], [late], previous=previous, refresh=True)["i0"].raw_id == "r9"


def test_nearest_times_prefer_own_camera(spark):
    images = files(spark, "i", {"stem": "a", "capture_time": T0, "camera_model": "c"})
    raws = files(spark, "r", *({"stem": "b", "capture_time": T0 + dt.timedelta(days=d), "camera_model": "c" if d == 300 else "d"} for d in (1, 2, 300, -4)))
    raws = raws.select("raw_id", F.col("capture_time").alias("r_time"), F.col("camera_model").alias("r_camera"))
    got = [r.raw_id for r in matching.nearest_times(images, raws, 3).orderBy("micros_apart").collect()]
    assert sorted(got) == ["r0", "r1", "r2"]


def test_nearest_times_equal_brute_force(spark):
    import random

    r = random.Random(2)
    at = lambda: T0 + dt.timedelta(seconds=r.choice([0, 0, 1, 59, 60, 61, 86_399, 86_400, r.randrange(400_000)]))
    images = [(f"i{n}", at(), r.choice(["c", "d", None, "none"])) for n in range(60)]
    raws = [(f"r{n:03}", at(), r.choice(["c", "d", "e", None])) for n in range(150)]
    i = spark.createDataFrame(images, "image_id string, capture_time timestamp, camera_model string")
    w = spark.createDataFrame(raws, "raw_id string, r_time timestamp, r_camera string")
    got = {}
    for x in matching.nearest_times(i, w, 5).collect():
        got.setdefault(x.image_id, []).append(x.raw_id)
    for n, t, camera in images:
        order = sorted(raws, key=lambda x: (camera is None or x[2] != camera, abs(x[1] - t), x[0]))
        assert sorted(got[n]) == sorted(x[0] for x in order[:5])


def test_recall_stages(spark):
    day = lambda d: T0 + dt.timedelta(days=d)
    raws = [{"stem": "sunset_0001x", "capture_time": day(0), "camera_model": "c"}, {"stem": "sunset_0001y", "camera_model": "d"}, {"stem": "forest", "capture_time": day(9), "camera_model": "c"}, {"stem": "forest", "capture_time": day(5), "camera_model": "e"}]
    r = files(spark, "r", *raws).withColumn("cached_at", F.when(F.col("raw_id") == "r3", F.lit(day(3))).otherwise(F.lit(day(1))))
    images = [{"stem": "forest"}, {"stem": "sunset.0001"}, {"stem": "IMG_7777"}, {"stem": "a", "capture_time": day(2), "camera_model": "c"}, {"stem": "b", "capture_time": day(2), "camera_model": "zz"}, {"stem": "c", "camera_model": "d"}, {"stem": "d"}]
    i, r = matching.prepared(files(spark, "i", *images), r)

    def found(k):
        out = {}
        for x in matching.recall(i, r, k).orderBy("image_id", "nth").collect():
            out.setdefault(x.image_id, (x.stage, []))[1].append(x.raw_id)
        return out

    assert found(200) == {"i0": (1, ["r3", "r2"]), "i1": (2, ["r0", "r1"]), "i3": (3, ["r0", "r2"]), "i4": (3, ["r0", "r3", "r2"]), "i5": (4, ["r1"]), "i6": (5, ["r3", "r0", "r1", "r2"])}
    assert found(1)["i0"] == (1, ["r3"]) and found(1)["i6"] == (5, ["r3"])
    assert matching.recall(i.filter("false"), r).count() == 0 and {x[0] for x in matching.recall(i, r.filter("false")).collect()} == set()
    pairs = matching.paired(i, r, matching.recall(i, r)).withColumn("similarity", F.lit(0.1))
    why = {(x.image_id, x.raw_id): x.why for x in pairs.select("image_id", "raw_id", matching.vetoes().alias("why")).collect()}
    assert why["i3", "r2"] == ["filename_family_conflict", "capture_time_window_exceeded"] and why["i4", "r3"] == ["filename_family_conflict", "camera_model_conflict", "capture_time_window_exceeded"]


def _catalog(spark):
    t = empty_tables(spark)
    meta = '{"camera_model": "R6", "iso": 200, "width": %d, "height": 400, "capture_time": "2026-05-0%d 10:00:00"}'
    t["assets"] = rows(spark, "assets", *({"asset_id": f"a{k}", "asset_type": "image", "path": f"/p/{n}.jpg", "stem": n, "extension": ".JPG", "metadata_json": meta % (300 + 100 * k, k + 1), "app_rating": k, "created_at": T0, "fingerprint": f"f{k % 2}", "exists_on_disk": True} for k, n in enumerate(["Paris", "tokyo", "fiji", "50%_off\\x"])))
    t["image_lookup_registry"] = rows(spark, "image_lookup_registry", *({"image_path": f"/p/{k}", "image_asset_id": f"a{k}", "raw_asset_id": f"raw{k}" if k < 2 else None, "status": "auto_bound" if k < 2 else "unmatched"} for k in range(4)))
    t["asset_tags"] = rows(spark, "asset_tags", {"asset_id": "a1", "tag": "night", "source": "user"}, {"asset_id": "a2", "tag": "night", "source": "ai"})
    box = lambda lat, lon: {"latitude": lat, "longitude": lon, "min_latitude": lat, "max_latitude": lat, "min_longitude": lon, "max_longitude": lon}
    t["asset_locations"] = rows(
        spark, "asset_locations",
        {"asset_id": "a0", "source": "exif", "precision_level": "exact", **box(48.8566, 2.3522)},
        {"asset_id": "raw0", "source": "exif", "precision_level": "exact", **box(35.6895, 139.6917)},
        {"asset_id": "a2", "source": "ai", "precision_level": "locality", **box(-17.7134, 178.065)},
        {"asset_id": "a3", "source": "ai", "precision_level": "country", **box(-13.759, -172.1046)},
    )
    return t


def ids(df):
    return [r.asset_id for r in df.collect()]


def test_browse(spark):
    t = _catalog(spark)
    B = browse.BrowseSpec
    assert ids(browse.browse(t)) == ["a3", "a2", "a0", "a1"]
    assert ids(browse.browse(t, B(sort="rating-desc", limit=2, offset=1))) == ["a2", "a1"]
    assert ids(browse.browse(t, B(status="matched"))) == ["a0", "a1"]
    assert ids(browse.browse(t, B(search="NIGHT"))) == ["a2", "a1"]
    assert ids(browse.browse(t, B(search="%_off\\"))) == ["a3"]
    assert ids(browse.browse(t, B(filters={"orientation": "portrait"}))) == ["a0"]
    assert ids(browse.browse(t, B(filters={"tag": "night", "date_from": "2026-05-03", "iso_max": 200, "unknown": 1}))) == ["a2"]
    with pytest.raises(ValueError, match="scope"):
        browse.browse(t, B(status="odd"))
    assert browse.detail(t, "a0").first().raw_asset_id == "raw0"
    assert ids(browse.duplicates_of(t["assets"], "a0")) == ["a2"]
    f = facets.facet_values(t)
    assert [tuple(r) for r in f["tag"].collect()] == [("night", 2)] and f["ranges"].first().max_iso == 200
    assert facets.search_facet(t, "odd") is None


def test_locations(spark):
    t = _catalog(spark)
    geo = lambda **k: ids(browse.browse(t, browse.BrowseSpec(filters={"geo": k})))
    assert geo(mode="bounds", west=130, south=30, east=150, north=40) == ["a0"]
    assert geo(mode="bounds", west=0, south=40, east=10, north=50) == []
    assert geo(mode="bounds", west=170, south=-30, east=-160, north=0) == ["a3", "a2"]
    assert geo(mode="bounds", west=170, south=-30, east=-160, north=0, min_precision="locality") == ["a2"]
    assert len(geo(mode="bounds", west="x")) == 4
    assert locations.location_of(t, "a0").first().from_raw
    assert ids(locations.map_points(t)) == ["a0", "a2"]
    manual = rows(spark, "asset_locations", {"asset_id": "a0", "source": "manual", "latitude": 1.0})
    merged = locations.merge_locations(manual, t["asset_locations"])
    assert {r.asset_id: r.source for r in merged.collect()}["a0"] == "manual"


GAZETTEER = {
    "countries": [{"q": "Q1", "en": "United States", "iso": "US", "aliases": ["USA"], "lat": 39, "lon": -98}, {"q": "Q2", "en": "France", "iso": "FR", "lat": 46, "lon": 2}],
    "admin1": [{"q": "Q3", "en": "California", "lat": 37, "lon": -120, "country": "Q1", "links": 200}],
    "localities": [{"q": "Q4", "en": "Paris", "lat": 48.9, "lon": 2.35, "country": "Q2", "links": 300}, {"q": "Q5", "en": "Paris", "lat": 33.7, "lon": -95.5, "country": "Q1", "links": 40}, {"q": "Q6", "en": "Yosemite Valley", "lat": 37.7, "lon": -119.6, "country": "Q1", "links": 30}],
    "landmarks": [{"q": "Q7", "en": "El Capitan", "lat": 37.73, "lon": -119.64, "country": "Q1", "links": 20}, {"q": "Q8", "en": "El Capitan", "lat": 31.9, "lon": -104.9, "country": "Q1", "links": 35}],
}


def test_places(spark):
    g = places.Gazetteer(GAZETTEER)
    where = lambda **k: (g.resolve(k) or {}).get("place_id")
    assert where(locality="Paris") == "wd:Q4"
    assert where(locality="Paris", country="usa") == "wd:Q5"
    assert where(landmark="El Capitan", locality="Yosemite Valley", country="USA") == "wd:Q7"
    assert where(landmark="El Capitan") is None
    assert where(landmark="Paris skyline (night)", country="France") == "wd:Q4"
    assert where(region="Nowhere, California", country="USA") == "wd:Q3"
    assert where(country="France", confidence=59) is None
    got = places.resolve_places(spark.createDataFrame([("a", '{"country": "France"}'), ("b", "{bad"), ("c", None)], "asset_id string, location_json string"), GAZETTEER).collect()
    assert [(r.asset_id, r.country_code) for r in got] == [("a", "FR")]


def _face_rows(spark, vectors_, assets):
    data = [(f"f{i}", a, "m", "1", None, None, "standard", 0.99, [float(x) for x in v]) for i, (v, a) in enumerate(zip(vectors_, assets))]
    return spark.createDataFrame(data, schemas.schema("asset_faces"))


def test_clusters(spark):
    e = np.eye(8)
    bridge = (e[0] + e[1]) / np.sqrt(2)
    faces = _face_rows(spark, [e[0], e[0], e[1], e[1], bridge], list("abcde"))
    got = {r.face_id: r.group_id for r in vectors.candidate_groups(faces).collect()}
    assert got["f0"] == got["f1"] and got["f2"] == got["f3"] and got["f0"] != got["f2"]
    same = vectors.candidate_groups(_face_rows(spark, [e[0], e[0], e[0]], ["a", "a", "b"])).collect()
    assert len(same) == 2 and sum(r.is_cover for r in same) == 1


def test_clusters_equal_a_global_run(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(6, 16))
    v = [base[i % 6] + 0.35 * rng.normal(size=16) for i in range(90)]
    faces = _face_rows(spark, v, [f"p{i // 2}" for i in range(90)])
    links = [(r.similarity, r.a, r.b) for r in vectors.edges(faces, block=16).collect()]
    order = sorted(f"f{i}" for i in range(90))
    place = {f: k for k, f in enumerate(order)}
    m = np.array([v[int(f[1:])] for f in order])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    groups = vectors.greedy_groups(order, [f"p{int(f[1:]) // 2}" for f in order], m, [(s, place[a], place[b]) for s, a, b in links], 0.48, 0.1)
    want = {frozenset(order[k] for k in g) for g in groups}
    found = {}
    for r in vectors.candidate_groups(faces).collect():
        found.setdefault(r.group_id, set()).add(r.face_id)
    assert {frozenset(g) for g in found.values()} == want and len(want) > 3


def test_clusters_equal_a_naive_version(spark):
    """Written from the rules alone: all pairs, lists of groups, no components."""
    rng = np.random.default_rng(11)
    base = rng.normal(size=(5, 12))
    v = np.array([base[i % 5] + 0.7 * rng.normal(size=12) for i in range(70)])
    names_, photos = [f"f{i}" for i in range(70)], [f"p{i // 3}" for i in range(70)]
    low = rng.random(70) < 0.2
    data = [(n, a, "m", "1", None, None, "low" if q else "standard", 0.99, [float(np.float32(x)) for x in row]) for n, a, q, row in zip(names_, photos, low, v)]
    faces = spark.createDataFrame(data, schemas.schema("asset_faces"))
    u = v.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    sim = u @ u.T
    order = sorted(range(70), key=lambda i: names_[i])
    links = []
    for pos, b in enumerate(order):
        near = [a for a in order[:pos] if sim[a, b] >= 0.48 + 0.06 * (low[a] or low[b])]
        near = sorted(near, key=lambda a: (-sim[a, b], names_[a]))[:4]
        links += [(-sim[a, b], order.index(a), pos) for a in near if photos[a] != photos[b]]
    groups = [{i} for i in range(70)]
    for _, x, y in sorted(links):
        g, h = (next(q for q in groups if order[z] in q) for z in (x, y))
        cross = [sim[i, j] for i in g for j in h]
        if g is h or {photos[i] for i in g} & {photos[i] for i in h} or np.mean(cross) < 0.48 or (len(cross) > 1 and min(cross) < 0.38):
            continue
        groups = [q for q in groups if q is not g and q is not h] + [g | h]
    want = {frozenset(names_[i] for i in g) for g in groups if len(g) > 1}
    found = {}
    for r in vectors.candidate_groups(faces, neighbours=4).collect():
        found.setdefault(r.group_id, set()).add(r.face_id)
    assert {frozenset(g) for g in found.values()} == want and len(want) > 3


def test_clusters_in_small_batches(spark):
    """Components and edges that go on over batches, in two spaces; no worker is
    handed a whole component."""
    rng = np.random.default_rng(7)
    base = rng.normal(size=(4, 10))
    v = np.array([base[i % 4] + 0.6 * rng.normal(size=10) for i in range(120)]).astype(np.float32)
    data = [(f"f{i:03}", f"p{i // 2}", f"m{i % 2}", "1", None, None, "standard", 0.99, v[i].tolist()) for i in range(120)]
    faces = spark.createDataFrame(data, schemas.schema("asset_faces"))
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    want = set()
    for m in (0, 1):
        own = range(m, 120, 2)
        links = sorted((-(u[a] @ u[b]), a, b) for b in own for a in own if a < b and u[a] @ u[b] >= 0.48 and a // 2 != b // 2)
        groups = [{i} for i in own]
        for _, x, y in links:
            g, h = (next(q for q in groups if z in q) for z in (x, y))
            cross = [u[i] @ u[j] for i in g for j in h]
            if g is not h and not {i // 2 for i in g} & {i // 2 for i in h} and np.mean(cross) >= 0.48 and (len(cross) == 1 or min(cross) >= 0.38):
                groups = [q for q in groups if q is not g and q is not h] + [g | h]
        want |= {(f"m{m}", frozenset(f"f{i:03}" for i in g)) for g in groups if len(g) > 1}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = vectors.candidate_groups(faces)
        found = {}
        for r in got.collect():
            found.setdefault((r.model_id, r.group_id), set()).add(r.face_id)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert {(m, frozenset(g)) for (m, _), g in found.items()} == want and len(want) > 8
    assert "InPandas" not in got._jdf.queryExecution().analyzed().toString()


def test_grouping_keeps_no_edges():
    """Ten times the edges take no more memory: they pass in batches."""
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(2)
    v = rng.normal(size=(300, 16)).astype(np.float32)
    n = len(v)

    def batches(edge_batches):
        ids = np.arange(n)
        same = lambda x, k: pa.array([x] * k)
        names_ = ["model_id", "model_version", "place", "a", "b", "asset_id", "low", "v"]
        yield pa.RecordBatch.from_arrays([same("m", n), same("1", n), same(-np.inf, n), pa.array(ids), pa.array(ids), pa.array(ids), same(False, n), pa.array(list(v), pa.list_(pa.float32()))], names_)
        for _ in range(edge_batches):
            a, b = np.sort(rng.integers(0, n, (2, 2000)), axis=0)
            k = len(a)
            yield pa.RecordBatch.from_arrays([same("m", k), same("1", k), same(0.0, k), pa.array(a), pa.array(b), pa.nulls(k, pa.int64()), pa.nulls(k, pa.bool_()), pa.nulls(k, pa.list_(pa.float32()))], names_)

    peaks = []
    for edge_batches in (2, 40, 400):  # the first run loads what is loaded once
        tracemalloc.start()
        assert sum(b.num_rows for b in vectors._grouper(0.48, 0.1)(batches(edge_batches))) > 100
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[2] < 1.3 * peaks[1]


def test_edges_do_not_depend_on_the_grid(spark):
    rng = np.random.default_rng(5)
    faces = _face_rows(spark, rng.normal(size=(120, 6)), [f"p{i // 2}" for i in range(120)])
    whole = {(r.a, r.b): round(r.similarity, 9) for r in vectors.edges(faces, 0.4, neighbours=None).collect()}
    parts = {(r.a, r.b): round(r.similarity, 9) for r in vectors.edges(faces, 0.4, neighbours=None, block=8, group=16).collect()}
    assert parts == whole and len(whole) > 100 and vectors.edges(faces.filter("false")).count() == 0
    assert vectors._groups(10_000_000, 512, 16_384) == 611 and vectors._groups(500, 512, 16_384) == 1


def test_components_of_a_long_chain(spark):
    chain = spark.range(5000).selectExpr("lpad(id, 5, '0') a", "lpad(id + 1, 5, '0') b")
    assert [tuple(r) for r in vectors.components(chain).groupBy("root").count().collect()] == [("00000", 5001)]


def test_people(spark):
    t = empty_tables(spark)
    t["asset_faces"] = _face_rows(spark, np.eye(4), list("aabc"))
    t["person_groups"] = rows(spark, "person_groups", {"group_id": "g1", "state": "candidate"}, {"group_id": "g2", "state": "confirmed", "name": "Ann"})
    t["person_group_faces"] = rows(spark, "person_group_faces", *({"group_id": g, "face_id": f, "membership_state": "candidate", "source": "auto"} for g, f in [("g1", "f0"), ("g1", "f2"), ("g2", "f3")]))
    assert [(r.group_id, r.face_count) for r in people.list_groups(t).collect()] == [("g2", 1), ("g1", 2)]
    one = lambda *f: spark.createDataFrame([(x,) for x in f], "face_id string")
    cut = people.remove_faces(t, one("f0"))
    assert [r.face_id for r in people.unassigned(cut, "m", "1").collect()] == ["f1"]
    assert people.clear_candidates(cut)["person_groups"].count() == 2
    with pytest.raises(generic.MissingRows):
        people.remove_faces(t, one("f0", "nobody"))
    merged = people.merge_groups(t, "g1", "g2")
    assert merged["person_groups"].count() == 1 and people.list_groups(merged).first().face_count == 3
    with pytest.raises(ValueError, match="name"):
        people.rename(t["person_groups"], "g1", " ")
    assert {r.face_id: r.group_id for r in people.assign_faces(t, one("f1", "f3"), "g1")["person_group_faces"].collect()} == {"f0": "g1", "f1": "g1", "f2": "g1", "f3": "g1"}


def test_jobs(spark):
    t = rows(spark, "jobs", {"job_id": "a", "job_type": "import", "status": "running", "priority": 10, "created_at": T0, "updated_at": T0}, {"job_id": "b", "job_type": "people_index", "status": "running", "priority": 100, "created_at": T0, "updated_at": T0}, {"job_id": "c", "job_type": "x", "status": "queued", "priority": 50, "created_at": T0, "updated_at": T0})
    later = T0 + dt.timedelta(minutes=11)
    assert [(r.job_id, r.status) for r in jobs.active(t, later).collect()] == [("b", "queued"), ("c", "queued")]
    state = lambda df, k: {r.job_id: r[k] for r in df.collect()}
    paused = jobs.request_pause(jobs.request_pause(t, "a"), "c")
    assert state(paused, "status")["c"] == "paused" and state(paused, "pause_requested")["a"]
    assert state(jobs.request_resume(paused, "c"), "status")["c"] == "queued"
    assert state(jobs.update(t, "a", progress=0.5, increment_attempt=True), "attempt_count")["a"] == 1


def test_stacks_and_library(spark):
    t = _catalog(spark)
    sets, items = versions.create_sets(t["resource_sets"], t["resource_set_items"], t["assets"].filter("asset_id <> 'a3'"))
    assert sets.count() == 3 and versions.singleton_sets(sets, items).count() == 3
    items = versions.attach_to_origins(items, spark.createDataFrame([("a1", "a0")], "asset_id string, origin_id string"))
    members = {r.asset_id: (r.set_id, r.sort_order) for r in items.collect()}
    assert members["a1"][0] == members["a0"][0] and members["a1"][1] == 2
    t |= {"resource_sets": versions.drop_empty(sets, items), "resource_set_items": items}
    gone = library.delete_assets(t, spark.createDataFrame([("a0",)], "asset_id string"))
    assert gone["assets"].count() == 3 and gone["image_lookup_registry"].count() == 3
    assert {r.primary_asset_id for r in gone["resource_sets"].collect()} == {"a1", "a2"}
    tagged = library.add_tag(t, "a0", " Dusk ")
    assert {r.asset_id: r.tags_json for r in tagged["asset_ai_annotations"].collect()}["a0"] == '["Dusk"]'
    assert library.remove_tag(tagged, "a0", "dusk")["asset_tags"].count() == 2
    rated = library.set_rating(t["assets"], spark.createDataFrame([("a3",)], "asset_id string"), 0)
    assert {r.asset_id: r.app_rating for r in rated.collect()}["a3"] is None
    roots = spark.createDataFrame([("/a",), ("/a/b/",), ("/ab",), ("/a/b/c",)], "path string")
    assert sorted(r.path for r in library.collapse_roots(roots).collect()) == ["/a", "/ab"]


def test_upsert_keeps(spark):
    old = spark.createDataFrame([(1, "a", 5), (2, "b", None)], "k int, v string, r int")
    new = spark.createDataFrame([(1, "x", None), (3, "z", 1)], "k int, v string, r int")
    assert sorted(map(tuple, generic.upsert(old, new, ["k"], keep=["r"]).collect())) == [(1, "x", 5), (2, "b", None), (3, "z", 1)]


def test_evaluation(spark):
    truth = spark.createDataFrame([("a", "r"), ("b", "r"), ("c", ""), ("d", "s"), ("e", "t")], "image_path string, raw_path string")
    got = spark.createDataFrame([("a", "r"), ("b", "x"), ("c", None), ("d", None)], "image_path string, matched_path string")
    assert tuple(reports.evaluation(reports.outcomes(truth, got)).first()) == (1, 1, 1, 1, 1, 0.5, 0.5)


def _tiff(capture=b"2026:05:01 10:00:00\0", model=b"R6m2\0"):
    head = b"II*\0" + struct.pack("<I", 8)
    entries = [(0x0110, 2, len(model), None), (0x8769, 4, 1, None)]
    at = 8 + 2 + 12 * len(entries) + 4
    exif_at = at + len(model)
    text_at = exif_at + 2 + 12 * 2 + 4
    main = struct.pack("<H", 2) + struct.pack("<HHII", 0x0110, 2, len(model), at) + struct.pack("<HHII", 0x8769, 4, 1, exif_at) + bytes(4)
    exif = struct.pack("<H", 2) + struct.pack("<HHII", 0x9003, 2, len(capture), text_at) + struct.pack("<HHII", 0x8827, 3, 1, 200) + bytes(4)
    return head + main + model + exif + capture


def test_embedded_metadata():
    data = b"\xff\xd8\xff\xe1\0\0Exif\0\0" + _tiff()
    got = embedded.embedded(data)
    assert (got["capture_text"], got["camera_model"], got["iso"]) == ("2026:05:01 10:00:00", "R6m2", 200)
    assert embedded.embedded(data, "matcher").keys() == {"capture_text", "camera_model"}
    assert embedded.xmp_rating(b'<x:xmpmeta><r xmp:Rating="4"></x:xmpmeta>') == 4
    assert embedded.dimensions(b"\xff\xd8\xff\xc0\0\x0b\x08" + struct.pack(">HH", 40, 60) + b"\x01\x01\x11\0") == (60, 40)
    assert embedded.dimensions(b"\x89PNG\r\n\x1a\n" + bytes(8) + struct.pack(">II", 5, 6)) == (5, 6)
    assert embedded.embedded(b"") == {} and embedded.embedded(b"II*\0\xff\xff\xff\xff") == {}


def test_ingest_and_store(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    (tmp_path / "img").mkdir()
    (tmp_path / "raw" / "B0023524.CR3").write_bytes(_tiff())
    (tmp_path / "raw" / "noext").write_bytes(b"\0\0\0\x18ftypcrx " + bytes(20))
    (tmp_path / "img" / "B0023524-2.jpg").write_bytes(b"\xff\xd8\xff\xc0\0\x0b\x08" + struct.pack(">HH", 40, 60) + b"\x01\x01\x11\0\xff\xd9")
    (tmp_path / "img" / "cut.jpg").write_bytes(b"\xff\xd8\xff\xc0")
    found = listing.list_files(spark, str(tmp_path / "raw"))
    assert sorted(r[0] for r in found.select(listing.raw_format(F.col("path"), F.col("content"))).collect()) == ["cr3", "cr3"]
    catalog = Catalog(spark, str(tmp_path / "cat.d")).ensure()
    counts = phases.run_import(catalog, [str(tmp_path / "raw")], [str(tmp_path / "img")])
    assert counts == {"scanned": 2, "images": 1, "pending_confirmation": 1}
    assert catalog.table("assets").count() == 3 and catalog.table("resource_sets").count() == 1
    assert listing.changed(found, catalog.table("assets")).count() == 0
    new, n = listing.new_media(listing.list_files(spark, str(tmp_path / "img")), catalog.table("assets"), catalog.table("deleted_files"))
    assert n.first().new == 1 and new.first().path.endswith("cut.jpg")
    with pytest.raises(ValueError, match="keys"):
        catalog.write({"collections": rows(spark, "collections", {"collection_id": None, "kind": "manual"})})
    assert catalog.table("collections").count() == 0


def test_migrations(spark):
    t = {n: rows(spark, n) for n in ("catalog_info", "jobs")}
    assets = rows(spark, "assets", {"asset_id": "a", "asset_type": "export", "metadata_json": '{"gps_latitude": 48.8, "gps_longitude": 2.3}'}, {"asset_id": "b", "metadata_json": '{"gps_latitude": 0, "gps_longitude": 0}'})
    t |= {"assets": assets.drop("app_rating"), "export_lookup_registry": spark.createDataFrame([("/x", "a")], "export_path string, export_asset_id string")}
    new = migrations.migrate(t, 2)
    assert new["image_lookup_registry"].first().image_path == "/x" and new["asset_locations"].count() == 1
    assert migrations.to_8(new)["asset_locations"].count() == 1
    assert {r.asset_type for r in new["assets"].collect()} == {"image", None}
    with pytest.raises(migrations.MigrationError):
        migrations.migrate(t, 9)


def test_tombstones(spark):
    f = spark.createDataFrame([("/a", 1, T0), ("/b", 2, T0)], "path string, file_size long, modified_time timestamp")
    t = spark.createDataFrame([("/a", 1, T0 + dt.timedelta(seconds=1)), ("/b", 3, T0)], "path string, file_size long, modified_time timestamp")
    hidden, stale = listing.split_tombstoned(f, t)
    assert [r.path for r in hidden.collect()] == ["/a"] and [r.path for r in stale.collect()] == ["/b"]


def test_every_verb_is_accounted_for():
    assert len(verbs.VERBS) + len(verbs.OUT_OF_SCOPE) == 86


def test_extract_by_profile(spark, tmp_path):
    (tmp_path / "a.cr2").write_bytes(_tiff())
    (tmp_path / "b.jpg").write_bytes(b"\xff\xd8\xff\xe1\0\0Exif\0\0" + _tiff() + b"\xff\xc0\0\x0b\x08" + struct.pack(">HH", 40, 60) + b"\x01\x01\x11\0\xff\xd9")
    (tmp_path / "c.jpg").write_bytes(b"no picture")
    files = listing.list_files(spark, str(tmp_path)).withColumn("content", F.col("content"))
    full = {r.path.rsplit("/", 1)[1]: r for r in embedded.extract(files).collect()}
    assert (full["b.jpg"].camera_model, full["b.jpg"].iso, full["b.jpg"].lens_specification) == ("R6m2", 200, None)
    assert full["a.cr2"].capture_time == T0 and full["c.jpg"].camera_model is None and full["c.jpg"].width is None
    lean = {r.path.rsplit("/", 1)[1]: r for r in embedded.extract(files, "matcher", "head-only").collect()}
    assert lean["a.cr2"].camera_model == "R6m2" and lean["a.cr2"].iso is None and lean["b.jpg"].width is None
    assert full["a.cr2"].fingerprint != lean["a.cr2"].fingerprint
    known = embedded.extract(files.filter(F.col("path").endswith("a.cr2")))
    assert sorted(r.stem for r in embedded.scan(files, known).collect()) == ["b", "c"]
    assert embedded.extract(files.filter("false")).count() == 0


def test_catalog_survives_a_dying_writer_and_finds_concurrent_ones(spark, tmp_path, monkeypatch):
    from lumenstack.sources import store

    catalog = Catalog(spark, str(tmp_path / "c")).ensure()
    assert Catalog(spark, str(tmp_path / "c")).ensure().table("jobs").count() == 0
    one = lambda k: rows(spark, "collections", {"collection_id": k, "name": k, "kind": "manual"})
    catalog.write({"collections": one("a"), "deleted_files": rows(spark, "deleted_files", {"path": "/p"})})

    def dies(self, state, number):
        raise OSError("gone")

    with monkeypatch.context() as m:
        m.setattr(store.Catalog, "_publish", dies)
        with pytest.raises(OSError, match="gone"):
            catalog.write({"collections": one("b")})
    assert [r.collection_id for r in catalog.table("collections").collect()] == ["a"]
    catalog.write({"collections": one("c")})
    assert catalog.table("deleted_files").count() == 1 and catalog.table("collections").first().collection_id == "c"
    number = catalog._latest()
    with monkeypatch.context() as m:
        m.setattr(store.Catalog, "_latest", lambda self: number - 1)
        with pytest.raises(store.ConcurrentChange):
            catalog.write({"collections": one("d")})
    assert catalog.table("collections").first().collection_id == "c"


def test_gazetteer_size_is_checked_before_it_is_sent(spark, monkeypatch):
    monkeypatch.setattr(places, "LARGEST", 3)
    with pytest.raises(ValueError, match="too large"):
        places.resolve_places(spark.createDataFrame([], "asset_id string, location_json string"), GAZETTEER)


def test_watch(spark, tmp_path):
    from lumenstack.streaming import watch

    jpeg = b"\xff\xd8\xff\xd9"
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.jpg").write_bytes(jpeg)
    (folder / "cut.jpg").write_bytes(jpeg[:3])
    seen = []

    def run():
        rows_ = watch.listing_stream(spark, str(folder), content=False)
        q = watch.watch(rows_, lambda df, _: seen.extend(r.path for r in df.collect()), str(tmp_path / "ck"), None)
        try:
            assert q.awaitTermination(60)
        finally:
            q.stop()

    run()
    (folder / "b.jpg").write_bytes(jpeg)
    run()
    assert sorted(p.rsplit("/", 1)[1] for p in seen) == ["a.jpg", "b.jpg"]


def test_watch_reports_completed_and_overwritten_files(spark, tmp_path):
    import os

    from lumenstack.streaming import watch

    jpeg = b"\xff\xd8\xff\xd9"
    folder = tmp_path / "in"
    folder.mkdir()
    seen: list[list[str]] = []

    def run(handle=None):
        note = lambda df, _: seen.append(sorted(r.path.rsplit("/", 1)[1] for r in df.collect()))
        q = watch.watch(watch.listing_stream(spark, str(folder)), handle or note, str(tmp_path / "ck"), None)
        try:
            assert q.awaitTermination(60)
        finally:
            q.stop()

    run()
    (folder / "a.jpg").write_bytes(jpeg)
    (folder / "cut.jpg").write_bytes(jpeg[:3])
    run()
    (folder / "cut.jpg").write_bytes(jpeg)
    run()
    (folder / "a.jpg").write_bytes(jpeg + jpeg)
    run()
    os.utime(folder / "cut.jpg", (1_000_000_000, 1_000_000_000))
    (folder / "a.jpg").unlink()

    def fails(df, _):
        raise RuntimeError("handler")

    with pytest.raises(StreamingQueryException):
        run(fails)
    run()
    run()
    (folder / "a.jpg").write_bytes(jpeg + jpeg)
    run()
    assert [x for x in seen if x] == [["a.jpg"], ["cut.jpg"], ["a.jpg"], ["cut.jpg"], ["a.jpg"]]
