"""Queries of the catalog operators over the driver's tables, with their SQL.

The driver's tables stand in for catalog tables (orders for the registry,
customers for assets, line items for stack members, embeddings for faces, and so
on); the operators are the library's own.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import geo, names, scores
from .operators import browse, facets, generic, jobs, library, locations, matching, places, reports, vectors, versions

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
AS_OF = dt.datetime(2024, 1, 20)


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# browse


@_query("""
    SELECT o.o_orderkey, o.o_custkey, o.o_orderstatus, o.o_totalprice, o.o_orderdate, c.c_name, n.n_name,
           coalesce(l.items, 0) AS version_count,
           EXISTS (SELECT 1 FROM lineitem x WHERE x.l_orderkey = o.o_orderkey AND x.l_returnflag = 'R') AS has_face
    FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey
    LEFT JOIN (SELECT l_orderkey, count(*) AS items FROM lineitem GROUP BY 1) l ON l.l_orderkey = o.o_orderkey
    WHERE o.o_orderstatus IN ('F', 'O') AND o.o_totalprice BETWEEN 1000 AND 300000
    ORDER BY o.o_orderdate DESC NULLS LAST, o.o_orderkey LIMIT 120 OFFSET 120""")
def browse_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O2 with J1 to J4, F2, F6: the page is cut before the joins that only add columns."""
    orders = _t(spark, sf_dir, "orders").filter(F.col("o_orderstatus").isin("F", "O") & F.col("o_totalprice").between(1000, 300000))
    customer, nation, items = (_t(spark, sf_dir, x) for x in ("customer", "nation", "lineitem"))
    order = [F.col("o_orderdate").desc_nulls_last(), F.col("o_orderkey").asc()]
    rows = browse.page(orders.join(customer.select("c_custkey", "c_name", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")), order, 120, 120)
    own = items.join(F.broadcast(rows.select(F.col("o_orderkey").alias("l_orderkey"))), "l_orderkey", "left_semi")  # at most 120 keys
    counts = own.groupBy("l_orderkey").agg(F.count("*").alias("version_count"), F.bool_or(F.col("l_returnflag") == "R").alias("has_face"))
    out = rows.join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(counts, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return out.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "c_name", "n_name", F.coalesce("version_count", F.lit(0)).alias("version_count"), F.coalesce("has_face", F.lit(False)).alias("has_face")).orderBy(*order)


@_query("SELECT event_id, event_type, ts FROM events WHERE ts >= TIMESTAMP '2024-01-20' - INTERVAL 7 DAY")
def scope_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "events").withColumn("created_at", F.col("ts").cast("timestamp"))
    return rows.filter(browse.scope("recent", AS_OF)).select("event_id", "event_type", "ts")


@_query("SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_name ILIKE '%9_1%' OR c_mktsegment ILIKE '%build%'")
def search_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return rows.filter(browse.search_columns("9_1", "c_name") | browse.search_columns("BUILD", "c_mktsegment"))


@_query("SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM lineitem WHERE l_quantity >= 5 AND l_quantity <= 10 AND l_discount >= 0.05")
def filter_numeric_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("iso"), F.col("l_discount").alias("aperture"))
    rows = rows.filter(browse.facet_condition({"iso_min": 5, "iso_max": 10, "aperture_min": 0.05}))
    return rows.withColumnsRenamed({"iso": "l_quantity", "aperture": "l_discount"})


@_query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate::DATE >= DATE '1995-03-01' AND o_orderdate::DATE <= DATE '1995-06-30'")
def filter_date_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").alias("capture_time"))
    return rows.filter(browse.facet_condition({"date_from": "1995-03-01", "date_to": "1995-06-30"})).withColumnRenamed("capture_time", "o_orderdate")


@_query("SELECT doc_id, quality FROM labels WHERE quality >= 1")
def filter_rating(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("app_rating"))
    return rows.filter(browse.facet_condition({"rating_min": 1})).withColumnRenamed("app_rating", "quality")


@_query("""SELECT p_partkey, CASE WHEN h > w THEN 'portrait' WHEN w > h THEN 'landscape' WHEN w = h THEN 'square' END AS orientation
           FROM (SELECT p_partkey, p_size AS w, p_partkey % 50 + 1 AS h FROM part)""")
def filter_orientation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("width"), (F.col("p_partkey") % 50 + 1).alias("height"))
    kinds = [rows.filter(browse.orientation(k)).select("p_partkey", F.lit(k).alias("orientation")) for k in ("portrait", "landscape", "square")]
    return kinds[0].unionByName(kinds[1]).unionByName(kinds[2])


@_query("SELECT p_partkey, p_name FROM part WHERE lower(trim(p_brand, '.')) = 'brand#13'")
def filter_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "part").select("p_partkey", "p_name", F.col("p_brand").alias("extension"))
    return rows.filter(browse.facet_condition({"extension": ".BRAND#13"})).drop("extension")


def _as_assets(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").alias("asset_id"), "lang", "source", "n_chars")


@_query("SELECT doc_id, lang FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def filter_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = _t(spark, sf_dir, "labels").select(F.col("doc_id").alias("asset_id"))
    rows = browse.semi_facets(_as_assets(_t(spark, sf_dir, "documents")), {"asset_ai_annotations": notes}, {"annotated": True})
    return rows.select(F.col("asset_id").alias("doc_id"), "lang")


@_query("SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def filter_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = _t(spark, sf_dir, "labels").select(F.col("doc_id").alias("asset_id"))
    rows = browse.semi_facets(_as_assets(_t(spark, sf_dir, "documents")), {"asset_ai_annotations": notes}, {"annotated": False})
    return rows.select(F.col("asset_id").alias("doc_id"), "lang")


# facets


@_query("SELECT source AS value, count(*) AS count FROM documents WHERE source IS NOT NULL AND source <> '' GROUP BY 1")
def facet_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generic.value_counts(_t(spark, sf_dir, "documents"), "source")


@_query("SELECT min(o_totalprice) AS min_o_totalprice, max(o_totalprice) AS max_o_totalprice, min(o_orderdate) AS min_o_orderdate, max(o_orderdate) AS max_o_orderdate FROM orders")
def facet_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.ranges(_t(spark, sf_dir, "orders"), "o_totalprice", "o_orderdate")


@_query("SELECT lower(trim(p_brand, '.')) AS value, count(*) AS count FROM part GROUP BY 1")
def facet_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.extension_counts(_t(spark, sf_dir, "part").select(F.col("p_brand").alias("extension")))


@_query("SELECT p_type AS value, count(*) AS count FROM part WHERE p_type ILIKE '%st%' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50")
def facet_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generic.value_counts(_t(spark, sf_dir, "part"), "p_type", 50, "st")


@_query("SELECT p_name AS value, count(*) AS count FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 60")
def facet_tags_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.tag_counts(_t(spark, sf_dir, "part").select(F.col("p_name").alias("tag")))


@_query("""SELECT event_type, count(k) AS n, min(k) AS min_k, max(k) AS max_k
           FROM (SELECT event_type, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) GROUP BY 1""")
def json_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "events").select("event_type", names.json_number(F.col("props"), "$.k", "int").alias("k"))
    return rows.groupBy("event_type").agg(F.count("k").alias("n"), F.min("k").alias("min_k"), F.max("k").alias("max_k"))


# per group


@_query("SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return generic.largest_per_group(rows, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")])


@_query("""SELECT l_orderkey, l_linenumber, l_extendedprice, (row_number() OVER w)::INTEGER AS rank FROM lineitem
           WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) QUALIFY row_number() OVER w <= 5""")
def top5_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return generic.top_per_group(rows, ["l_orderkey"], [F.desc("l_extendedprice"), F.col("l_linenumber").asc()], 5)


@_query("SELECT user_id, event_type, event_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1")
def dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts")
    return rows.groupBy("user_id", "event_type").agg(F.min(F.struct("ts", "event_id")).alias("x")).select("user_id", "event_type", "x.event_id", "x.ts")


_UNIT = "list_transform(embedding, lambda x: x::DOUBLE / greatest(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 1e-7))"
_CENTROIDS = f"""
    v AS (SELECT vec_id, label, {_UNIT} AS v FROM embeddings),
    s AS (SELECT label, i, sum(v[i]) AS x FROM v, unnest(range(1, 65)) t(i) GROUP BY 1, 2),
    r AS (SELECT label, list(x ORDER BY i) AS c FROM s GROUP BY 1),
    c AS (SELECT label, list_transform(c, lambda x: x / sqrt(list_dot_product(c, c))) AS c FROM r)"""


@_query(f"""WITH {_CENTROIDS} SELECT label, vec_id AS cover FROM v JOIN c USING (label)
            QUALIFY row_number() OVER (PARTITION BY label ORDER BY round(list_dot_product(v, c), 9) DESC, vec_id DESC) = 1""")
def medoid_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.medoids(_t(spark, sf_dir, "embeddings"), "label", "vec_id")


# joins


@_query("""SELECT doc_id, md5(text) AS fingerprint, count(*) OVER (PARTITION BY md5(text)) AS copies FROM documents
           WHERE text IS NOT NULL QUALIFY count(*) OVER (PARTITION BY md5(text)) > 1""")
def duplicates_by_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("fingerprint"))
    return browse.duplicate_sets(rows, "fingerprint", "doc_id")


@_query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def orphans_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return generic.delete_keys(_t(spark, sf_dir, "customer").select("c_custkey", "c_name"), keys, "c_custkey")


def _stacks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders as stacks, with their least line number as primary; line items as members."""
    lines = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("supplier"))
    items = lines.select(F.col("l_orderkey").alias("set_id"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("asset_id"), F.col("l_linenumber").alias("sort_order"), "supplier")
    sets = items.groupBy("set_id").agg(F.min_by("asset_id", "sort_order").alias("primary_asset_id"))
    return sets, items


@_query("SELECT l_orderkey AS set_id, min(l_orderkey || '-' || l_linenumber) AS primary_asset_id FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_linenumber) = 1")
def singleton_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.singleton_sets(*_stacks(spark, sf_dir))


@_query("SELECT l_orderkey AS set_id, count(*) AS independents, count(DISTINCT s % 10) AS directories FROM (SELECT l_orderkey, min(l_suppkey) AS s FROM lineitem GROUP BY l_orderkey, l_linenumber) GROUP BY 1 HAVING count(*) >= 2 AND count(DISTINCT s % 10) >= 2")
def merged_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, items = _stacks(spark, sf_dir)
    assets = items.select("asset_id", F.concat(F.lit("/photos/"), (F.col("supplier") % 10).cast("string"), F.lit("/"), "asset_id", F.lit(".jpg")).alias("path"))
    return versions.wrongly_merged(items.withColumn("parent_asset_id", F.lit(None).cast("string")), assets)


@_query("SELECT l_orderkey AS set_id, coalesce(max(l_linenumber), -1) + 1 AS next_order FROM lineitem GROUP BY 1")
def next_sort_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.next_sort_order(_stacks(spark, sf_dir)[1])


def _point(key: str) -> tuple[Column, Column]:
    k = F.col(key)
    return ((k * 37) % 1800) / 10.0 - 90, ((k * 73) % 3600) / 10.0 - 180


def _located(rows: DataFrame, key: str, source: str) -> DataFrame:
    lat, lon = _point(key)
    half = F.when(F.col(key) % 3 == 0, 0.15).otherwise(0.0)
    level = F.when(F.col(key) % 3 == 0, "locality").otherwise("exact")
    return rows.select(F.col(key).alias("asset_id"), lat.alias("latitude"), lon.alias("longitude"), *(c.alias(n) for n, c in geo.box_around(lat, lon, half).items()), F.lit(source).alias("source"), level.alias("precision_level"), F.concat(F.lit("p:"), (F.col(key) % 100).cast("string")).alias("place_id"))


_POINT = "(({k} * 37) % 1800) / 10.0 - 90 AS latitude, (({k} * 73) % 3600) / 10.0 - 180 AS longitude"


@_query(f"""WITH own AS (SELECT c_custkey, {_POINT.format(k='c_custkey')} FROM customer WHERE c_custkey % 2 = 0),
    raw AS (SELECT s_suppkey, {_POINT.format(k='(s_suppkey + 7)')} FROM supplier)
    SELECT c.c_custkey AS asset_id, CASE WHEN raw.s_suppkey IS NOT NULL THEN raw.latitude ELSE own.latitude END::DOUBLE AS latitude,
           CASE WHEN raw.s_suppkey IS NOT NULL THEN raw.longitude ELSE own.longitude END::DOUBLE AS longitude, raw.s_suppkey IS NOT NULL AS from_raw
    FROM customer c LEFT JOIN own USING (c_custkey) LEFT JOIN raw ON raw.s_suppkey = CASE WHEN c.c_custkey % 5 = 0 THEN c.c_custkey // 5 END""")
def effective_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J10: the RAW's row as a whole, else the picture's own."""
    customer, supplier = _t(spark, sf_dir, "customer"), _t(spark, sf_dir, "supplier")
    own = _located(customer.filter("c_custkey % 2 = 0"), "c_custkey", "exif")
    raw = _located(supplier.select((F.col("s_suppkey") + 7).alias("k"), "s_suppkey"), "k", "exif").withColumn("asset_id", 6 - F.col("asset_id"))
    pairs = customer.select(F.col("c_custkey").alias("asset_id"), F.when(F.col("c_custkey") % 5 == 0, -1 - F.floor(F.col("c_custkey") / 5)).alias("raw_asset_id"))
    return locations.effective(pairs, own.unionByName(raw)).select("asset_id", "latitude", "longitude", "from_raw")


_BOXES = f"""(SELECT asset_id, latitude::DOUBLE AS latitude, longitude::DOUBLE AS longitude, greatest(-90, latitude - half)::DOUBLE AS min_lat, least(90, latitude + half)::DOUBLE AS max_lat,
    greatest(-180, longitude - half)::DOUBLE AS min_lon, least(180, longitude + half)::DOUBLE AS max_lon
    FROM (SELECT c_custkey AS asset_id, {_POINT.format(k='c_custkey')}, CASE WHEN c_custkey % 3 = 0 THEN 0.15 ELSE 0 END AS half FROM customer))"""


def _viewport(spark: SparkSession, sf_dir: str, bounds: dict) -> DataFrame:
    rows = _located(_t(spark, sf_dir, "customer"), "c_custkey", "exif")
    return rows.filter(locations.geo_condition({"mode": "bounds", **bounds})).select("asset_id", "latitude", "longitude")


@_query(f"SELECT asset_id, latitude, longitude FROM {_BOXES} WHERE max_lat >= 10 AND min_lat <= 50 AND max_lon >= -20.5 AND min_lon <= 40")
def viewport_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _viewport(spark, sf_dir, {"west": -20.5, "south": 10, "east": 40, "north": 50})


@_query(f"SELECT asset_id, latitude, longitude FROM {_BOXES} WHERE max_lat >= -30 AND min_lat <= 5 AND (max_lon >= 170 OR min_lon <= -165)")
def viewport_antimeridian(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _viewport(spark, sf_dir, {"west": 170, "south": -30, "east": -165, "north": 5})


@_query(f"""SELECT floor((longitude + 180) / size)::BIGINT AS cell_x, floor((latitude + 90) / size)::BIGINT AS cell_y, count(*) AS points, max(asset_id) AS cover
    FROM {_BOXES}, (SELECT 360.0::DOUBLE / 16 * 52 / 256 AS size) GROUP BY 1, 2""")
def map_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _located(_t(spark, sf_dir, "customer"), "c_custkey", "exif").withColumns({"app_rating": F.lit(0), "capture_time": F.lit(None).cast("timestamp")})
    return locations.map_clusters(rows, 4).select("cell_x", "cell_y", "points", "cover")


@_query("""SELECT a.event_id AS image_id, b.event_id AS raw_id, abs(epoch_us(a.ts) - epoch_us(b.ts)) AS micros_apart
    FROM events a, events b WHERE a.event_type = 'purchase' AND b.event_type = 'signup'
    QUALIFY row_number() OVER (PARTITION BY a.event_id ORDER BY CASE WHEN a.user_id = b.user_id THEN 0 ELSE 1 END, abs(epoch_us(a.ts) - epoch_us(b.ts)), b.event_id) <= 3""")
def nearest_time_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J15: for each purchase the three nearest sign-ups, the same user's first."""
    rows = _t(spark, sf_dir, "events").select("event_id", "event_type", F.col("user_id").cast("string").alias("camera_model"), F.col("ts").cast("timestamp").alias("capture_time"))
    images = rows.filter(F.col("event_type") == "purchase").withColumnRenamed("event_id", "image_id")
    raws = rows.filter(F.col("event_type") == "signup").select(F.col("event_id").alias("raw_id"), F.col("capture_time").alias("r_time"), F.col("camera_model").alias("r_camera"))
    return matching.nearest_times(images, raws, 3)


# names and other scalars

_STEM = "p_name || CASE p_partkey % 6 WHEN 0 THEN '-2' WHEN 1 THEN '_edit' WHEN 2 THEN ' (3)' WHEN 3 THEN '.v2 final' WHEN 4 THEN '' ELSE '-thumb-1' END"
_NORMAL = "trim(regexp_replace(lower(trim({s})), '[\\s._-]+', '-', 'g'), '-')"
_WORDS = "|".join(names.VARIANT_WORDS)
_KEY = f"""
    n AS (SELECT *, trim(regexp_replace({_NORMAL.format(s='stem')}, '\\(\\d+\\)$', ''), '-') AS a FROM s),
    c AS (SELECT *, CASE WHEN regexp_matches(a, '^[a-z]{{2,5}}-\\d{{3,}}(-\\d+)*$') THEN regexp_extract(a, '^([a-z]{{2,5}}-\\d{{3,}})', 1) ELSE trim(regexp_replace(a, '(-+\\d+)+$', ''), '-') END AS b FROM n),
    k AS (SELECT *, CASE WHEN trim(regexp_replace(b, '((^|-+)({_WORDS}|v\\d+))+$', ''), '-') <> '' THEN trim(regexp_replace(b, '((^|-+)({_WORDS}|v\\d+))+$', ''), '-') ELSE b END AS stem_key FROM c)"""


def _stems(part: DataFrame) -> DataFrame:
    tail = F.element_at(F.array(*map(F.lit, ["-2", "_edit", " (3)", ".v2 final", "", "-thumb-1"])), (F.col("p_partkey") % 6 + 1).cast("int"))
    return part.select("p_partkey", F.concat("p_name", tail).alias("stem"))


@_query(f"SELECT p_partkey, {_NORMAL.format(s=_STEM)} AS normalized FROM part")
def normalize_stem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stems(_t(spark, sf_dir, "part")).select("p_partkey", names.normalize_stem(F.col("stem")).alias("normalized"))


@_query(f"WITH s AS (SELECT p_partkey, {_STEM} AS stem FROM part), {_KEY} SELECT p_partkey, stem_key, regexp_replace(stem_key, '[^a-z0-9]+', '', 'g') AS alnum_key FROM k")
def stem_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("stem")
    return _stems(_t(spark, sf_dir, "part")).select("p_partkey", names.stem_key(c).alias("stem_key"), names.stem_alnum_key(c).alias("alnum_key"))


_CAMERA = "CASE doc_id % 5 WHEN 0 THEN 'IMG_' || lpad((doc_id * 7 % 10000)::VARCHAR, 4, '0') || '-edit' WHEN 1 THEN 'B' || lpad(doc_id::VARCHAR, 7, '0') || '-2' WHEN 2 THEN '0Y1A' || lpad(doc_id::VARCHAR, 4, '0') WHEN 3 THEN 'cover-final' ELSE 'DJI_' || lpad(doc_id::VARCHAR, 8, '0') END"


@_query(f"""WITH s AS (SELECT doc_id, {_CAMERA} AS stem FROM documents), {_KEY}
    SELECT doc_id, CASE WHEN regexp_matches(stem_key, '^({"|".join(names.CAMERA_TOKENS)})$') THEN stem_key END AS token FROM k""")
def camera_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    stem = (
        F.when(k % 5 == 0, F.concat(F.lit("IMG_"), pad(k * 7 % 10000, 4), F.lit("-edit")))
        .when(k % 5 == 1, F.concat(F.lit("B"), pad(k, 7), F.lit("-2")))
        .when(k % 5 == 2, F.concat(F.lit("0Y1A"), pad(k, 4)))
        .when(k % 5 == 3, "cover-final")
        .otherwise(F.concat(F.lit("DJI_"), pad(k, 8)))
    )
    return _t(spark, sf_dir, "documents").select("doc_id", names.camera_token(stem).alias("token"))


@_query("SELECT page_id, 'page_' || substr(sha1(md5(html) || ':' || url), 1, 24) AS asset_id FROM pages")
def stable_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "pages").select("page_id", names.stable_id("page", F.md5("html"), F.col("url")).alias("asset_id"))


@_query("""SELECT score, count(*) AS n FROM (SELECT CASE WHEN d <= 5 THEN 1.0 WHEN d <= 60 THEN 0.85 WHEN d <= 300 THEN 0.6 WHEN d <= 3600 THEN 0.3 ELSE 0.0 END::DOUBLE AS score
    FROM (SELECT abs(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 1000000.0 AS d FROM events) WHERE d IS NOT NULL) GROUP BY 1""")
def timestamp_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    rows = _t(spark, sf_dir, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    before = F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = rows.withColumn("before", before).filter("before is not null")
    return rows.groupBy(scores.timestamp_score(F.col("ts"), F.col("before")).alias("score")).agg(F.count("*").alias("n"))


@_query("""SELECT p_partkey, CASE WHEN p_size * 2 > h * 3 THEN floor((p_size - round(h * 3 / 2.0)) / 2) ELSE 0 END::INTEGER AS left_edge,
    CASE WHEN p_size * 2 > h * 3 THEN round(h * 3 / 2.0) ELSE p_size END::INTEGER AS width,
    CASE WHEN p_size * 2 > h * 3 THEN h ELSE round(p_size * 2 / 3.0) END::INTEGER AS height FROM (SELECT p_partkey, p_size, (p_partkey % 50 + 1)::INTEGER AS h FROM part)""")
def crop_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratio = names.ratio_parts(F.lit("3:2"))
    box = names.crop_box(F.col("p_size"), (F.col("p_partkey") % 50 + 1).cast("int"), ratio["a"], ratio["b"])
    rows = _t(spark, sf_dir, "part").select("p_partkey", box.alias("x"))
    return rows.select("p_partkey", F.col("x.left").alias("left_edge"), (F.col("x.right") - F.col("x.left")).alias("width"), (F.col("x.bottom") - F.col("x.top")).alias("height"))


# aggregates


@_query("""SELECT (SELECT count(*) FROM orders) AS assets, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS matched, (SELECT count(DISTINCT o_custkey) FROM orders) AS bound_raws,
    (SELECT count(*) FROM labels) AS annotated, (SELECT count(*) FROM nation) AS collections, (SELECT count(DISTINCT label) FROM embeddings) AS person_groups""")
def summary_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _t(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "auto_bound").otherwise("unmatched")
    tables = {
        "assets": orders.select(F.lit("image").alias("asset_type"), F.lit(0).alias("app_rating"), F.lit(True).alias("exists_on_disk")),
        "image_lookup_registry": orders.select(status.alias("status"), F.col("o_custkey").alias("raw_asset_id")),
        "asset_ai_annotations": _t(spark, sf_dir, "labels"),
        "collections": _t(spark, sf_dir, "nation"),
        "person_groups": _t(spark, sf_dir, "embeddings").select("label").distinct(),
    }
    return reports.summary(tables).select("assets", "matched", "bound_raws", "annotated", "collections", "person_groups")


@_query("SELECT r_regionkey AS collection_id, r_name AS name, coalesce(n, 0) AS item_count FROM region LEFT JOIN (SELECT n_regionkey, count(*) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1) ON n_regionkey = r_regionkey")
def collections_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    region, nation, customer = (_t(spark, sf_dir, x) for x in ("region", "nation", "customer"))
    items = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("collection_id"))
    heads = region.select(F.col("r_regionkey").alias("collection_id"), F.col("r_name").alias("name"), F.lit(0).alias("sort_order"))
    return library.list_collections(heads, items).drop("sort_order")


@_query("""SELECT field, present, round(present / n, 4) AS ratio FROM (SELECT count(*)::DOUBLE AS n, count(quality) AS q, count(toxic) AS t, count(lang) AS l FROM documents LEFT JOIN labels USING (doc_id)),
    LATERAL (VALUES ('quality', q), ('toxic', t), ('lang', l)) x(field, present)""")
def coverage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "documents").join(_t(spark, sf_dir, "labels"), "doc_id", "left")
    return reports.coverage(rows, "quality", "toxic", "lang")


@_query("""SELECT count(*) FILTER (outcome = 'true_positive') AS true_positive, count(*) FILTER (outcome = 'false_positive') AS false_positive, count(*) FILTER (outcome = 'false_negative') AS false_negative,
    count(*) FILTER (outcome = 'true_negative') AS true_negative, count(*) FILTER (outcome = 'missing') AS missing,
    round(count(*) FILTER (outcome = 'true_positive') / count(*) FILTER (outcome IN ('true_positive', 'false_positive')), 4) AS precision,
    round(count(*) FILTER (outcome = 'true_positive') / count(*) FILTER (outcome IN ('true_positive', 'false_negative')), 4) AS recall
    FROM (SELECT CASE WHEN l.doc_id IS NULL THEN 'missing' WHEN d.n_chars > 800 AND quality = 1 THEN 'true_positive' WHEN quality = 1 THEN 'false_positive' WHEN d.n_chars > 800 THEN 'false_negative' ELSE 'true_negative' END AS outcome
          FROM documents d LEFT JOIN labels l USING (doc_id))""")
def confusion_precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A13 with "long" as truth and quality as decision."""
    truth = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("image_path"), F.when(F.col("n_chars") > 800, "x").otherwise("").alias("raw_path"))
    found = _t(spark, sf_dir, "labels").select(F.col("doc_id").alias("image_path"), F.when(F.col("quality") == 1, "x").alias("matched_path"))
    return reports.evaluation(reports.outcomes(truth, found))


# entity resolution


def _files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Parts as exported pictures of camera files; RAWs of two thirds of them."""
    k = F.col("p_partkey")
    digits = k.cast("string")
    name = F.concat(F.lit("IMG_"), F.lpad(digits, F.greatest(F.length(digits), F.lit(6)), F.lit("0")))  # lpad would cut longer ones
    tail = F.element_at(F.array(*map(F.lit, ["", "-edit", "-2"])), (k % 3 + 1).cast("int"))
    time = F.timestamp_seconds(F.lit(1_700_000_000) + k * 60)
    ratio = scores.aspect_ratio(F.col("p_size"), F.lit(10))
    shared = {"camera_model": F.col("p_brand"), "lens_model": F.col("p_type"), "aspect_ratio": ratio}
    part = _t(spark, sf_dir, "part")
    images = part.select(k.alias("image_id"), F.concat(name, tail).alias("stem"), (time + F.expr("INTERVAL 1 SECOND") * (k % 7 * 100).cast("int")).alias("capture_time"), *(c.alias(n) for n, c in shared.items()))
    raws = part.filter(k % 3 != 1).select((-k).alias("raw_id"), name.alias("stem"), time.alias("capture_time"), *(c.alias(n) for n, c in shared.items()))
    return images, raws


_DECIDED = """WITH p AS (SELECT p_partkey AS k, p_size, p_partkey % 7 * 100 AS d, p_brand, p_type FROM part),
    s AS (SELECT k, k % 3 <> 1 AS there, round(0.62 + 0.14 + 0.12 + 0.06 * CASE WHEN d <= 5 THEN 1 WHEN d <= 60 THEN 0.85 WHEN d <= 300 THEN 0.6 WHEN d <= 3600 THEN 0.3 ELSE 0 END
          + CASE WHEN p_brand <> '' THEN 0.03 ELSE 0 END + CASE WHEN p_type <> '' THEN 0.01 ELSE 0 END + CASE WHEN p_size <> 0 THEN 0.02 ELSE 0 END, 4)::DOUBLE AS score FROM p),
    r AS (SELECT k AS image_id, CASE WHEN NOT there THEN 'unmatched' WHEN score >= 0.9 THEN 'auto_bound' ELSE 'pending_confirmation' END AS status, CASE WHEN there THEN -k END AS raw_id, CASE WHEN there THEN score ELSE 0 END::DOUBLE AS score FROM s)"""


@_query(f"{_DECIDED} SELECT image_id, status, raw_id::VARCHAR AS raw_id, score FROM r")
def match_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J13 to J18 and M1 to M7. Pictures without their RAW carry a camera's name, which ends their chain."""
    return matching.resolve(*_files(spark, sf_dir)).select("image_id", "status", F.col("raw_id").cast("string").alias("raw_id"), "score")


@_query(f"{_DECIDED} SELECT status, count(*) AS count FROM r GROUP BY 1")
def match_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    images, raws = matching.prepared(*_files(spark, sf_dir))
    return matching.status_counts(matching.decided_status(images, matching.scored(images, raws, matching.recall(images, raws))))


@_query(f"{_DECIDED} SELECT image_id, raw_id, score FROM r WHERE raw_id IS NOT NULL")
def match_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    images, raws = map(matching.keyed, _files(spark, sf_dir))
    return matching.scored(images, raws, matching.recall(images, raws)).select("image_id", "raw_id", "score")


# vectors


def _faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector is a face; three follow each other in one picture."""
    e = _t(spark, sf_dir, "embeddings")
    return e.select(F.lit("m").alias("model_id"), F.lit("1").alias("model_version"), F.col("vec_id").alias("face_id"), F.floor(F.col("vec_id") / 3).alias("asset_id"), F.lit("standard").alias("quality"), "embedding")


_EDGES = f"""WITH v AS (SELECT vec_id, {_UNIT} AS v FROM embeddings),
    e AS (SELECT a.vec_id AS a, b.vec_id AS b, list_dot_product(a.v, b.v) AS s FROM v a JOIN v b ON a.vec_id < b.vec_id WHERE a.vec_id // 3 <> b.vec_id // 3 AND list_dot_product(a.v, b.v) >= 0.35)"""


@_query(f"{_EDGES} SELECT a, b, round(s, 6) AS similarity FROM e")
def cosine_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.edges(_faces(spark, sf_dir), 0.35, neighbours=None).select("a", "b", F.round("similarity", 6).alias("similarity"))


@_query(f"{_EDGES} SELECT a, b FROM e QUALIFY row_number() OVER (PARTITION BY b ORDER BY s DESC, a) <= 3")
def edge_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.edges(_faces(spark, sf_dir), 0.35, neighbours=3, cut_first=False).select("a", "b")


@_query(f"""WITH v AS (SELECT vec_id, {_UNIT} AS v FROM embeddings),
    e AS (SELECT a.vec_id AS a, b.vec_id AS b, list_dot_product(a.v, b.v) AS s FROM v a JOIN v b ON a.vec_id < b.vec_id WHERE list_dot_product(a.v, b.v) >= 0.35),
    t AS (SELECT a, b FROM e QUALIFY row_number() OVER (PARTITION BY b ORDER BY s DESC, a) <= 3)
    SELECT a, b FROM t WHERE a // 3 <> b // 3""")
def edge_topk_cut_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V2: the strongest neighbours are cut before pairs of one picture go."""
    return vectors.edges(_faces(spark, sf_dir), 0.35, neighbours=3).select("a", "b")


@_query()
def candidate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3: greedy merging has no SQL form; tests hold it against a global run."""
    return vectors.candidate_groups(_faces(spark, sf_dir), threshold=0.35)


@_query(f"WITH {_CENTROIDS} SELECT label, i AS dimension, round(c[i], 6) AS value FROM c, unnest(range(1, 65)) t(i)")
def group_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors.centroids(_t(spark, sf_dir, "embeddings"), "label")
    return rows.select("label", F.posexplode("centroid").alias("i", "x")).select("label", (F.col("i") + 1).cast("long").alias("dimension"), F.round("x", 6).alias("value"))


@_query(f"WITH {_CENTROIDS} SELECT b.label, round(list_dot_product(a.c, b.c), 4) AS similarity FROM c a, c b WHERE a.label = 0 AND b.label <> 0 ORDER BY 2 DESC, 1 LIMIT 10")
def similar_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.similar_groups(vectors.centroids(_t(spark, sf_dir, "embeddings"), "label"), "label", 0)


# changes


@_query("""SELECT coalesce(n.c_custkey, c.c_custkey) AS c_custkey, CASE WHEN n.c_custkey IS NULL THEN c.c_name ELSE n.c_name END AS c_name, coalesce(n.c_acctbal, c.c_acctbal) AS c_acctbal, c.c_mktsegment
    FROM customer c FULL JOIN (SELECT s_suppkey * 20 AS c_custkey, s_name AS c_name, CASE WHEN s_suppkey % 2 = 0 THEN s_acctbal END AS c_acctbal FROM supplier) n USING (c_custkey)""")
def upsert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D1: new rows replace old ones by key; a null balance keeps the old one."""
    table = _t(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    rows = _t(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 20).alias("c_custkey"), F.col("s_name").alias("c_name"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_acctbal")).alias("c_acctbal"))
    return generic.upsert(table, rows, ["c_custkey"], keep=["c_acctbal"])


@_query("SELECT c_custkey, c_name FROM customer UNION ALL SELECT s_suppkey * 20, min(s_name) FROM supplier WHERE s_suppkey * 20 NOT IN (SELECT c_custkey FROM customer) GROUP BY 1")
def insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 20).alias("c_custkey"), F.col("s_name").alias("c_name"))
    return generic.insert_ignore(_t(spark, sf_dir, "customer").select("c_custkey", "c_name"), rows, ["c_custkey"])


@_query("""SELECT 'orders' AS name, count(*) AS rows FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
    UNION ALL SELECT 'customer', count(*) FROM customer WHERE c_mktsegment <> 'BUILDING'""")
def delete_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {x: _t(spark, sf_dir, x) for x in ("customer", "orders")}
    ids = tables["customer"].filter(F.col("c_mktsegment") == "BUILDING").select(F.col("c_custkey").alias("id"))
    left = generic.cascade_delete(tables, ids, {"customer": ["c_custkey"], "orders": ["o_custkey"]})
    counts = [left[x].agg(F.count("*").alias("rows")).select(F.lit(x).alias("name"), "rows") for x in ("customer", "orders")]
    return counts[0].unionByName(counts[1])


@_query("SELECT CASE WHEN label = 3 THEN 5 ELSE label END AS group_id, count(*) AS faces, count(*) FILTER (label = 3) AS merged FROM embeddings GROUP BY 1")
def merge_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators import people

    e = _t(spark, sf_dir, "embeddings")
    members = e.select(F.col("label").alias("group_id"), F.col("vec_id").alias("face_id"), F.lit("candidate").alias("membership_state"), F.lit("auto").alias("source"))
    groups = e.select(F.col("label").alias("group_id"), F.lit("candidate").alias("state"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("long").alias("cover_face_id")).distinct()
    out = people.merge_groups({"person_groups": groups, "person_group_faces": members}, 3, 5)["person_group_faces"]
    return out.groupBy("group_id").agg(F.count("*").alias("faces"), F.count_if(F.col("source") == "user_merged").alias("merged"))


@_query("SELECT n_nationkey, CASE WHEN n_nationkey = 7 THEN 'RENAMED' ELSE n_name END AS n_name, n_regionkey FROM nation")
def partial_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generic.partial_update(_t(spark, sf_dir, "nation"), "n_nationkey", 7, n_name="RENAMED", n_regionkey=None)


@_query("SELECT doc_id AS asset_id, CASE WHEN toxic = 1 THEN 5 ELSE quality END AS app_rating FROM labels")
def set_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "labels").select(F.col("doc_id").alias("asset_id"), F.col("quality").cast("int").alias("app_rating"), "toxic")
    return library.set_rating(rows.drop("toxic"), rows.filter("toxic = 1"), 9)


@_query("""SELECT user_id AS asset_id, min(event_id) AS position, tag FROM (SELECT user_id, event_id, CASE WHEN event_type = 'click' THEN 'Click' ELSE event_type END AS tag FROM events) GROUP BY 1, 3""")
def merge_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U3: raw tags take the library's spelling, each once in its first place."""
    raw = _t(spark, sf_dir, "events").select(F.col("user_id").alias("asset_id"), F.col("event_id").alias("position"), F.concat(F.lit(" "), F.col("event_type")).alias("tag"))
    return library.merge_tags(raw, spark.createDataFrame([("Click",)], "tag string"))


# places and jobs


@_query("""SELECT c_custkey AS asset_id, ((n_nationkey * 7) % 60)::DOUBLE AS latitude, ((n_nationkey * 13) % 90)::DOUBLE AS longitude, 'country' AS precision_level, 'wd:Q' || n_nationkey AS place_id
    FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey % 100 >= 60""")
def resolve_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1: nations as a gazetteer; the confidence of a customer's place is its key modulo 100."""
    nations = _t(spark, sf_dir, "nation")
    gazetteer = {"countries": [{"q": f"Q{r.n_nationkey}", "en": r.n_name, "lat": r.n_nationkey * 7 % 60, "lon": r.n_nationkey * 13 % 90} for r in nations.collect()]}  # a gazetteer of countries
    rows = _t(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    place = F.to_json(F.struct(F.lower("n_name").alias("country"), (F.col("c_custkey") % 100).alias("confidence")))
    found = places.resolve_places(rows.select(F.col("c_custkey").alias("asset_id"), place.alias("location_json")), gazetteer)
    return found.select("asset_id", "latitude", "longitude", "precision_level", "place_id")


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events")
    status = F.when(F.col("event_id") % 3 == 0, "running").when(F.col("event_id") % 3 == 1, "queued").otherwise("succeeded")
    return e.select(F.col("event_id").alias("job_id"), F.col("event_type").alias("job_type"), status.alias("status"), (F.col("user_id") % 100).cast("int").alias("priority"), F.col("ts").cast("timestamp").alias("created_at"), F.col("ts").cast("timestamp").alias("updated_at"), F.lit(None).cast("string").alias("error_text"))


_JOBS = "(SELECT event_id AS job_id, event_type AS job_type, CASE event_id % 3 WHEN 0 THEN 'running' WHEN 1 THEN 'queued' ELSE 'succeeded' END AS status, user_id % 100 AS priority, ts FROM events)"


@_query(f"""SELECT job_id, CASE WHEN status = 'running' AND ts < TIMESTAMP '2024-01-20' - INTERVAL 10 MINUTE THEN CASE WHEN job_type = 'click' THEN 'queued' ELSE 'failed' END ELSE status END AS status,
    CASE WHEN status = 'running' AND ts < TIMESTAMP '2024-01-20' - INTERVAL 10 MINUTE AND job_type <> 'click' THEN 'stalled' END AS error_text FROM {_JOBS}""")
def reap_stalled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.reap(_jobs(spark, sf_dir), AS_OF, resumable=("click",)).select("job_id", "status", "error_text")


@_query(f"SELECT job_id, priority::INTEGER AS priority FROM {_JOBS} WHERE status = 'queued' ORDER BY priority DESC, ts, job_id LIMIT 50")
def job_queue_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.queue_order(_jobs(spark, sf_dir).filter(F.col("status") == "queued")).select("job_id", "priority").limit(50)


@_query(f"""SELECT job_id, status, priority::INTEGER AS priority FROM {_JOBS}
    WHERE status = 'queued' OR (status = 'running' AND ts >= TIMESTAMP '2024-01-20' - INTERVAL 10 MINUTE) ORDER BY priority DESC, ts, job_id""")
def active_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole active listing; ``job_queue_order`` is its first queued rows."""
    return jobs.active(_jobs(spark, sf_dir), AS_OF).select("job_id", "status", "priority")


@_query(f"SELECT job_id, job_type FROM {_JOBS} ORDER BY ts DESC, job_id DESC LIMIT 20")
def latest_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.latest(_jobs(spark, sf_dir), limit=20).select("job_id", "job_type")
