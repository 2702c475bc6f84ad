"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="the driver's tables aren't here")


def plain(frame):
    def show(v):
        return "" if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) in ("NaT", "<NA>") else str(round(v, 9) if isinstance(v, float) else v)

    columns = sorted(frame.columns)
    return columns, sorted(tuple(map(show, r)) for r in frame[columns].values.tolist())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DIR}/{f}'")
    assert plain(entry.queries()[name](spark, DIR).toPandas()) == plain(con.sql(entry.oracle_sql()[name]).df())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_places_of_every_nation(spark, tmp_path):
    spark.range(1200).selectExpr("cast(id as int) n_nationkey", "concat('NATION ', id) n_name").write.parquet(f"{tmp_path}/nation.parquet")
    spark.range(1200).selectExpr("id * 100 + 80 c_custkey", "cast(id as int) c_nationkey").write.parquet(f"{tmp_path}/customer.parquet")
    got = entry.queries()["resolve_places"](spark, str(tmp_path)).collect()
    assert {(r.asset_id, r.place_id) for r in got} == {(i * 100 + 80, f"wd:Q{i}") for i in range(1200)}


def test_active_listing_is_whole(spark):
    jobs = entry.queries()["active_jobs"](spark, DIR).collect()
    assert len(jobs) > 50 and [r.priority for r in jobs] == sorted((r.priority for r in jobs), reverse=True)


@pytest.mark.parametrize("name", ["match_decisions", "match_scores", "match_status_counts"])
def test_parts_with_long_numbers_keep_their_names(spark, tmp_path, name):
    keys = [*range(100_000, 100_006), *range(1_000_000, 1_000_060), *range(12_345_678, 12_345_690)]
    spark.createDataFrame([(k, "Brand#11", "TIN", 1 + k % 50) for k in keys], "p_partkey bigint, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    assert plain(entry.queries()[name](spark, str(tmp_path)).toPandas()) == plain(con.sql(entry.oracle_sql()[name]).df())
