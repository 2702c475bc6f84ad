"""Version stacks: sets of pictures of one origin, their repair, and the link graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import directory_of, hashed_id, origin_kind, origin_stem
from .generic import first_per_group, upsert


def set_of(tables: dict[str, DataFrame], asset_id: str) -> DataFrame:
    return tables["resource_sets"].join(tables["resource_set_items"].filter(F.col("asset_id") == asset_id).select("set_id"), "set_id", "left_semi")


def next_sort_order(items: DataFrame) -> DataFrame:
    """set_id and the order that its next member gets (sets without members: 0)."""
    return items.groupBy("set_id").agg((F.coalesce(F.max("sort_order"), F.lit(-1)) + 1).alias("next_order"))


def create_sets(sets: DataFrame, items: DataFrame, primaries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A stack for each asset_id of ``primaries`` that is in none, itself first."""
    alone = primaries.select("asset_id").distinct().join(items.select("asset_id"), "asset_id", "left_anti").withColumn("set_id", hashed_id("set", F.col("asset_id")))
    new_sets = alone.select("set_id", F.col("asset_id").alias("primary_asset_id"))
    new_items = alone.select("set_id", "asset_id", F.lit("primary").alias("role"), F.lit("original").alias("version_kind"), F.lit(None).cast("string").alias("parent_asset_id"), F.lit(1).alias("sort_order"))
    return sets.unionByName(new_sets, allowMissingColumns=True), items.unionByName(new_items, allowMissingColumns=True)


def attach(items: DataFrame, rows: DataFrame) -> DataFrame:
    """Adds or moves members (set_id, asset_id, role, version_kind,
    parent_asset_id) to the ends of their stacks, in the order of their ids."""
    start = next_sort_order(items)
    nth = F.row_number().over(Window.partitionBy("set_id").orderBy("asset_id")) - 1
    placed = rows.join(start, "set_id", "left").withColumn("sort_order", (F.coalesce("next_order", F.lit(0)) + nth).cast("int")).drop("next_order")
    return upsert(items, placed, ["set_id", "asset_id"])


def attach_to_origins(items: DataFrame, pairs: DataFrame, kind: str = "derived") -> DataFrame:
    """Moves each asset_id of ``pairs`` to its origin_id's stack; rows without one stay."""
    homes = items.select(F.col("asset_id").alias("origin_id"), "set_id").dropDuplicates(["origin_id"])
    moved = pairs.join(homes, "origin_id").select("set_id", "asset_id", F.lit("version").alias("role"), F.lit(kind).alias("version_kind"), F.col("origin_id").alias("parent_asset_id"))
    rest = items.join(moved.select("asset_id"), "asset_id", "left_anti").select(*items.columns)
    return attach(rest, moved)


def drop_empty(sets: DataFrame, items: DataFrame) -> DataFrame:
    return sets.join(items.select("set_id"), "set_id", "left_semi")


def promote_primaries(sets: DataFrame, items: DataFrame) -> DataFrame:
    """Stacks whose primary is no member get their first one (order, then id)."""
    first = first_per_group(items, ["set_id"], [F.col("sort_order").asc_nulls_last(), F.col("asset_id").asc()]).select("set_id", F.col("asset_id").alias("first_id"))
    member = items.select("set_id", F.col("asset_id").alias("primary_asset_id"), F.lit(True).alias("held"))
    out = sets.join(first, "set_id", "left").join(member, ["set_id", "primary_asset_id"], "left")
    return out.withColumn("primary_asset_id", F.when(F.col("held"), F.col("primary_asset_id")).otherwise(F.col("first_id"))).select(*sets.columns)


def remove_members(sets: DataFrame, items: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without the asset_ids of ``gone``: emptied stacks go, primaries are replaced."""
    left = items.join(gone.select("asset_id"), "asset_id", "left_anti").select(*items.columns)
    return promote_primaries(drop_empty(sets, left), left), left


def remove_raws(sets: DataFrame, items: DataFrame, assets: DataFrame) -> tuple[DataFrame, DataFrame]:
    return remove_members(sets, items, assets.filter(F.col("asset_type") == "raw").select("asset_id"))


def without_set(assets: DataFrame, items: DataFrame) -> DataFrame:
    """Pictures in no stack."""
    return assets.filter(F.col("asset_type") == "image").join(items.select("asset_id"), "asset_id", "left_anti").orderBy("path")


def singleton_sets(sets: DataFrame, items: DataFrame) -> DataFrame:
    """Stacks whose primary is their only member."""
    single = items.groupBy("set_id").agg(F.count("*").alias("n"), F.min("asset_id").alias("only")).filter("n = 1")
    return sets.join(single, "set_id").filter(F.col("only") == F.col("primary_asset_id")).select(*sets.columns)


def wrongly_merged(items: DataFrame, assets: DataFrame) -> DataFrame:
    """set_id, independents, directories of stacks with several members that
    have no parent, from several directories."""
    free = items.filter("parent_asset_id is null").join(assets.select("asset_id", directory_of(F.col("path")).alias("directory")), "asset_id")
    return free.groupBy("set_id").agg(F.count("*").alias("independents"), F.count_distinct("directory").alias("directories")).filter("independents >= 2 and directories >= 2")


def split_wrongly_merged(sets: DataFrame, items: DataFrame, assets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each independent member of such a stack, but for the primary, gets its own."""
    bad = items.join(wrongly_merged(items, assets).select("set_id"), "set_id", "left_semi").filter("parent_asset_id is null")
    away = bad.join(sets.select("set_id", "primary_asset_id"), "set_id").filter("asset_id <> primary_asset_id").select("asset_id")
    left_sets, left = remove_members(sets, items, away)
    return create_sets(left_sets, left, away)


def split_shared_assets(registry: DataFrame) -> DataFrame:
    """image_path, old and new id of registry rows that share an asset: all but
    the first path get an id of their own that depends on the path."""
    shared = registry.groupBy("image_asset_id").agg(F.count("*").alias("n"), F.min("image_path").alias("first")).filter("n > 1")
    rows = registry.join(shared, "image_asset_id").filter("image_path <> first")
    return rows.select("image_path", F.col("image_asset_id").alias("old_id"), hashed_id("image", F.col("image_asset_id"), F.col("image_path")).alias("new_id"))


def inferred_origins(assets: DataFrame) -> DataFrame:
    """asset_id, origin_id and kind of pictures whose name derives from the one
    other picture with the origin's name (several: first created, then path)."""
    c = F.col("stem")
    derived = assets.filter(F.col("asset_type") == "image").select("asset_id", origin_stem(c).alias("origin"), origin_kind(c).alias("kind")).filter("origin is not null")
    first = first_per_group(assets.filter(F.col("asset_type") == "image"), ["stem"], [F.col("created_at").asc_nulls_last(), F.col("path").asc()])
    return derived.join(first.select(F.col("stem").alias("origin"), F.col("asset_id").alias("origin_id")), "origin").filter("asset_id <> origin_id").select("asset_id", "origin_id", "kind")


def link(links: DataFrame, rows: DataFrame) -> DataFrame:
    """Upserts edges (parent, child, relation, confidence, confirmed_by, recipe_json)."""
    named = rows.withColumn("link_id", hashed_id("link", F.col("parent_asset_id"), F.col("child_asset_id"), F.col("relation_type")))
    return upsert(links, named, ["parent_asset_id", "child_asset_id", "relation_type"], keep=["recipe_json"])


def collage_sources(links: DataFrame, assets: DataFrame, collage: str) -> DataFrame:
    """What a collage was made of, in the order of its recipe."""
    own = links.filter((F.col("child_asset_id") == collage) & (F.col("relation_type") == "collage_source"))
    order = F.get_json_object("recipe_json", "$.sort_order").try_cast("int")
    return own.select(F.col("parent_asset_id").alias("asset_id"), order.alias("sort_order")).join(assets, "asset_id").orderBy(F.col("sort_order").asc_nulls_last(), "asset_id")


def collages_using(links: DataFrame, assets: DataFrame, asset_id: str) -> DataFrame:
    own = links.filter((F.col("parent_asset_id") == asset_id) & (F.col("relation_type") == "collage_source"))
    return own.select(F.col("child_asset_id").alias("asset_id")).distinct().join(assets, "asset_id").orderBy("path")


def repaint_history(items: DataFrame, assets: DataFrame, jobs: DataFrame, set_id: str) -> DataFrame:
    """Repainted members of a stack with the last job that succeeded for each path."""
    members = items.filter((F.col("set_id") == set_id) & (F.col("version_kind") == "ai_repaint")).join(assets.select("asset_id", "path"), "asset_id")
    done = jobs.filter(F.col("status") == "succeeded").withColumn("path", F.get_json_object("result_json", "$.output_path")).filter("path is not null")
    last = first_per_group(done, ["path"], [F.col("created_at").desc(), F.col("job_id").desc()]).select("path", "job_id", "payload_json")
    return members.join(last, "path", "left").orderBy("sort_order", "asset_id")
