"""Summaries, coverage and precision."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import review_label
from .browse import MATCHED, Tables
from .generic import value_counts

OUTCOMES = ("true_positive", "false_positive", "false_negative", "true_negative", "missing")


def summary(tables: Tables) -> DataFrame:
    """One row of counters: a pass over each table, then rows side by side."""
    a = tables["assets"].agg(F.count("*").alias("assets"), F.count_if(F.col("asset_type") == "raw").alias("raws"), F.count_if(F.col("asset_type") == "image").alias("images"), F.count_if(F.col("asset_type") == "video").alias("videos"), F.count_if(F.col("app_rating") > 0).alias("rated"), F.count_if(~F.col("exists_on_disk")).alias("missing"))
    r = tables["image_lookup_registry"].agg(F.count_if(F.col("status").isin(*MATCHED)).alias("matched"), F.count_if(F.col("status") == "unmatched").alias("unmatched"), F.count_if(F.col("status") == "pending_confirmation").alias("pending"), F.count_distinct("raw_asset_id").alias("bound_raws"))
    t = tables["asset_ai_annotations"].agg(F.count("*").alias("annotated"))
    c = tables["collections"].agg(F.count("*").alias("collections"))
    p = tables["person_groups"].agg(F.count("*").alias("person_groups"))
    return a.crossJoin(F.broadcast(r)).crossJoin(F.broadcast(t)).crossJoin(F.broadcast(c)).crossJoin(F.broadcast(p))  # a row each


def import_mode(has_raws: bool, has_images: bool) -> str:
    return "combined" if has_raws and has_images else "raw" if has_raws else "images"


def outcomes(truth: DataFrame, decisions: DataFrame) -> DataFrame:
    """image_path and outcome. ``truth``: image_path, raw_path (empty: none);
    ``decisions``: image_path, matched_path (null: none)."""
    rows = truth.select("image_path", F.nullif(F.trim("raw_path"), F.lit("")).alias("want")).join(decisions.select("image_path", F.col("matched_path").alias("got"), F.lit(True).alias("known")), "image_path", "left")
    kind = (
        F.when(F.col("known").isNull(), "missing")
        .when(F.col("want").isNotNull() & (F.col("want") == F.col("got")), "true_positive")
        .when(F.col("got").isNotNull(), "false_positive")
        .when(F.col("want").isNotNull(), "false_negative")
        .otherwise("true_negative")
    )
    return rows.select("image_path", kind.alias("outcome"))


def evaluation(outcome_rows: DataFrame) -> DataFrame:
    """One row: the five counts, precision and recall to four digits (null without a case)."""
    n = {k: F.count_if(F.col("outcome") == k) for k in OUTCOMES}
    tp, fp, fn = n["true_positive"], n["false_positive"], n["false_negative"]
    return outcome_rows.agg(*(c.alias(k) for k, c in n.items()), F.round(tp / F.nullif(tp + fp, F.lit(0)), 4).alias("precision"), F.round(tp / F.nullif(tp + fn, F.lit(0)), 4).alias("recall"))


def ground_truth(registry: DataFrame, assets: DataFrame, statuses: tuple[str, ...] = MATCHED) -> DataFrame:
    """image_path, raw_path and notes of decisions, for a CSV sink."""
    raw = assets.select(F.col("asset_id").alias("raw_asset_id"), F.col("path").alias("raw_path"))
    rows = registry.filter(F.col("status").isin(*statuses)).join(raw, "raw_asset_id", "left")
    return rows.select("image_path", F.coalesce("raw_path", F.lit("")).alias("raw_path"), F.concat(review_label(F.col("status")), F.lit(" score="), F.round("score", 4).cast("string")).alias("notes")).orderBy("image_path")


def coverage(rows: DataFrame, *fields: str) -> DataFrame:
    """field, present and ratio: one pass, then a row for each field."""
    there = lambda c: F.count_if(F.col(c).isNotNull() & (F.col(c).cast("string") != ""))
    one = rows.agg(F.count("*").alias("n"), *(there(c).alias(c) for c in fields))
    each = F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("present")) for c in fields))
    return one.select("n", F.inline(each)).select("field", "present", F.round(F.coalesce(F.col("present") / F.nullif("n", F.lit(0)), F.lit(0.0)), 4).alias("ratio"))


def samples(rows: DataFrame, field: str, n: int = 5) -> DataFrame:
    """The first n distinct values of a field."""
    return rows.filter(F.col(field).isNotNull()).select(F.col(field).cast("string").alias("value")).distinct().orderBy("value").limit(n)


def most_common(rows: DataFrame, field: str, n: int = 10) -> DataFrame:
    return value_counts(rows, field, n)
