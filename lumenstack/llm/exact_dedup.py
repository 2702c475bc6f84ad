"""Exact duplicates by progressive refinement, in DataFrame operations only.

1. Lengths: rows whose length no other row has are done.
2. Prefix hashes: of the rest, those whose (length, hash of the first
   ``PREFIX`` characters) is theirs alone are done.
3. Full hashes (SHA-256) of the survivors' whole texts decide.

The first two steps work on a staged table of two narrow columns. A filter of
bounded size holds the surviving groups, so the third step finds its rows in
place at every size of the input: texts are never shuffled, and the few rows that
the filter lets through beside them are hashed for nothing. Group tables are
pre-aggregated on the map side, so a text that a third of the rows share sends
a row for each task.

Null text counts as empty. Of equal texts the row with the largest doc_id stays;
where several rows share that doc_id too, one of them. A null doc_id is smaller
than any other. Very long texts are hashed whole. Empty table: no rows. Columns
other than doc_id and text have no part in the decision; whatever their names,
they come back as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bloom import Bloom, fresh, without
from .common import staged

PREFIX = 512


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def _group() -> Column:
    """A hash of (length, prefix hash)."""
    return F.xxhash64(F.octet_length(_text()), F.xxhash64(F.substring(_text(), 1, PREFIX)))


def _sha() -> Column:
    return F.unhex(F.sha2(_text(), 256))


def surviving_groups(docs: DataFrame) -> DataFrame:
    """(length, prefix) that several rows share; staged."""
    narrow = staged(docs.select(F.octet_length(_text()).alias("length"), F.xxhash64(F.substring(_text(), 1, PREFIX)).alias("prefix")), "lengths")
    lengths = narrow.groupBy("length").count().filter("count > 1").select("length")
    same_length = narrow.join(lengths, "length", "left_semi")
    return staged(same_length.groupBy("length", "prefix").count().filter("count > 1").select("length", "prefix"), "survivors")


def survivors(docs: DataFrame) -> Bloom:
    """A filter that holds the group of every row that may have a copy."""
    return Bloom.of(surviving_groups(docs), F.xxhash64("length", "prefix"))


def _groups(hashed: DataFrame) -> DataFrame:
    """sha, keep_id, group_size of the texts that several rows of ``hashed`` have; staged."""
    return staged(hashed.groupBy("sha").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).filter("group_size > 1"), "groups")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row. The hash of
    every text is asked for here; only survivors are grouped by it."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _group().alias("h"), _sha().alias("sha"))
    hashed = staged(survivors(docs).flagged(narrow, F.col("h"), "candidate").drop("h"), "hashed")
    some = hashed.filter("candidate")
    # rows that repeat both id and text are counted, and come back as so many rows
    rows = some.groupBy("doc_id", "sha").agg(F.count("*").alias("times")).join(_groups(some), "sha", "left")
    rows = rows.select("doc_id", "sha", F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.when(F.col("group_size").isNotNull(), F.col("keep_id")).otherwise(F.col("doc_id")).alias("keep_id"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("nth"))
    own = hashed.filter("not candidate").select("doc_id", "sha", F.lit(1).cast("long").alias("group_size"), F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("nth"))
    out = own.unionByName(rows)
    return out.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def without_copies(docs: DataFrame) -> DataFrame:
    """The rows, all columns as they are, less the copies."""
    known = survivors(docs)
    (flag,) = fresh(docs, "__candidate")
    marked = known.flagged(docs, _group(), flag)
    hashed = staged(marked.filter(F.col(flag)).select(F.col("doc_id").cast("long").alias("doc_id"), _sha().alias("sha")), "hashed")
    keys = hashed.groupBy("doc_id", "sha").agg(F.count("*").alias("times")).join(_groups(hashed), "sha", "left")
    kept = F.col("group_size").isNull() | F.col("doc_id").eqNullSafe(F.col("keep_id"))
    decided = staged(keys.select(F.col("doc_id").alias("k0"), F.col("sha").alias("k1"), kept.alias("kept"), "times"), "decided")
    key = lambda df: [F.col("doc_id").cast("long"), _sha()]
    return without(marked, key, decided, F.col(flag)).select(*docs.columns)
