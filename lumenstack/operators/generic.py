"""Operators that the catalog's own ones are made of. All are pure functions
from DataFrames to DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# per group


def first_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each group. For orders of plain columns prefer
    ``largest_per_group``, which needs no sort."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).filter("__rank = 1").drop("__rank")


def largest_per_group(df: DataFrame, keys: Sequence[str], by: Sequence[Column]) -> DataFrame:
    """The row with the greatest ``by`` (nulls least) of each group, as an
    aggregate: partial results leave each task, so hot groups don't."""
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*(F.col(c) for c in df.columns)), F.struct(*by)).alias("__row"))
    return best.select("__row.*")


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each group, ranked; Spark limits groups before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= n)


# counts


def value_counts(df: DataFrame, column: str, limit: int | None = None, contains: str | None = None) -> DataFrame:
    """value and count of what is neither null nor empty, most frequent first, then by value."""
    from ..functions.names import like_pattern

    value = F.col(column)
    rows = df.filter(value.isNotNull() & (value.cast("string") != ""))
    if contains:
        rows = rows.filter(value.ilike(like_pattern(contains)))
    out = rows.groupBy(value.alias("value")).agg(F.count("*").alias("count")).orderBy(F.desc("count"), "value")
    return out.limit(limit) if limit is not None else out


def min_max(df: DataFrame, *columns: str) -> DataFrame:
    """One row: the least and greatest value of each column."""
    return df.agg(*(f(c).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))))


# changes of tables


def upsert(table: DataFrame, rows: DataFrame, keys: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """``rows`` replace those of ``table`` with their keys, or are added.
    Columns in ``keep`` hold on to the old value where the new one is null, and
    columns that ``rows`` lacks hold on to it anyway. ``rows`` has a row a key."""
    old = table.select(*(F.col(c).alias(f"__{c}") for c in table.columns), F.lit(True).alias("__there"))
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    both = rows.withColumn("__new", F.lit(True)).join(old, on, "full_outer")

    def value(c: str) -> Column:
        if c not in rows.columns:
            return F.col(f"__{c}")
        new = F.coalesce(F.col(c), F.col(f"__{c}")) if c in keep else F.col(c)
        return F.when(F.col("__new"), new).otherwise(F.col(f"__{c}"))

    return both.select(*(value(c).cast(table.schema[c].dataType).alias(c) for c in table.columns))


def insert_ignore(table: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds the rows whose keys aren't there yet, each key once."""
    new = rows.select(*table.columns).dropDuplicates(list(keys)).join(table.select(*keys), list(keys), "left_anti")
    return table.unionByName(new)


def delete_keys(table: DataFrame, keys: DataFrame, on: str | Sequence[str]) -> DataFrame:
    return table.join(keys, [on] if isinstance(on, str) else list(on), "left_anti")


def cascade_delete(tables: dict[str, DataFrame], ids: DataFrame, references: dict[str, Sequence[str]]) -> dict[str, DataFrame]:
    """Removes, in every table of ``references``, the rows in which any of the
    named columns is one of ``ids`` (its one column)."""
    (key,) = ids.columns
    out = dict(tables)
    for name, columns in references.items():
        for c in columns:
            gone = ids.select(F.col(key).alias("__gone"))
            out[name] = out[name].join(gone, out[name][c] == gone["__gone"], "left_anti")
    return out


def update_where(table: DataFrame, condition: Column, **values: Column) -> DataFrame:
    """Sets columns where the condition is true; false and null leave the row."""
    return table.withColumns({c: F.when(condition, v).otherwise(F.col(c)).cast(table.schema[c].dataType) for c, v in values.items()})


def partial_update(table: DataFrame, key: str, value: object, **values: object) -> DataFrame:
    """Sets the given columns of one row; None leaves a column as it is."""
    given = {c: F.lit(v) for c, v in values.items() if v is not None}
    return update_where(table, F.col(key) == value, **given) if given else table


def missing_keys(wanted: DataFrame, present: DataFrame, on: str) -> DataFrame:
    """Wanted keys that aren't present: the guard of batches that are all or nothing."""
    return wanted.select(on).distinct().join(present.select(on), on, "left_anti")


class MissingRows(LookupError):
    """A batch names rows that aren't there; nothing is changed."""


def require_all(wanted: DataFrame, present: DataFrame, on: str) -> None:
    gone = [r[0] for r in missing_keys(wanted, present, on).limit(5).collect()]
    if gone:
        raise MissingRows(f"no such {on}: {', '.join(map(str, gone))}")
