"""Writes onto plain files: upsert, insert of what is missing, run log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: list[str] = (), order: str | None = None) -> DataFrame:
    """old with new's rows put in by key, plus `action` (insert, update, none). Columns in `keep` stay as they were.

    Of several rows of a key in new the one with the greatest `order` (a column of new: a sequence, a time) is the last write
    and wins; without an order, and among equals, the greatest row, so that the result does not depend on the place of
    rows. A null key matches a null key. Either table may be empty. Write the result to a new path, never over the one that is read.
    """
    value = [c for c in old.columns if c not in keys]
    row = F.struct(*value)
    last = new.groupBy(*keys).agg((F.max_by(row, F.struct(F.col(order), row)) if order else F.max(row)).alias("_new"))
    had = old.select(*keys, F.struct(*value).alias("_old"))
    cond = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    both = had.alias("o").join(last.alias("n"), cond, "full")
    pick = lambda c: F.coalesce(F.col(f"_old.{c}"), F.col(f"_new.{c}")) if c in keep else F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(f"_old.{c}"))
    action = F.when(F.col("_old").isNull(), "insert").when(F.col("_new").isNotNull(), "update").otherwise("none")
    return both.select(*[F.coalesce(f"o.{k}", f"n.{k}").alias(k) for k in keys], *[pick(c).alias(c) for c in value], action.alias("action")).select(*old.columns, "action")


def merge_json(df: DataFrame, column: str, change: DataFrame, keys: list[str], patch: str) -> DataFrame:
    """df with the JSON objects of `column` merged with those of change's `patch` by key: its keys replace or join the old ones.

    Values of the objects are kept as JSON text; an old value that is null or no object counts as an empty one; rows without a patch
    stay as they are. One patch per key.
    """
    had = F.coalesce(F.try_parse_json(column), F.parse_json(F.lit("{}")))
    return df.join(change.select(*keys, F.col(patch).alias("_patch")), keys, "left").withColumn(column, F.when(F.col("_patch").isNull(), F.col(column)).otherwise(merged_json(F.to_json(had), F.col("_patch")))).select(*df.columns)


def merged_json(old: Column, patch: Column) -> Column:
    """The object of old with the entries of patch put in; keys in alphabetical order."""
    entries = lambda c: F.coalesce(F.from_json(c, "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    a, b = entries(old), entries(patch)
    kept = F.map_filter(a, lambda k, _: ~F.array_contains(F.map_keys(b), k))
    both = F.map_concat(kept, b)
    order = F.sort_array(F.map_keys(both))
    return F.to_json(F.map_from_arrays(order, F.transform(order, lambda k: F.element_at(both, k))))


def insert_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old and those rows of new whose key it lacks, one per key."""
    value = [c for c in old.columns if c not in keys]
    one = new.groupBy(*keys).agg(F.min(F.struct(*value)).alias("v")).select(*keys, "v.*") if value else new.select(*keys).distinct()
    return old.unionByName(one.join(old.select(*keys), keys, "left_anti").select(*old.columns))


def changed_since(df: DataFrame, column: str, after) -> DataFrame:
    """Rows whose watermark column lies after a point; the filter reaches the scan."""
    return df.where(F.col(column) > F.lit(after))


def changed_page(df: DataFrame, column: str, after, number: int = 0, size: int = 1000) -> DataFrame:
    """A page of the rows changed since `after`, oldest first, so that the last one's time (and id) is where the next run resumes."""
    ids = [c for c in df.columns if c != column]
    return changed_since(df, column, after).orderBy(F.col(column).asc_nulls_last(), *ids).offset(number * size).limit(size)


def keyset_page(df: DataFrame, key: str, after=None, size: int = 1000) -> DataFrame:
    """The next `size` rows behind `after` in the order of a unique key; None begins. The filter reaches the scan."""
    return (df if after is None else df.where(F.col(key) > F.lit(after))).orderBy(key).limit(size)


def page(df: DataFrame, order: list, number: int, size: int = 20) -> DataFrame:
    """Page `number` (from 0) in a total order, with the number of all rows and pages."""
    total = df.count()
    return df.orderBy(*order).offset(number * size).limit(size).withColumns({"total": F.lit(total).cast("bigint"), "pages": F.lit(-(-total // size)).cast("bigint")})
