"""References to records that do not exist, or that were created only later."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polispark.functions.keys import clean_key
from polispark.operators.hierarchy import current_agencies
from polispark.operators.skew import skew_join
from polispark.session import durable, table

#: The table that each end type names.
TARGET_TABLES = {"official": "officials", "agency": "agencies", "proposal": "proposals", "financial_entity": "financial_entities", "governing_body": "governing_bodies"}


def reference_status(refs: DataFrame, targets: DataFrame, key: list[str], at: str, match: str = "partial") -> DataFrame:
    """Adds `status` to refs: 'ok', 'missing' (no such target) or 'late' (every target was created after the reference).

    refs holds the composite key columns `key` and its own time `at`; targets holds `key` and `created_at`. References are
    grouped by the mask of their null key columns, and each mask is looked up on its non-null columns:
    match 'simple': a reference with any null is 'ok', as in SQL; 'full': all null is 'ok', some null is 'missing';
    'partial': all null is 'ok', else the non-null columns must match some target. Several targets of one key count as
    created at the earliest of their times; a null time on either side is never late. Both tables may be empty.
    """
    if match not in ("simple", "partial", "full"):
        raise ValueError(match)
    bits = functools.reduce(lambda a, b: a + b, [F.when(F.col(c).isNull(), 1 << i).otherwise(0) for i, c in enumerate(key)])
    found = sorted(r.mask for r in refs.select(bits.alias("mask")).distinct().collect())  # at most 2 ** columns
    parts = []
    for mask in found or [0]:
        part = refs.where(bits == mask)
        live = [c for i, c in enumerate(key) if not mask >> i & 1]
        if not live or (mask and match == "simple"):
            parts.append(part.withColumn("status", F.lit("ok")))
        elif mask and match == "full":
            parts.append(part.withColumn("status", F.lit("missing")))
        else:
            dim = targets.dropna(subset=live).groupBy(*live).agg(F.min("created_at").alias("_born")).withColumn("_there", F.lit(True))
            status = F.when(F.col("_there").isNull(), "missing").when(F.col("_born") > F.col(at), "late").otherwise("ok")
            joined = skew_join(part, dim, live, "left")
            parts.append(joined.withColumn("status", status).drop("_there", "_born").select(*refs.columns, "status"))
    return functools.reduce(DataFrame.unionByName, parts)


def target_keys(spark, sf_dir: str) -> DataFrame:
    """ref_type, key, created_at of every record that can be pointed to; of agencies the current rows."""
    parts = []
    for kind, name in TARGET_TABLES.items():
        src = table(spark, sf_dir, name)
        src = current_agencies(src).select("id", "created_at") if name == "agencies" else src.select(clean_key("id").alias("id"), "created_at")
        parts.append(src.select(F.lit(kind).alias("ref_type"), F.col("id").alias("key"), "created_at"))
    return functools.reduce(DataFrame.unionByName, parts)


def source_references(spark, sf_dir: str) -> DataFrame:
    """ref_table, ref_field, row_id, ref_type, key, created_at of all references that are not null.

    A reference of blanks only is kept: it is no null, and no record has such a key.
    """
    con = table(spark, sf_dir, "entity_connections").select("id", "from_type", "from_id", "to_type", "to_id", "created_at")
    ends = F.array(*[F.struct(F.lit(f"{end}_id").alias("ref_field"), F.col(f"{end}_type").alias("ref_type"), clean_key(f"{end}_id").alias("key")) for end in ("from", "to")])
    con = con.select(F.lit("entity_connections").alias("ref_table"), clean_key("id").alias("row_id"), "created_at", F.inline(ends))
    fin = table(spark, sf_dir, "financial_relationships").select(F.lit("financial_relationships").alias("ref_table"), F.lit("official_id").alias("ref_field"), clean_key("id").alias("row_id"), F.lit("official").alias("ref_type"), clean_key("official_id").alias("key"), "created_at")
    raw = table(spark, sf_dir, "agencies")
    age = current_agencies(raw).select(F.lit("agencies").alias("ref_table"), F.lit("parent_agency_id").alias("ref_field"), F.col("id").alias("row_id"), F.lit("agency").alias("ref_type"), F.col("parent").alias("key"), "created_at")
    return con.unionByName(fin).unionByName(age).where(F.col("key").isNotNull())


def broken_references(spark, sf_dir: str) -> DataFrame:
    """Every reference whose target is missing or late, with its status and the month of its created_at.

    The cleaned references are written once, as they are read for their masks, their heavy keys and each join.
    """
    found = reference_status(durable(source_references(spark, sf_dir), "references"), target_keys(spark, sf_dir), ["ref_type", "key"], "created_at")
    return found.where(F.col("status") != "ok").withColumn("month", F.date_format("created_at", "yyyy-MM"))
