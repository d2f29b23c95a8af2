"""Deterministic matching in passes: narrow the candidates until one is left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polispark.operators.skew import skew_join


def narrow(left: DataFrame, right: DataFrame, base: list[str], more: list[str], left_id: str, right_id: str) -> DataFrame:
    """left_id, right_id, stage: rows of left whose candidates (equal on `base`) become exactly one.

    The candidates are narrowed by each further column in turn, wherever that leaves any; as soon as one is left, it is the
    match and `stage` is the number of columns used. Rows that stay ambiguous, and null keys, match nothing. A column of
    `more` is compared where both sides have it. Ids must be unique.
    """
    r = right.select(*base, F.col(right_id), *[F.col(c).alias(f"_{c}") for c in more])
    pool = skew_join(left.select(*base, F.col(left_id), *more), r, base, "inner")
    flags = [F.coalesce(F.col(c) == F.col(f"_{c}"), F.lit(False)).cast("int") for c in more]
    # per left row: number of candidates at each stage, and the least id among them
    aggs, on = [F.count("*").alias("n0"), F.min(right_id).alias("m0")], F.lit(1)
    for i, f in enumerate(flags, 1):
        on = on * f
        aggs += [F.sum(on).alias(f"n{i}"), F.min(F.when(on == 1, F.col(right_id))).alias(f"m{i}")]
    got = pool.groupBy(left_id).agg(*aggs)
    hit, stage = F.lit(None).cast(dict(right.dtypes)[right_id]), F.lit(None).cast("int")
    for i in range(len(more), -1, -1):
        hit, stage = F.when(F.col(f"n{i}") == 1, F.col(f"m{i}")).otherwise(hit), F.when(F.col(f"n{i}") == 1, i).otherwise(stage)
    return got.select(left_id, hit.alias(right_id), stage.alias("stage")).where(F.col("stage").isNotNull())


def in_passes(passes: list[DataFrame], left_id: str) -> DataFrame:
    """Results of several passes with the same columns; a row keeps the match of the first pass that has one."""
    out = passes[0].withColumn("pass", F.lit(1))
    for i, p in enumerate(passes[1:], 2):
        out = out.unionByName(p.join(out.select(left_id), left_id, "left_anti").withColumn("pass", F.lit(i)))
    return out
