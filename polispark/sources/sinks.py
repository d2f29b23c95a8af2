"""Writes: whole versions of a table, a run log, and a small state table."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOG = "run string, pipeline string, status string, n bigint, message string, at timestamp"
_STATE = "key string, value string, at timestamp"


def write_version(df: DataFrame, root: str, partition_by: list[str] = ()) -> str:
    """Writes a new version below root and returns its path; readers of older versions are not disturbed."""
    path = f"{root.rstrip('/')}/v-{uuid.uuid4().hex}"
    (df.write.partitionBy(*partition_by) if partition_by else df.write).parquet(path)
    return path


def log_run(spark: SparkSession, path: str, run: str, pipeline: str, status: str, n: int = 0, message: str = "") -> None:
    """Appends one line: running, complete or failed; messages are cut at 1000 characters."""
    now = datetime.datetime.now(datetime.UTC)
    spark.createDataFrame([(run, pipeline, status, n, message[:1000], now)], _LOG).coalesce(1).write.mode("append").parquet(path)


def last_runs(spark: SparkSession, path: str, known: list[str] = ()) -> DataFrame:
    """The latest line of each pipeline; known ones without a run are pending."""
    got = spark.read.schema(_LOG).parquet(path).groupBy("pipeline").agg(F.max_by(F.struct("status", "n", "message", "at"), F.struct("at", "status")).alias("v")).select("pipeline", "v.*")
    if not known:
        return got
    names = spark.createDataFrame([(k,) for k in known], "pipeline string")
    return names.join(got, "pipeline", "left").withColumn("status", F.coalesce("status", F.lit("pending")))


def put_state(spark: SparkSession, path: str, key: str, value: str) -> None:
    """Appends a value for a key; the latest counts."""
    spark.createDataFrame([(key, value, datetime.datetime.now(datetime.UTC))], _STATE).coalesce(1).write.mode("append").parquet(path)


def get_state(spark: SparkSession, path: str, key: str) -> str | None:
    row = spark.read.schema(_STATE).parquet(path).where(F.col("key") == key).agg(F.max_by("value", "at").alias("v")).first()
    return row.v if row else None
