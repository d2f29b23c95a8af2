"""Structured Streaming over event files: windows, sessions, limits, and incremental upserts."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polispark.operators.upsert import upsert
from polispark.session import shared_dir

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


#: Buckets into which an upserted table is cut by key; a batch rewrites only those that it touches.
BUCKETS = 64


def read_events(spark: SparkSession, path: str, per_trigger: int = 100) -> DataFrame:
    """The event files at a path, which may be one Parquet file or a folder of them, as a stream."""
    reader = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", per_trigger)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile():  # a stream reads folders: its own, and of that one name
        return reader.option("pathGlobFilter", at.getName()).parquet(at.getParent().toString())
    return reader.parquet(path)


def windowed(stream: DataFrame, width: str = "1 day", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Events per window and type. In append mode, windows leave the state once the latest event is `late` past their end; events
    that come later than that are dropped."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    got = stream.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return got.select(F.col("w.start").alias("start"), "event_type", "n", "value")


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions per user: events with no pause of `gap`."""
    got = stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return got.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def over_limit(stream: DataFrame, limit: int, width: str = "1 minute", late: str = "1 hour") -> DataFrame:
    """Users with more than `limit` events in a fixed window."""
    got = stream.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return got.where(F.col("n") > limit).select("user_id", F.col("w.start").alias("start"), "n")


def drained(spark: SparkSession, path: str, plan, name: str) -> DataFrame:
    """What plan(stream of events) gives in append mode, once all files at path are read and all windows are closed.

    Only windows and sessions that the watermark has closed leave the state, so the state is bounded by what is open. Each batch is
    written under its own number, so a repeated batch replaces itself. At the end a single event of the far future is
    read from a second folder by the same query, which closes what is still open.
    """
    base = f"{shared_dir(spark)}/polispark/{spark.sparkContext.applicationId}/stream/{name}-{uuid.uuid4().hex}"
    end = f"{base}/end"
    far = spark.createDataFrame([(None, datetime.datetime(9000, 1, 1), None, None, None, None)], EVENTS)
    far.limit(0).write.parquet(end)
    result = plan(read_events(spark, path).unionByName(spark.readStream.schema(EVENTS).parquet(end)))

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={n}")

    def run() -> None:
        result.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()

    run()
    far.write.mode("append").parquet(end)
    run()
    try_path = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/out")
    there = try_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(try_path)
    return spark.read.schema(result.schema).parquet(f"{base}/out").select(*result.columns) if there else spark.createDataFrame([], result.schema)


def running(spark: SparkSession, path: str, schema: str, keys: list[str], sums: dict, name: str) -> DataFrame:
    """Running aggregates over landed files, taken one at a time: the state is one row per key; the changed rows of each batch are written under its
    number, and the last of each key counts."""
    base = f"{shared_dir(spark)}/polispark/{spark.sparkContext.applicationId}/stream/{name}-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    result = stream.groupBy(*keys).agg(*[c.alias(n) for n, c in sums.items()])

    def write(batch: DataFrame, n: int) -> None:
        batch.withColumn("_batch", F.lit(n)).write.mode("overwrite").parquet(f"{base}/out/{n}")

    result.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    done = _numbers(spark, f"{base}/out")
    if not done:
        return spark.createDataFrame([], result.schema)
    got = spark.read.parquet(*[f"{base}/out/{n}" for n in done])
    return got.groupBy(*keys).agg(F.max_by(F.struct(*sums), "_batch").alias("v")).select(*keys, "v.*")


def _numbers(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the finished entries (folders named by a number that hold _SUCCESS) below a path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(n) for n in names if n.isdigit() and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS")))


_ENTRY = "bucket int, path string, source string, batch bigint"


def _manifest(spark: SparkSession, root: str) -> tuple[int, list]:
    """Number and rows (bucket, path, and the checkpoint and batch that wrote last) of the latest version; 0 and none if there is none."""
    found = _numbers(spark, f"{root}/versions")
    return (found[-1], spark.read.schema(_ENTRY).json(f"{root}/versions/{found[-1]}").collect()) if found else (0, [])


def upserted(spark: SparkSession, root: str, schema) -> DataFrame:
    """The current version of a table that incremental_upsert keeps; empty if there is none."""
    paths = [r.path for r in _manifest(spark, root.rstrip("/"))[1] if r.path]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def incremental_upsert(stream: DataFrame, root: str, keys: list[str], checkpoint: str, order: str | None = None) -> int | None:
    """Takes only files that came since the last call (the checkpoint remembers) and upserts them; the number of the new version.

    The table is cut into BUCKETS by key. A batch reads and rewrites only the buckets that it touches, under new paths, and then
    writes one small list of all buckets' paths as the next version; so readers see whole versions, a lost executor leaves
    no half of one, and a batch that is repeated after its version was written is skipped. `order` is the column by which the last write of a key wins.
    """
    spark = stream.sparkSession
    schema, root = stream.schema, root.rstrip("/")
    done: dict[str, int] = {}
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int").alias("bucket")

    def merge(batch: DataFrame, n: int) -> None:
        last, entries = _manifest(spark, root)
        if any(r.source == checkpoint and r.batch >= n for r in entries):
            return
        batch = batch.persist()
        touched = [r.bucket for r in batch.select(bucket).distinct().collect()]  # at most BUCKETS
        if touched:
            paths = {r.bucket: r.path for r in entries if r.path}
            old = [paths[b] for b in touched if b in paths]
            now = upsert(spark.read.schema(schema).parquet(*old) if old else spark.createDataFrame([], schema), batch, keys, order=order).drop("action")
            at = f"{root}/data/v-{uuid.uuid4().hex}"
            now.withColumn("bucket", bucket).repartition("bucket").write.partitionBy("bucket").parquet(at)
            paths |= {b: f"{at}/bucket={b}" for b in touched}
            rows = [(b, p, None, None) for b, p in sorted(paths.items())] + [(None, None, r.source, r.batch) for r in entries if r.source and r.source != checkpoint] + [(None, None, checkpoint, n)]
            spark.createDataFrame(rows, _ENTRY).coalesce(1).write.mode("overwrite").json(f"{root}/versions/{last + 1}")
            done["version"] = last + 1
        batch.unpersist()

    stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return done.get("version")
