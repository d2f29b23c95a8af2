"""Session helpers: table access and durable intermediate results."""

from __future__ import annotations

import atexit
import io
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_SHIPPED: set[str] = set()
_CLEANED: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` below `sf_dir`; columns are pruned by whatever is selected from it."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session.

    Where the setting is absent, a temporary folder is used, and only in local mode, where one machine is the cluster.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        _OWN[app] = tempfile.mkdtemp(prefix="polispark-")
        atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
    return "file://" + _OWN[app]


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers once per application, so that they need not have it installed.

    Without a shared folder nothing is sent: then the workers must have it.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    try:
        shared_dir(spark)
    except RuntimeError:
        return
    root, data = Path(__file__).resolve().parent, io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, Path("polispark") / p.relative_to(root))
    name = f"{shared_dir(spark)}/polispark/{app}/polispark-workers.zip"
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(data.getvalue()))
    out.close()
    spark.sparkContext.addPyFile(name)


def _clean_later(spark: SparkSession) -> None:
    """Has the application's folder deleted when its driver ends."""
    app = spark.sparkContext.applicationId
    if app not in _CLEANED:
        _CLEANED.add(app)
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/polispark/{app}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def written(df: DataFrame, name: str = "step") -> str:
    """Writes `df` once to the shared folder and returns its path. The files stay until the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/polispark/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _clean_later(spark)
    return path


def durable(df: DataFrame, name: str = "step") -> DataFrame:
    """Writes `df` once to the shared folder and returns a reader of it.

    This cuts the lineage, survives the loss of executors, and keeps column pruning and filter push-down, which a
    checkpointed RDD would lose.
    """
    return df.sparkSession.read.schema(df.schema).parquet(written(df, name))
