"""Spark session defaults and shared-folder staging.

``stage`` cuts lineage by writing an intermediate result to Parquet in the
folder the cluster names in ``spark.checkpoint.dir``.  Unlike an executor-local
cache the written table survives lost executors, and unlike an RDD checkpoint
it keeps column pruning and row counts from file footers.
"""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SESSION_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def session(app: str = "tabloom", master: str | None = None, **conf: str) -> SparkSession:
    """Get or create a session with the defaults the operators assume."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    made = builder.getOrCreate()
    # Two scans of one input then have the same splits, whatever executors come and go.
    if made.conf.get("spark.sql.files.minPartitionNum", None) is None:
        made.conf.set("spark.sql.files.minPartitionNum", str(made.sparkContext.defaultParallelism))
    return made


def shared_dir(spark: SparkSession) -> str:
    """Folder for staged tables: the cluster's setting, or a temporary one in local mode only."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="tabloom-"))
    return context.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh, unused path below the shared folder."""
    return f"{shared_dir(spark)}/tabloom-{label}-{uuid.uuid4().hex}"


#: Folders that ``stage`` of this process has written.
_staged: list[str] = []


def release(spark: SparkSession) -> int:
    """Delete what ``stage`` has written so far, once no result that reads it is needed; returns the number of folders."""
    jvm, count = spark._jvm, 0
    while _staged:
        path = jvm.org.apache.hadoop.fs.Path(_staged.pop())
        count += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return count


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and return a scan of the written table."""
    path = new_path(df.sparkSession, label)
    _staged.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
