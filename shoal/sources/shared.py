"""The folder that all executors share, and tables and marks in it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names. Where it is unset, a local session (one machine) gets a new folder and a cluster an error."""
    at = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not at:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="shoal-shared-")
        spark.conf.set("spark.checkpoint.dir", at)
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage: df as Parquet in the shared folder, read again. It runs once (checkpoint() runs a plan twice), and later plans know its size."""
    path = f"{shared_dir(df.sparkSession)}/shoal/rows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _place(spark: SparkSession, path: str) -> tuple:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def touch(spark: SparkSession, path: str) -> None:
    """Make an empty file in any file system that Spark reaches; one that is there stays."""
    at, fs = _place(spark, path)
    fs.mkdirs(at.getParent())
    fs.createNewFile(at)


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names below a folder; none if there is no folder."""
    at, fs = _place(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []
