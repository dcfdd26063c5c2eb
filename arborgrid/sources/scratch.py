"""Tables written between the steps of an operator."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession


_LEFT: set[str] = set()


def scratch_dir(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir, which the cluster shares. Where that is unset, as in tests, a
    local master gets /tmp/checkpoints; any other is an error, since its executors would not see each other's files."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir names no folder that the executors share")
        root = "file:///tmp/checkpoints"
    folder = f"{root.rstrip('/')}/{spark.sparkContext.applicationId}"
    if folder not in _LEFT:
        _LEFT.add(folder)
        atexit.register(_leave, spark, folder)
    return folder


def _leave(spark: SparkSession, folder: str) -> None:
    """What results still read when the driver ends goes with it; after a crash the folder's name tells the application."""
    with contextlib.suppress(Exception):
        drop_folder(spark, folder)


def new_folder(spark: SparkSession, what: str) -> str:
    """A name that no other call has; two runs, or two attempts, never share files."""
    return f"{scratch_dir(spark)}/{what}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, what: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read back, so that a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = new_folder(spark, what)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._folder = path
    return out


def release(*frames: DataFrame) -> None:
    """Delete what materialise() wrote for these frames, and no other: nothing reads them any more."""
    for df in frames:
        if folder := df.__dict__.pop("_folder", None):
            drop_folder(df.sparkSession, folder)


def drop_folder(spark: SparkSession, uri: str) -> None:
    """Delete a folder through Hadoop's file system, which reaches any store that Spark does."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
