"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    Where it is unset, a folder of our own serves if driver and executors are one machine (tests,
    a local run); on a cluster that is an error, since its machines share no temporary folder.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = os.path.join(tempfile.gettempdir(), "tidemark-shared")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def _path(spark: SparkSession, at: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _own(spark: SparkSession) -> str:
    """What the names of this application's intermediate tables begin with."""
    return f"{shared_dir(spark)}/tidemark-{spark.sparkContext.applicationId}-"


def release(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application now, for sessions that live long:
    results that were not written elsewhere can no longer be read."""
    path, files = _path(spark, _own(spark) + "*")
    for found in files.globStatus(path) or ():
        files.delete(found.getPath(), True)


def discard(df: DataFrame) -> None:
    """Delete a table that ``cut`` made and that nothing reads any more."""
    if at := getattr(df, "_tidemark_cut", None):
        path, files = _path(df.sparkSession, at)
        files.delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it again: the lineage ends there, and lost
    executors take nothing with them. It is deleted when the application ends."""
    spark = df.sparkSession
    at = _own(spark) + uuid.uuid4().hex
    path, files = _path(spark, at)
    df.write.parquet(at)
    files.deleteOnExit(path)
    made = spark.read.schema(df.schema).parquet(at)
    made._tidemark_cut = at
    return made
