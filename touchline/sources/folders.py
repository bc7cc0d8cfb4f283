"""Where intermediate tables and stream checkpoints are written."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_LOCAL_FOLDER: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a local run without that setting gets its own."""
    folder = spark.conf.get("spark.checkpoint.dir", "") or ""
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _LOCAL_FOLDER:
        _LOCAL_FOLDER.append(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return f"file://{_LOCAL_FOLDER[0]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder under a new name and read back, so that all that reads it sees the same rows."""
    path = f"{shared_folder(df.sparkSession)}/touchline/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to path to its end."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def cached(spark: SparkSession, name: str, write: Callable[[str], None]) -> str:
    """The path of a table that is written once for each application and name, and found again from then on.

    It is written beside its place and moved there whole, so a reader never sees half of it; of two writers one wins.
    """
    folder = f"{shared_folder(spark)}/touchline/cached-{spark.sparkContext.applicationId}"
    path = f"{folder}/{name}"
    if not exists(spark, path):
        own = f"{folder}/{name}-{uuid.uuid4().hex}"
        write(own)
        make = spark._jvm.org.apache.hadoop.fs.Path
        files = make(own).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not files.rename(make(own), make(path)) and not exists(spark, path):
            raise OSError(f"{own} cannot be moved to {path}")
    return path
