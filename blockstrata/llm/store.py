"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the session has it; where it is unset, on one machine alone, a folder of our own."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if there:
        return there.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="blockstrata-")
    return _own[app]


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/blockstrata-{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def settle(df: DataFrame, name: str, *, sort: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage: whatever follows reads a table that outlives any executor, and non-deterministic
    ids in it stay as first written.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    (df.sortWithinPartitions(*sort) if sort else df).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_at = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
    _made.remove(path)


def discard(*tables: DataFrame) -> None:
    """Delete settled tables that no later step reads."""
    for df in tables:
        _delete(df.sparkSession, df._settled_at)


def clear(spark: SparkSession) -> None:
    """Delete all that this process has left in the shared folder, once no result is read any more."""
    for path in list(_made):
        _delete(spark, path)


def release(spark: SparkSession) -> None:
    """Let the cleaner drop shuffle files of finished phases: it does so when their handles are collected."""
    import gc

    gc.collect()
    spark._jvm.System.gc()
