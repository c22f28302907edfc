"""Folders that the driver and all executors share, and tables written there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Without it a local session gets a folder of its own; on a cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="spark-jobloom-"))


def fresh_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a fresh folder and read again: its lineage ends there."""
    path = fresh_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, name: str) -> bool:
    path, fs = _path(spark, name)
    return fs.exists(path)


def children(spark: SparkSession, name: str) -> list[str]:
    """Names in a folder; none if it is not there."""
    path, fs = _path(spark, name)
    return sorted(x.getPath().getName() for x in fs.listStatus(path)) if fs.exists(path) else []


def make(spark: SparkSession, name: str) -> None:
    """Makes a folder and those above it where they are not there."""
    path, fs = _path(spark, name)
    fs.mkdirs(path)


def delete(spark: SparkSession, name: str) -> None:
    path, fs = _path(spark, name)
    fs.delete(path, True)


def rename(spark: SparkSession, name: str, to: str) -> bool:
    """Whether the rename took place; it does not where ``to`` is already there."""
    path, fs = _path(spark, name)
    return not exists(spark, to) and fs.rename(path, _path(spark, to)[0])
