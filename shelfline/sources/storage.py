"""The few file system calls that DataFrames have no word for, on any store Spark can reach."""

from __future__ import annotations

from pyspark.sql import SparkSession

MARKER = "_SUCCESS"


def _at(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    place, store = _at(spark, path)
    return store.exists(place)


def delete(spark: SparkSession, path: str) -> None:
    """A folder and all below it; nothing if it is not there."""
    place, store = _at(spark, path)
    store.delete(place, True)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders right below a path, in order."""
    place, store = _at(spark, path)
    if not store.exists(place):
        return []
    return sorted(s.getPath().getName() for s in store.listStatus(place) if s.isDirectory())


def complete(spark: SparkSession, path: str) -> bool:
    """Whether a Spark job has finished writing there."""
    return exists(spark, f"{path.rstrip('/')}/{MARKER}")
