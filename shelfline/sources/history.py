"""Listings over time: what was added, rewritten or removed between two looks at a folder.

The history is a log.  Recording a listing appends only what differs from the log's last
state, under the next number, so it grows with changes and not with looks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfline.sources import storage

FILE = ("length", "modificationTime")
LOG = "path string, length bigint, modificationTime timestamp, status string"


def differences(before: DataFrame, after: DataFrame) -> DataFrame:
    """``(path, length, modificationTime, status)`` of files that differ between listings of ``path, length, modificationTime``.

    A file of another length or time was ``rewritten``.  Removed files keep what was last known of them.
    """
    old = before.select("path", *[F.col(c).alias(f"was_{c}") for c in FILE], F.lit(True).alias("was"))
    both = after.select("path", *FILE, F.lit(True).alias("now")).join(old, "path", "full_outer")
    same = F.col("length").eqNullSafe(F.col("was_length")) & F.col("modificationTime").eqNullSafe(F.col("was_modificationTime"))
    status = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(~same, "rewritten")
    known = [F.when(F.col("now"), F.col(c)).otherwise(F.col(f"was_{c}")).alias(c) for c in FILE]
    return both.select("path", *known, status.alias("status")).where("status is not null")


def looks(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the looks that were recorded whole."""
    numbers = [int(name.removeprefix("look=")) for name in storage.folders(spark, path) if name.startswith("look=")]
    return sorted(n for n in numbers if storage.complete(spark, f"{path}/look={n}"))


def log(spark: SparkSession, path: str) -> DataFrame:
    """Every change with the number of the ``look`` that found it."""
    whole = [f"{path}/look={n}" for n in looks(spark, path)]
    if not whole:
        return spark.createDataFrame([], f"{LOG}, look int")
    return spark.read.option("basePath", path).schema(f"{LOG}, look int").parquet(*whole)


def current(spark: SparkSession, path: str) -> DataFrame:
    """The listing as last recorded."""
    last = log(spark, path).groupBy("path").agg(F.max_by(F.struct(*FILE, "status"), "look").alias("f"))
    return last.where("f.status <> 'removed'").select("path", "f.length", "f.modificationTime")


def record(listing: DataFrame, path: str) -> DataFrame:
    """Appends what differs from the last look, and returns it.  One recorder at a time."""
    spark, path = listing.sparkSession, path.rstrip("/")
    at = f"{path}/look={max(looks(spark, path), default=0) + 1}"
    differences(current(spark, path), listing).write.mode("overwrite").parquet(at)
    return spark.read.schema(LOG).parquet(at)
