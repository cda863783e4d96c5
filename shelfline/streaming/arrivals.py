"""Scheduled pick-up of newly landed drops.

Each call sees which files arrived since the last one (the checkpoint remembers)
and files the snapshots of their days under their own ``run_date``, read off the
file name.  The stream only names the days: a day's drop is read whole from the
landing folder, so a drop whose parts become visible over several calls ends up
whole.  A day's partition holds one drop, the last in text order of those that
have landed, as in the landing audit, whichever call saw which; delivered again
under the same name, it is replaced.  Nothing waits in between, so a timer may
call it as often as it likes.  Drops are whole snapshots, so there is no window,
state or late data here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shelfline.functions import names as N
from shelfline.sources import schemas
from shelfline.sources.files import Location, list_files
from shelfline.streaming import readiness


def _dated(raw: DataFrame, table: str) -> DataFrame:
    """Typed rows of one table's drops with their day."""
    named = raw.withColumn("run_date", N.date_of(N.landed_name(F.col("_metadata.file_path"))))
    return schemas.conform(named.filter(F.col("run_date").isNotNull()), table)


def _landed(location: Location, table: str) -> str:
    return f"{location.base.rstrip('/')}/{table}_[0-9]*"


def arrivals(spark: SparkSession, location: Location, table: str) -> DataFrame:
    """An unbounded frame of the days of one table's files as they arrive; names are read, contents are not."""
    names = readiness.landed_names(spark, _landed(location, table)).select("name", N.date_of(F.col("name")).alias("run_date"))
    return names.filter((N.table_of(F.col("name")) == table) & F.col("run_date").isNotNull())


def replace_days(batch: DataFrame, location: Location, table: str, target: str) -> None:
    """Writes the drop of each day in the batch, as it lies in the landing folder now.

    A day's partition is replaced as a whole, so a batch can run again.
    """
    spark = batch.sparkSession
    days = [row.run_date for row in batch.select("run_date").distinct().collect()]
    if not days:
        return
    # only these days' drops are looked into, in either convention
    labels = ",".join(f"{day:%Y%m%d},{day:%Y-%m-%d}" for day in days)
    near = list_files(spark, f"{location.base.rstrip('/')}/{table}_{{{labels}}}.csv*")
    names = near.select("name", N.date_of(F.col("name")).alias("run_date"))
    names = names.filter((N.table_of(F.col("name")) == table) & F.col("run_date").isin(days))
    chosen = names.groupBy("run_date").agg(F.max("name").alias("name")).collect()  # one row a day
    if not chosen:
        return
    paths = [f"{location.base.rstrip('/')}/{row.name}" for row in chosen]
    raw = spark.read.schema(schemas.reader_ddl(table)).options(**location.options).csv(paths)
    (
        _dated(raw, table)
        .write.mode("overwrite")
        .partitionBy("run_date")
        .option("partitionOverwriteMode", "dynamic")
        .parquet(target)
    )


def ingest(
    spark: SparkSession, location: Location, table: str, target: str, checkpoint: str
) -> StreamingQuery:
    """Starts one pass over what has arrived; wait for it with ``awaitTermination``."""
    return (
        arrivals(spark, location, table)
        .writeStream.foreachBatch(lambda batch, _: replace_days(batch, location, table, target))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
