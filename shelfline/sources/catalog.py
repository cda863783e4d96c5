"""Schemas and tables in Spark's catalog, for reporting tools to query."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from shelfline.sources import schemas


def create_schema(spark: SparkSession, schema: str, path: str | None = None) -> None:
    where = f" LOCATION '{path}'" if path else ""
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS {schema}{where}")


def create_raw_table(spark: SparkSession, table: str, name: str, path: str) -> None:
    """An empty table under the declared contract, lengths and NOT NULL included."""
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.sql(f"CREATE TABLE {name} ({schemas.table_ddl(table)}) USING parquet LOCATION '{path}'")


def load(df: DataFrame, table: str, name: str) -> None:
    """Append rows to a declared table; Spark checks lengths and types on insert."""
    schemas.to_contract(df, table).write.mode("append").insertInto(name)


def expose(spark: SparkSession, name: str, path: str) -> DataFrame:
    """Make a saved parquet folder a catalog table, its partitions included.

    An existing table stays where it is: partitions written since are added, so
    readers never find it gone.
    """
    if not spark.catalog.tableExists(name):
        spark.catalog.createTable(name, path=path, source="parquet")
    if spark.sql(f"DESCRIBE TABLE {name}").filter("col_name = '# Partition Information'").count():
        spark.catalog.recoverPartitions(name)
    spark.catalog.refreshTable(name)
    return spark.table(name)


def expose_run(spark: SparkSession, name: str, folder: str, run_date: str) -> None:
    """The folder of all runs as a table partitioned by ``run_date``, and ``{name}_latest`` on one run."""
    expose(spark, name, folder)
    spark.sql(f"CREATE OR REPLACE VIEW {name}_latest AS SELECT * FROM {name} WHERE run_date = {run_date}")


def store_bucketed(df: DataFrame, name: str, keys: Sequence[str], buckets: int, path: str) -> DataFrame:
    """A table whose files are dealt by the hash of ``keys``, sorted by them.

    Tables with as many buckets on the keys of a join or grouping meet without another
    shuffle.  Rows are dealt to one task a bucket first, so a bucket is one file.
    """
    writer = df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys)
    writer.mode("overwrite").option("path", path).option("compression", "zstd").saveAsTable(name)
    return df.sparkSession.table(name)
