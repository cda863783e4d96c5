"""Typed scans of headered CSV drops and of parquet tables."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfline.functions import names as N
from shelfline.sources import schemas

# Comma separated, one header line.  The header is checked against
# the contract (enforceSchema off) instead of columns being taken by position.
CSV_PROFILE: dict[str, str] = {
    "header": "true",
    "sep": ",",
    "enforceSchema": "false",
    "dateFormat": "yyyy-MM-dd",
    "mode": "FAILFAST",
}


@dataclass(frozen=True)
class Location:
    """A base path of any URI scheme plus the format of the files under it."""

    base: str
    options: dict[str, str] = field(default_factory=lambda: dict(CSV_PROFILE))

    def path(self, table: str, run_date: dt.date, dashed: bool = False) -> str:
        label = f"{run_date:%Y-%m-%d}.csv" if dashed else f"{N.date_label(run_date)}.csv.gz"
        return f"{self.base.rstrip('/')}/{table}_{label}"

    def with_options(self, **options: str) -> Location:
        return Location(self.base, {**self.options, **options})


def read_drop(
    spark: SparkSession, location: Location, table: str, run_date: dt.date, dashed: bool = False
) -> DataFrame:
    """One table's drop for one day, in operator types.

    The path may be a file or a folder of part files; only a folder is read in
    parallel, since a gzip file cannot be split.
    """
    return read_csv(spark, location.path(table, run_date, dashed), table, location.options)


def read_csv(
    spark: SparkSession, path: str, table: str, options: dict[str, str] | None = None
) -> DataFrame:
    raw = spark.read.schema(schemas.reader_ddl(table)).options(**(options or CSV_PROFILE)).csv(path)
    return schemas.conform(raw, table)


def read_text_csv(
    spark: SparkSession, path: str, table: str, options: dict[str, str] | None = None
) -> DataFrame:
    """The same columns as text, for ``quality.coerce``."""
    return (
        spark.read.schema(schemas.text_ddl(table))
        .options(**{**(options or CSV_PROFILE), "mode": "PERMISSIVE"})
        .csv(path)
    )


def read_saved(spark: SparkSession, path: str) -> DataFrame:
    """A table written by ``sinks.save_table``."""
    return spark.read.parquet(path)


def list_files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """Files below a path: location, size, time and landed name.

    Contents are never read; the column is pruned from the scan.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path).select(
        "path", "length", "modificationTime", N.landed_name(F.col("path")).alias("name")
    )


def register(tables: dict[str, DataFrame]) -> None:
    """Name frames as views so that they can be queried in SQL."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
