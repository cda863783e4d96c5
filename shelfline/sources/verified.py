"""Exports that can be proved: a marker with row counts and checksums, written last.

While a table is unloaded, each task adds up the rows it sends and an order-free hash of
them.  The files are then read back and summed the same way.  Only if both agree is the
marker written, and readers refuse a folder without it.  A lost, doubled or altered
part changes the sums (a chance of 2**-64 aside), whatever the order of rows or files.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from shelfline.operators.changes import row_hash
from shelfline.sources import files, schemas, sinks, storage
from shelfline.sources.files import Location

MARKER = "_verified"
SUMS = ("n_rows", "high", "low")


class NotVerified(Exception):
    """A folder that has no marker, or whose files do not add up to it."""


def _spelled(df: DataFrame) -> DataFrame:
    """Values as an unload spells them: an empty text is written as no value."""
    texts = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    return df.withColumns({c: F.nullif(F.col(c), F.lit("")) for c in texts}) if texts else df


def checksum(df: DataFrame) -> list[Column]:
    """Aggregates over all rows: their number, and a hash of each summed in halves, which cannot overflow."""
    h = row_hash(df, 7)
    halves = F.shiftrightunsigned(h, 32), h.bitwiseAND(F.lit(0xFFFFFFFF))
    return [F.count(F.lit(1)).alias("n_rows"), *(F.coalesce(F.sum(x), F.lit(0)).alias(n) for x, n in zip(halves, SUMS[1:], strict=True))]


def measure(df: DataFrame) -> dict[str, int]:
    """The sums of a frame, by reading it."""
    spelled = _spelled(df)
    return spelled.agg(*checksum(spelled)).first().asDict()


def export(df: DataFrame, table: str, path: str, *, options: dict[str, str] | None = None, unload: Callable[..., object] = sinks.unload_csv) -> dict[str, int]:
    """Unloads a table of contract columns and proves it; returns its sums.

    ``path`` is without marker from before the first file is replaced until all files
    have been read back, so a run that dies leaves a folder nobody reads.
    """
    spark = df.sparkSession
    storage.delete(spark, f"{path}/{MARKER}")
    seen, rows = Observation(), _spelled(schemas.to_contract(df, table))
    unload(rows.observe(seen, *checksum(rows)), path)
    sent = {k: int(seen.get[k]) for k in SUMS}
    found = measure(_contract_rows(spark, table, path, options))
    if found != sent:
        raise NotVerified(f"{path}: {sent} were sent, {found} are in the files")
    spark.createDataFrame([(table, *(sent[k] for k in SUMS))], MARKER_DDL).coalesce(1).write.mode("overwrite").json(f"{path}/{MARKER}")
    return sent


MARKER_DDL = "table_name string, n_rows bigint, high bigint, low bigint"


def _contract_rows(spark: SparkSession, table: str, path: str, options: dict[str, str] | None) -> DataFrame:
    """The files' rows in contract types, as they were sent."""
    reader = spark.read.schema(schemas.reader_ddl(table)).options(**(options or files.CSV_PROFILE))
    return reader.csv(path)


def marker(spark: SparkSession, path: str) -> dict[str, int]:
    """The sums a folder was proved with."""
    at = f"{path.rstrip('/')}/{MARKER}"
    if not storage.complete(spark, at):
        raise NotVerified(f"{path} has no complete marker")
    return {k: v for k, v in spark.read.schema(MARKER_DDL).json(at).first().asDict().items() if k in SUMS}


def read(spark: SparkSession, table: str, path: str, *, options: dict[str, str] | None = None, prove: bool = False) -> DataFrame:
    """A proved export in operator types; with ``prove`` its files are summed up again first."""
    sums = marker(spark, path)
    rows = _contract_rows(spark, table, path, options)
    if prove and (found := measure(rows)) != sums:
        raise NotVerified(f"{path}: the marker says {sums}, {found} are in the files")
    return schemas.conform(rows, table)


def export_snapshot(tables: dict[str, DataFrame], location: Location, as_of, *, max_bytes: int = 0, compression: str = "gzip") -> DataFrame:
    """Every table as of a date, facts cut there, each proved: ``(table_name, n_rows, high, low)``."""
    spark, proved = next(iter(tables.values())).sparkSession, []
    layout = {"compression": compression, **({"max_bytes": max_bytes, "at_once": False} if max_bytes else {})}
    unload = functools.partial(sinks.unload_capped if max_bytes else sinks.unload_csv, **layout)
    for table, df in tables.items():
        sums = export(sinks.as_delivered(df, table, as_of), table, location.path(table, as_of), options=location.options, unload=unload)
        proved.append((table, *(sums[k] for k in SUMS)))
    return spark.createDataFrame(proved, MARKER_DDL)
