"""Landed file names: ``{table}_{date}.csv[.gz]``, built and taken apart."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# The tables a day needs and the two naming conventions in use.
REQUIRED_TABLES = ("sales", "inventory", "product", "store", "calendar")
COMPACT_LABEL = "yyyyMMdd"  # sales_20221012.csv.gz
DASHED_LABEL = "yyyy-MM-dd"  # sales_2022-10-12.csv
NAME_PATTERN = r"([^/]+)_(\d{8}|\d{4}-\d{2}-\d{2})\.csv(?:\.gz)?"


def date_label(run_date: dt.date) -> str:
    """Label of one run date, for paths built on the driver."""
    return f"{run_date:%Y%m%d}"


def compact_name(table: Column, day: Column) -> Column:
    return F.concat(table, F.lit("_"), F.date_format(day, COMPACT_LABEL), F.lit(".csv.gz"))


def dashed_name(table: Column, day: Column) -> Column:
    return F.concat(table, F.lit("_"), F.date_format(day, DASHED_LABEL), F.lit(".csv"))


def table_of(name: Column) -> Column:
    """Table part of a landed name (or of a path ending in one); "" if it is none."""
    return F.regexp_extract(name, _whole(), 1)


def date_of(name: Column) -> Column:
    """Date part of a landed name, either convention; NULL if it is no date."""
    digits = F.replace(F.regexp_extract(name, _whole(), 2), F.lit("-"), F.lit(""))
    return F.try_to_date(digits, COMPACT_LABEL)


def landed_name(path: Column) -> Column:
    """The landed name inside a path (a file, or a folder of part files); "" if none."""
    return F.regexp_extract(path, f"(?:^|/)({NAME_PATTERN})(?:/[^/]*)?$", 1)


def _whole() -> str:
    return f"(?:^|/){NAME_PATTERN}$"
