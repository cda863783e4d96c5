"""Did every table land?  Audit and manifest over a listing of file names.

Input is a frame with a ``name`` column, of any length and any number of days.
A name that does not follow the pattern belongs to no day and is left out; see
``unrecognised``.  Duplicates (a name listed twice, or both conventions for one
table and day) count once.  Arrays hold required tables only, so they are
bounded by five; unexpected tables, which may be many, stay rows.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfline.functions import names as N

REQUIRED = N.REQUIRED_TABLES


def parse(listing: DataFrame) -> DataFrame:
    """Names with their table and date; the date is NULL if the name is not recognised."""
    return listing.withColumns(
        {"table_name": N.table_of(F.col("name")), "run_date": N.date_of(F.col("name"))}
    )


def unrecognised(listing: DataFrame) -> DataFrame:
    return parse(listing).filter(F.col("run_date").isNull()).select("name")


def found(listing: DataFrame) -> DataFrame:
    """Distinct (run_date, table_name), with one name each: the last in text order."""
    return (
        parse(listing)
        .filter(F.col("run_date").isNotNull())
        .groupBy("run_date", "table_name")
        .agg(F.max("name").alias("name"))
    )


def differences(listing: DataFrame, required: Sequence[str] = REQUIRED) -> DataFrame:
    """Rows that break set equality: ``missing`` and ``unexpected`` tables per day.

    One pass: a day's recognised names meet in one row that says which required
    tables are there, every other table of the day in a row of its own.
    """
    wanted = F.col("table_name").isin(*required)
    other = F.when(~wanted, F.col("table_name"))
    rows = (
        parse(listing)
        .filter(F.col("run_date").isNotNull())
        .select("run_date", "table_name", F.explode(F.array_distinct(F.array(F.lit(None).cast("string"), other))).alias("other"))
    )
    days = rows.groupBy("run_date", "other").agg(*[F.bool_or(F.col("table_name") == t).alias(f"_{t}") for t in required])
    gaps = F.array_compact(F.array(*[F.when(~F.col(f"_{t}"), t) for t in required]))
    listed = F.when(F.col("other").isNull(), gaps).otherwise(F.array("other"))
    status = F.when(F.col("other").isNull(), "missing").otherwise("unexpected")
    return days.select("run_date", F.explode(listed).alias("table_name"), status.alias("status"))


def audit(
    listing: DataFrame,
    required: Sequence[str] = REQUIRED,
    days: Sequence[dt.date] | None = None,
) -> DataFrame:
    """One row per day: what is present, what is missing, is the day ready.

    ``days`` adds days to report on even if nothing landed for them.
    """
    have = found(listing).select("run_date", "table_name")
    if days:
        asked = F.explode(F.array(*[F.lit(d).cast("date") for d in days]))
        blank = listing.sparkSession.range(1).select(
            asked.alias("run_date"), F.lit(None).cast("string").alias("table_name")
        )
        have = have.unionByName(blank)
    is_wanted = F.col("table_name").isin(*required)
    per_day = have.groupBy("run_date").agg(
        *[F.bool_or(F.col("table_name") == t).alias(f"_{t}") for t in required],
        F.count_if(~is_wanted).alias("n_unexpected"),
    )
    seen = {t: F.coalesce(F.col(f"_{t}"), F.lit(False)) for t in sorted(required)}
    present = F.array_compact(F.array(*[F.when(hit, t) for t, hit in seen.items()]))
    missing = F.array_compact(F.array(*[F.when(~hit, t) for t, hit in seen.items()]))
    return per_day.select(
        "run_date",
        present.alias("present"),
        missing.alias("missing"),
        F.size(present).alias("n_present"),
        F.size(missing).alias("n_missing"),
        "n_unexpected",
        ((F.size(missing) == 0) & (F.col("n_unexpected") == 0)).alias("ready"),
    )


def manifest(listing: DataFrame, base: str, required: Sequence[str] = REQUIRED) -> DataFrame:
    """For each ready day, a JSON object from table to file location.

    A ready day holds the required tables and nothing else, so only required
    tables are gathered: at most five entries a day, whatever the listing holds.
    """
    is_wanted = F.col("table_name").isin(*required)
    entry = F.struct("table_name", F.concat(F.lit(base.rstrip("/") + "/"), F.col("name")))
    per_day = (
        found(listing)
        .groupBy("run_date")
        .agg(
            F.collect_list(F.when(is_wanted, entry)).alias("entries"),
            F.count_if(~is_wanted).alias("n_unexpected"),
        )
    )
    ready = (F.size("entries") == len(required)) & (F.col("n_unexpected") == 0)
    conf = F.struct(F.map_from_entries(F.array_sort("entries")).alias("conf"))
    return per_day.filter(ready).select("run_date", F.to_json(conf).alias("payload"))


def read_manifest(manifests: DataFrame, required: Sequence[str] = REQUIRED) -> DataFrame:
    """Look each table's location up in the JSON again, one column per table."""
    conf = F.from_json("payload", "conf map<string,string>").getField("conf")
    return manifests.select(
        "run_date", *[F.try_element_at(conf, F.lit(t)).alias(f"{t}_path") for t in sorted(required)]
    )
