"""The daily job: read one day's five drops, build the mart, save four tables.

    python -m shelfline.plans.job --run-date 2022-10-12 \\
        --input s3a://landing --output s3a://warehouse

The run date is an argument (the default is today), never "now plus a day".
"""

from __future__ import annotations

import argparse
import datetime as dt
import functools
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfline.functions import names as N
from shelfline.operators import quality
from shelfline.operators.daily import CELL, daily
from shelfline.operators.weekly import WEEK, WEEK_END_DAY, weekly_mart
from shelfline.plans import refresh
from shelfline.session import build_session
from shelfline.sources import catalog, files, records, schemas, scratch, sinks
from shelfline.sources.files import Location

DIMENSIONS = ("calendar", "product", "store")
FACTS = ("sales", "inventory")
MART = "sales_inv_store_wk"
CURRENT = "sales_inv_store_wk_current"
DAY_TABLE = "sales_inv_store_dy"
CHANGED = "changed_days"
REJECTS = "rejects"
REPEATED = "repeated_keys"
STOCK_KEY = ("cal_dt", "store_key", "prod_key")


@dataclass(frozen=True)
class JobConfig:
    run_date: dt.date
    input_base: str
    output_base: str
    mode: str = "overwrite"
    week_end_day: int = WEEK_END_DAY
    compression: str = "zstd"
    save_daily: bool = False
    save_sales: bool = False
    rejects: bool = False
    incremental: bool = False
    null_value: str | None = None
    dashed_names: bool = False
    catalog_schema: str | None = None

    def location(self) -> Location:
        place = Location(self.input_base)
        return place if self.null_value is None else place.with_options(nullValue=self.null_value)

    def target(self, table: str) -> str:
        return sinks.table_path(self.output_base, table, self.run_date)


def read_inputs(spark: SparkSession, config: JobConfig) -> dict[str, DataFrame]:
    return {
        table: files.read_drop(
            spark, config.location(), table, config.run_date, config.dashed_names
        )
        for table in FACTS + DIMENSIONS
    }


def read_untrusted(spark: SparkSession, config: JobConfig) -> dict[str, DataFrame]:
    """Every line of every drop, coerced: each table with the reason a row is rejected for.

    A drop's text is scanned once; what uses its rows reads the records written then.
    """
    place, found = config.location(), {}
    for table in FACTS + DIMENSIONS:
        path = place.path(table, config.run_date, config.dashed_names)
        found[table] = quality.coerce(records.read_records(spark, path, table, place.options), table)
        if table in DIMENSIONS:
            found[table] = quality.mark_repeated(found[table], schemas.KEYS[table])
    return found


def run(spark: SparkSession, config: JobConfig) -> dict[str, str]:
    """Runs the job; returns the path of every table it saved.

    A run's folder is replaced as a whole (mode "overwrite") or added to; dimensions
    are always replaced, as each run delivers them whole.  The mart is built from this
    run's day rows only; if the day table is kept, they are joined once: the mart is
    built from the kept table or, if that is added to, both from a table of the job's own.

    A dimension key that comes more than once would multiply the facts: it stops the
    job.  With ``rejects`` nothing in a drop does: broken lines, rows that do not parse
    and repeats of a dimension key are saved beside the mart with reason, file and line,
    and so are keys of stock rows that came more than once.

    With ``incremental`` there is one mart for all runs, of which only the weeks are
    rebuilt that have changed since the last run (see ``refresh``); the days that had
    are saved with the run.
    """
    saved: dict[str, str] = {}

    def save(table: str, df: DataFrame, mode: str = config.mode, **layout) -> None:
        path = config.target(table)
        sinks.save_table(df, path, mode=mode, compression=config.compression, **layout)
        saved[table] = path

    if config.rejects:
        checked = read_untrusted(spark, config)
        inputs = {t: schemas.conform(quality.accepted(df), t) for t, df in checked.items()}
        bad = [
            quality.rejected(df).select(
                F.lit(t).alias("table_name"), quality.REASON, records.FILE, records.LINE
            )
            for t, df in checked.items()
        ]
        save(REJECTS, functools.reduce(DataFrame.unionByName, bad), partition_by=("table_name",), spread_by=(records.LINE,))
        save(REPEATED, quality.repeated_keys(inputs["inventory"], STOCK_KEY))
    else:
        inputs = read_inputs(spark, config)

    for table in DIMENSIONS:
        save(table, inputs[table], mode="overwrite")
        inputs[table] = files.read_saved(spark, saved[table])
        quality.require_unique(inputs[table], table)
    if config.save_sales:
        save("sales", inputs["sales"])
    if config.incremental:
        base = f"{config.output_base.rstrip('/')}/{CURRENT}"
        changed = refresh.refresh(spark, *(inputs[t] for t in (*FACTS, "calendar")), base, f"{base}_state", config.week_end_day)
        save(CHANGED, changed)
    if config.save_daily or not config.incremental:
        cells = daily(inputs["sales"], inputs["inventory"])
    if config.save_daily:
        if config.mode == "append":
            own = scratch.fresh_path(spark, "cells")
            sinks.save_table(cells, own, cluster_by=CELL[:1], sort_by=CELL)
            cells = files.read_saved(spark, own)
        save(DAY_TABLE, cells, cluster_by=CELL[:1], sort_by=CELL)
        if config.mode != "append":
            cells = files.read_saved(spark, saved[DAY_TABLE])
    if not config.incremental:
        mart = weekly_mart(cells, inputs["calendar"], config.week_end_day)
        save(MART, mart, partition_by=WEEK[:2], sort_by=WEEK)

    if config.catalog_schema:
        catalog.create_schema(spark, config.catalog_schema)
        for table, path in saved.items():
            name = f"{config.catalog_schema}.{table}"
            catalog.expose_run(spark, name, path.rsplit("/", 1)[0], N.date_label(config.run_date))
        if config.incremental:
            catalog.expose(spark, f"{config.catalog_schema}.{CURRENT}", base)
    return saved if not config.incremental else {**saved, CURRENT: base}


def parse_args(argv: list[str] | None = None) -> JobConfig:
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    parser.add_argument("--run-date", type=dt.date.fromisoformat, default=dt.date.today())
    parser.add_argument("--input", required=True, dest="input_base")
    parser.add_argument("--output", required=True, dest="output_base")
    parser.add_argument("-m", "--mode", choices=("overwrite", "append"), default="overwrite")
    parser.add_argument("--week-end-day", type=int, default=WEEK_END_DAY)
    parser.add_argument("--compression", default="zstd")
    parser.add_argument("--save-daily", action="store_true")
    parser.add_argument("--save-sales", action="store_true")
    parser.add_argument("--rejects", action="store_true")
    parser.add_argument("--incremental", action="store_true")
    parser.add_argument("--null-value")
    parser.add_argument("--dashed-names", action="store_true")
    parser.add_argument("--catalog-schema")
    return JobConfig(**vars(parser.parse_args(argv)))


if __name__ == "__main__":
    run(build_session(), parse_args())
