"""The week mart kept up to date: only weeks with a changed, new or withdrawn day are rebuilt.

    changes = refresh(spark, sales, inventory, calendar, mart_path, state_path)

A digest of every day of both facts is kept beside the mart.  A refresh digests the
facts (one scan, a row a day leaves each task), compares, reads the days of the weeks
that differ and replaces those weeks' partitions.  Of facts partitioned by week, as
``store_days`` keeps them, only those partitions are read.

Order makes a lost driver harmless: the days about to be rebuilt are first marked as
unknown in the state, then weeks are replaced, then the new digests are written.  A
refresh that finds marks rebuilds those weeks again.  One refresh of a mart runs at a time.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Collection

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfline.operators import changes as C
from shelfline.operators.daily import daily
from shelfline.operators.weekly import WEEK, WEEK_END_DAY, weekly_mart
from shelfline.sources import files, schemas, scratch, sinks, storage

#: Partition column of stored facts: the Monday of a row's date.
WEEK_FROM = "week_from"
#: The columns the mart depends on; a change in any other rebuilds nothing.
USED = {
    "sales": ("trans_dt", "store_key", "prod_key", "sales_qty", "sales_price", "sales_amt", "discount", "sales_cost", "sales_mgrn"),
    "inventory": ("cal_dt", "store_key", "prod_key", "inventory_on_hand_qty", "inventory_on_order_qty", "out_of_stock_flg"),
}
STATE = {"week_end_day": "int", "fact": "string", "day": "date", "yr_num": "int", "wk_num": "int", **dict.fromkeys(C.DIGEST, "bigint")}


def _in_weeks(df: DataFrame, days: Collection[dt.date]) -> Column:
    """The partitions these days may lie in, of a table that ``store_days`` keeps; of any other, all of it."""
    mondays = sorted({day - dt.timedelta(days=day.weekday()) for day in days})
    return F.col(WEEK_FROM).isin(mondays) if WEEK_FROM in df.columns else F.lit(True)


def store_days(df: DataFrame, table: str, path: str, withdrawn: Collection[dt.date] = ()) -> None:
    """Delivers days of a fact to a table partitioned by week: days in ``df`` are replaced whole, ``withdrawn`` ones go.

    Only partitions with such a day are read and written.  Days are listed in the
    driver, which bounds them by the calendar; rows without a date are replaced together.
    """
    spark, date = df.sparkSession, schemas.FACT_DATES[table]
    rows = df.withColumn(WEEK_FROM, F.trunc(date, "week"))
    emptied: set[dt.date] = set()
    if storage.folders(spark, path):
        days = {r[0] for r in df.select(date).distinct().collect()} - {None} | set(withdrawn)
        stored = files.read_saved(spark, path)
        kept = stored.where(_in_weeks(stored, days) & ~F.col(date).isin(sorted(days)))
        rows = rows.unionByName(kept)
        left = {r[0] for r in rows.select(WEEK_FROM).distinct().collect()}
        emptied = {day - dt.timedelta(days=day.weekday()) for day in days} - left
    sinks.save_table(rows, path, partition_by=(WEEK_FROM,), sort_by=(date, "store_key", "prod_key"), replace_partitions=True)
    for monday in emptied:
        storage.delete(spark, f"{path.rstrip('/')}/{WEEK_FROM}={monday.isoformat()}")


def digests(sales: DataFrame, inventory: DataFrame, calendar: DataFrame) -> DataFrame:
    facts = {"sales": sales, "inventory": inventory}
    sales_days, stock_days = (
        C.day_digests(df.select(*USED[table]), table, schemas.FACT_DATES[table], calendar) for table, df in facts.items()
    )
    return sales_days.unionByName(stock_days)


def _state(spark: SparkSession, path: str, week_end_day: int) -> tuple[DataFrame | None, int]:
    """The last state that was written whole, if it is of the same kind of mart, and its number."""
    steps = [int(name[len("step=") :]) for name in storage.folders(spark, path) if name.startswith("step=")]
    for step in sorted(steps, reverse=True):
        at = f"{path}/step={step}"
        if storage.complete(spark, at):
            found = spark.read.schema(", ".join(map(" ".join, STATE.items()))).parquet(at)
            of_other_kind = not found.where(F.col("week_end_day") != week_end_day).isEmpty()
            return (None if of_other_kind else found), max(steps)
    return None, max(steps, default=0)


def _keep(spark: SparkSession, state: DataFrame, path: str, step: int, week_end_day: int) -> None:
    state = state.withColumn("week_end_day", F.lit(week_end_day))
    rows = state.select(*[F.col(name).cast(kind).alias(name) for name, kind in STATE.items()])
    rows.coalesce(1).write.mode("overwrite").parquet(f"{path}/step={step}")  # two rows a day


def rebuilt(
    sales: DataFrame, inventory: DataFrame, calendar: DataFrame, days: list[dt.date], week_end_day: int = WEEK_END_DAY
) -> DataFrame:
    """The mart of the weeks that these days make up.  The dates reach the scans of both facts."""
    facts = (
        df.where(_in_weeks(df, days) & F.col(schemas.FACT_DATES[t]).isin(days)) for t, df in (("sales", sales), ("inventory", inventory))
    )
    return weekly_mart(daily(*facts), calendar, week_end_day)


def refresh(
    spark: SparkSession, sales: DataFrame, inventory: DataFrame, calendar: DataFrame,
    mart_path: str, state_path: str, week_end_day: int = WEEK_END_DAY,
) -> DataFrame:
    """Brings the mart below ``mart_path`` up to date; returns ``changed_days``.

    Without a state, or with one of another ``week_end_day``, everything is built and the
    mart's folder replaced as a whole.  A week that has lost all its days loses its
    partition.  The driver sees the weeks that differ and their dates, as many as the
    calendar has at most.
    """
    state_path = state_path.rstrip("/")
    own = scratch.fresh_path(spark, "digests")
    digests(sales, inventory, calendar).write.parquet(own)
    after = spark.read.parquet(own)
    before, step = _state(spark, state_path, week_end_day)
    layout = {"partition_by": WEEK[:2], "sort_by": WEEK}

    if before is None:
        changes = C.changed_days(after.limit(0), after)
        sinks.save_table(weekly_mart(daily(sales, inventory), calendar, week_end_day), mart_path, **layout)
    else:
        kept = scratch.fresh_path(spark, "changes")
        C.changed_days(before, after).write.parquet(kept)
        changes = spark.read.parquet(kept)
        weeks = C.touched_weeks(changes)
        touched = {(r.yr_num, r.wk_num) for r in weeks.collect()}
        if touched:
            marked = before.join(weeks.withColumn("_touched", F.lit(True)), list(C.WEEK_OF), "left")
            n_rows = F.when(F.col("_touched"), C.UNKNOWN).otherwise(F.col("n_rows"))
            _keep(spark, marked.withColumn("n_rows", n_rows), state_path, step + 1, week_end_day)

            days = [r.cal_dt for r in calendar.join(weeks, list(C.WEEK_OF), "left_semi").select("cal_dt").distinct().collect()]
            sinks.save_table(rebuilt(sales, inventory, calendar, days, week_end_day), mart_path, replace_partitions=True, **layout)
            there = {(r.yr_num, r.wk_num) for r in after.join(weeks, list(C.WEEK_OF), "left_semi").select(*C.WEEK_OF).distinct().collect()}
            for year, week in touched - there:
                storage.delete(spark, f"{mart_path.rstrip('/')}/yr_num={year}/wk_num={week}")

    _keep(spark, after, state_path, step + 2, week_end_day)
    for name in storage.folders(spark, state_path):
        if name != f"step={step + 2}":
            storage.delete(spark, f"{state_path}/{name}")
    return changes


def current(spark: SparkSession, mart_path: str) -> DataFrame:
    """The mart as the last refresh left it, columns in the mart's order."""
    mart = files.read_saved(spark, mart_path)
    return mart.select(*WEEK, *[c for c in mart.columns if c not in WEEK])
