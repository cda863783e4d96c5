"""As-of views: a table, or the whole week mart, as it stood on given dates."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfline.operators.daily import daily
from shelfline.operators.weekly import WEEK, WEEK_END_DAY, by_week, summarise


def as_of(
    df: DataFrame, date_column: str, day: dt.date | str | Column, plus_days: int = 0
) -> DataFrame:
    """Rows dated up to ``day`` (plus some days).  On parquet this reaches the scan."""
    limit = day if isinstance(day, Column) else F.lit(str(day)).cast("date")
    return df.filter(F.col(date_column) <= (F.date_add(limit, plus_days) if plus_days else limit))


def cells_until(sales: DataFrame, inventory: DataFrame, days: Sequence[dt.date]) -> DataFrame:
    """The day table for a replay of these dates: neither fact is read beyond the last of them."""
    last = max(days)
    return daily(as_of(sales, "trans_dt", last), as_of(inventory, "cal_dt", last))


def replay(
    cells: DataFrame,
    calendar: DataFrame,
    days: Sequence[dt.date],
    week_end_day: int = WEEK_END_DAY,
) -> DataFrame:
    """The week mart for each as-of date, as if rebuilt from facts up to it.

    A week that has closed by an as-of date looks the same for every later date,
    so it is aggregated once; only the week an as-of date falls into is built for
    that date.  Which builds ("slots") a day takes part in is worked out on the
    calendar, so the facts meet it in one equi-join on the date and copy a row
    only for as-of dates inside its own week (a NULL slot is the closed build).
    Copies are made and summed where ``by_week`` put the rows, without another
    shuffle.  Closed rows then fan out to the dates they serve; ``compact`` leaves
    them as they are.
    """
    built, weeks, closed_for = _builds(cells, calendar, days, week_end_day)
    dates = F.when(F.col("_slot").isNull(), closed_for).otherwise(F.array("_slot"))
    return (
        built.join(weeks, ["yr_num", "wk_num"])
        .withColumn("as_of", F.explode(dates))
        .select("as_of", *[c for c in built.columns if c != "_slot"])
    )


def compact(
    cells: DataFrame,
    calendar: DataFrame,
    days: Sequence[dt.date],
    week_end_day: int = WEEK_END_DAY,
) -> DataFrame:
    """The same without copies: a closed week once, valid from its last day; an open one per date.

    ``as_of`` is NULL for closed weeks: they hold for every date from ``valid_from`` on.
    """
    built, weeks, _ = _builds(cells, calendar, days, week_end_day)
    return built.join(weeks, ["yr_num", "wk_num"]).select(
        F.col("_slot").alias("as_of"),
        F.coalesce("_slot", "_close").alias("valid_from"),
        *[c for c in built.columns if c != "_slot"],
    )


def _builds(
    cells: DataFrame, calendar: DataFrame, days: Sequence[dt.date], week_end_day: int
) -> tuple[DataFrame, DataFrame, Column]:
    """Weeks built per slot, the last day of each week, and the dates it has closed by."""
    wanted = F.array(*[F.lit(d).cast("date") for d in sorted(set(days))])
    weeks = calendar.groupBy("yr_num", "wk_num").agg(F.max("cal_dt").alias("_close"))
    closed_for = F.filter(wanted, lambda d: d >= F.col("_close"))
    open_for = F.filter(wanted, lambda d: (d >= F.col("_day")) & (d < F.col("_close")))
    closed_slot = F.when(F.size(closed_for) > 0, F.array(F.lit(None).cast("date"))).otherwise(
        F.array().cast("array<date>")
    )

    slots = (
        calendar.select(F.col("cal_dt").alias("_day"), "yr_num", "wk_num")
        .join(weeks, ["yr_num", "wk_num"])
        .select("_day", F.explode(F.concat(open_for, closed_slot)).alias("_slot"))
    )
    built = summarise(
        by_week(cells, calendar).join(slots, F.col("trans_dt") == F.col("_day"), "inner"),
        ("_slot", *WEEK),
        week_end_day,
    )
    return built, weeks, closed_for


#: Days that share a bin of the interval join between weeks and as-of dates.
BIN_DAYS = 32


def replay_dates(
    cells: DataFrame, calendar: DataFrame, dates: DataFrame, week_end_day: int = WEEK_END_DAY
) -> DataFrame:
    """``replay`` for as-of dates from a table ``dates(as_of)``, however many there are.

    Every join has an equality: dates meet the days of the week they fall into, and
    the weeks closed by then in bins of ``BIN_DAYS`` days.  Repeated and null dates
    count for nothing.  Its rows are as many as the marts it stands for; ``compact_dates`` has one
    row for a closed week instead.
    """
    built, weeks, opened, dates, last = _dated_builds(cells, calendar, dates, week_end_day)
    bins = F.sequence(_bin("_close"), _bin(F.lit(last)))
    waiting = weeks.where(F.col("_close") <= F.lit(last)).withColumn("_bin", F.explode(bins))
    closed = waiting.join(dates.withColumn("_bin", _bin("as_of")), "_bin").where("as_of >= _close")
    serves = closed.select("yr_num", "wk_num", F.lit(None).cast("date").alias("_for"), "as_of").union(
        opened.select("yr_num", "wk_num", F.col("as_of").alias("_for"), "as_of")
    )
    same = [built[c] == serves[c] for c in ("yr_num", "wk_num")] + [F.col("_slot").eqNullSafe(F.col("_for"))]
    return built.join(serves, same).select("as_of", *[built[c] for c in built.columns if c != "_slot"])


def compact_dates(
    cells: DataFrame, calendar: DataFrame, dates: DataFrame, week_end_day: int = WEEK_END_DAY
) -> DataFrame:
    """``compact`` for as-of dates from a table ``dates(as_of)``."""
    built, weeks, *_ = _dated_builds(cells, calendar, dates, week_end_day)
    return built.join(weeks, ["yr_num", "wk_num"]).select(
        F.col("_slot").alias("as_of"),
        F.coalesce("_slot", "_close").alias("valid_from"),
        *[c for c in built.columns if c != "_slot"],
    )


def _bin(day: Column | str) -> Column:
    return F.floor(F.unix_date(day) / BIN_DAYS)


def _dated_builds(
    cells: DataFrame, calendar: DataFrame, dates: DataFrame, week_end_day: int
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, dt.date | None]:
    """Weeks built per slot, the span of each week, the week each date falls into while it is open, the dates, the last date.

    The last date alone reaches the driver.
    """
    dates = dates.select("as_of").dropna().distinct()
    last = dates.agg(F.max("as_of")).first()[0]
    weeks = calendar.groupBy("yr_num", "wk_num").agg(F.min("cal_dt").alias("_open"), F.max("cal_dt").alias("_close"))
    before_close = F.sequence("_open", F.date_sub("_close", 1))
    spans = weeks.where("_open < _close").select("yr_num", "wk_num", F.explode(before_close).alias("as_of"))
    opened = spans.join(dates, "as_of")
    days = calendar.select(F.col("cal_dt").alias("_day"), "yr_num", "wk_num")
    slots = (
        days.join(opened, ["yr_num", "wk_num"]).where("_day <= as_of").select("_day", F.col("as_of").alias("_slot"))
    ).union(
        days.join(weeks, ["yr_num", "wk_num"]).where(F.col("_close") <= F.lit(last)).select("_day", F.lit(None).cast("date"))
    )
    built = summarise(
        by_week(as_of(cells, "trans_dt", F.lit(last).cast("date")), calendar).join(slots, F.col("trans_dt") == F.col("_day"), "inner"),
        ("_slot", *WEEK),
        week_end_day,
    )
    return built, weeks, opened, dates, last
