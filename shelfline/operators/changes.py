"""What has changed between two states of dated facts, by day.

A day's digest is the row count and two sums of 64-bit row hashes (kept in halves, so
that they cannot overflow).  Sums do not depend on the order or the files of the rows,
and count repeated rows.  Each task sends one row a day, however many lines a day has.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ("fact", "day")
WEEK_OF = ("yr_num", "wk_num")
DIGEST = ("n_rows", "high_1", "low_1", "high_2", "low_2")
#: A digest no day has: marks days whose week is being rebuilt.
UNKNOWN = -1


def row_hash(df: DataFrame, seed: int) -> Column:
    """64 bits of a row.  Spark's hash skips nulls, so which columns are null is hashed too."""
    nulls = functools.reduce(F.concat, [F.when(F.col(c).isNull(), "1").otherwise("0") for c in df.columns])
    return F.xxhash64(F.lit(seed), nulls, *df.columns)


def day_digests(df: DataFrame, fact: str, date_column: str, calendar: DataFrame) -> DataFrame:
    """``(fact, day, yr_num, wk_num, n_rows, ...)``: a row for each date of a fact.

    Rows without a date are left out, as no week can hold them; a date the calendar
    does not have gets a null week.  The weekday is part of the digest.
    """
    sums = []
    for seed in (1, 2):
        h = row_hash(df, seed)
        sums += [
            F.sum(F.shiftrightunsigned(h, 32)).alias(f"high_{seed}"),
            F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))).alias(f"low_{seed}"),
        ]
    days = df.where(F.col(date_column).isNotNull()).groupBy(F.col(date_column).alias("day"))
    found = days.agg(F.count(F.lit(1)).alias("n_rows"), *sums)
    weeks = calendar.select(F.col("cal_dt").alias("day"), *WEEK_OF, "day_of_wk_num")
    return found.join(weeks, "day", "left").select(
        F.lit(fact).alias("fact"), "day", *WEEK_OF,
        "n_rows", "high_1", (F.col("low_1") + F.coalesce("day_of_wk_num", F.lit(-1))).alias("low_1"), "high_2", "low_2",
    )


def changed_days(before: DataFrame, after: DataFrame) -> DataFrame:
    """``(fact, day, status, yr_num, wk_num, was_yr_num, was_wk_num)`` of days that differ.

    Status is ``new``, ``withdrawn``, ``moved`` (to another week) or ``changed``.
    """
    old = before.select(*KEY, *[F.col(c).alias(f"was_{c}") for c in (*WEEK_OF, *DIGEST)])
    both = after.join(old, list(KEY), "full_outer")
    moved = functools.reduce(lambda a, b: a | b, [~F.col(c).eqNullSafe(F.col(f"was_{c}")) for c in WEEK_OF])
    differs = functools.reduce(lambda a, b: a | b, [~F.col(c).eqNullSafe(F.col(f"was_{c}")) for c in DIGEST])
    status = (
        F.when(F.col("was_n_rows").isNull(), "new").when(F.col("n_rows").isNull(), "withdrawn")
        .when(moved, "moved").when(differs, "changed")
    )
    return both.withColumn("status", status).where("status is not null").select(*KEY, "status", *WEEK_OF, *[f"was_{c}" for c in WEEK_OF])


def touched_weeks(changes: DataFrame) -> DataFrame:
    """Weeks that hold, or held, a day that differs."""
    now, was = changes.select(*WEEK_OF), changes.select(*[F.col(f"was_{c}").alias(c) for c in WEEK_OF])
    return now.union(was).dropna().distinct()
