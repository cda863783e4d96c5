"""As-of dates from a table, and facts stored for the day join."""

import datetime as dt
import random

import pytest
from sample_rows import day
from shelfline.operators import replay
from shelfline.operators.daily import CELL, daily
from shelfline.sources import catalog, schemas, scratch


def rows(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


@pytest.fixture
def facts(make):
    draw = random.Random(4)
    days = [day("2020-12-01") + dt.timedelta(days=draw.randrange(90)) for _ in range(120)]
    sales = make.sales(*[(str(d), draw.randint(1, 2), draw.randint(1, 3), draw.randint(1, 9), draw.randint(1, 99)) for d in days])
    stock = make.stock(*[(str(d), draw.randint(1, 2), draw.randint(1, 3), draw.randint(0, 9), draw.choice([True, False, None])) for d in days])
    return daily(sales, stock)


def table(spark, days):
    return spark.createDataFrame([(d,) for d in days], "as_of date")


def test_dates_from_a_table_are_those_of_a_list(spark, facts, make):
    """Days before, in, between and after the weeks; repeated and null ones."""
    calendar = make.calendar().where("cal_dt <> date '2020-12-31'")  # a gap within a week
    days = [day("2019-01-01"), *(day("2020-11-29") + dt.timedelta(days=i) for i in range(0, 100, 3)), day("2020-12-31"), day("2031-01-01")]
    given = table(spark, [*days, days[5], None])
    assert rows(replay.replay_dates(facts, calendar, given)) == rows(replay.replay(facts, calendar, days))
    assert rows(replay.compact_dates(facts, calendar, given)) == rows(replay.compact(facts, calendar, days))


def test_a_thousand_dates(spark, facts, make):
    days = [day("2019-06-01") + dt.timedelta(days=i) for i in range(1000)]
    found = replay.replay_dates(facts, make.calendar(), table(spark, days))
    some = [days[k] for k in (0, 550, 583, 600, 640, 999)]
    want = replay.replay(facts, make.calendar(), some)
    assert rows(found.where(found.as_of.isin(some))) == rows(want)
    assert found.select("as_of").distinct().count() == sum(d >= day("2020-12-01") for d in days)


@pytest.mark.parametrize("days", [[], [None], [dt.date(2019, 1, 1)]])
def test_no_date_to_serve(spark, facts, make, days):
    assert replay.replay_dates(facts, make.calendar(), table(spark, days)).count() == 0
    assert replay.compact_dates(facts, make.calendar(), table(spark, days)).count() == 0


def test_no_join_without_an_equality(spark, facts, make, capsys):
    for build in (replay.replay_dates, replay.compact_dates):
        capsys.readouterr()
        build(facts, make.calendar(), table(spark, [day("2021-01-05")])).explain()
        plan = capsys.readouterr().out
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_bucketed_facts_meet_without_an_exchange(spark, make, capsys):
    sales = make.sales(*[("2021-01-04", i % 3, i % 7, 1, 2) for i in range(100)])
    stock = make.stock(*[("2021-01-04", i % 3, i, 1, False) for i in range(9)])
    catalog.create_schema(spark, "bucketed", scratch.fresh_path(spark, "schema"))
    stored = [
        catalog.store_bucketed(df, f"bucketed.{t}", (schemas.FACT_DATES[t], *CELL[1:]), 8, scratch.fresh_path(spark, t))
        for t, df in (("sales", sales), ("inventory", stock))
    ]
    capsys.readouterr()
    joined = daily(*stored)
    joined.explain()
    plan = capsys.readouterr().out
    assert "FullOuter" in plan and "Exchange" not in plan
    assert plan.count("SelectedBucketsCount: 8 out of 8") == 2
    assert rows(joined) == rows(daily(sales, stock))
    capsys.readouterr()
    replay.replay(joined, make.calendar(), [day("2021-01-05")]).explain()  # day rows move once, for the weeks
    plan = capsys.readouterr().out
    assert "FullOuter" in plan and "hashpartitioning(trans_dt" not in plan and "hashpartitioning(cal_dt" not in plan
