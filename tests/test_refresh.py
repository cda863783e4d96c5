"""Change detection by day and the mart kept up to date."""

import datetime as dt

import pytest
from sample_rows import SALES_DDL, STOCK_DDL, day, money
from pyspark.sql import functions as F
from shelfline.operators import changes
from shelfline.operators.daily import daily
from shelfline.operators.weekly import weekly_mart
from shelfline.plans import job, refresh
from shelfline.sources import files, sinks, storage
from shelfline.sources.files import Location

SOLD = [("2021-01-04", 1, 1, 3, 30), ("2021-01-04", 1, 1, 3, 30), ("2021-01-05", 1, 2, 1, 9), ("2021-01-12", 2, 1, 5, 50), ("2021-01-20", 1, 1, 2, 8)]
HELD = [("2021-01-04", 1, 1, 9, False), ("2021-01-10", 1, 1, None, None), ("2021-01-13", 2, 1, 0, True), ("2021-01-27", 1, 1, 4, False)]


class Kept:
    """Facts in tables by week, their mart and its state."""

    def __init__(self, spark, make, tmp_path):
        self.spark, self.calendar = spark, make.calendar()
        self.paths = {t: f"{tmp_path}/{t}" for t in ("sales", "inventory")}
        self.mart, self.state = f"{tmp_path}/mart", f"{tmp_path}/state"

    def facts(self):
        return [files.read_saved(self.spark, p) for p in self.paths.values()]

    def refresh(self, **more):
        return refresh.refresh(self.spark, *self.facts(), self.calendar, self.mart, self.state, **more)

    def check(self, **more):
        want = weekly_mart(daily(*(f.drop(refresh.WEEK_FROM) for f in self.facts())), self.calendar, **more)
        got = refresh.current(self.spark, self.mart).select(want.columns)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))

    def weeks(self):
        return {r[0] for r in refresh.current(self.spark, self.mart).select("wk_num").distinct().collect()}


@pytest.fixture
def kept(spark, make, tmp_path):
    made = Kept(spark, make, tmp_path)
    refresh.store_days(make.sales(*SOLD), "sales", made.paths["sales"])
    refresh.store_days(make.stock(*HELD), "inventory", made.paths["inventory"])
    made.refresh()
    made.check()
    return made


def statuses(found):
    return {(r.fact, str(r.day)): r.status for r in found.collect()}


def test_inserts_corrections_and_withdrawals(kept, make):
    assert kept.weeks() == {1, 2, 3, 4}
    refresh.store_days(make.sales(("2021-01-05", 1, 2, 2, 18), ("2021-02-02", 1, 1, 1, 4)), "sales", kept.paths["sales"], withdrawn=[day("2021-01-20")])
    found = kept.refresh()
    assert statuses(found) == {("sales", "2021-01-05"): "changed", ("sales", "2021-02-02"): "new", ("sales", "2021-01-20"): "withdrawn"}
    kept.check()
    assert kept.weeks() == {1, 2, 4, 5}  # nothing is left of week 3
    assert kept.refresh().isEmpty()
    kept.check()


def test_only_touched_weeks_are_written_and_read(kept, make, capsys):
    times = lambda: {r.path: r.modificationTime for r in files.list_files(kept.spark, kept.mart, "*.parquet").collect()}
    before = times()
    refresh.store_days(make.sales(("2021-01-12", 2, 1, 6, 60)), "sales", kept.paths["sales"])
    kept.refresh()
    after = times()
    assert {p for p in before if "wk_num=2/" not in p} == {p for p in after if "wk_num=2/" not in p}
    assert not {p for p in before if "wk_num=2/" in p} & set(after)

    capsys.readouterr()
    days = [day("2021-01-11") + dt.timedelta(days=i) for i in range(7)]
    rebuilt = refresh.rebuilt(*kept.facts(), kept.calendar, days)
    rebuilt.explain()
    plan = capsys.readouterr().out
    assert plan.count(f"PartitionFilters: [{refresh.WEEK_FROM}") == 2 or plan.count(f"PartitionFilters: [isnotnull({refresh.WEEK_FROM}") == 2
    assert {r.wk_num for r in rebuilt.collect()} == {2}


@pytest.mark.parametrize("stage", ["save_table", "delete"])
def test_a_run_that_dies_is_made_good_by_the_next(kept, make, monkeypatch, stage):
    """Even if the facts are back as they were by then."""
    refresh.store_days(make.sales(("2021-01-12", 2, 1, 6, 60)), "sales", kept.paths["sales"], withdrawn=[day("2021-01-20")])
    owner = sinks if stage == "save_table" else storage
    real = getattr(owner, stage)

    def die(df_or_spark, path, *args, **layout):
        if "/mart" in path:
            if stage == "save_table":
                real(df_or_spark, path, *args, **layout)  # the weeks are written, the state is not
            raise RuntimeError("lost")
        return real(df_or_spark, path, *args, **layout)

    with monkeypatch.context() as m:
        m.setattr(owner, stage, die)
        with pytest.raises(RuntimeError, match="lost"):
            kept.refresh()
    refresh.store_days(make.sales(*SOLD), "sales", kept.paths["sales"])
    kept.refresh()
    kept.check()


def test_other_calendar_or_week_end(kept):
    moved = kept.calendar.withColumn("wk_num", F.when(F.col("cal_dt") == day("2021-01-04"), 53).otherwise(F.col("wk_num")))
    moved = moved.withColumn("yr_num", F.when(F.col("cal_dt") == day("2021-01-04"), 2020).otherwise(F.col("yr_num")))
    kept.calendar = moved
    assert set(statuses(kept.refresh()).values()) == {"moved"}
    kept.check()
    kept.refresh(week_end_day=2)
    kept.check(week_end_day=2)


def test_days_off_the_calendar_and_without_date(kept, make, spark):
    late = make.sales(("2031-01-05", 1, 2, 2, 18))
    undated = spark.createDataFrame([(9, None, 1, 1, *[money(1)] * 6)], SALES_DDL)
    refresh.store_days(late.union(undated), "sales", kept.paths["sales"])
    assert statuses(kept.refresh()) == {("sales", "2031-01-05"): "new"}
    kept.check()


def test_digest_sees_repeats_order_and_nulls(spark, make):
    calendar = make.calendar()

    def digest(*rows):
        df = spark.createDataFrame([(day(d), 1, 1, money(h), money(o), None) for d, h, o in rows], STOCK_DDL).repartition(3)
        return sorted(map(str, changes.day_digests(df, "inventory", "cal_dt", calendar).collect()))

    one, two = ("2021-01-04", 3, None), ("2021-01-04", None, 3)
    assert digest(one, two, two) == digest(two, one, two)
    assert len({str(digest(*rows)) for rows in ([one], [two], [one, one], [one, two], [one, one, two], [two, two])}) == 6


def test_nothing_at_all(spark, make, tmp_path):
    made = Kept(spark, make, tmp_path)
    none = [spark.createDataFrame([], SALES_DDL), spark.createDataFrame([], STOCK_DDL)]
    for _ in range(2):
        assert refresh.refresh(spark, *none, made.calendar, made.mart, made.state).isEmpty()


def test_incremental_job(spark, make, tmp_path):
    """Two nights of whole snapshots; the second rebuilds the weeks of its new days only."""
    place, out = Location(str(tmp_path / "in")), str(tmp_path / "out")
    dims = {
        "calendar": make.calendar(),
        "store": spark.createDataFrame([(1,), (2,)], "store_key int"),
        "product": spark.createDataFrame([(1,), (2,)], "prod_key int"),
    }
    for date, statuses_ in ((day("2021-01-13"), {"new"}), (day("2021-01-27"), {"new"})):
        sinks.export_snapshot({"sales": make.sales(*SOLD), "inventory": make.stock(*HELD), **dims}, place, date)
        config = job.parse_args(["--run-date", str(date), "--input", place.base, "--output", out, "--incremental", "--catalog-schema", "kept"])
        saved = job.run(spark, config)
        found = files.read_saved(spark, saved[job.CHANGED])
        assert set(statuses(found).values()) == statuses_
    assert {str(r.day) for r in found.collect()} == {"2021-01-20", "2021-01-27"}
    want = weekly_mart(daily(make.sales(*SOLD), make.stock(*HELD)), make.calendar())
    got = refresh.current(spark, saved[job.CURRENT])
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert spark.table(f"kept.{job.CURRENT}").count() == got.count()
