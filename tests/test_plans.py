"""The shapes of plans that keep the jobs scalable."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from shelfline.operators import landing, weekly
from shelfline.operators.daily import daily
from shelfline.operators.replay import as_of, cells_until, replay
from shelfline.plans import catalogue
from shelfline.plans import sample_model as sample
from shelfline.plans.catalogue import QUERIES


@pytest.fixture
def saved(spark, sample_dir, tmp_path_factory):
    """Facts as parquet tables, so that plans show only the operators."""
    base = tmp_path_factory.mktemp("facts")
    sample.sales(spark, sample_dir).write.parquet(f"{base}/sales")
    sample.inventory(spark, sample_dir).write.parquet(f"{base}/inventory")
    return spark.read.parquet(f"{base}/sales"), spark.read.parquet(f"{base}/inventory")


@pytest.fixture
def plan(capsys):
    def text(df):
        capsys.readouterr()
        df.explain()
        return capsys.readouterr().out

    return text


def shuffles(text):
    return re.findall(r"Exchange (?:hash|range|single)partitioning\(([^)]*)\)|Exchange SinglePartition", text)


def test_mart_shuffles_each_fact_once_and_the_day_rows_once(spark, sample_dir, saved, plan):
    text = plan(weekly.weekly_mart(daily(*saved), sample.model_calendar(spark, sample_dir)))
    assert len(shuffles(text)) == 3
    assert "SortMergeJoin" in text and "FullOuter" in text
    assert "BroadcastHashJoin" in text  # the calendar
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert text.count("partial_sum(sales_qty") >= 1  # lines are summed before they move


def test_without_broadcast_the_joins_shuffle_and_agree(spark, sample_dir, saved, plan):
    """What happens to a calendar or dimension that is over the size threshold."""
    build = lambda: weekly.weekly_mart(daily(*saved), sample.model_calendar(spark, sample_dir))
    usual = build().collect()
    key, before = "spark.sql.autoBroadcastJoinThreshold", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set(key, "-1")
    try:
        assert "Broadcast" not in plan(build())
        assert sorted(map(str, build().collect())) == sorted(map(str, usual))
    finally:
        spark.conf.set(key, before)


def test_replay_adds_no_shuffle_of_facts(spark, sample_dir, saved, plan):
    mart = weekly.weekly_mart(daily(*saved), sample.model_calendar(spark, sample_dir))
    again = replay(daily(*saved), sample.model_calendar(spark, sample_dir), [dt.date(1996, 6, 30)])
    assert len(shuffles(plan(again))) <= len(shuffles(plan(mart))) + 2  # calendar weeks only


def test_weekly_sales_is_one_shuffle(spark, sample_dir, saved, plan):
    text = plan(weekly.weekly_sales(saved[0], sample.model_calendar(spark, sample_dir)))
    assert len(shuffles(text)) == 1
    assert re.search(r"ReadSchema: struct<prod_key:int,store_key:int,trans_dt:date,sales_qty:[^,]*,2\),sales_amt", text)


def test_as_of_reaches_the_scan(saved, plan):
    text = plan(as_of(saved[0], "trans_dt", "1998-09-02"))
    assert "LessThanOrEqual(trans_dt,1998-09-02)" in text


def test_replay_reads_no_fact_after_its_last_date(saved, plan):
    text = plan(cells_until(*saved, [dt.date(1996, 6, 30), dt.date(1995, 1, 1)]))
    assert "LessThanOrEqual(trans_dt,1996-06-30)" in text and "LessThanOrEqual(cal_dt,1996-06-30)" in text


def test_differences_read_the_listing_once(spark, sample_dir, plan):
    text = plan(landing.differences(sample.landing_names(spark, sample_dir)))
    assert text.count("FileScan") == 2  # orders and events


def test_preview_is_a_top_n(spark, sample_dir, saved, plan):
    weeks = weekly.weekly_sales(saved[0], sample.model_calendar(spark, sample_dir))
    text = plan(weekly.in_key_order(weeks).limit(20))
    assert "TakeOrderedAndProject" in text and "Sort [" not in text


def test_no_query_plans_a_product_or_python(spark, sample_dir, plan):
    writers = ("s01", "s02", "s03", "s06", "s08", "s10", "s12", "k0", "r04", "r01_audit_of", "p11_job")
    for name, query in QUERIES.items():
        if name.startswith(writers):
            continue
        text = plan(query(spark, sample_dir))
        for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "InPandas"):
            assert bad not in text, (name, bad)


def test_hot_cell_is_collapsed_before_the_shuffle(spark, make):
    """A third of all lines in one cell: right totals, and one row per task moved."""
    lines = spark.range(0, 90000, 1, 6).select(
        F.col("id").alias("trans_id"),
        F.lit("2021-01-10").cast("date").alias("trans_dt"),
        F.when(F.col("id") % 3 == 0, 1).otherwise((F.col("id") % 997).cast("int")).alias("store_key"),
        F.lit(1).alias("prod_key"),
        *[F.lit(1).cast("decimal(18,2)").alias(m) for m in
          ("sales_qty", "sales_price", "sales_amt", "discount", "sales_cost", "sales_mgrn")],
    )
    mart = weekly.weekly_mart(daily(lines, make.stock()), make.calendar())
    assert mart.agg(F.sum("wk_sales_qty")).first()[0] == 90000
    assert mart.filter("store_key = 1").first().wk_sales_qty > 30000


def test_arrivals_build_their_stock_once(spark, make, monkeypatch):
    """The table that four drops are cut from is computed once, not once a drop."""
    stock = make.stock(*[("1998-09-02", 1, i, i, False) for i in range(20)], ("1998-09-03", 1, 1, 1, False))
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    monkeypatch.setattr(sample, "inventory", lambda *_: stock.mapInArrow(counted, stock.schema))
    found = catalogue.s12_arrivals(spark, "").orderBy("run_date").collect()
    assert [r.n_rows for r in found] == [20, 21] and seen.value == 21
