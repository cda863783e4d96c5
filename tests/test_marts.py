"""Hand-computed cases for the day table and the week mart."""

import pytest
from pyspark.sql import functions as F

from sample_rows import day
from shelfline.operators import quality, weekday, weekly
from shelfline.operators.daily import CELL, daily, with_coded_flags
from shelfline.operators.replay import as_of, replay

SUNDAY = "2021-01-10"  # ISO 2021 week 1, the closing day
MONDAY = "2021-01-04"


def one(df):
    rows = df.collect()
    assert len(rows) == 1, rows
    return rows[0]


def mart(make, sales, stock):
    return weekly.weekly_mart(daily(sales, stock), make.calendar())


def test_stock_counts_once_for_several_lines(make):
    sales = make.sales((SUNDAY, 1, 1, 2, 20), (SUNDAY, 1, 1, 3, 30))
    stock = make.stock((SUNDAY, 1, 1, 9, False))
    row = one(mart(make, sales, stock))
    assert (row.wk_sales_qty, row.wk_sales_amt) == (5, 50)
    assert (row.eop_stock_on_hand_qty, row.eop_ordered_stock_qty) == (9, 18)
    assert row.weeks_of_supply == 9 / 5
    coded = one(weekly.weekly_mart_as_coded(sales, stock, make.calendar()))
    assert coded.eop_stock_on_hand_qty == 18
    assert coded.out_of_stock_times == coded.in_stock_times == coded.low_stock_times == 2


def test_stock_without_a_sale_is_kept(make):
    row = one(mart(make, make.sales(), make.stock((SUNDAY, 1, 1, 0, True), (MONDAY, 1, 1, 5, False))))
    assert (row.store_key, row.prod_key, row.yr_num, row.wk_num) == (1, 1, 2021, 1)
    assert (row.wk_sales_qty, row.wk_sales_amt, row.wk_sales_cost) == (0, 0, 0)
    assert row.avg_sales_price is None and row.weeks_of_supply is None
    assert (row.out_of_stock_times, row.in_stock_times, row.low_stock_times) == (1, 1, 0)
    assert row.out_of_stock_pct == 1 / 7 and row.in_stock_pct == 1 - 1 / 7
    assert row.low_stock_impact == 1 and row.no_stock_impact is None


def test_sale_without_stock_is_unknown_not_in_stock(make):
    sales = make.sales((SUNDAY, 1, 1, 2, 20))
    cell = one(with_coded_flags(daily(sales, make.stock())))
    assert cell.out_of_stock_flg is None and cell.in_stock_flg is None and cell.low_stock_flg is None
    assert cell.in_stock_flg_as_coded is True and cell.low_stock_flg_as_coded is False
    row = one(mart(make, sales, make.stock()))
    assert (row.out_of_stock_times, row.in_stock_times, row.low_stock_times) == (0, 0, 0)
    assert row.out_of_stock_pct == 0 and row.in_stock_pct is None and row.low_stock_impact is None
    assert row.eop_stock_on_hand_qty is None


@pytest.mark.parametrize(("on_hand", "sold", "low"), [(9, 10, True), (100, 99, False), (5, 5, False)])
def test_low_stock_compares_numbers(make, on_hand, sold, low):
    cell = one(daily(make.sales((SUNDAY, 1, 1, sold, 10)), make.stock((SUNDAY, 1, 1, on_hand, False))))
    assert cell.low_stock_flg is low


def test_week_over_new_year_is_one_week(make):
    sales = make.sales(("2020-12-28", 1, 1, 1, 1), ("2020-12-31", 1, 1, 1, 1), ("2021-01-03", 1, 1, 1, 1))
    row = one(mart(make, sales, make.stock()))
    assert (row.yr_num, row.wk_num, row.wk_sales_qty) == (2020, 53, 3)


def test_zero_quantity_gives_null_ratios(make):
    sales = make.sales((SUNDAY, 1, 1, 3, 30), (SUNDAY, 1, 1, -3, -30))
    row = one(mart(make, sales, make.stock((SUNDAY, 1, 1, 4, False))))
    assert row.wk_sales_qty == 0 and row.avg_sales_price is None and row.weeks_of_supply is None
    assert row.mean_line_price == 10


def test_impacts(make):
    sales = make.sales((MONDAY, 1, 1, 10, 100), (SUNDAY, 1, 1, 4, 44))
    stock = make.stock((MONDAY, 1, 1, 6, False), (SUNDAY, 1, 1, 0, True))
    row = one(mart(make, sales, stock))
    assert row.potential_low_stock_impact == (100 - 6 * 10) + (44 - 0)
    assert row.no_stock_impact == 44
    assert row.low_stock_times == 2 and row.low_stock_impact == 3


def test_no_row_on_the_closing_day(make):
    row = one(mart(make, make.sales((MONDAY, 1, 1, 1, 1)), make.stock((MONDAY, 1, 1, 8, False))))
    assert row.eop_stock_on_hand_qty is None and row.eop_ordered_stock_qty is None
    assert row.weeks_of_supply is None


def test_closing_day_is_a_parameter(make):
    cells = daily(make.sales((MONDAY, 1, 1, 1, 1)), make.stock((MONDAY, 1, 1, 8, False)))
    assert one(weekly.weekly_mart(cells, make.calendar(), week_end_day=0)).eop_stock_on_hand_qty == 8


def test_repeated_stock_row_counts_once_and_is_reported(make):
    stock = make.stock((SUNDAY, 1, 1, 9, False), (SUNDAY, 1, 1, 9, False))
    row = one(mart(make, make.sales((SUNDAY, 1, 1, 2, 20)), stock))
    assert row.eop_stock_on_hand_qty == 9 and row.in_stock_times == 1
    assert one(quality.repeated_keys(stock, ["cal_dt", "store_key", "prod_key"])).n_rows == 2


def test_as_coded_equals_the_line_grain_join(spark, make):
    """Cells with n lines and m stock rows, against the join spelled out."""
    sales = make.sales(
        (SUNDAY, 1, 1, 2, 20), (SUNDAY, 1, 1, 3, 36), (MONDAY, 1, 1, 1, 7),
        (SUNDAY, 1, 2, 4, 4), ("2021-01-11", 1, 1, 5, 5), (SUNDAY, 2, 1, 6, 60),
    )
    stock = make.stock(
        (SUNDAY, 1, 1, 9, False), (SUNDAY, 1, 1, 2, True), (MONDAY, 1, 1, 4, None),
        (SUNDAY, 1, 2, None, False), (SUNDAY, 7, 7, 1, False),
    )
    calendar = make.calendar()
    s, i, c = sales.alias("s"), stock.alias("i"), calendar.alias("c")
    closing = F.col("day_of_wk_num") == 6
    pairs = s.join(
        i,
        (F.col("s.trans_dt") == F.col("i.cal_dt"))
        & (F.col("s.store_key") == F.col("i.store_key"))
        & (F.col("s.prod_key") == F.col("i.prod_key")),
        "full_outer",
    ).join(c, F.col("s.trans_dt") == F.col("c.cal_dt"))
    want = pairs.groupBy("yr_num", "wk_num", "s.store_key", "s.prod_key").agg(
        F.sum("sales_qty").alias("wk_sales_qty"),
        F.sum("sales_amt").alias("wk_sales_amt"),
        F.sum("discount").alias("wk_discount"),
        F.sum("sales_cost").alias("wk_sales_cost"),
        F.sum("sales_mgrn").alias("wk_sales_mgrn"),
        F.sum(F.when(closing, F.col("inventory_on_hand_qty")).otherwise(0)).alias("eop_stock_on_hand_qty"),
        F.sum(F.when(closing, F.col("inventory_on_order_qty")).otherwise(0)).alias("eop_ordered_stock_qty"),
        F.count("*").alias("out_of_stock_times"),
        F.count("*").alias("in_stock_times"),
        F.count("*").alias("low_stock_times"),
        (F.sum("sales_price").cast("double") / F.count("sales_price")).alias("avg_sales_price"),
    )
    got = weekly.weekly_mart_as_coded(sales, stock, calendar)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(
        map(tuple, want.select(got.columns).collect()), key=str
    )


def test_weekday_rollups(make):
    stock = make.stock((MONDAY, 1, 1, 3, True), ("2021-01-11", 1, 1, 4, True), (SUNDAY, 1, 1, 5, False))
    rows = {r.day_of_wk_num: r for r in weekday.inventory_by_weekday(stock, make.calendar()).collect()}
    assert rows[0].sum_inventory_on_hand_qty == 7 and rows[0].percentage_in_stock == 2 / 7
    assert rows[6].low_stock_impact == 0
    sales = make.sales((MONDAY, 1, 1, 3, 30), (MONDAY, 1, 1, -3, -30), (SUNDAY, 1, 1, 2, 30))
    rows = {r.day_of_wk_num: r for r in weekday.sales_by_weekday(sales, make.calendar()).collect()}
    assert rows[0].average_sales_price is None and rows[6].average_sales_price == 15


@pytest.mark.parametrize(("limit", "n"), [("2021-01-09", 0), (SUNDAY, 1), ("2021-01-11", 1)])
def test_as_of_is_inclusive(make, limit, n):
    assert as_of(make.sales((SUNDAY, 1, 1, 1, 1)), "trans_dt", limit).count() == n
    assert as_of(make.sales(("2021-01-11", 1, 1, 1, 1)), "trans_dt", limit, plus_days=1).count() == (
        limit != "2021-01-09"
    )


def test_replay_equals_rebuilding(spark, make):
    days = ["2020-12-29", "2021-01-03", "2021-01-04", "2021-01-06", SUNDAY, "2021-01-13"]
    sales = make.sales(*[(d, s, p, s + p, 10 * p) for d in days for s in (1, 2) for p in (1, 2)])
    stock = make.stock(*[(d, s, 1, 3, s == 2) for d in days for s in (1, 2)])
    calendar = make.calendar()
    cells = daily(sales, stock)
    asked = [day(d) for d in ("2020-12-01", "2020-12-30", "2021-01-03", "2021-01-05", SUNDAY, "2021-02-01")]
    got = replay(cells, calendar, [*asked, asked[2]])
    want = None
    for d in asked:
        built = weekly.weekly_mart(as_of(cells, "trans_dt", d), calendar).select(
            F.lit(d).alias("as_of"), *[c for c in got.columns if c != "as_of"]
        )
        want = built if want is None else want.unionByName(built)
    assert got.count() == want.count() > 0
    assert got.exceptAll(want).count() == 0
    full = weekly.weekly_mart(cells, calendar)
    assert got.filter(F.col("as_of") == asked[-1]).drop("as_of").exceptAll(full).count() == 0


def test_invariants_on_the_sample(spark, sample_dir):
    from shelfline.plans import sample_model as sample

    sales, stock = sample.sales(spark, sample_dir), sample.inventory(spark, sample_dir)
    cells = daily(sales, stock)
    mart_rows = weekly.weekly_mart(cells, sample.model_calendar(spark, sample_dir))
    left = sales.select(*CELL).distinct()
    right = stock.select(F.col("cal_dt").alias("trans_dt"), "store_key", "prod_key")
    assert cells.count() == left.union(right).distinct().count()
    assert quality.repeated_keys(mart_rows, weekly.WEEK).count() == 0
    total = one(mart_rows.agg(F.sum("wk_sales_qty").alias("q"), F.sum("wk_sales_amt").alias("a")))
    lines = one(sales.agg(F.sum("sales_qty").alias("q"), F.sum("sales_amt").alias("a")))
    assert (total.q, total.a) == (lines.q, lines.a)
    flags = one(
        cells.agg(
            F.count_if("out_of_stock_flg").alias("o"),
            F.count_if("in_stock_flg").alias("i"),
            F.count_if(F.col("out_of_stock_flg").isNull()).alias("u"),
            F.count("*").alias("n"),
        )
    )
    assert flags.o + flags.i + flags.u == flags.n
