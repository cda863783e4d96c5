"""Rollups by store, product and day of the week, over all weeks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfline.functions.flags import ratio
from shelfline.operators.weekly import DAYS_PER_WEEK, on_calendar

WEEKDAY = ("store_key", "prod_key", "day_of_wk_num")


def inventory_by_weekday(inventory: DataFrame, calendar: DataFrame) -> DataFrame:
    """Stock sums.  ``percentage_in_stock`` is out-of-stock days over seven, as worded."""
    empty = F.col("out_of_stock_flg").cast("int")
    return (
        on_calendar(inventory, calendar, "cal_dt")
        .groupBy(*WEEKDAY)
        .agg(
            F.sum("inventory_on_hand_qty").alias("sum_inventory_on_hand_qty"),
            F.sum("inventory_on_order_qty").alias("sum_inventory_on_order_qty"),
            F.sum(empty).alias("low_stock_impact"),
            (F.sum(empty).cast("double") / DAYS_PER_WEEK).alias("percentage_in_stock"),
        )
    )


def sales_by_weekday(sales: DataFrame, calendar: DataFrame) -> DataFrame:
    """Sales sums and the average price as amount over quantity."""
    return (
        on_calendar(sales, calendar, "trans_dt")
        .groupBy(*WEEKDAY)
        .agg(
            F.sum("sales_qty").alias("sum_sales_qty"),
            F.sum("sales_amt").alias("sum_sales_amt"),
            ratio(F.sum("sales_amt"), F.sum("sales_qty")).alias("average_sales_price"),
            F.sum("sales_cost").alias("total_cost"),
        )
    )
