"""The week mart: year x week x store x product.

``weekly_mart`` holds the thirteen required metrics.  Where their wording leaves
room, the reading chosen is:

* average sales price is amount over quantity, NULL for no quantity; the plain
  mean of line prices is kept beside it as ``mean_line_price``;
* end-of-week levels are those of the last day of the week only, NULL if that
  day has no stock row;
* sums of a week with stock rows but no sales are 0, its ratios NULL;
* ``out_of_stock_pct`` is out-of-stock days over seven, as worded; the share in
  stock is one minus it, NULL if the week has no known flag;
* potential low-stock impact values the stock on hand at the day's own average
  price (no amount column for stock exists).  Each day's term is an exact decimal
  quotient at six places, so the sum does not depend on the order of rows;
* the impact of low stock counts each flag by itself, NULL only if neither is
  known on any day of the week;
* partial weeks still divide by seven.

``weekly_mart_as_coded`` answers what the line-grain SQL form computes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfline.functions.flags import ratio
from shelfline.operators.daily import CELL, sales_cells
from shelfline.operators.fill import fill_forward

WEEK = ("yr_num", "wk_num", "store_key", "prod_key")
WEEK_END_DAY = 6  # Monday is 0
DAYS_PER_WEEK = 7


def on_calendar(df: DataFrame, calendar: DataFrame, date_column: str) -> DataFrame:
    """Attach the week columns of a date.

    No hint: the calendar has a row per date, so its size statistics put it under
    Spark's broadcast threshold; were it not, Spark would shuffle instead.
    """
    days = calendar.select(
        F.col("cal_dt").alias("_day"), "yr_num", "wk_num", "day_of_wk_num"
    )
    return df.join(days, F.col(date_column) == F.col("_day"), "inner").drop("_day")


def undated(df: DataFrame, calendar: DataFrame, date_column: str) -> DataFrame:
    """Rows whose date the calendar does not have: those ``on_calendar`` would drop."""
    days = calendar.select(F.col("cal_dt").alias("_day"))
    return df.join(days, F.col(date_column) == F.col("_day"), "left_anti")


def by_week(cells: DataFrame, calendar: DataFrame) -> DataFrame:
    """Day rows with their week, gathered by mart key.

    A mart key has at most seven day rows, so there is nothing to gain from
    partial sums before the shuffle: they would merge next to nothing and are
    several times wider than the rows.  Shuffling the rows themselves lets every
    aggregation by mart key, with or without further keys, run where they land.
    """
    return on_calendar(cells, calendar, "trans_dt").repartition(*WEEK)


def weekly_mart(
    cells: DataFrame, calendar: DataFrame, week_end_day: int = WEEK_END_DAY
) -> DataFrame:
    """All weekly metrics from the day table."""
    return summarise(by_week(cells, calendar), WEEK, week_end_day)


def summarise(
    days: DataFrame, keys: tuple[str, ...], week_end_day: int = WEEK_END_DAY
) -> DataFrame:
    """Metrics over day-grain rows that already carry ``day_of_wk_num``."""
    amount, on_hand = F.col("sales_amt"), F.col("inventory_on_hand_qty")
    empty, low = F.col("out_of_stock_flg"), F.col("low_stock_flg")
    closing = F.col("day_of_wk_num") == week_end_day
    sold = F.col("sales_qty")
    unmet = F.try_divide(amount * (sold - on_hand), sold)  # amount - on_hand * (amount / sold)

    sums = days.groupBy(*keys).agg(
        _sum_or_zero("sales_qty").alias("wk_sales_qty"),
        _sum_or_zero("sales_amt").alias("wk_sales_amt"),
        _sum_or_zero("discount").alias("wk_discount"),
        _sum_or_zero("sales_cost").alias("wk_sales_cost"),
        _sum_or_zero("sales_mgrn").alias("wk_sales_mgrn"),
        F.sum("price_total").alias("_price_total"),
        F.sum("price_lines").alias("_price_lines"),
        F.sum(F.when(closing, on_hand)).alias("eop_stock_on_hand_qty"),
        F.sum(F.when(closing, F.col("inventory_on_order_qty"))).alias("eop_ordered_stock_qty"),
        F.count_if(empty).alias("out_of_stock_times"),
        F.count_if("in_stock_flg").alias("in_stock_times"),
        F.count_if(low).alias("low_stock_times"),
        F.count(empty).alias("_known_days"),
        F.when(
            F.count(empty) + F.count(low) > 0,
            F.sum(F.coalesce(empty.cast("int"), F.lit(0)) + F.coalesce(low.cast("int"), F.lit(0))),
        ).alias("low_stock_impact"),
        F.sum(F.when(low, unmet)).alias("potential_low_stock_impact"),
        F.sum(F.when(empty, amount)).alias("no_stock_impact"),
    )
    out_share = F.col("out_of_stock_times").cast("double") / DAYS_PER_WEEK
    return sums.select(
        *keys,
        "wk_sales_qty",
        ratio(F.col("wk_sales_amt"), F.col("wk_sales_qty")).alias("avg_sales_price"),
        ratio(F.col("_price_total"), F.col("_price_lines")).alias("mean_line_price"),
        "wk_sales_amt",
        "wk_discount",
        "wk_sales_cost",
        "wk_sales_mgrn",
        "eop_stock_on_hand_qty",
        "eop_ordered_stock_qty",
        "out_of_stock_times",
        "in_stock_times",
        "low_stock_times",
        out_share.alias("out_of_stock_pct"),
        F.when(F.col("_known_days") > 0, 1 - out_share).alias("in_stock_pct"),
        "low_stock_impact",
        "potential_low_stock_impact",
        "no_stock_impact",
        ratio(F.col("eop_stock_on_hand_qty"), F.col("wk_sales_qty")).alias("weeks_of_supply"),
    )


def weekly_sales(sales: DataFrame, calendar: DataFrame) -> DataFrame:
    """Quantity and amount per week straight from the lines, one shuffle."""
    return (
        on_calendar(sales, calendar, "trans_dt")
        .groupBy(*WEEK)
        .agg(F.sum("sales_qty").alias("wk_sales_qty"), F.sum("sales_amt").alias("wk_sales_amt"))
    )


def weekly_mart_as_coded(
    sales: DataFrame,
    inventory: DataFrame,
    calendar: DataFrame,
    week_end_day: int = WEEK_END_DAY,
) -> DataFrame:
    """What the line-grain SQL form yields, without building its line-grain join.

    That form pairs every line with every stock row of its cell, keeps the left
    keys only (so cells without a sale vanish at the calendar join), repeats
    stock once per line, and its three "times" columns count every row.  All of
    it follows from per-cell totals: a cell with ``n`` lines and ``m`` stock rows
    contributes ``n * m`` pairs (``n`` when unmatched), ``m`` times its sales and
    ``n`` times its stock.  So both sides are summed before they meet.
    """
    sold = sales_cells(sales).alias("s")
    stock = (
        inventory.groupBy(F.col("cal_dt").alias("trans_dt"), "store_key", "prod_key")
        .agg(
            F.count(F.lit(1)).alias("n_stock"),
            F.sum("inventory_on_hand_qty").alias("on_hand"),
            F.sum("inventory_on_order_qty").alias("on_order"),
        )
        .alias("i")
    )
    paired = sold.join(
        stock, [F.col(f"s.{k}") == F.col(f"i.{k}") for k in CELL], "left"
    ).select("s.*", F.coalesce("i.n_stock", F.lit(1)).alias("n_stock"), "i.on_hand", "i.on_order")

    copies, lines = _whole_number("n_stock"), _whole_number("n_lines")
    closing = F.col("day_of_wk_num") == week_end_day
    pairs = F.sum(F.col("n_lines") * F.col("n_stock"))
    sums = (
        by_week(paired, calendar)
        .groupBy(*WEEK)
        .agg(
            F.sum(F.col("sales_qty") * copies).alias("wk_sales_qty"),
            F.sum(F.col("price_total") * copies).alias("_price_total"),
            F.sum(F.col("price_lines") * F.col("n_stock")).alias("_price_lines"),
            F.sum(F.col("sales_amt") * copies).alias("wk_sales_amt"),
            F.sum(F.col("discount") * copies).alias("wk_discount"),
            F.sum(F.col("sales_cost") * copies).alias("wk_sales_cost"),
            F.sum(F.col("sales_mgrn") * copies).alias("wk_sales_mgrn"),
            F.sum(F.when(closing, F.col("on_hand") * lines).otherwise(0)).alias(
                "eop_stock_on_hand_qty"
            ),
            F.sum(F.when(closing, F.col("on_order") * lines).otherwise(0)).alias(
                "eop_ordered_stock_qty"
            ),
            pairs.alias("out_of_stock_times"),
            pairs.alias("in_stock_times"),
            pairs.alias("low_stock_times"),
        )
    )
    return sums.withColumn(
        "avg_sales_price", ratio(F.col("_price_total"), F.col("_price_lines"))
    ).drop("_price_total", "_price_lines")


def with_last_levels(mart: DataFrame, cells: DataFrame, calendar: DataFrame) -> DataFrame:
    """Adds ``last_on_hand_qty`` and ``last_on_order_qty``: the levels last recorded up to the end of the week.

    Beside the end-of-week levels, which are NULL without a stock row on the last day,
    these are the latest known of the week or, without one, of the weeks before.
    """
    day = F.col("trans_dt")
    latest = {
        "on_hand_qty": F.max(F.when(F.col("inventory_on_hand_qty").isNotNull(), F.struct(day, "inventory_on_hand_qty"))),
        "on_order_qty": F.max(F.when(F.col("inventory_on_order_qty").isNotNull(), F.struct(day, "inventory_on_order_qty"))),
    }
    weeks = by_week(cells, calendar).groupBy(*WEEK).agg(*[v.alias(n) for n, v in latest.items()])
    levels = weeks.select(*WEEK, *[F.col(f"{n}.inventory_{n}").alias(n) for n in latest])
    filled = fill_forward(levels, WEEK[2:], WEEK[:2], tuple(latest)).select(*WEEK, *[f"last_{n}" for n in latest])
    return mart.join(filled, list(WEEK), "left")


def in_key_order(mart: DataFrame) -> DataFrame:
    """Total ascending order by the mart keys: a range shuffle, no single task."""
    return mart.orderBy(*WEEK)


def _sum_or_zero(column: str) -> Column:
    return F.coalesce(F.sum(column), F.lit(0))


def _whole_number(column: str) -> Column:
    return F.col(column).cast("decimal(18,0)")
