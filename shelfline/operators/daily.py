"""The day table: sales and stock side by side at day x store x product grain.

Sales are transaction lines, stock is one row per day.  Joining lines to stock
directly would repeat the stock once per line, so lines are summed to the cell
first.  That sum runs map-side before the shuffle, which also disarms hot keys:
however many lines one cell has, a task sends one row for it.  Both sides then
hold at most one row per cell and are already hashed on the three join keys, so
the full outer join needs no further exchange and cannot skew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfline.functions import flags
from shelfline.sources.schemas import narrow

CELL = ("trans_dt", "store_key", "prod_key")


def sales_cells(sales: DataFrame) -> DataFrame:
    """Transaction lines summed to one row per day, store and product.

    Sums go back to ``decimal(18,2)``: up to 18 digits a decimal is one long, in
    rows, sorts and shuffles alike.  A day's total beyond that is an error.
    """
    return sales.groupBy(*CELL).agg(
        F.count(F.lit(1)).alias("n_lines"),
        _total("sales_qty").alias("sales_qty"),
        _total("sales_price").alias("price_total"),
        F.count("sales_price").alias("price_lines"),
        _total("sales_amt").alias("sales_amt"),
        _total("discount").alias("discount"),
        _total("sales_cost").alias("sales_cost"),
        _total("sales_mgrn").alias("sales_mgrn"),
    )


def stock_cells(inventory: DataFrame) -> DataFrame:
    """One stock row per cell.

    The contract already promises that.  Of rows for one cell the greatest is taken
    as a whole (most on hand, then on order, then out of stock), so the result is a
    row that was delivered; ``quality.repeated_keys`` lists such keys.
    """
    row = F.struct("inventory_on_hand_qty", "inventory_on_order_qty", "out_of_stock_flg")
    cells = inventory.groupBy(F.col("cal_dt").alias("trans_dt"), "store_key", "prod_key")
    return cells.agg(F.max(row).alias("_row")).select(*CELL, "_row.*")


def daily(sales: DataFrame, inventory: DataFrame) -> DataFrame:
    """Full outer join of both sides; a key present on either side is kept."""
    sold, stock = sales_cells(sales).alias("s"), stock_cells(inventory).alias("i")
    matches = [F.col(f"s.{k}") == F.col(f"i.{k}") for k in CELL]
    on_hand, sold_qty = F.col("i.inventory_on_hand_qty"), F.col("s.sales_qty")
    out_of_stock = F.col("i.out_of_stock_flg")
    return sold.join(stock, matches, "full_outer").select(
        *[_either(k) for k in CELL],
        "s.n_lines",
        "s.sales_qty",
        flags.ratio(F.col("s.price_total"), F.col("s.price_lines")).alias("sales_price"),
        "s.sales_amt",
        "s.discount",
        "s.sales_cost",
        "s.sales_mgrn",
        "s.price_total",
        "s.price_lines",
        "i.inventory_on_hand_qty",
        "i.inventory_on_order_qty",
        "i.out_of_stock_flg",
        flags.in_stock(out_of_stock).alias("in_stock_flg"),
        flags.low_stock(on_hand, sold_qty).alias("low_stock_flg"),
    )


def with_coded_flags(cells: DataFrame) -> DataFrame:
    """Adds the two-valued readings of both flags."""
    return cells.withColumns(
        {
            "in_stock_flg_as_coded": flags.in_stock_as_coded(F.col("out_of_stock_flg")),
            "low_stock_flg_as_coded": flags.low_stock_as_coded(
                F.col("inventory_on_hand_qty"), F.col("sales_qty")
            ),
        }
    )


def _total(measure: str) -> Column:
    return narrow(F.sum(measure))


def _either(key: str) -> Column:
    return F.coalesce(F.col(f"s.{key}"), F.col(f"i.{key}")).alias(key)
