"""Stock flags of one day x store x product cell.

Two readings are kept apart:

* the engine's own: three-valued.  Without a stock row nothing is known, so the
  flag is NULL; a day without a sale cannot be low.
* ``*_as_coded``: the two-valued CASE form, where an unknown stock counts as in
  stock and as not low.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def in_stock(out_of_stock: Column) -> Column:
    return ~out_of_stock


def low_stock(on_hand: Column, sold: Column) -> Column:
    return F.when(on_hand.isNotNull(), F.coalesce(on_hand < sold, F.lit(False)))


def in_stock_as_coded(out_of_stock: Column) -> Column:
    return F.when(out_of_stock, False).otherwise(True)


def low_stock_as_coded(on_hand: Column, sold: Column) -> Column:
    return F.coalesce(on_hand < sold, F.lit(False))


def ratio(top: Column, bottom: Column) -> Column:
    """Unrounded double quotient; NULL for a zero or unknown denominator."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))
