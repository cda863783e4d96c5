"""Values and column lists that small test frames are made from."""

import datetime as dt
from decimal import Decimal


def day(text: str) -> dt.date:
    return dt.date.fromisoformat(text)


def money(value) -> Decimal | None:
    return None if value is None else Decimal(str(value)).quantize(Decimal("0.01"))


SALES_DDL = (
    "trans_id bigint, trans_dt date, store_key int, prod_key int, sales_qty decimal(18,2), "
    "sales_price decimal(18,2), sales_amt decimal(18,2), discount decimal(18,2), "
    "sales_cost decimal(18,2), sales_mgrn decimal(18,2)"
)
STOCK_DDL = (
    "cal_dt date, store_key int, prod_key int, inventory_on_hand_qty decimal(18,2), "
    "inventory_on_order_qty decimal(18,2), out_of_stock_flg boolean"
)
