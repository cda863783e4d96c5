"""Column contracts of the five source tables.

``CONTRACTS`` is what a landed file or raw table must look like.  ``conform``
turns a frame read under that contract into the types the operators use:

* measures become ``decimal(18,2)``, so sums stay exact and ratios keep scale
  (a ``decimal(38,2)`` ratio would be cut to six places);
* ``out_of_stock_flg`` arrives as 0/1 and becomes a boolean, once, here;
* ``day_of_wk_num`` arrives as text and becomes an int.

Declared ``int`` is a 38-digit integer at the source.  Keys stay ``int``, but
``trans_id`` is ``bigint``: transaction lines outgrow 2**31 at scale.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names, order and types every landed file must have.
CONTRACTS: dict[str, tuple[tuple[str, str], ...]] = {
    "store": (
        ("store_key", "int"),
        ("store_num", "varchar(30)"),
        ("store_desc", "varchar(150)"),
        ("addr", "varchar(500)"),
        ("city", "varchar(50)"),
        ("region", "varchar(100)"),
        ("cntry_cd", "varchar(30)"),
        ("cntry_nm", "varchar(150)"),
        ("postal_zip_cd", "varchar(10)"),
        ("prov_state_desc", "varchar(30)"),
        ("prov_state_cd", "varchar(30)"),
        ("store_type_cd", "varchar(30)"),
        ("store_type_desc", "varchar(150)"),
        ("frnchs_flg", "boolean"),
        ("store_size", "decimal(19,3)"),
        ("market_key", "int"),
        ("market_name", "varchar(150)"),
        ("submarket_key", "int"),
        ("submarket_name", "varchar(150)"),
        ("latitude", "decimal(19,6)"),
        ("longitude", "decimal(19,6)"),
    ),
    "sales": (
        ("trans_id", "bigint"),
        ("prod_key", "int"),
        ("store_key", "int"),
        ("trans_dt", "date"),
        ("trans_time", "int"),
        ("sales_qty", "decimal(38,2)"),
        ("sales_price", "decimal(38,2)"),
        ("sales_amt", "decimal(38,2)"),
        ("discount", "decimal(38,2)"),
        ("sales_cost", "decimal(38,2)"),
        ("sales_mgrn", "decimal(38,2)"),
        ("ship_cost", "decimal(38,2)"),
    ),
    "calendar": (
        ("cal_dt", "date"),
        ("cal_type_desc", "varchar(20)"),
        ("day_of_wk_num", "varchar(30)"),
        ("day_of_wk_desc", "string"),
        ("yr_num", "int"),
        ("wk_num", "int"),
        ("yr_wk_num", "int"),
        ("mnth_num", "int"),
        ("yr_mnth_num", "int"),
        ("qtr_num", "int"),
        ("yr_qtr_num", "int"),
    ),
    "product": (
        ("prod_key", "int"),
        ("prod_name", "string"),
        ("vol", "decimal(38,2)"),
        ("wgt", "decimal(38,2)"),
        ("brand_name", "string"),
        ("status_code", "int"),
        ("status_code_name", "string"),
        ("category_key", "int"),
        ("category_name", "string"),
        ("subcategory_key", "int"),
        ("subcategory_name", "string"),
    ),
    "inventory": (
        ("cal_dt", "date"),
        ("store_key", "int"),
        ("prod_key", "int"),
        ("inventory_on_hand_qty", "decimal(38,2)"),
        ("inventory_on_order_qty", "decimal(38,2)"),
        ("out_of_stock_flg", "int"),
        ("waste_qty", "decimal(38,2)"),
        ("promotion_flg", "boolean"),
        ("next_delivery_dt", "date"),
    ),
}

# The only column declared NOT NULL.
REQUIRED_COLUMNS: dict[str, tuple[str, ...]] = {"calendar": ("cal_dt",)}

# Keys implied by how the tables are joined; sales is line grain and has none.
KEYS: dict[str, tuple[str, ...]] = {
    "store": ("store_key",),
    "product": ("prod_key",),
    "calendar": ("cal_dt",),
    "inventory": ("cal_dt", "store_key", "prod_key"),
}

# The date an as-of filter applies to; dimensions are always whole.
FACT_DATES: dict[str, str] = {"sales": "trans_dt", "inventory": "cal_dt"}

# The day table's columns.
DAY_COLUMNS = (
    "trans_dt", "store_key", "prod_key", "sales_qty", "sales_price", "sales_amt", "discount", "sales_cost", "sales_mgrn",
    "inventory_on_hand_qty", "inventory_on_order_qty", "out_of_stock_flg", "in_stock_flg", "low_stock_flg",
)

MEASURE = "decimal(18,2)"


def columns(table: str) -> list[str]:
    return [name for name, _ in CONTRACTS[table]]


def table_ddl(table: str) -> str:
    """Column list for ``CREATE TABLE``; Spark enforces varchar(n) on insert."""
    return ", ".join(
        f"{name} {kind}" + (" NOT NULL" if name in REQUIRED_COLUMNS.get(table, ()) else "")
        for name, kind in CONTRACTS[table]
    )


def reader_ddl(table: str) -> str:
    """Column list for a file reader, where varchar(n) is plain text."""
    return ", ".join(f"{name} {_plain(kind)}" for name, kind in CONTRACTS[table])


def text_ddl(table: str) -> str:
    """Every column as text, for files whose values are not trusted yet."""
    return ", ".join(f"{name} string" for name in columns(table))


def varchar_limits(table: str) -> dict[str, int]:
    return {
        name: int(kind[len("varchar(") : -1])
        for name, kind in CONTRACTS[table]
        if kind.startswith("varchar(")
    }


def _plain(kind: str) -> str:
    return "string" if kind.startswith("varchar") else kind


def flag_from_int(flag: Column) -> Column:
    """0/1 to boolean, NULL stays unknown; any other value is an error."""
    other = F.raise_error(F.concat(F.lit("a stock flag must be 0, 1 or empty, not "), flag.cast("string")))
    return F.when(flag == 1, True).when(flag == 0, False).when(flag.isNotNull(), other.cast("boolean"))


def narrow(value: Column) -> Column:
    """To ``MEASURE``; a value that does not fit is an error, whatever the session's ANSI mode."""
    fits = value.try_cast(MEASURE)
    lost = F.raise_error(F.concat(F.lit(f"does not fit {MEASURE}: "), value.cast("string")))
    return F.when(value.isNull() | fits.isNotNull(), fits).otherwise(lost.cast(MEASURE))


def conform(df: DataFrame, table: str) -> DataFrame:
    """Contract types to operator types.  A projection only, so it prunes."""
    changes: dict[str, Column] = {
        name: narrow(F.col(name))
        for name, kind in CONTRACTS[table]
        if kind == "decimal(38,2)" and table in FACT_DATES
    }
    if table == "inventory":
        changes["out_of_stock_flg"] = flag_from_int(F.col("out_of_stock_flg"))
    if table == "calendar":
        changes["day_of_wk_num"] = F.col("day_of_wk_num").cast("int")
    return df.withColumns(changes) if changes else df


def to_contract(df: DataFrame, table: str) -> DataFrame:
    """Operator types back to contract types and order; absent columns are NULL."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(name) if name in have else F.lit(None)).cast(_plain(kind)).alias(name)
            for name, kind in CONTRACTS[table]
        ]
    )
