"""The retail model over the sample tables (``lineitem``, ``orders``, ...).

=========  =================================================================
store      regions
product    distinct part brands (``Brand#7`` is product 7)
sales      line items with the store of their supplier, product of their part
inventory  line items by order date: finished lines are on hand, all on order
calendar   ISO weeks, Monday 0 to Sunday 6, from the first to the last fact date
landing    a file name per order (priority picks the table, status the style)
           and per event (its type picks the table)
=========  =================================================================

Dimension joins carry no hints: Spark broadcasts what its statistics show to be
under the threshold and shuffles the rest (adaptive execution splits hot keys).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfline.functions import names as N
from shelfline.sources import schemas

MONEY = schemas.MEASURE

# The columns used here; a declared schema saves a footer-reading job per table.
COLUMNS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_regionkey int",
    "supplier": "s_suppkey bigint, s_nationkey int",
    "customer": "c_custkey bigint, c_name string, c_mktsegment string",
    "part": "p_partkey bigint, p_brand string, p_retailprice double",
    "orders": "o_orderkey bigint, o_orderstatus string, o_orderdate timestamp_ntz, "
    "o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "ts timestamp_ntz, event_type string",
}
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {
        "sales": sales(spark, sf_dir),
        "inventory": inventory(spark, sf_dir),
        "store": store(spark, sf_dir),
        "product": product(spark, sf_dir),
        "calendar": model_calendar(spark, sf_dir),
    }


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _placed(spark, sf_dir).select(
        F.col("l_orderkey").alias("trans_id"),
        "prod_key",
        "store_key",
        F.to_date("l_shipdate").alias("trans_dt"),
        F.col("l_linenumber").alias("trans_time"),
        F.col("l_quantity").cast(MONEY).alias("sales_qty"),
        F.col("p_retailprice").cast(MONEY).alias("sales_price"),
        F.col("l_extendedprice").cast(MONEY).alias("sales_amt"),
        F.col("l_discount").cast("decimal(4,2)").alias("_discount_rate"),
        F.col("l_tax").cast("decimal(4,2)").alias("_ship_rate"),
    )
    amount = F.col("sales_amt")
    cost = (F.col("sales_price") * F.col("sales_qty")).cast(MONEY)
    return lines.select(
        "trans_id",
        "prod_key",
        "store_key",
        "trans_dt",
        "trans_time",
        "sales_qty",
        "sales_price",
        "sales_amt",
        (amount * F.col("_discount_rate")).cast(MONEY).alias("discount"),
        cost.alias("sales_cost"),
        (amount - cost).cast(MONEY).alias("sales_mgrn"),
        (amount * F.col("_ship_rate")).cast(MONEY).alias("ship_cost"),
    )


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stock per order date, store and product, as the source would deliver it."""
    orders = read(spark, sf_dir, "orders").select(
        "o_orderkey", F.to_date("o_orderdate").alias("cal_dt")
    )
    quantity = F.col("l_quantity").cast(MONEY)
    finished = F.col("l_linestatus") == "F"
    return (
        _placed(spark, sf_dir)
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("cal_dt", "store_key", "prod_key")
        .agg(
            _total(F.when(finished, quantity).otherwise(0)).alias("inventory_on_hand_qty"),
            _total(quantity).alias("inventory_on_order_qty"),
            (F.count_if(finished) == 0).alias("out_of_stock_flg"),
            _total(F.when(F.col("l_returnflag") == "R", quantity).otherwise(0)).alias("waste_qty"),
            (F.max(F.col("l_discount").cast("decimal(4,2)")) > F.lit("0.05").cast("decimal(4,2)")).alias(
                "promotion_flg"
            ),
            F.to_date(F.max("l_shipdate")).alias("next_delivery_dt"),
        )
    )


def store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "region").select(
        F.col("r_regionkey").alias("store_key"),
        F.col("r_name").alias("store_desc"),
        F.col("r_name").alias("region"),
    )


def product(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        read(spark, sf_dir, "part")
        .select(_prod_key().alias("prod_key"), F.col("p_brand").alias("brand_name"))
        .distinct()
    )


def model_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The calendar of all dates between the first and the last of either fact.

    Two dates reach the driver; with them the calendar's size is known in advance.
    """
    days = read(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("d"))
    days = days.union(read(spark, sf_dir, "orders").select(F.to_date("o_orderdate")))
    first, last = days.agg(F.min("d"), F.max("d")).first()
    return calendar(spark, first, last)


def calendar(spark: SparkSession, first: dt.date, last: dt.date) -> DataFrame:
    """One row per date; its size is known from the range, so Spark broadcasts it."""
    n_days = (last - first).days + 1
    day = F.date_add(F.lit(first), F.col("id").cast("int"))
    return (
        spark.range(0, n_days, 1, 1)
        .select(day.alias("cal_dt"))
        .select(
            "cal_dt",
            F.lit("ISO").alias("cal_type_desc"),
            F.weekday("cal_dt").alias("day_of_wk_num"),
            F.date_format("cal_dt", "EEEE").alias("day_of_wk_desc"),
            F.extract(F.lit("YEAROFWEEK"), "cal_dt").alias("yr_num"),
            F.weekofyear("cal_dt").alias("wk_num"),
            (F.extract(F.lit("YEAROFWEEK"), "cal_dt") * 100 + F.weekofyear("cal_dt")).alias("yr_wk_num"),
            F.month("cal_dt").alias("mnth_num"),
            (F.year("cal_dt") * 100 + F.month("cal_dt")).alias("yr_mnth_num"),
            F.quarter("cal_dt").alias("qtr_num"),
            (F.year("cal_dt") * 10 + F.quarter("cal_dt")).alias("yr_qtr_num"),
        )
    )


def landing_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file name per order and per event.

    Orders are sparse over years of days, in both conventions, and some are for a
    table nobody asked for; events are dense over one month.
    """
    rank, status = F.substring("o_orderpriority", 1, 1), F.col("o_orderstatus")
    order_table = F.when((rank == "5") & (status == "P"), "returns")
    event_table = F.when(F.col("event_type").isNull(), "returns")
    for digit, (kind, name) in enumerate(zip(EVENT_TYPES, N.REQUIRED_TABLES), start=1):
        order_table = order_table.when(rank == str(digit), name)
        event_table = event_table.when(F.col("event_type") == kind, name)
    day = F.to_date("o_orderdate")
    dashed, compact = N.dashed_name(order_table, day), N.compact_name(order_table, day)
    by_order = read(spark, sf_dir, "orders").select(
        F.when(status == "O", dashed).otherwise(compact).alias("name")
    )
    by_event = read(spark, sf_dir, "events").select(
        N.compact_name(event_table, F.to_date("ts")).alias("name")
    )
    return by_order.unionByName(by_event)


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with the store and product they belong to.

    Each dimension joins the lines by itself, so Spark judges its size from its
    own files and not from an estimate over a join of dimensions.
    """
    parts = read(spark, sf_dir, "part").select(
        "p_partkey", _prod_key().alias("prod_key"), "p_retailprice"
    )
    return (
        read(spark, sf_dir, "lineitem")
        .join(read(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .withColumnRenamed("n_regionkey", "store_key")
    )


def _prod_key() -> Column:
    return F.substring("p_brand", 7, 10).cast("int")


def _total(quantity: Column) -> Column:
    return F.sum(quantity).cast(MONEY)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(COLUMNS[name]).parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
