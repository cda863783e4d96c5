"""Every operator as a named query over the sample tables.

Keys start with the survey's operator ids.  Each query reads whole tables.
Measures are exact decimals in the library; ``_plain`` turns them into doubles
at the very end, for comparison with another engine.
"""

from __future__ import annotations

import datetime as dt
import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfline.functions import names as N
from shelfline.operators import changes, landing, quality, replay, star, weekday, weekly
from shelfline.operators.daily import CELL, daily, stock_cells, with_coded_flags
from shelfline.plans import job, refresh
from shelfline.plans import sample_model as sample
from shelfline.sources import catalog, files, history, records, schemas, scratch, sinks, storage, verified
from shelfline.sources.files import Location
from shelfline.streaming import arrivals, readiness

Query = Callable[[SparkSession, str], DataFrame]

AS_OF = dt.date(1998, 9, 2)  # a Wednesday: its week is open
REPLAY_DAYS = (dt.date(1996, 6, 30), AS_OF, dt.date(2000, 12, 31))
PART_ROWS = 1_000
PART_BYTES, N_ORDERED_PARTS = 1 << 16, 200
BUCKETS = 16
LANDING_BASE = "s3a://landing"
SCHEMA = "shelfline"


# ---------------------------------------------------------------- the pieces


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily(sample.sales(spark, sf_dir), sample.inventory(spark, sf_dir))


def _mart(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weekly.weekly_mart(_cells(spark, sf_dir), sample.model_calendar(spark, sf_dir))


def _mart_columns(*metrics: str) -> Query:
    return lambda spark, sf_dir: _plain(_mart(spark, sf_dir).select(*weekly.WEEK, *metrics))


def _plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles and whole numbers as bigint; order and names unchanged."""
    changed = {}
    for field in df.schema.fields:
        if isinstance(field.dataType, T.DecimalType):
            changed[field.name] = F.col(field.name).cast("double")
        elif isinstance(field.dataType, T.IntegerType):
            changed[field.name] = F.col(field.name).cast("bigint")
    return df.withColumns(changed) if changed else df


def _day_columns(cells: DataFrame) -> DataFrame:
    return cells.select(*schemas.DAY_COLUMNS)


def _unloaded(spark: SparkSession, df: DataFrame, table: str, **layout) -> DataFrame:
    """Out to contract CSV and back in through the typed reader."""
    path = scratch.fresh_path(spark, f"{table}-csv")
    sinks.unload_csv(schemas.to_contract(df, table), path, **layout)
    return files.read_csv(spark, path, table)


# ------------------------------------------------------------------ sources


def s01_typed_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several parts of bounded length, since readers cannot split a gzip file."""
    return _plain(_unloaded(spark, sample.sales(spark, sf_dir), "sales", max_records=100_000))


def s02_drop_for_a_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both naming conventions resolve to the drop of the same day."""
    place = Location(scratch.fresh_path(spark, "drops"))
    stock = sample.inventory(spark, sf_dir)
    for dashed in (False, True):
        sinks.export_snapshot(
            {"inventory": stock},
            place,
            AS_OF,
            compression="none" if dashed else "gzip",
            dashed=dashed,
        )
    found = [
        files.read_drop(spark, place, "inventory", AS_OF, dashed).withColumn(
            "dashed_name", F.lit(dashed)
        )
        for dashed in (False, True)
    ]
    return _plain(found[0].unionByName(found[1]))


def s03_declared_table_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog.create_schema(spark, SCHEMA, scratch.fresh_path(spark, "schema"))
    path = scratch.fresh_path(spark, "inventory")
    name = f"{SCHEMA}.inventory_{path.rsplit('-', 1)[1]}"
    catalog.create_raw_table(spark, "inventory", name, path)
    catalog.load(_unloaded(spark, sample.inventory(spark, sf_dir), "inventory"), "inventory", name)
    return _plain(schemas.conform(spark.table(name), "inventory"))


def s06_list_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weeks that have at least one non-empty file, read off a listing alone."""
    path = scratch.fresh_path(spark, "listing")
    sinks.save_table(_mart(spark, sf_dir), path, partition_by=weekly.WEEK[:2])
    year = F.regexp_extract("path", r"/yr_num=(\d+)/", 1)
    week = F.regexp_extract("path", r"/wk_num=(\d+)/", 1)
    return (
        files.list_files(spark, path, "*.parquet")
        .groupBy(year.cast("bigint").alias("yr_num"), week.cast("bigint").alias("wk_num"))
        .agg((F.min("length") > 0).alias("has_data"), F.bool_and(F.col("modificationTime").isNotNull()).alias("dated"))
    )


def _listing(spark: SparkSession, sf_dir: str, *statuses: str) -> DataFrame:
    """A file for each name that orders of these states give: as long as its orders are many, as new as their last key."""
    orders = sample.read(spark, sf_dir, "orders").where(F.col("o_orderstatus").isin(*statuses))
    table = F.lower(F.regexp_replace("o_orderpriority", "[^A-Z]+", ""))
    day = F.to_date("o_orderdate")
    name = F.when(F.col("o_orderstatus") == "O", N.dashed_name(table, day)).otherwise(N.compact_name(table, day))
    files_ = orders.groupBy(F.concat(F.lit(f"{LANDING_BASE}/"), name).alias("path"))
    return files_.agg(F.count(F.lit(1)).alias("length"), F.timestamp_seconds(F.max("o_orderkey")).alias("modificationTime"))


def s06_listing_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three looks at a folder, the last without a change: what each of them found."""
    path = scratch.fresh_path(spark, "looks")
    for statuses in (("O", "F"), ("F", "P"), ("P", "F")):
        history.record(_listing(spark, sf_dir, *statuses), path)
    return history.log(spark, path).select(
        F.col("look").cast("bigint").alias("look"), "path", "status", "length", F.unix_timestamp("modificationTime").alias("seconds")
    )


def s08_mart_from_saved_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch.fresh_path(spark, "daily")
    sinks.save_table(_cells(spark, sf_dir), path, cluster_by=CELL[:1], sort_by=CELL)
    return _plain(weekly.weekly_mart(files.read_saved(spark, path), sample.model_calendar(spark, sf_dir)))


def s09_views_in_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    files.register(
        {"sales": sample.sales(spark, sf_dir), "calendar": sample.model_calendar(spark, sf_dir)}
    )
    return _plain(
        spark.sql(
            """
            SELECT yr_num, wk_num, store_key, prod_key,
                   sum(sales_qty) AS wk_sales_qty, sum(sales_amt) AS wk_sales_amt
            FROM sales JOIN calendar ON trans_dt = cal_dt
            GROUP BY ALL
            """
        )
    )


def s10_external_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The saved mart as a partitioned catalog table, queried by name."""
    catalog.create_schema(spark, SCHEMA, scratch.fresh_path(spark, "schema"))
    path = scratch.fresh_path(spark, "mart")
    name = f"{SCHEMA}.mart_{path.rsplit('-', 1)[1]}"
    sinks.save_table(
        _mart(spark, sf_dir), path, partition_by=weekly.WEEK[:2], sort_by=weekly.WEEK
    )
    catalog.expose(spark, name, path)
    return _plain(
        spark.sql(
            f"""
            SELECT yr_num, store_key, count(*) AS n_rows, sum(wk_sales_qty) AS qty,
                   sum(wk_sales_amt) AS amt, sum(out_of_stock_times) AS out_of_stock_times
            FROM {name} GROUP BY yr_num, store_key
            """
        )
    )


def s10_dimension_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job's dimensions and mart as catalog tables, joined in SQL by the views on the latest run."""
    schema = f"{SCHEMA}_{scratch.fresh_path(spark, 'schema').rsplit('-', 1)[1]}"
    catalog.create_schema(spark, schema, scratch.fresh_path(spark, "schema"))
    landed = scratch.fresh_path(spark, "landed")
    sinks.export_snapshot(sample.tables(spark, sf_dir), Location(landed), AS_OF)
    config = job.JobConfig(AS_OF, landed, scratch.fresh_path(spark, "out"), catalog_schema=schema)
    job.run(spark, config)
    return _plain(
        spark.sql(
            f"""
            SELECT s.store_desc, p.brand_name, c.yr_num, c.wk_num, count(*) AS n_days,
                   max(m.wk_sales_qty) AS qty, max(m.wk_sales_amt) AS amt
            FROM {schema}.{job.MART}_latest m
            JOIN {schema}.store_latest s ON m.store_key = s.store_key
            JOIN {schema}.product_latest p ON m.prod_key = p.prod_key
            JOIN {schema}.calendar_latest c ON m.yr_num = c.yr_num AND m.wk_num = c.wk_num
            GROUP BY s.store_desc, p.brand_name, c.yr_num, c.wk_num
            """
        )
    )


def s01_store_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer per store, every column filled, out to CSV and back through the typed reader."""
    key, name = F.col("c_custkey"), F.col("c_name")
    columns = {"store_key": key.cast("int"), "frnchs_flg": key % 2 == 0, "store_size": (key / 8).cast("decimal(19,3)")}
    columns |= {"market_key": (key % 100).cast("int"), "submarket_key": (key % 1000).cast("int")}
    columns |= {"latitude": (key / 16 - 90).cast("decimal(19,6)"), "longitude": (key / 32).cast("decimal(19,6)")}
    texts = {n: F.substring(F.concat(name, F.lit(f", {n}")), 1, limit) for n, limit in schemas.varchar_limits("store").items()}
    stores = sample.read(spark, sf_dir, "customer").select(*[c.alias(n) for n, c in {**texts, **columns}.items()])
    return _plain(_unloaded(spark, stores, "store"))


def s11_contract_breaches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers put through the store contract: their names overrun some columns."""
    name, segment = F.col("c_name"), F.col("c_mktsegment")
    stores = sample.read(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("store_key"),
        name.alias("store_num"),
        name.alias("postal_zip_cd"),
        F.concat_ws(" ", name, segment).alias("prov_state_desc"),
        segment.alias("market_name"),
    )
    return quality.contract_breaches(schemas.to_contract(stores, "store"), "store")


def s11_repeated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with several sales lines: what joining lines to stock would repeat."""
    return _plain(quality.repeated_keys(sample.sales(spark, sf_dir), CELL))


def s12_job_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole job from landed drops to the saved mart."""
    landed = scratch.fresh_path(spark, "landed")
    sinks.export_snapshot(sample.tables(spark, sf_dir), Location(landed), AS_OF)
    config = job.JobConfig(AS_OF, landed, scratch.fresh_path(spark, "out"), save_daily=True)
    return _plain(files.read_saved(spark, job.run(spark, config)[job.MART]))


def s12_append_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two appended runs that keep the day table: every mart row twice, none doubled."""
    landed, out = scratch.fresh_path(spark, "landed"), scratch.fresh_path(spark, "out")
    sinks.export_snapshot(sample.tables(spark, sf_dir), Location(landed), AS_OF)
    config = job.JobConfig(AS_OF, landed, out, mode="append", save_daily=True)
    for _ in range(2):
        saved = job.run(spark, config)
    return _plain(
        files.read_saved(spark, saved[job.MART])
        .groupBy(*weekly.WEEK)
        .agg(F.count(F.lit(1)).alias("n_rows"), F.sum("wk_sales_qty").alias("qty"), F.sum("wk_sales_amt").alias("amt"))
    )


def p11_job_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole job over a drop with bad stock rows: what it rejects, and why."""
    landed = scratch.fresh_path(spark, "landed")
    tables = sample.tables(spark, sf_dir)
    sinks.export_snapshot({t: df for t, df in tables.items() if t != "inventory"}, Location(landed), AS_OF)
    sinks.unload_csv(_untrusted_stock(spark, sf_dir), Location(landed).path("inventory", AS_OF))
    saved = job.run(spark, job.JobConfig(AS_OF, landed, scratch.fresh_path(spark, "out"), rejects=True))
    rejects = files.read_saved(spark, saved[job.REJECTS]).groupBy("table_name", quality.REASON)
    repeated = files.read_saved(spark, saved[job.REPEATED])
    return rejects.agg(F.count(F.lit(1)).alias("n_rows")).union(
        repeated.agg(F.lit("inventory"), F.lit("repeated key"), F.count(F.lit(1)))
    )


def s12_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two days land one after the other, then again, once under the other name: each counts once."""
    place = Location(scratch.fresh_path(spark, "arrivals"))
    target = scratch.fresh_path(spark, "ingested")
    checkpoint = scratch.fresh_path(spark, "arrivals-checkpoint")
    # the source's table, which each day's drop is cut from
    source = scratch.fresh_path(spark, "stock")
    sinks.save_table(sample.inventory(spark, sf_dir), source)
    stock = files.read_saved(spark, source)
    next_day = AS_OF + dt.timedelta(days=1)
    for day, dashed in ((AS_OF, False), (next_day, False), (AS_OF, False), (next_day, True)):
        sinks.export_snapshot({"inventory": stock}, place, day, dashed=dashed, compression="none" if dashed else "gzip")
        arrivals.ingest(spark, place, "inventory", target, checkpoint).awaitTermination()
    return _plain(
        files.read_saved(spark, target)
        .groupBy("run_date")
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.sum("inventory_on_hand_qty").alias("on_hand"),
            F.max("cal_dt").alias("last_cal_dt"),
        )
    )


# -------------------------------------------------------------------- sinks


def k01_parquet_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch.fresh_path(spark, "mart")
    sinks.save_table(
        _mart(spark, sf_dir),
        path,
        partition_by=weekly.WEEK[:2],
        sort_by=weekly.WEEK,
        compression="gzip",
    )
    return _plain(files.read_saved(spark, path))


def k02_daily_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch.fresh_path(spark, "daily")
    sinks.save_table(_day_columns(_cells(spark, sf_dir)), path, compression="gzip")
    return _plain(files.read_saved(spark, path))


def k03_gzip_unload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(
        _unloaded(spark, sample.inventory(spark, sf_dir), "inventory", compression="gzip")
    )


def k04_plain_unload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(_unloaded(spark, sample.sales(spark, sf_dir), "sales", compression="none"))


def k05_bounded_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of limited length hold the same rows: how many, and none too long."""
    stock = _unloaded(spark, sample.inventory(spark, sf_dir), "inventory", max_records=PART_ROWS)
    parts = stock.groupBy(F.col("_metadata.file_path").alias("part")).agg(F.count(F.lit(1)).alias("n"))
    return parts.agg(
        F.sum("n").alias("n_rows"),
        (F.max("n") <= PART_ROWS).alias("bounded"),
        (F.count("part") >= F.ceil(F.sum("n") / PART_ROWS)).alias("enough_parts"),
    )


def k05_byte_capped_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales in plain CSV parts of at most ``PART_BYTES``: all rows once, no part over the cap, parts well filled."""
    path = scratch.fresh_path(spark, "capped")
    lines = schemas.to_contract(sample.sales(spark, sf_dir), "sales")
    sinks.unload_capped(lines, path, max_bytes=PART_BYTES, order_by=("trans_dt", "trans_id", "trans_time"))
    listed = files.list_files(spark, path, "*.txt").agg(
        (F.max("length") <= PART_BYTES).alias("bounded"),
        # each ordered part can leave one file unfilled, beside the rows that no longer fit
        (F.count("path") <= F.ceil(F.sum("length") / (PART_BYTES - 512)) + N_ORDERED_PARTS).alias("filled"),
    )
    rows = files.read_csv(spark, path, "sales").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("sales_amt").alias("amt"), F.sum("trans_id").alias("ids"), F.max("trans_dt").alias("last_dt")
    )
    return _plain(rows.withColumn("_one", F.lit(1)).join(listed.withColumn("_one", F.lit(1)), "_one").drop("_one"))


def k07_append_and_rerun(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two appended halves, then a rerun that replaces only its own partitions."""
    path = scratch.fresh_path(spark, "mart")
    mart = _mart(spark, sf_dir)
    first_half, second_half = F.col("wk_num") <= 26, F.col("wk_num") > 26
    sinks.save_table(mart.filter(first_half), path, partition_by=("wk_num",), mode="append")
    sinks.save_table(mart.filter(second_half), path, partition_by=("wk_num",), mode="append")
    sinks.save_table(mart.filter(second_half), path, partition_by=("wk_num",), replace_partitions=True)
    return _plain(files.read_saved(spark, path))


def k01_rerun_smaller(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second run with fewer weeks leaves none of the first run's."""
    path = scratch.fresh_path(spark, "mart")
    mart = _mart(spark, sf_dir)
    for rows in (mart, mart.filter("wk_num <= 26")):
        sinks.save_table(rows, path, partition_by=weekly.WEEK[:2])
    return _plain(files.read_saved(spark, path))


def k02_raw_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch.fresh_path(spark, "sales")
    sinks.save_table(sample.sales(spark, sf_dir), path, compression="gzip")
    return _plain(files.read_saved(spark, path))


# -------------------------------------------------- projections and filters


def p04_p05_stock_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_coded_flags(_cells(spark, sf_dir)).select(
        "trans_dt",
        F.col("store_key").cast("bigint").alias("store_key"),
        F.col("prod_key").cast("bigint").alias("prod_key"),
        "out_of_stock_flg",
        "in_stock_flg",
        "low_stock_flg",
        "in_stock_flg_as_coded",
        "low_stock_flg_as_coded",
    )


def p06_p07_closing_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On-hand on the closing day, else zero; one row per stock row."""
    dated = weekly.on_calendar(
        sample.inventory(spark, sf_dir), sample.model_calendar(spark, sf_dir), "cal_dt"
    )
    closing = F.col("day_of_wk_num") == weekly.WEEK_END_DAY
    return _plain(
        dated.select(
            "cal_dt",
            "store_key",
            "prod_key",
            F.when(closing, F.col("inventory_on_hand_qty")).otherwise(0).alias("closing_on_hand"),
            F.when(F.col("out_of_stock_flg"), 1).otherwise(0).alias("is_out"),
        )
    )


def p08_as_of_today(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stock with its dates moved so that ``AS_OF`` falls on today: later rows go."""
    moved = F.date_add("cal_dt", F.date_diff(F.current_date(), F.lit(AS_OF)))
    stock = sample.inventory(spark, sf_dir).withColumn("cal_dt", moved)
    return _plain(replay.as_of(stock, "cal_dt", F.current_date()))


def p09_as_of_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(replay.as_of(sample.sales(spark, sf_dir), "trans_dt", AS_OF))


def p10_as_of_next_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(replay.as_of(sample.inventory(spark, sf_dir), "cal_dt", AS_OF, plus_days=1))


def _untrusted_stock(spark: SparkSession, sf_dir: str, *more: Column) -> DataFrame:
    """Lines as untrusted text: a status where a flag belongs, a word as quantity."""
    lines = sample.read(spark, sf_dir, "lineitem")
    flag = F.when(F.col("l_linestatus") == "F", "0").when(F.col("l_returnflag") == "A", "2")
    return lines.select(
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("cal_dt"),
        F.col("l_suppkey").cast("string").alias("store_key"),
        F.col("l_partkey").cast("string").alias("prod_key"),
        F.when(F.col("l_returnflag") == "N", "many")
        .otherwise(F.col("l_quantity").cast("string"))
        .alias("inventory_on_hand_qty"),
        F.col("l_quantity").cast("string").alias("inventory_on_order_qty"),
        flag.when(F.col("l_returnflag") == "R", "1").alias("out_of_stock_flg"),
        F.lit(None).cast("string").alias("waste_qty"),
        F.lit("true").alias("promotion_flg"),
        F.lit(None).cast("string").alias("next_delivery_dt"),
        *more,
    )


def p11_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _untrusted_stock(spark, sf_dir)
    checked = quality.coerce(raw, "inventory")
    return _plain(
        checked.groupBy(quality.REASON, "out_of_stock_flg").agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.sum("inventory_on_hand_qty").alias("on_hand"),
            F.sum("inventory_on_order_qty").alias("on_order"),
        )
    )


def _broken_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Untrusted stock as lines of text: some cut short, too long, with an open quote or a byte that is no UTF-8."""
    columns = schemas.columns("inventory")
    stock = _untrusted_stock(spark, sf_dir, F.col("l_linenumber").alias("nth"))
    fields = [F.coalesce(c, F.lit("")) for c in columns]
    whole, nth = F.concat_ws(",", *fields), F.col("nth")
    return stock.select(
        F.when(nth == 7, F.concat_ws(",", *fields[:3]))
        .when(nth == 6, F.concat(whole, F.lit(",,")))
        .when(nth == 5, F.concat_ws(",", *fields[:7], F.lit('"true'), F.lit("")))
        .when(nth == 4, F.concat(whole, F.unhex(F.lit("E9")).cast("string")))
        .otherwise(whole)
        .alias("value")
    )


def _with_header(lines: DataFrame, header: str) -> DataFrame:
    """Lines whose every partition begins with a header, to be written as text."""
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    return lines.select(F.when(first, F.concat(F.lit(header + "\n"), "value")).otherwise(F.col("value")).alias("value"))


def p11_malformed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job over a stock drop with broken lines: each is rejected as it stands, the mart holds the rest."""
    landed = scratch.fresh_path(spark, "landed")
    tables = sample.tables(spark, sf_dir)
    sinks.export_snapshot({t: df for t, df in tables.items() if t != "inventory"}, Location(landed), AS_OF)
    lines = _with_header(_broken_lines(spark, sf_dir), ",".join(schemas.columns("inventory")))
    lines.write.option("compression", "gzip").text(Location(landed).path("inventory", AS_OF))
    saved = job.run(spark, job.JobConfig(AS_OF, landed, scratch.fresh_path(spark, "out"), rejects=True, save_daily=True))
    rejects = files.read_saved(spark, saved[job.REJECTS]).groupBy("table_name", quality.REASON)
    stock = files.read_saved(spark, saved[job.DAY_TABLE]).where("inventory_on_order_qty is not null")
    return rejects.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.length(records.LINE)).alias("n_chars")).union(
        stock.agg(F.lit(job.DAY_TABLE), F.lit(None).cast("string"), F.count(F.lit(1)), F.sum("inventory_on_order_qty").cast("bigint"))
    )


def j02_repeated_dimension_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job over dimensions that hold every key twice: the mart is the one of single keys."""
    landed = scratch.fresh_path(spark, "landed")
    tables = sample.tables(spark, sf_dir)
    for table in job.DIMENSIONS:
        tables[table] = tables[table].union(tables[table])
    sinks.export_snapshot(tables, Location(landed), AS_OF)
    saved = job.run(spark, job.JobConfig(AS_OF, landed, scratch.fresh_path(spark, "out"), rejects=True))
    return _plain(files.read_saved(spark, saved[job.MART]))


def p11_repeated_dimension_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which rows of twice delivered dimensions are rejected: one for each key."""
    landed = scratch.fresh_path(spark, "landed")
    tables = sample.tables(spark, sf_dir)
    for table in job.DIMENSIONS:
        tables[table] = tables[table].union(tables[table])
    sinks.export_snapshot(tables, Location(landed), AS_OF)
    config = job.JobConfig(AS_OF, landed, scratch.fresh_path(spark, "out"), rejects=True)
    checked = job.read_untrusted(spark, config)
    rejects = [
        quality.rejected(checked[t]).groupBy(quality.REASON).agg(F.lit(t).alias("table_name"), F.count(F.lit(1)).alias("n_rows"))
        for t in job.DIMENSIONS
    ]
    return functools.reduce(DataFrame.union, rejects)


# -------------------------------------------------------------------- joins


def j01_daily_sales_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(_day_columns(_cells(spark, sf_dir)))


def j01_from_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The day rows from stored facts that are dealt by the join's keys: no row moves for the join."""
    schema = f"{SCHEMA}_{scratch.fresh_path(spark, 'schema').rsplit('-', 1)[1]}"
    catalog.create_schema(spark, schema, scratch.fresh_path(spark, "schema"))
    stored = [
        catalog.store_bucketed(df, f"{schema}.{t}", (schemas.FACT_DATES[t], *CELL[1:]), BUCKETS, scratch.fresh_path(spark, t))
        for t, df in (("sales", sample.sales(spark, sf_dir)), ("inventory", sample.inventory(spark, sf_dir)))
    ]
    return _plain(_day_columns(daily(*stored)))


def j01_conflicting_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stock row per line, so cells conflict: the cell keeps one of its rows whole."""
    return _plain(stock_cells(_line_stock(spark, sf_dir)))


def _line_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = sample.read(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("cal_dt"))
    sold = sample.sales(spark, sf_dir).join(orders, F.col("trans_id") == F.col("o_orderkey"))
    on_hand = F.when(F.col("trans_time") % 2 == 0, F.col("sales_qty")).otherwise(F.lit(0).cast(schemas.MEASURE))
    return sold.select(
        "cal_dt", "store_key", "prod_key", on_hand.alias("inventory_on_hand_qty"),
        F.col("sales_qty").alias("inventory_on_order_qty"),
        F.when(F.col("trans_time") != 3, F.col("trans_time") % 2 == 1).alias("out_of_stock_flg"),
    )


def j02_undated_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts a calendar cut short does not have: counted, not lost unseen."""
    days = sample.model_calendar(spark, sf_dir).filter(F.col("cal_dt") <= F.lit(AS_OF))
    lines, stock = sample.sales(spark, sf_dir), sample.inventory(spark, sf_dir)
    return functools.reduce(
        DataFrame.union,
        [
            weekly.undated(df, days, on).agg(F.lit(t).alias("table_name"), F.count(F.lit(1)).alias("n_rows"))
            for t, df, on in (("sales", lines, "trans_dt"), ("inventory", stock, "cal_dt"))
        ],
    )


def j03_inventory_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    stock = sample.inventory(spark, sf_dir)
    return _plain(
        weekly.on_calendar(stock, sample.model_calendar(spark, sf_dir), "cal_dt").select(
            "cal_dt", "store_key", "prod_key", "yr_num", "wk_num", "day_of_wk_num",
            "inventory_on_hand_qty",
        )
    )


def j04_sales_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = sample.sales(spark, sf_dir)
    return _plain(
        weekly.on_calendar(lines, sample.model_calendar(spark, sf_dir), "trans_dt").select(
            "trans_id", "trans_dt", "store_key", "prod_key", "yr_num", "wk_num",
            "day_of_wk_num", "sales_qty", "sales_amt",
        )
    )


def j05_star_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = star.star(
        _mart(spark, sf_dir), sample.store(spark, sf_dir), sample.product(spark, sf_dir)
    )
    return _plain(
        joined.select(*weekly.WEEK, "store_desc", "brand_name", "wk_sales_qty", "wk_sales_amt")
    )


def r01_unrecognised_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of no day: those of orders whose label has lost a digit."""
    names = sample.landing_names(spark, sf_dir).select("name")
    broken = names.select(F.regexp_replace("name", r"_(\d{4})0", "_$1").alias("name"))
    return landing.unrecognised(names.union(broken)).groupBy("name").agg(F.count(F.lit(1)).alias("n_files"))


def j06_missing_unexpected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landing.differences(sample.landing_names(spark, sf_dir))


# ------------------------------------------------------------- aggregations


def m01_m02_weekly_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    weeks = weekly.weekly_sales(sample.sales(spark, sf_dir), sample.model_calendar(spark, sf_dir))
    return _plain(weekly.in_key_order(weeks))


def m_weekly_mart(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(_mart(spark, sf_dir))


def m04_m05_last_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """End-of-week levels and, beside them, the ones last recorded."""
    cells, days = _cells(spark, sf_dir), sample.model_calendar(spark, sf_dir)
    mart = weekly.weekly_mart(cells, days).select(*weekly.WEEK, "eop_stock_on_hand_qty", "eop_ordered_stock_qty")
    return _plain(weekly.with_last_levels(mart, cells, days))


def a_weekly_mart_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    mart = weekly.weekly_mart_as_coded(
        sample.sales(spark, sf_dir), sample.inventory(spark, sf_dir), sample.model_calendar(spark, sf_dir)
    )
    return _plain(mart)


def a13_inventory_by_weekday(spark: SparkSession, sf_dir: str) -> DataFrame:
    stock = sample.inventory(spark, sf_dir)
    return _plain(weekday.inventory_by_weekday(stock, sample.model_calendar(spark, sf_dir)))


def a14_sales_by_weekday(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(weekday.sales_by_weekday(sample.sales(spark, sf_dir), sample.model_calendar(spark, sf_dir)))


def o01_ordered_mart(spark: SparkSession, sf_dir: str) -> DataFrame:
    mart = _mart(spark, sf_dir).select(
        *weekly.WEEK, "wk_sales_qty", "wk_sales_amt", "eop_stock_on_hand_qty"
    )
    return _plain(weekly.in_key_order(mart))


def o02_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twenty rows in key order, which is what ``show`` prints."""
    mart = _mart(spark, sf_dir).select(*weekly.WEEK, "wk_sales_qty", "wk_sales_amt")
    return _plain(weekly.in_key_order(mart).limit(20))


# ---------------------------------------------------- functions on file names


def f02_f06_names_and_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names built in both conventions, then taken apart again."""
    orders = sample.read(spark, sf_dir, "orders")
    day = F.to_date("o_orderdate")
    table = F.lower(F.regexp_replace("o_orderpriority", "[^A-Z]+", ""))
    built = orders.select(
        "o_orderkey",
        F.date_add(day, 1).alias("next_day"),
        N.compact_name(table, F.date_add(day, 1)).alias("compact_name"),
        N.dashed_name(table, F.date_add(day, 1)).alias("dashed_name"),
    )
    return built.select(
        "*",
        N.table_of(F.col("compact_name")).alias("compact_table"),
        N.table_of(F.col("dashed_name")).alias("dashed_table"),
        N.date_of(F.col("compact_name")).alias("compact_date"),
        N.date_of(F.col("dashed_name")).alias("dashed_date"),
    )


def f09_manifest_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifests = landing.manifest(sample.landing_names(spark, sf_dir), LANDING_BASE)
    return landing.read_manifest(manifests)


# ------------------------------------------------------------ user-level jobs


def r01_landing_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = landing.audit(sample.landing_names(spark, sf_dir))
    return _plain(
        report.withColumns(
            {"present": F.array_join("present", ","), "missing": F.array_join("missing", ",")}
        )
    )


def _replay_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.cells_until(sample.sales(spark, sf_dir), sample.inventory(spark, sf_dir), REPLAY_DAYS)


def r02_as_of_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = sample.model_calendar(spark, sf_dir)
    return _plain(replay.replay(_replay_cells(spark, sf_dir), days, REPLAY_DAYS))


def r02_compact_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed weeks once, open weeks per date."""
    days = sample.model_calendar(spark, sf_dir)
    return _plain(replay.compact(_replay_cells(spark, sf_dir), days, REPLAY_DAYS))


def _altered(spark: SparkSession, sf_dir: str) -> tuple[dict[str, DataFrame], dict[str, DataFrame], dict[str, DataFrame]]:
    """Facts before and after a change, and those withdrawn by it.

    By the day of the year, modulo 50: day 0 has no facts before, on day 1 a quantity is
    one more, and days 2 and 30 to 44, whole weeks among them, have none after.
    """
    before, after, gone = {}, {}, {}
    for t, df, measure in (
        ("sales", sample.sales(spark, sf_dir), "sales_qty"),
        ("inventory", sample.inventory(spark, sf_dir), "inventory_on_order_qty"),
    ):
        phase = F.dayofyear(schemas.FACT_DATES[t]) % 50
        withdrawn = (phase == 2) | phase.between(30, 44)
        one_more = F.when(phase == 1, F.col(measure) + 1).otherwise(F.col(measure)).cast(schemas.MEASURE)
        before[t], after[t], gone[t] = df.where(phase != 0).withColumn(measure, one_more), df.where(~withdrawn), df.where(withdrawn)
    return before, after, gone


def _order_dates(spark: SparkSession, sf_dir: str, condition: str = "true") -> DataFrame:
    return sample.read(spark, sf_dir, "orders").where(condition).select(F.to_date("o_orderdate").alias("as_of"))


def r02_dates_from_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mart as of the date of every partly filled order, summed up."""
    cells, days = _cells(spark, sf_dir), sample.model_calendar(spark, sf_dir)
    found = replay.replay_dates(cells, days, _order_dates(spark, sf_dir, "o_orderstatus = 'P'"))
    sums = found.groupBy("as_of").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("wk_sales_qty").alias("qty"), F.sum("wk_sales_amt").alias("amt"),
        F.sum("eop_stock_on_hand_qty").alias("on_hand"), F.sum("out_of_stock_times").alias("out_of_stock_times"),
        F.sum("low_stock_impact").alias("low_stock_impact"),
    )
    return _plain(sums)


def r02_compact_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed weeks once, open weeks for every order date."""
    return _plain(replay.compact_dates(_cells(spark, sf_dir), sample.model_calendar(spark, sf_dir), _order_dates(spark, sf_dir)))


def r02_incremental_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After inserts, corrections and withdrawals the refreshed mart is the one built from the facts as they are.

    Facts lie in tables partitioned by week, of which the days that change are delivered anew.
    """
    days, mart, state = (sample.model_calendar(spark, sf_dir), *(scratch.fresh_path(spark, x) for x in ("mart", "state")))
    before, after, gone = _altered(spark, sf_dir)
    paths = {t: scratch.fresh_path(spark, t) for t in before}
    for t, df in before.items():
        refresh.store_days(df, t, paths[t])
    refresh.refresh(spark, *(files.read_saved(spark, paths[t]) for t in before), days, mart, state)
    for t, df in after.items():
        date = schemas.FACT_DATES[t]
        withdrawn = [r[0] for r in gone[t].select(date).distinct().collect()]  # dates
        refresh.store_days(df.where(F.dayofyear(date) % 50 < 2), t, paths[t], withdrawn)
    refresh.refresh(spark, *(files.read_saved(spark, paths[t]) for t in before), days, mart, state)
    return _plain(refresh.current(spark, mart))


def r02_changed_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The days that differ between two states of the facts, and why."""
    days = sample.model_calendar(spark, sf_dir)
    before, after, _ = _altered(spark, sf_dir)
    old, new = (refresh.digests(x["sales"], x["inventory"], days) for x in (before, after))
    return _plain(changes.changed_days(old, new).select("fact", "day", "status", "yr_num", "wk_num"))


def r01_audit_of_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An exported snapshot, listed from the file system and audited; one table is held back."""
    place = Location(scratch.fresh_path(spark, "snapshot"))
    tables = sample.tables(spark, sf_dir)
    sinks.export_snapshot(tables, place, AS_OF)
    sinks.export_snapshot({t: df for t, df in tables.items() if t != "store"}, place, AS_OF, label=AS_OF + dt.timedelta(days=1))
    listed = files.list_files(spark, place.base, "*.csv.gz").filter("length > 0")
    report = landing.audit(listed)
    return _plain(
        report.withColumns({"present": F.array_join("present", ","), "missing": F.array_join("missing", ",")})
    )


def r03_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landing.manifest(sample.landing_names(spark, sf_dir), LANDING_BASE)


def r03_continuous_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The landing names of all days streamed in over several passes, some twice: what is sent, once each.

    Tables nobody asked for land first, the last required ones late, after a restart;
    then time goes on until every deadline has passed.
    """
    landed, target, checkpoint = (scratch.fresh_path(spark, x) for x in ("names", "reports", "readiness"))
    names = landing.parse(sample.landing_names(spark, sf_dir)).where("run_date is not null").select("name", "table_name").distinct()
    waves = {1: ("returns", "sales"), 2: ("sales", "inventory", "product"), 3: ("store", "product"), 4: ("calendar", "sales")}
    for hour, tables in waves.items():
        at = F.lit(dt.datetime(1990, 1, 1, hour)).cast("timestamp")
        names.where(F.col("table_name").isin(*tables)).select("name", at.alias("landed_at")).write.mode("append").parquet(landed)
        if hour in (2, 4):
            _readiness_pass(spark, landed, target, checkpoint)
    # names of no day move the clock on
    for year in (2090, 2091):
        clock = spark.range(1).select(F.lit("clock").alias("name"), F.lit(dt.datetime(year, 1, 1)).cast("timestamp").alias("landed_at"))
        clock.write.mode("append").parquet(landed)
        _readiness_pass(spark, landed, target, checkpoint)
    return spark.read.schema(readiness.OUT).parquet(target)


def _readiness_pass(spark: SparkSession, landed: str, target: str, checkpoint: str) -> None:
    arrived = spark.readStream.schema("name string, landed_at timestamp").parquet(landed)
    readiness.run_once(readiness.readiness(arrived, LANDING_BASE), target, checkpoint).awaitTermination()


def r04_snapshot_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = Location(scratch.fresh_path(spark, "snapshot"))
    return sinks.export_snapshot(sample.tables(spark, sf_dir), place, AS_OF)


def r04_verified_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every table exported with a proof and read back by it; once a part is gone the folder is refused."""
    place = Location(scratch.fresh_path(spark, "proved"))
    proved = verified.export_snapshot(sample.tables(spark, sf_dir), place, AS_OF, max_bytes=PART_BYTES, compression="none")
    found = []
    for table in (r["table_name"] for r in proved.collect()):  # a row a table
        path = place.path(table, AS_OF)
        n_rows = verified.read(spark, table, path, prove=True).count()
        part = files.list_files(spark, path, "part-*").agg(F.min("path")).first()[0]
        storage.delete(spark, part)
        try:
            verified.read(spark, table, path, prove=True)
            found.append((table, n_rows, False))
        except verified.NotVerified:
            found.append((table, n_rows, True))
    return spark.createDataFrame(found, "table_name string, n_rows bigint, loss_refused boolean")


QUERIES: dict[str, Query] = {
    "m01_m02_weekly_sales": m01_m02_weekly_sales,
    "m_weekly_mart": m_weekly_mart,
    "m03_avg_price": _mart_columns("avg_sales_price", "mean_line_price"),
    "m04_m05_end_of_week": _mart_columns("eop_stock_on_hand_qty", "eop_ordered_stock_qty"),
    "m04_m05_last_levels": m04_m05_last_levels,
    "m06_total_cost": _mart_columns("wk_sales_cost", "wk_discount", "wk_sales_mgrn"),
    "m07_stock_pct": _mart_columns("out_of_stock_pct", "in_stock_pct"),
    "m08_m10_impacts": _mart_columns(
        "low_stock_impact", "potential_low_stock_impact", "no_stock_impact"
    ),
    "m11_m12_instances": _mart_columns(
        "low_stock_times", "out_of_stock_times", "in_stock_times"
    ),
    "m13_weeks_of_supply": _mart_columns("weeks_of_supply"),
    "a_weekly_mart_compat": a_weekly_mart_compat,
    "a13_inventory_by_weekday": a13_inventory_by_weekday,
    "a14_sales_by_weekday": a14_sales_by_weekday,
    "j01_daily_sales_inventory": j01_daily_sales_inventory,
    "j03_inventory_calendar": j03_inventory_calendar,
    "j04_sales_calendar": j04_sales_calendar,
    "j05_star_join": j05_star_join,
    "j06_missing_unexpected": j06_missing_unexpected,
    "p04_p05_stock_flags": p04_p05_stock_flags,
    "p06_p07_closing_levels": p06_p07_closing_levels,
    "p08_as_of_today": p08_as_of_today,
    "p09_as_of_date": p09_as_of_date,
    "p10_as_of_next_day": p10_as_of_next_day,
    "p11_coercion": p11_coercion,
    "o01_ordered_mart": o01_ordered_mart,
    "o02_preview": o02_preview,
    "f02_f06_names_and_dates": f02_f06_names_and_dates,
    "f09_manifest_lookup": f09_manifest_lookup,
    "r01_landing_audit": r01_landing_audit,
    "r01_unrecognised_names": r01_unrecognised_names,
    "r02_as_of_replay": r02_as_of_replay,
    "r03_manifest": r03_manifest,
    "r03_continuous_readiness": r03_continuous_readiness,
    "r04_snapshot_counts": r04_snapshot_counts,
    "r04_verified_export": r04_verified_export,
    "s01_typed_csv_roundtrip": s01_typed_csv_roundtrip,
    "s02_drop_for_a_date": s02_drop_for_a_date,
    "s03_declared_table_load": s03_declared_table_load,
    "s06_list_files": s06_list_files,
    "s06_listing_history": s06_listing_history,
    "s08_mart_from_saved_daily": s08_mart_from_saved_daily,
    "s09_views_in_sql": s09_views_in_sql,
    "s10_external_table": s10_external_table,
    "s11_contract_breaches": s11_contract_breaches,
    "s11_repeated_keys": s11_repeated_keys,
    "s12_job_run": s12_job_run,
    "s12_arrivals": s12_arrivals,
    "k01_parquet_roundtrip": k01_parquet_roundtrip,
    "k02_daily_roundtrip": k02_daily_roundtrip,
    "k03_gzip_unload": k03_gzip_unload,
    "k04_plain_unload": k04_plain_unload,
    "k05_bounded_parts": k05_bounded_parts,
    "k05_byte_capped_parts": k05_byte_capped_parts,
    "k07_append_and_rerun": k07_append_and_rerun,
    "j01_from_buckets": j01_from_buckets,
    "r02_dates_from_table": r02_dates_from_table,
    "r02_compact_dates": r02_compact_dates,
    "r02_compact_replay": r02_compact_replay,
    "r02_incremental_refresh": r02_incremental_refresh,
    "r02_changed_days": r02_changed_days,
    "r01_audit_of_snapshot": r01_audit_of_snapshot,
    "s01_store_contract": s01_store_contract,
    "s10_dimension_tables": s10_dimension_tables,
    "j02_undated_facts": j02_undated_facts,
    "j01_conflicting_stock": j01_conflicting_stock,
    "p11_job_rejects": p11_job_rejects,
    "p11_malformed_lines": p11_malformed_lines,
    "p11_repeated_dimension_rejects": p11_repeated_dimension_rejects,
    "j02_repeated_dimension_keys": j02_repeated_dimension_keys,
    "s12_append_daily": s12_append_daily,
    "k02_raw_sales": k02_raw_sales,
    "k01_rerun_smaller": k01_rerun_smaller,
}
