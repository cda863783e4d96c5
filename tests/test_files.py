"""Readers, writers, catalog, job and arrivals."""

import glob
import gzip
import os

import pytest
from sample_rows import day
from pyspark.sql import functions as F
from shelfline.operators import quality
from shelfline.plans import job
from shelfline.plans import sample_model as sample
from shelfline.sources import catalog, files, schemas, scratch, sinks
from shelfline.sources.files import Location
from shelfline.streaming import arrivals

RUN = day("1998-09-02")


def write(path, text, zipped=False):
    opener = gzip.open if zipped else open
    with opener(path, "wt") as f:
        f.write(text)
    return str(path)


STOCK_HEADER = ",".join(c.upper() for c in schemas.columns("inventory"))


def test_single_gzip_file_with_upper_case_header(spark, tmp_path):
    write(
        tmp_path / "inventory_19980902.csv.gz",
        f"{STOCK_HEADER}\n1998-09-01,1,2,3.50,4.00,1,,true,\n1998-09-01,1,3,0.00,,,0.25,false,1998-09-04\n",
        zipped=True,
    )
    for base in (str(tmp_path), f"file://{tmp_path}"):
        rows = files.read_drop(spark, Location(base), "inventory", RUN).orderBy("prod_key").collect()
        assert [r.out_of_stock_flg for r in rows] == [True, None]
        assert str(rows[0].inventory_on_hand_qty) == "3.50" and rows[1].next_delivery_dt == day("1998-09-04")


def test_columns_are_matched_to_the_header(spark, tmp_path):
    swapped = STOCK_HEADER.replace("STORE_KEY,PROD_KEY", "PROD_KEY,STORE_KEY")
    path = write(tmp_path / "x.csv", f"{swapped}\n1998-09-01,1,2,3.50,4.00,1,,true,\n")
    with pytest.raises(Exception, match="(?i)header"):
        files.read_csv(spark, path, "inventory").collect()


def test_bad_value_fails_fast_and_can_be_rejected_instead(spark, tmp_path):
    path = write(
        tmp_path / "x.csv",
        f"{STOCK_HEADER}\n1998-09-01,1,2,many,4.00,1,,true,\n1998-09-01,1,3,1.00,4.00,2,,true,\n"
        "1998-09-01,1,4,1.00,4.00,0,,true,\n1998-09-01,1,5,1.00,4.00,,,true,\n",
    )
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_csv(spark, path, "inventory").collect()
    checked = quality.coerce(files.read_text_csv(spark, path, "inventory"), "inventory")
    assert {(r.prod_key, r[quality.REASON]) for r in quality.rejected(checked).collect()} == {
        (2, "inventory_on_hand_qty"),
        (3, "out_of_stock_flg"),
    }
    good = schemas.conform(quality.accepted(checked), "inventory")
    assert {(r.prod_key, r.out_of_stock_flg) for r in good.collect()} == {(4, False), (5, None)}


def test_null_spelling_is_configurable(spark, tmp_path):
    write(tmp_path / "inventory_1998-09-02.csv", f"{STOCK_HEADER}\n1998-09-01,1,2,\\N,4.00,\\N,\\N,true,\\N\n")
    place = Location(str(tmp_path)).with_options(nullValue="\\N")
    row = files.read_drop(spark, place, "inventory", RUN, dashed=True).first()
    assert row.inventory_on_hand_qty is None and row.out_of_stock_flg is None


def test_only_needed_columns_are_read(spark, tmp_path, capsys):
    path = write(tmp_path / "x.csv", f"{STOCK_HEADER}\n1998-09-01,1,2,3.50,4.00,1,,true,\n")
    df = files.read_csv(spark, path, "inventory").select("cal_dt", "inventory_on_hand_qty")
    df.explain()
    assert "ReadSchema: struct<cal_dt:date,inventory_on_hand_qty:decimal(38,2)>" in capsys.readouterr().out
    assert df.count() == 1


def test_missing_date_breaks_the_calendar_contract(spark, make):
    broken = make.calendar().withColumn(
        "cal_dt", F.when(F.col("wk_num") != 53, F.col("cal_dt"))
    ).withColumn("cal_type_desc", F.repeat(F.lit("x"), 21))
    found = {
        (r.column_name, r.rule): r.n_rows
        for r in quality.contract_breaches(schemas.to_contract(broken, "calendar"), "calendar").collect()
    }
    assert found[("cal_dt", "not null")] == 7
    assert found[("cal_type_desc", "at most 20 characters")] == broken.count()


def test_declared_table_rejects_text_that_is_too_long(spark):
    catalog.create_schema(spark, "checks", scratch.fresh_path(spark, "schema"))
    catalog.create_raw_table(spark, "store", "checks.store", scratch.fresh_path(spark, "store"))
    good = spark.createDataFrame([(1, "a")], "store_key int, postal_zip_cd string")
    catalog.load(good, "store", "checks.store")
    with pytest.raises(Exception, match="(?i)length limitation"):
        catalog.load(good.withColumn("postal_zip_cd", F.repeat(F.lit("9"), 11)), "store", "checks.store")
    assert spark.table("checks.store").count() == 1


def test_parts_are_bounded_by_records(spark, tmp_path):
    df = spark.range(0, 1000, 1, 1)
    sinks.unload_csv(df, str(tmp_path / "parts"), max_records=50, compression="none")
    sizes = [sum(1 for _ in open(f)) - 1 for f in glob.glob(f"{tmp_path}/parts/*.csv")]
    assert sum(sizes) == 1000 and max(sizes) <= 50


def test_invalid_flags_and_wide_totals_are_errors(spark):
    rows = spark.createDataFrame([(2,), (None,), (1,)], "out_of_stock_flg int")
    assert rows.filter("out_of_stock_flg is null or out_of_stock_flg = 1").select(schemas.flag_from_int(F.col("out_of_stock_flg"))).count() == 2
    with pytest.raises(Exception, match="must be 0, 1 or empty, not 2"):
        rows.select(schemas.flag_from_int(F.col("out_of_stock_flg"))).collect()
    big = spark.sql("select cast(99999999999999999 as decimal(38,2)) as x")
    for ansi in ("true", "false"):
        spark.conf.set("spark.sql.ansi.enabled", ansi)
        with pytest.raises(Exception, match="does not fit"):
            big.select(schemas.narrow(F.col("x"))).collect()
    spark.conf.set("spark.sql.ansi.enabled", "true")


def test_saved_files_are_sorted(spark, tmp_path):
    df = spark.range(0, 10000).select((F.col("id") * 7919 % 10007).alias("k"))
    sinks.save_table(df, str(tmp_path / "t"), cluster_by=("k",))
    for path in glob.glob(f"{tmp_path}/t/*.parquet"):
        keys = [r.k for r in spark.read.parquet(path).collect()]
        assert keys == sorted(keys)


def test_rerun_replaces_only_its_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    sinks.save_table(df, path, partition_by=("k",))
    changed = df.filter("k = 2").withColumn("v", F.lit("c"))
    sinks.save_table(changed, path, partition_by=("k",), replace_partitions=True)
    assert {(r.k, r.v) for r in files.read_saved(spark, path).collect()} == {(1, "a"), (2, "c")}
    sinks.save_table(changed, path, partition_by=("k",))
    assert {(r.k, r.v) for r in files.read_saved(spark, path).collect()} == {(2, "c")}


def test_external_table_sees_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.save_table(spark.range(10).selectExpr("id", "id % 3 AS p"), path, partition_by=("p",))
    catalog.create_schema(spark, "checks", scratch.fresh_path(spark, "schema"))
    catalog.expose(spark, "checks.t", path)
    assert spark.sql("SELECT count(*) FROM checks.t WHERE p = 0").first()[0] == 4
    sinks.save_table(spark.range(5), str(tmp_path / "u"))
    assert catalog.expose(spark, "checks.u", str(tmp_path / "u")).count() == 5


def test_listing_does_not_read_contents(spark, tmp_path, capsys):
    write(tmp_path / "sales_20221012.csv.gz", "x")
    df = files.list_files(spark, str(tmp_path)).select("name", "length")
    df.explain()
    assert "content" not in capsys.readouterr().out.split("ReadSchema")[1]
    assert [tuple(r) for r in df.collect()] == [("sales_20221012.csv.gz", 1)]


def test_job_end_to_end(spark, sample_dir, tmp_path, capsys):
    tables = sample.tables(spark, sample_dir)
    counts = sinks.export_snapshot(tables, Location(str(tmp_path / "in")), RUN)
    written = {r.table_name: r.rows_written for r in counts.collect()}
    assert written["sales"] == tables["sales"].filter(F.col("trans_dt") <= RUN).count()
    listed = files.list_files(spark, str(tmp_path / "in"), "*.csv.gz")
    assert {r.name for r in listed.collect()} == {f"{t}_19980902.csv.gz" for t in tables}

    config = job.parse_args(
        ["--run-date", str(RUN), "--input", str(tmp_path / "in"), "--output", str(tmp_path / "out"),
         "--save-sales", "--catalog-schema", "reports"]
    )
    catalog.create_schema(spark, "reports", scratch.fresh_path(spark, "reports"))
    saved = job.run(spark, config)
    assert set(saved) == {"calendar", "product", "store", "sales", job.MART}
    assert os.path.basename(saved["store"]) == "run_date=19980902"
    rows = spark.sql("SELECT * FROM reports.sales_inv_store_wk_latest").drop("run_date")
    week = files.read_saved(spark, os.path.dirname(saved[job.MART])).filter(
        "run_date = 19980902 AND yr_num = 1998 AND wk_num = 1"
    )
    capsys.readouterr()
    week.explain()
    pruned = capsys.readouterr().out.split("PartitionFilters: ")[1].split("PushedFilters")[0]
    assert "run_date" in pruned and "yr_num" in pruned and "wk_num" in pruned
    assert week.count() == rows.filter("yr_num = 1998 AND wk_num = 1").count() > 0
    kept = job.run(spark, job.JobConfig(RUN, str(tmp_path / "in"), str(tmp_path / "kept"), save_daily=True))
    again = files.read_saved(spark, kept[job.MART]).select(rows.columns)
    assert rows.count() == again.count() > 0 and rows.exceptAll(again).count() == 0

    sinks.save_table(files.read_saved(spark, saved["store"]), saved["store"] + "-copy", mode="append")
    appended = job.JobConfig(RUN, str(tmp_path / "in"), str(tmp_path / "kept"), mode="append")
    stores = files.read_saved(spark, job.run(spark, appended)["store"])
    assert stores.count() == written["store"]  # delivered whole by each run, so replaced


def test_arrivals_are_ingested_once(spark, tmp_path, make):
    place, out, state = Location(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state")
    stock = make.stock(("2021-01-04", 1, 1, 3, False), ("2021-01-05", 1, 1, 4, True))

    def arrive(d):
        sinks.export_snapshot({"inventory": stock}, place, day(d))

    def ingested():
        arrivals.ingest(spark, place, "inventory", out, state).awaitTermination()
        rows = files.read_saved(spark, out).groupBy("run_date").count().collect()
        return {r.run_date: r["count"] for r in rows}

    arrive("2021-01-04")
    assert ingested() == {day("2021-01-04"): 1}
    assert ingested() == {day("2021-01-04"): 1}
    arrive("2021-01-05")
    assert ingested() == {day("2021-01-04"): 1, day("2021-01-05"): 2}
    arrive("2021-01-05")  # delivered again, then under the other name
    assert ingested() == {day("2021-01-04"): 1, day("2021-01-05"): 2}
    sinks.export_snapshot({"inventory": stock}, place, day("2021-01-05"), dashed=True, compression="none")
    write(tmp_path / "in" / "inventory_inv_store_wk_20210105.csv", "a,b\n1,2\n")
    assert ingested() == {day("2021-01-04"): 1, day("2021-01-05"): 2}


def test_a_drop_whose_parts_arrive_over_two_passes_is_whole(spark, tmp_path, make):
    place, out, state = Location(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state")
    d = day("2021-01-05")

    def part(k, name):  # one more part of the drop becomes visible
        elsewhere = Location(str(tmp_path / f"{name}{k}"))
        sinks.export_snapshot({"inventory": make.stock(("2021-01-04", 1, k, 3, False))}, elsewhere, d)
        folder = tmp_path / "in" / name
        folder.mkdir(parents=True, exist_ok=True)
        for i, source in enumerate((tmp_path / f"{name}{k}").glob("*/part-*")):
            (folder / f"part-{k}-{i}.csv.gz").write_bytes(source.read_bytes())

    def ingested():
        arrivals.ingest(spark, place, "inventory", out, state).awaitTermination()
        return sorted(r.prod_key for r in files.read_saved(spark, out).collect())

    part(1, "inventory_20210105.csv.gz")
    assert ingested() == [1]
    part(2, "inventory_20210105.csv.gz")
    assert ingested() == [1, 2]
    part(7, "inventory_2021-01-05.csv.gz")  # before the other in text order
    assert ingested() == [1, 2]


def test_shared_folder_comes_from_the_session(spark):
    assert scratch.shared_folder(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert scratch.fresh_path(spark, "a") != scratch.fresh_path(spark, "a")


@pytest.mark.parametrize("mode", ["overwrite", "append"])
def test_kept_day_rows_are_written_once_unless_added_to(spark, make, tmp_path, monkeypatch, mode):
    """The mart is built from the kept day table; where that holds other runs' rows too, from a copy of this run's."""
    place = Location(str(tmp_path / "in"))
    dims = {t: spark.createDataFrame([(1,)], f"{schemas.KEYS[t][0]} int") for t in ("product", "store")}
    facts = {"sales": make.sales(("2021-01-04", 1, 1, 2, 10)), "inventory": make.stock(("2021-01-05", 1, 1, 3, False))}
    sinks.export_snapshot({**facts, "calendar": make.calendar(), **dims}, place, RUN.replace(year=2021))
    labels, fresh = [], scratch.fresh_path
    monkeypatch.setattr(scratch, "fresh_path", lambda spark, label: labels.append(label) or fresh(spark, label))
    for nth in (1, 2):
        saved = job.run(spark, job.JobConfig(RUN.replace(year=2021), place.base, str(tmp_path / "out"), mode=mode, save_daily=True))
        times = nth if mode == "append" else 1
        assert files.read_saved(spark, saved[job.DAY_TABLE]).count() == 2 * times
        assert [r.wk_sales_qty for r in files.read_saved(spark, saved[job.MART]).collect()] == [2] * times
    assert labels == (["cells"] * 2 if mode == "append" else [])


def test_exported_rows_move_before_they_take_contract_types(spark, make, tmp_path, monkeypatch):
    """A decimal of 38 digits is no longer one long; columns that no contract has do not move at all."""
    moved, to_contract = [], schemas.to_contract

    def seen(df, table):
        moved.append((df._jdf.queryExecution().optimizedPlan().toString(), df.columns))
        return to_contract(df, table)

    monkeypatch.setattr(schemas, "to_contract", seen)
    stock = make.stock(("2021-01-04", 1, 1, 3, False)).withColumn("note", F.lit("x"))
    sinks.export_snapshot({"inventory": stock}, Location(str(tmp_path)), RUN.replace(year=2021), compression="none")
    ((plan, columns),) = moved
    assert plan.startswith("Rebalance") and "note" not in columns
    (row,) = files.read_csv(spark, str(tmp_path / f"inventory_{RUN.replace(year=2021):%Y%m%d}.csv.gz"), "inventory").collect()
    assert (row.prod_key, row.inventory_on_hand_qty, row.out_of_stock_flg, row.waste_qty) == (1, 3, False, None)
