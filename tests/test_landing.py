"""Names, audit and manifest."""

import json

from sample_rows import day
from pyspark.sql import functions as F
from shelfline.functions import names as N
from shelfline.operators import landing

REQUIRED = ("sales", "inventory", "product", "store", "calendar")


def listing(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "name string")


def full_day(label, suffix):
    return [f"{t}_{label}{suffix}" for t in REQUIRED]


def test_audit_of_complete_short_and_overfull_days(spark):
    names = (
        full_day("20221012", ".csv.gz")
        + full_day("2022-10-13", ".csv")
        + full_day("20221014", ".csv.gz")[1:]
        + full_day("20221015", ".csv.gz")
        + ["returns_20221015.csv.gz", "notes.txt", "sales_20221399.csv.gz"]
    )
    rows = {r.run_date: r for r in landing.audit(listing(spark, *names)).collect()}
    assert set(rows) == {day(f"2022-10-{d}") for d in (12, 13, 14, 15)}
    assert rows[day("2022-10-12")].ready and rows[day("2022-10-13")].ready
    assert rows[day("2022-10-14")].missing == ["sales"] and not rows[day("2022-10-14")].ready
    assert rows[day("2022-10-15")].n_unexpected == 1 and not rows[day("2022-10-15")].ready
    assert {r.name for r in landing.unrecognised(listing(spark, *names)).collect()} == {
        "notes.txt",
        "sales_20221399.csv.gz",
    }
    diff = {tuple(r) for r in landing.differences(listing(spark, *names)).collect()}
    assert diff == {
        (day("2022-10-14"), "sales", "missing"),
        (day("2022-10-15"), "returns", "unexpected"),
    }


def test_both_conventions_for_one_table_count_once(spark):
    names = full_day("20221012", ".csv.gz") + ["sales_2022-10-12.csv"]
    row = landing.audit(listing(spark, *names)).first()
    assert row.n_present == 5 and row.ready


def test_empty_listing_and_a_day_asked_for(spark):
    empty = listing(spark)
    assert landing.audit(empty).count() == 0
    assert landing.manifest(empty, "s3a://b").count() == 0
    row = landing.audit(empty, days=[day("2022-10-12")]).first()
    assert row.n_missing == 5 and row.present == [] and not row.ready


def test_manifest_pairs_each_table_with_its_own_file(spark):
    names = full_day("20221012", ".csv.gz") + full_day("20221013", ".csv.gz")[1:]
    made = landing.manifest(listing(spark, *names), "s3a://b/")
    row = made.first()
    assert made.count() == 1
    assert json.loads(row.payload) == {
        "conf": {t: f"s3a://b/{t}_20221012.csv.gz" for t in REQUIRED}
    }
    assert landing.read_manifest(made).first().store_path == "s3a://b/store_20221012.csv.gz"


def test_names_inside_paths(spark):
    df = listing(
        spark,
        "file:/x/sales_20221012.csv.gz/part-0.csv.gz",
        "s3a://b/store_inv_2022-10-12.csv",
        "s3a://b/readme.md",
    )
    rows = df.select(
        N.landed_name(F.col("name")).alias("n"), N.table_of(N.landed_name(F.col("name"))).alias("t")
    ).collect()
    assert [tuple(r) for r in rows] == [
        ("sales_20221012.csv.gz", "sales"),
        ("store_inv_2022-10-12.csv", "store_inv"),
        ("", ""),
    ]
