"""Listings over time, and last observations carried forward."""

import os
import random
import time

import pytest
from sample_rows import day
from shelfline.operators import weekly
from shelfline.operators.daily import daily
from shelfline.operators.fill import fill_forward
from shelfline.sources import files, history, storage


def statuses(df):
    return {(os.path.basename(r.path), r.status) for r in df.collect()}


def test_looks_at_a_folder(spark, tmp_path):
    folder, looks = tmp_path / "in", str(tmp_path / "looks")
    folder.mkdir()
    look = lambda: history.record(files.list_files(spark, str(folder)), looks)
    for name in "abc":
        (folder / name).write_text(name)
    assert statuses(look()) == {("a", "added"), ("b", "added"), ("c", "added")}
    assert look().isEmpty()
    (folder / "a").write_text("longer")
    os.utime(folder / "b", (time.time() + 9, time.time() + 9))  # the same length, another time
    (folder / "c").unlink()
    (folder / "d").write_text("dd")  # Spark lists no empty files
    found = look()
    assert statuses(found) == {("a", "rewritten"), ("b", "rewritten"), ("c", "removed"), ("d", "added")}
    assert {os.path.basename(r.path): r.length for r in found.collect()} == {"a": 6, "b": 1, "c": 1, "d": 2}
    (folder / "c").write_text("back")
    assert statuses(look()) == {("c", "added")}
    now = history.current(spark, looks)
    listed = files.list_files(spark, str(folder)).select(now.columns)
    assert now.exceptAll(listed).isEmpty() and now.count() == listed.count() == 4
    assert history.log(spark, looks).groupBy("look").count().count() == 3  # the second look left no rows


def test_a_look_that_died_does_not_count(spark, tmp_path):
    looks = str(tmp_path / "looks")
    listing = lambda *rows: spark.createDataFrame([(p, n, None) for p, n in rows], "path string, length bigint, modificationTime timestamp")
    history.record(listing(("a", 1)), looks)
    history.record(listing(("a", 2)), looks)
    storage.delete(spark, f"{looks}/look=2/_SUCCESS")
    assert [r.length for r in history.current(spark, looks).collect()] == [1]
    assert statuses(history.record(listing(("b", 2)), looks)) == {("a", "removed"), ("b", "added")}


def carried(rows):
    """Rows (key, at, value) with the last value at or before."""
    out = []
    for key, at, value in rows:
        before = [(a, v) for k, a, v in rows if k == key and a <= at and v is not None]
        out.append((key, at, value, max(before)[1] if before else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("parts", ["1", "2", "30"])
def test_fill_forward_over_parts(spark, parts):
    """One series has most rows and lies in several parts; null keys are a series too; places repeat."""
    draw = random.Random(int(parts))
    rows = [(draw.choice(["hot", "hot", "hot", "hot", "b", None]), draw.randrange(300), draw.choice([None, None, None, draw.randrange(9)])) for _ in range(600)]
    rows += [("empty", i, None) for i in range(5)]
    df = spark.createDataFrame(rows, "k string, at int, v int")
    before = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = fill_forward(df, ["k"], ["at"], ["v"]).collect()
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    assert sorted(map(tuple, got), key=str) == carried(rows)


def test_nothing_to_fill(spark):
    assert fill_forward(spark.createDataFrame([], "k int, at int, v int"), ["k"], ["at"], ["v"]).count() == 0


def test_last_levels_of_weeks(spark, make):
    stock = make.stock(
        ("2021-01-05", 1, 1, 5, None), ("2021-01-06", 1, 1, None, None), ("2021-01-10", 1, 1, 9, None), ("2021-01-30", 1, 1, 2, None), ("2021-01-06", 2, 1, None, None)
    )
    sales = make.sales(("2021-01-20", 1, 1, 1, 1), ("2021-01-26", 1, 1, 1, 1), ("2021-02-26", 1, 1, 1, 1), ("2021-01-02", 1, 1, 1, 1))
    cells, calendar = daily(sales, stock), make.calendar()
    found = weekly.with_last_levels(weekly.weekly_mart(cells, calendar), cells, calendar)
    got = {(r.store_key, r.yr_num, r.wk_num): (r.eop_stock_on_hand_qty, r.last_on_hand_qty) for r in found.collect()}
    assert got == {
        (1, 2020, 53): (None, None), (1, 2021, 1): (9, 9), (1, 2021, 3): (None, 9), (1, 2021, 4): (None, 2), (1, 2021, 8): (None, 2), (2, 2021, 1): (None, None),
    }
    assert day("2021-01-30").isoweekday() == 6
