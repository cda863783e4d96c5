"""Unloads whose files are capped in bytes."""

import glob
import gzip
import os
import random

import pytest
from sample_rows import day
from pyspark.sql import functions as F
from shelfline.sources import files, schemas, sinks
from shelfline.sources.files import Location


def parts(path):
    return sorted(glob.glob(f"{path}/part-*"))


@pytest.mark.parametrize("cap", [40, 200, 5000])
def test_no_file_over_the_cap_and_every_row_once(spark, tmp_path, cap):
    draw = random.Random(cap)
    rows = [(i, "é" * draw.choice([0, 1, 5, 30, 120 if i % 50 == 0 else 2])) for i in range(2000)]
    df = spark.createDataFrame(rows, "k int, text string").repartition(7)
    n = sinks.unload_capped(df, str(tmp_path / "out"), max_bytes=cap, order_by=("k",))
    found, sizes = [], []
    for path in parts(tmp_path / "out"):
        with open(path, encoding="utf-8") as f:
            head, *lines = f.read().splitlines()
        assert head == "k,text"
        assert os.path.getsize(path) <= cap or len(lines) == 1  # a long row is alone
        sizes.append(os.path.getsize(path))
        found += lines
    assert len(sizes) == n
    assert [int(line.split(",")[0]) for line in found] == list(range(2000))  # in order over the files
    back = spark.read.schema("k int, text string").option("header", "true").csv(str(tmp_path / "out"))
    assert sorted(back.fillna("").collect()) == sorted(rows)
    if cap == 5000:
        assert sorted(sizes)[len(sizes) // 2] > 0.9 * cap


def test_each_partition_is_cut_by_itself(spark, tmp_path):
    """Without an order, rows stay in their partitions' order; no task holds more than one file."""
    df = spark.range(0, 1000, 1, 4).select(F.col("id"), F.repeat(F.lit("x"), 20).alias("x"))
    sinks.unload_capped(df, str(tmp_path / "out"), max_bytes=1000)
    ids = []
    for path in parts(tmp_path / "out"):
        ids += [int(line.split(",")[0]) for line in open(path).read().splitlines()[1:]]
    assert ids == list(range(1000))


def test_rows_that_need_quotes(spark, tmp_path):
    rows = [(1, 'a,"b"'), (2, None), (3, ""), (4, " c "), (5, "\\")]
    df = spark.createDataFrame(rows, "k int, text string")
    sinks.unload_capped(df, str(tmp_path / "out"), max_bytes=30)
    sinks.unload_csv(df, str(tmp_path / "usual"), compression="none")
    read = lambda p: sorted(map(tuple, spark.read.option("header", "true").csv(str(tmp_path / p)).collect()))
    assert read("out") == read("usual")


def test_empty_table_and_gzip(spark, tmp_path):
    none = spark.createDataFrame([], "k int, text string")
    assert sinks.unload_capped(none, str(tmp_path / "none")) == 0
    assert [open(p).read() for p in parts(tmp_path / "none")] == ["k,text\n"]
    sinks.unload_capped(spark.range(100), str(tmp_path / "zip"), max_bytes=50, compression="gzip")
    assert max(len(gzip.open(p).read()) for p in parts(tmp_path / "zip")) <= 50


def test_snapshot_with_a_cap(spark, make, tmp_path):
    stock = make.stock(*[("2021-01-04", 1, i, i, None) for i in range(200)], ("2021-01-09", 1, 1, 1, None))
    place = Location(str(tmp_path))
    written = sinks.export_snapshot({"inventory": stock}, place, day("2021-01-05"), compression="none", dashed=True, max_bytes=1 << 10)
    assert [tuple(r) for r in written.collect()] == [("inventory", 200)]
    path = place.path("inventory", day("2021-01-05"), True)
    assert max(map(os.path.getsize, parts(path))) <= 1 << 10
    assert files.read_drop(spark, place, "inventory", day("2021-01-05"), True).count() == 200
    assert files.read_csv(spark, path, "inventory").columns == schemas.columns("inventory")


def test_small_files_share_a_task(spark, tmp_path):
    """Tasks grow with the bytes, not with the files; names stay in order over a task's thousand files."""
    df = spark.range(0, 4500, 1, 2).select("id", F.repeat(F.lit("x"), 20).alias("x"))
    assert sinks.unload_capped(df, str(tmp_path / "out"), max_bytes=60) == 2250
    found = parts(tmp_path / "out")
    assert len({os.path.basename(p).split("-")[1] for p in found}) == 3
    assert [int(line.split(",")[0]) for p in found for line in open(p).read().splitlines()[1:]] == list(range(4500))
    assert max(map(os.path.getsize, found)) <= 60


@pytest.mark.parametrize("cap", [9500, sinks.FILE_CAP])
def test_lines_move_in_runs(spark, tmp_path, monkeypatch, cap):
    """What is stored and shuffled grows with the bytes, not with the lines; long lines and order are kept."""
    monkeypatch.setattr(sinks, "fresh_path", lambda *_: str(tmp_path / "own"))
    text = F.repeat(F.lit("x"), F.when(F.col("id") % 1500 == 7, 9000).otherwise(20).cast("int"))
    df = spark.range(0, 4500, 1, 4).select("id", text.alias("x"))
    assert sinks.unload_capped(df, str(tmp_path / "out"), max_bytes=cap) == len(parts(tmp_path / "out"))
    assert max(map(os.path.getsize, parts(tmp_path / "out"))) <= cap
    lines = [line for p in parts(tmp_path / "out") for line in open(p).read().splitlines() if line != "id,x"]
    assert lines == [f"{i},{'x' * (9000 if i % 1500 == 7 else 20)}" for i in range(4500)]
    assert spark.read.parquet(str(tmp_path / "own")).count() < 150
