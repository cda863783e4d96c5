"""Exports with a proof: what a lost or altered part does."""

import glob
import os
import shutil

import pytest
from sample_rows import day
from shelfline.sources import schemas, sinks, storage, verified
from shelfline.sources.files import Location


@pytest.fixture
def stock(make):
    return make.stock(*[("2021-01-04", 1 + i % 2, i, i, [True, False, None][i % 3]) for i in range(300)])


@pytest.fixture
def folder(spark, stock, tmp_path):
    path = str(tmp_path / "inventory")
    plain = lambda df, p: sinks.unload_csv(df, p, compression="none", max_records=50)
    assert verified.export(stock, "inventory", path, unload=plain)["n_rows"] == 300
    return path


def parts(path):
    return sorted(glob.glob(f"{path}/part-*.csv"))


def refused(spark, path):
    with pytest.raises(verified.NotVerified):
        verified.read(spark, "inventory", path, prove=True)
    return True


def test_what_was_sent_is_read(spark, folder, stock):
    got = verified.read(spark, "inventory", folder, prove=True)
    assert got.columns == schemas.columns("inventory")
    assert got.select(stock.columns).exceptAll(stock).isEmpty() and got.count() == 300


def test_lost_doubled_and_altered_parts(spark, folder):
    first, *_ = parts(folder)
    with open(first) as f:
        whole = f.read()
    os.rename(first, first + ".away")
    os.rename(first + ".away", os.path.join(os.path.dirname(folder), "away.csv"))
    assert refused(spark, folder)
    away = os.path.join(os.path.dirname(folder), "away.csv")
    shutil.copy(away, first)
    verified.read(spark, "inventory", folder, prove=True)
    shutil.copy(away, first.replace("part-", "part-9"))
    assert refused(spark, folder)
    storage.delete(spark, first.replace("part-", "part-9"))
    verified.read(spark, "inventory", folder, prove=True)
    with open(first, "w") as f:
        f.write(whole.replace(".00,", ".01,", 1))
    crc = os.path.join(folder, f".{os.path.basename(first)}.crc")
    if os.path.exists(crc):
        os.unlink(crc)
    assert refused(spark, folder)


def test_no_marker_no_read(spark, folder, stock, tmp_path):
    """Also while a later export is under way, or after it died."""

    def die(df, path):
        sinks.unload_csv(df.limit(10), path)
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError, match="lost"):
        verified.export(stock, "inventory", folder, unload=die)
    with pytest.raises(verified.NotVerified, match="no complete marker"):
        verified.read(spark, "inventory", folder)


def test_files_that_do_not_hold_what_was_sent(spark, stock, tmp_path):
    def lose(df, path):
        sinks.unload_csv(df, path, max_records=100, compression="none")
        storage.delete(spark, parts(path)[0])

    with pytest.raises(verified.NotVerified, match="were sent"):
        verified.export(stock, "inventory", str(tmp_path / "x"), unload=lose)
    assert not storage.exists(spark, f"{tmp_path}/x/{verified.MARKER}")


def test_texts_empty_tables_and_repeated_rows(spark, tmp_path):
    rows = [(1, ""), (2, None), (3, 'a "b", c'), (3, 'a "b", c'), (None, " x "), (4, "ü")]
    df = spark.createDataFrame(rows, "prod_key int, prod_name string")
    assert verified.export(df, "product", str(tmp_path / "p"))["n_rows"] == 6
    assert verified.read(spark, "product", str(tmp_path / "p"), prove=True).count() == 6
    assert verified.export(df.limit(0), "product", str(tmp_path / "none")) == {"n_rows": 0, "high": 0, "low": 0}
    assert verified.read(spark, "product", str(tmp_path / "none"), prove=True).isEmpty()


def test_snapshot_sums_do_not_depend_on_the_files(spark, stock, tmp_path):
    place = [Location(str(tmp_path / x)) for x in "ab"]
    one = verified.export_snapshot({"inventory": stock}, place[0], day("2021-01-05")).collect()
    two = verified.export_snapshot({"inventory": stock.repartition(5)}, place[1], day("2021-01-05"), max_bytes=700, compression="none").collect()
    assert one == two and one[0].n_rows == 300
