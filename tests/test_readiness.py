"""Readiness as names stream in: order, repeats, restarts, deadlines."""

import datetime as dt
import itertools
import json

import pytest
from sample_rows import day
from shelfline.functions import names as N
from shelfline.operators import landing
from shelfline.streaming import readiness

BASE = "s3a://landing"
D1, D2, D3 = "20210104", "20210105", "20210106"


class Stream:
    def __init__(self, spark, tmp_path):
        self.spark, self.at = spark, str(tmp_path)

    def land(self, when, *names):
        rows = [(n, dt.datetime.fromisoformat(when)) for n in names]
        df = self.spark.createDataFrame(rows, "name string, landed_at timestamp")
        df.coalesce(1).write.mode("append").parquet(f"{self.at}/names")
        return self

    def run(self, **more):
        """A new query each time, as after a restart; the checkpoint remembers."""
        arrived = self.spark.readStream.schema("name string, landed_at timestamp").parquet(f"{self.at}/names")
        readiness.run_once(readiness.readiness(arrived, BASE, **more), f"{self.at}/out", f"{self.at}/state").awaitTermination()
        return {(r.run_date, r.status): r for r in self.all()}

    def all(self):
        return self.spark.read.schema(readiness.OUT).parquet(f"{self.at}/out").collect()


@pytest.fixture
def stream(spark, tmp_path):
    return Stream(spark, tmp_path)


def whole(label, *, but=(), ending=".csv.gz"):
    return [f"{t}_{label}{ending}" for t in N.REQUIRED_TABLES if t not in but]


def test_manifest_goes_out_once_and_equals_the_batch(stream, spark):
    names = [*whole(D1), *whole("2021-01-05", ending=".csv"), *whole(D2, but=["store"])]
    first, second, third = names[::3], names[1::3], [*names[2::3], *names[::2]]
    for hour, some in enumerate((first, second, third), 1):
        found = stream.land(f"2021-01-05T0{hour}:00:00", *some).run()
    listing = spark.createDataFrame([(n,) for n in names], "name string")
    want = {(r.run_date, "ready"): r.payload for r in landing.manifest(listing, BASE).collect()}
    assert {k: r.payload for k, r in found.items()} == want and len(want) == 2
    stream.land("2021-01-05T09:00:00", *names).run()
    assert len(stream.all()) == 2
    assert json.loads(found[day("2021-01-04"), "ready"].payload)["conf"]["sales"] == f"{BASE}/sales_{D1}.csv.gz"


def test_late_day_is_reported_once_and_can_still_become_ready(stream):
    stream.land("2021-01-05T01:00:00", *whole(D1, but=["store", "sales"]), *whole(D3, but=["store"])).run()
    assert stream.all() == []
    # the clock passes the first day's deadline, 6 o'clock of the next day, by more than the delay
    found = stream.land("2021-01-05T07:30:00", "unrelated.txt").run()
    assert set(found) == {(day("2021-01-04"), "late")}
    assert found[day("2021-01-04"), "late"].missing == "sales,store"
    stream.land("2021-01-05T09:00:00", f"store_{D1}.csv.gz").run()
    assert len(stream.all()) == 1
    found = stream.land("2021-01-05T09:10:00", f"sales_{D1}.csv.gz").run()
    assert set(found) == {(day("2021-01-04"), "late"), (day("2021-01-04"), "ready")}
    assert len(stream.land("2021-01-05T10:00:00", f"sales_{D1}.csv.gz", f"sales_{D1}.csv.gz").run()) == 2


def test_unexpected_table_holds_a_day_back(stream):
    found = stream.land("2021-01-04T08:00:00", *whole(D1), f"returns_{D1}.csv.gz", f"returns_{D1}.csv.gz", f"notes_{D1}.csv.gz").run()
    assert found == {}
    found = stream.land("2021-01-09T08:00:00", "tick").run()
    late = found[day("2021-01-04"), "late"]
    assert (late.missing, late.n_unexpected) == ("", 2)


def test_any_order_of_passes_sends_the_same(spark, tmp_path):
    pieces = [whole(D1, but=["store", "sales"]), [f"store_{D1}.csv.gz", f"sales_{D2}.csv.gz"], [f"sales_{D1}.csv.gz", "junk", ""]]
    sent = set()
    for i, order in enumerate(itertools.permutations(pieces)):
        one = Stream(spark, tmp_path / str(i))
        for hour, some in enumerate(order, 1):
            one.land(f"2021-01-05T0{hour}:00:00", *some).run()
        one.land("2021-02-01T00:00:00", "tick").run()
        sent.add(frozenset((r.run_date, r.status, r.payload, r.missing) for r in one.all()))
    assert len(sent) == 1 and len(next(iter(sent))) == 2


def test_files_of_a_folder(spark, tmp_path):
    """Names of landed files, single ones and folders of parts, whose contents are not read."""
    for name in whole(D1, but=["sales"]):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_bytes(b"\xff\x00")
    (tmp_path / "in" / f"sales_{D1}.csv.gz").mkdir()
    (tmp_path / "in" / f"sales_{D1}.csv.gz" / "part-0.csv.gz").write_bytes(b"x")
    reports = readiness.readiness(readiness.landed_names(spark, str(tmp_path / "in")), BASE)
    readiness.run_once(reports, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    rows = spark.read.schema(readiness.OUT).parquet(str(tmp_path / "out")).collect()
    assert [(r.run_date, r.status) for r in rows] == [(day("2021-01-04"), "ready")]
