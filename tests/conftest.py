import os
import sys

import pytest

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.path.dirname(__file__)]

from sample_rows import SALES_DDL, STOCK_DDL, day, money
from shelfline.session import build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    session = build_session(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.sql.sources.parallelPartitionDiscovery.threshold": "1000",
            # tables here are kilobytes; let them still be written by several tasks
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
            "spark.driver.memory": "4g",
            "spark.checkpoint.dir": str(shared),
            "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sample_dir():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def make(spark):
    """Small frames: sales (date, store, product, qty, amt) and stock (..., on hand, out)."""

    class Make:
        def sales(self, *rows):
            full = [
                (i, day(d), s, p, money(q), money(a / q if q else a), money(a), money(1),
                 money(a / 2), money(a / 2))
                for i, (d, s, p, q, a) in enumerate(rows)
            ]
            return spark.createDataFrame(full, SALES_DDL)

        def stock(self, *rows):
            full = [
                (day(d), s, p, money(h), money(h * 2 if h is not None else None), out)
                for d, s, p, h, out in rows
            ]
            return spark.createDataFrame(full, STOCK_DDL)

        def calendar(self, first="2020-12-01", last="2021-02-28"):
            from shelfline.plans.sample_model import calendar

            return calendar(spark, day(first), day(last))

    return Make()
