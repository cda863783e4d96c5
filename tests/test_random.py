"""Random small facts with NULLs, gaps, returns and repeats, against plain SQL."""

import datetime as dt
import random

import duckdb
import pytest
from compare import bag
from sample_rows import SALES_DDL, STOCK_DDL, day, money

from shelfline.operators import weekly
from shelfline.operators.daily import daily
from shelfline.operators.replay import as_of, replay
from shelfline.plans import oracle
from shelfline.plans.catalogue import _plain

FIRST = day("2020-12-07")


def facts(seed):
    rng = random.Random(seed)
    date = lambda: FIRST + dt.timedelta(days=rng.randrange(45))
    maybe = lambda value: None if rng.random() < 0.1 else money(value)
    hot = (FIRST + dt.timedelta(days=3), 1, 1)  # a third of the lines share one cell
    sales = []
    for i in range(400):
        d, s, p = hot if i % 3 == 0 else (date(), rng.randint(1, 2), rng.randint(1, 3))
        qty = rng.choice([-2, 0, 1, 2, 3, 7.25, 16])
        sales.append(
            (i, d, s, p, maybe(qty), maybe(rng.randint(1, 999) / 100), maybe(rng.randint(0, 99999) / 100),
             maybe(rng.random()), maybe(rng.random() * 10), maybe(rng.random() * 10))
        )
    cells = {(date(), rng.randint(1, 2), rng.randint(1, 3)) for _ in range(120)}
    stock = [
        (d, s, p, maybe(rng.choice([0, 1, 2, 5.5, 40])), maybe(rng.randint(0, 9)),
         rng.choice([True, False, False, None]))
        for d, s, p in sorted(cells)
    ]
    return sales, stock


def tables(con, sales, stock):
    con.execute(f"create table sales ({SALES_DDL.replace(' int,', ' integer,')})")
    con.execute(f"create table inventory ({STOCK_DDL.replace(' int,', ' integer,')})")
    con.executemany(f"insert into sales values ({', '.join('?' * 10)})", sales)
    con.executemany(f"insert into inventory values ({', '.join('?' * 6)})", stock)


@pytest.mark.parametrize("seed", [1, 2])
def test_mart_and_replay_on_random_facts(spark, make, seed):
    sales, stock = facts(seed)
    con = duckdb.connect()
    tables(con, sales, stock)
    metrics = oracle._metrics("dated", oracle.WEEK_KEYS)
    # the calendar runs from the first to the last of these dates
    con.execute("create view lineitem as select timestamp '2021-02-28' as l_shipdate")
    con.execute("create view orders as select timestamp '2020-12-01' as o_orderdate")

    def expected(limit):
        days = oracle.DATED.replace("trans_dt = cal_dt)", f"trans_dt = cal_dt where trans_dt <= date '{limit}')")
        cursor = con.execute(
            f"with {oracle.CALENDAR},{oracle.DAILY},{days},{metrics}\n"
            f"select {oracle.KEYS}, {oracle.MART_COLUMNS} from mart"
        )
        return bag(cursor.fetchall(), [d[0] for d in cursor.description])

    cells = daily(spark.createDataFrame(sales, SALES_DDL), spark.createDataFrame(stock, STOCK_DDL))
    mart = _plain(weekly.weekly_mart(cells, make.calendar()))
    assert bag(mart.collect(), mart.columns) == expected("2021-02-28")

    limits = [FIRST + dt.timedelta(days=n) for n in (0, 6, 9, 27, 60)]
    replayed = _plain(replay(cells, make.calendar(), limits)).cache()
    for limit in limits:
        rows = as_of(replayed.filter(replayed.as_of == limit), "as_of", limit).drop("as_of")
        assert bag(rows.collect(), rows.columns) == expected(limit)
    replayed.unpersist()
