"""Every registered query against its SQL, all rows, values exactly equal."""

import pytest
from compare import compare, connect

import __spark_entry__ as contract
from shelfline.plans.catalogue import QUERIES


@pytest.fixture(scope="module")
def con(sample_dir):
    return connect(sample_dir)


def test_every_query_has_sql():
    assert set(QUERIES) <= set(contract.queries()) & set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, con, sample_dir, name):
    query, sql = contract.queries()[name], contract.oracle_sql()[name]
    rows, different, sample = compare(spark, con, sample_dir, query, sql)
    assert different == 0, sample
    assert rows > 0


def test_entry_has_rows_and_a_stable_schema(spark):
    first, second = contract.entry(spark), contract.entry(spark)
    assert first.schema == second.schema
    assert first.limit(1).count() == 1
