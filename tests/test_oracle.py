"""Every registered query against its SQL, on the smallest tables."""

import pytest
from oracle_check import compare, connect

import __spark_entry__ as driver

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(driver.queries()))
def test_query_matches_sql(spark, con, name):
    ok, message = compare(spark, con, SF, name, driver.queries()[name], driver.oracle_sql().get(name))
    assert ok, message


def test_entry(spark):
    assert driver.entry(spark).count() > 0


def test_sql_only_for_registered_queries():
    assert set(driver.oracle_sql()) <= set(driver.queries())
