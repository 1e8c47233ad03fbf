"""Every registered query against its SQL (TEST_QUERIES narrows the names)."""

import os

import oracle
import pytest

import __spark_entry__ as driver

SQL = driver.oracle_sql()
WANTED = [n for n in SQL if any(p in n for p in os.environ.get("TEST_QUERIES", "").split(","))]


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", WANTED)
def test_same_rows_as_sql(spark, sf_dir, con, name):
    names, ours = oracle.run_spark(driver.queries()[name](spark, sf_dir))
    assert oracle.difference(names, ours, con, SQL[name]) == ""


def test_entry_and_names(spark):
    assert set(SQL) <= set(driver.queries())
    assert driver.entry(spark).count() > 0
