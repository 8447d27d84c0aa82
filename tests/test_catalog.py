"""Every registered query against its SQL twin, or at least for rows."""

import pytest

import __spark_entry__ as driver
from notewright.plans.catalog import CATALOG
from tests.oracle import connect, difference

WITH_SQL = [name for name, query in CATALOG.items() if query.sql is not None]
WITHOUT_SQL = [name for name, query in CATALOG.items() if query.sql is None]


@pytest.fixture(scope="module")
def database(folder):
    return connect(folder)


@pytest.mark.parametrize("name", WITH_SQL)
def test_equals_sql(spark, folder, database, name):
    assert difference(CATALOG[name].run(spark, folder), CATALOG[name].sql, database) is None


@pytest.mark.parametrize("name", WITHOUT_SQL)
def test_gives_rows(spark, folder, name):
    first = CATALOG[name].run(spark, folder)
    assert len(first.collect()) > 0


def test_entry_gives_one_row(spark):
    assert driver.entry(spark).count() == 1


def test_every_sql_has_a_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())
