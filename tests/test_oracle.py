"""Every query with SQL gives the same rows on both engines."""

import pytest

import __spark_entry__ as entry
from checks.compare import compare, connect

SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def database(sf):
    return connect(sf)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(entry.queries())
    assert len(SQL) >= 90


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, database, name):
    rows = entry.queries()[name](spark, sf).toPandas()
    assert compare(rows, database.execute(SQL[name]).df()) == ""


def test_entry_gives_one_row_per_entity(spark):
    rows = entry.entry(spark)
    assert rows.count() == rows.select("patientunitstayid").distinct().count() > 0
    assert len(rows.columns) == 141
