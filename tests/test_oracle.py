"""Every registered query against its SQL, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.compare import differences, duck

FOLDER = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    run = entry.queries()[name]
    if name not in SQL:
        assert run(spark, FOLDER).columns
        return
    found = [d for d in differences(spark, con, name, run, SQL[name], FOLDER) if d != "no rows"]
    assert not found, found


def test_entry(spark):
    frame = entry.entry(spark)
    assert frame.columns == ["name", "value"]
    assert [r["name"] for r in frame.collect()]


def test_all_sql_has_a_query():
    assert set(SQL) <= set(entry.queries())
