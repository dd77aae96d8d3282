"""Every registered query against its SQL, and the driver contract."""

import datetime

import pytest

import __spark_entry__ as driver
from weftlink.workloads.catalog import QUERIES
from weftlink.workloads.oracle import ORACLE
from conftest import TESTDATA

duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not TESTDATA.exists(), reason="test tables not found")


@pytest.fixture(scope="session")
def sql():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in TESTDATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([plain(row[i]) for i in order]) for row in rows)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert QUERIES.items() <= driver.queries().items() and ORACLE.items() <= driver.oracle_sql().items()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, sql, name):
    frame = QUERIES[name](spark, str(TESTDATA))
    expected = sql.execute(ORACLE[name])
    names = [c[0] for c in expected.description]
    assert sorted(names) == sorted(frame.columns)
    assert normal(frame.collect(), frame.columns) == normal(expected.fetchall(), names)


def test_entry(spark):
    assert driver.entry(spark).count() > 0
