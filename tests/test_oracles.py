"""Every registered query of the event engine against its DuckDB SQL on the smallest tables."""

import datetime
import decimal
import os

import duckdb
import pytest

from eventloom.plans.queries import ORACLES, QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "labels")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are absent")


def plain(value):
    if value is None or isinstance(value, bool):
        return str(value)
    if isinstance(value, (float, decimal.Decimal)):
        return f"{float(value):.6g}"
    if isinstance(value, (list, tuple)):
        return f"[{', '.join(map(plain, value))}]"
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return str(value)


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, SF_DIR)
    names = sorted(got.columns)
    rows = sorted(tuple(plain(r[c]) for c in names) for r in got.collect())
    expected = duck.sql(ORACLES[name])
    assert sorted(expected.columns) == names
    at = [expected.columns.index(c) for c in names]
    assert rows == sorted(tuple(plain(r[i]) for i in at) for r in expected.fetchall())


def test_whole_tables_are_read(spark, duck):
    found = QUERIES["unpivot_matrix_month"](spark, SF_DIR).selectExpr("sum(n)").head()[0]
    assert found == duck.sql("SELECT count(*) FROM events WHERE ts IS NOT NULL").fetchall()[0][0]
    rules = QUERIES["rrule_occurrences_all"](spark, SF_DIR).select("rule_id").distinct().count()
    assert rules == duck.sql("SELECT count(*) FROM part").fetchall()[0][0]
