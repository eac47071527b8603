"""Every registered query against its SQL in DuckDB."""

import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from baitwatch import catalog, oracle

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "labels", "pages", "events", "conversations")
#: No mail of the smallest tables is long or blank.
EMPTY = {"quarantined_mail"}
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(oracle.queries())
    assert set(catalog.queries()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = Counter(tuple(r) for r in df.select(*columns).collect())
    sql = duck.sql(oracle.queries()[name])
    assert sorted(sql.columns) == columns
    expected = Counter(sql.select(*[f'"{c}"' for c in columns]).fetchall())
    assert got == expected and (expected or name in EMPTY)
