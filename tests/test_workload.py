"""Every registered query against its SQL, on the smallest driver tables."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from phasegrid.plans.workload import QUERIES
from phasegrid.plans.workload_sql import ORACLE_SQL

SF_DIR = Path("/root/testdata/sf0.001")
TABLES = ("customer", "events", "lineitem", "orders")
TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
    "date": "DATE", "timestamp_ntz": "TIMESTAMP",
}

pytestmark = pytest.mark.skipif(not SF_DIR.exists(), reason="no driver tables here")


@pytest.fixture(scope="module")
def database():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).columns == ["device", "phase", "window_start", "date", "total_act_energy_kwh"]


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, database, name):
    df = QUERIES[name](spark, str(SF_DIR))
    result = database.execute(ORACLE_SQL[name])
    expected_types = {d[0]: str(d[1]) for d in result.description}
    columns = sorted(expected_types)
    assert {c: TYPES[t] for c, t in df.dtypes} == expected_types
    order = [list(expected_types).index(c) for c in columns]
    expected = sorted(repr([row[i] for i in order]) for row in result.fetchall())
    assert sorted(repr(list(row)) for row in df.select(*[f"`{c}`" for c in columns]).collect()) == expected
    assert expected
