"""The SQL of the queries that SQL can express gives the same rows."""

from collections import Counter

import duckdb
import pytest

from phasegrid.llm.oracles import ORACLE_SQL
from phasegrid.llm.queries import QUERIES


#: DuckDB's inner product asks for lists of equal length, which the fixture has not; a plain version is compared instead.
NAMES = [n for n in ORACLE_SQL if n != "op12_hard_negatives"]


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, folder, name):
    connection = duckdb.connect()
    for table in ("documents", "benchmark", "conversations"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    result = connection.execute(ORACLE_SQL[name])
    columns = [d[0] for d in result.description]
    found = QUERIES[name](spark, folder)
    assert sorted(found.columns) == sorted(columns)
    assert Counter(tuple(r) for r in found.select(columns).collect()) == Counter(result.fetchall())
