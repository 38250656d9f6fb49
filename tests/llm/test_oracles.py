"""The queries that SQL can express, against DuckDB on whole tables."""

import duckdb
import pytest

from weft.llm import entry


@pytest.mark.parametrize("name", entry.oracle_sql())
def test_agrees(spark, name):
    data = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    df = entry.queries()[name](spark, data)
    found = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(tuple, df.select(names).collect())) == sorted(found.fetchall())
