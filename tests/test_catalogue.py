"""Every registered query of the star schema against its SQL, run by DuckDB."""

import duckdb
import pytest

from weft.plans import catalogue

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in catalogue.TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", catalogue.queries())
def test_agrees(spark, oracle, name):
    df = catalogue.queries()[name](spark, DATA)
    found = oracle.execute(catalogue.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(names)
    plain = lambda row: tuple(v.isoformat() if hasattr(v, "isoformat") else v for v in row)
    wanted = sorted((plain(r) for r in found.fetchall()), key=repr)
    assert sorted((plain(r) for r in df.select(*(f"`{c}`" for c in names)).collect()), key=repr) == wanted


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
