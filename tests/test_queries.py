"""Every query that has SQL, against DuckDB on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from graphloom.plans import queries as graph_queries

SQL = graph_queries.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_like_sql(spark, sf_dir, con, name):
    got = graph_queries.queries()[name](spark, sf_dir)
    columns = sorted(got.columns)
    quoted = ", ".join(f'"{c}"' for c in columns)
    want = sorted(map(repr, con.execute(f"SELECT {quoted} FROM ({SQL[name]})").fetchall()))
    assert sorted(repr(tuple(r)) for r in got.select(*columns).collect()) == want


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 25
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
