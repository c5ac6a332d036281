"""Queries whose results SQL can express, against DuckDB."""

import duckdb
import pytest

pytest.importorskip("tickforge.llm")
from tickforge.llm import queries  # noqa: E402


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = con.execute(queries.ORACLE_SQL[name])
    columns = sorted(d[0] for d in got.description)
    df = queries.QUERIES[name](spark, sf)
    assert sorted(df.columns) == columns
    pick = lambda names, found: sorted(tuple(r[names.index(c)] for c in columns) for r in found)
    assert pick(df.columns, [tuple(r) for r in df.collect()]) == pick([d[0] for d in got.description], got.fetchall())
