"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

from tickforge.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    out = duckdb.connect()
    out.execute("SET TimeZone='UTC'")
    for t in TABLES:
        out.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return out


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, bool):
        return v
    return float(v) if isinstance(v, (int, float)) else str(v)


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=str)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_equals_sql(spark, sf, con, name):
    df = registry.QUERIES[name](spark, sf)
    got = con.execute(registry.ORACLE_SQL[name])
    columns = [d[0] for d in got.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, df.collect()) == rows(columns, got.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs_alike_twice(spark, sf, name):
    a, b = (registry.QUERIES[name](spark, sf) for _ in range(2))
    first = rows(a.columns, a.collect())
    assert first and first == rows(b.columns, b.collect())
