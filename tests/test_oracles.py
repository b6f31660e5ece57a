"""Every registered core query against its DuckDB twin on the smallest tables."""

import datetime
import decimal

import duckdb
import pytest

from varve.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if v != v else float(f"{v:.9g}")
    if isinstance(v, datetime.datetime):
        return str(v)
    return tuple(map(norm, v)) if isinstance(v, list) else v


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(name, spark, duck):
    df = registry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    rows = sorted(str([norm(r[c]) for c in cols]) for r in df.collect())
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    rel = duck.sql(sql)
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert rows == sorted(str([norm(r[i]) for i in at]) for r in rel.fetchall())
