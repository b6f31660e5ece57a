"""Registered queries against their DuckDB twins on small odd tables."""

import datetime
import math

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from varve.plans import registry


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isnan(a) and math.isnan(b) or a == pytest.approx(b, abs=2e-6)
    return a == b


@pytest.fixture
def against_sql(spark, tmp_path):
    """Rows of a query on the given tables, checked against its SQL."""

    def run(name, **tables):
        con = duckdb.connect()
        con.sql("SET timezone = 'UTC'")
        for table, rows in tables.items():
            pq.write_table(rows, str(tmp_path / f"{table}.parquet"))
            con.sql(f"CREATE OR REPLACE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet'")
        df = registry.queries()[name](spark, str(tmp_path))
        rel = con.sql(registry.oracle_sql()[name])
        key = lambda r: [str(x) for x in r]
        got = sorted((tuple(r) for r in df.select(*rel.columns).collect()), key=key)
        want = sorted(rel.fetchall(), key=key)
        assert len(got) == len(want)
        for a, b in zip(got, want):
            assert all(map(same, a, b)), (a, b)
        return got

    return run


def line_tables(rows):
    """lineitem, supplier and part of (year or None, supplier, flag, brand, type, reads)."""
    suppliers = sorted({r[1] for r in rows})
    parts = sorted({(r[3], r[4]) for r in rows})
    lines = {
        "l_orderkey": pa.array(range(len(rows)), pa.int64()),
        "l_partkey": pa.array([parts.index((r[3], r[4])) for r in rows], pa.int64()),
        "l_suppkey": pa.array([r[1] for r in rows], pa.int64()),
        "l_returnflag": pa.array([r[2] for r in rows]),
        "l_quantity": pa.array([r[5] for r in rows], pa.float64()),
        "l_shipdate": pa.array([r[0] and datetime.datetime(r[0], 5, 1) for r in rows], pa.timestamp("us")),
    }
    part = {"p_partkey": pa.array(range(len(parts)), pa.int64()), "p_brand": [p[0] for p in parts], "p_type": [p[1] for p in parts], "p_name": [p[0] for p in parts]}
    supplier = {"s_suppkey": pa.array(suppliers, pa.int64()), "s_nationkey": pa.array([s % 3 for s in suppliers], pa.int32())}
    return {"lineitem": pa.table(lines), "part": pa.table(part), "supplier": pa.table(supplier)}


@pytest.mark.parametrize("case", ["all equal", "equal but for one campaign", "equal response", "one campaign", "no date"])
def test_refit_of_a_predictor_without_spread(against_sql, case):
    """Every unit holds as many features: no slope, but no error either."""
    years = [1995] if case == "one campaign" else [1995, 1996, 1997, *([None] if case == "no date" else [])]
    rows = []
    for year in years:
        for s in range(3):
            brands = 2 + s if case == "equal response" or case == "equal but for one campaign" and year == 1997 else 2
            reads = 12 if case == "equal response" else 5 + s + (year or 0) % 7
            rows += [(year, s, "A", f"Brand#{b}", "STANDARD", reads / brands if case == "equal response" else reads) for b in range(brands)]
    got = against_sql("rm_12_refit_without_campaign", **line_tables(rows))
    assert len(got) == (0 if case == "one campaign" else 3)
