"""Every query that has SQL gives the same rows as DuckDB does, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from auditgrain.plans.registry import ORACLE, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def cell(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return repr(round(float(v), 6) + 0.0)
    return str(v)[:19] if hasattr(v, "strftime") else str(v)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(cell(v) for v in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, sf, duck, name):
    ours, theirs = QUERIES[name](spark, sf).toPandas(), duck.sql(ORACLE[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_company_checks_make_headers_once(spark, sf):
    """Branches of a check read the headers that were written once; they don't each make them again from all claims."""
    from auditgrain.plans.registry import QUERIES

    for name in ("q15_company", "q15_company_ranges", "q16_trend", "q13_summary_full"):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert "l_orderkey" not in plan, name
