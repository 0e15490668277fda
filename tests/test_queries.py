"""Every registered query of the engine against its DuckDB twin, or at least run."""

import glob
import os

import duckdb
import pytest

from mailgauge.plans import catalog, oracles

QUERIES, ORACLES = catalog.queries(), oracles.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def cell(v):
    if v is None or v != v:
        return "null"
    return f"{float(v):.7g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in values)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf, con, name):
    got, want = QUERIES[name](spark, sf), con.execute(ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    assert rows(got.columns, got.collect()) == rows(names, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_no_oracle_without_query():
    assert set(ORACLES) <= set(QUERIES)


def test_pushdown_and_pruning(spark, sf):
    from mailgauge.session import load

    plan = QUERIES["main_model"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "text:string" not in plan  # only the columns of the experiment are read
    plan = load(spark, sf, "orders").where("o_orderkey = 5").select("o_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderkey,5)" in plan
