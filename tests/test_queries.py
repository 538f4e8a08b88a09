"""Each registered query with SQL gives the same rows in DuckDB."""

import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from tidemark.plans import registry

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    out = [tuple(None if r[k] is None or r[k] != r[k] else round(float(r[k]), 9) + 0.0 if isinstance(r[k], (int, float)) and not isinstance(r[k], bool) else str(r[k]) for k in order) for r in data]
    return [columns[k] for k in order], sorted(out, key=str)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    rel = duck.sql(registry.oracle_sql()[name])
    assert rows(df.columns, df.collect()) == rows(rel.columns, rel.fetchall())


def test_entry_runs(spark):
    assert entry.entry(spark).first().n >= 0


def test_session_queries_cover_all_events(spark):
    q, events = entry.queries(), spark.read.parquet(f"{SF}/events.parquet")
    for name in ("m1_continuity_whole", "m9_session_quality_whole"):
        assert q[name](spark, SF).selectExpr("sum(frames) as n").first().n == events.count()
    last = events.selectExpr("max(unix_seconds(cast(ts as timestamp))) as t").first().t
    assert q["m12_decision_grid_whole"](spark, SF).selectExpr("max(q) as t").first().t > last


def test_all_plans_are_registered():
    assert registry.queries().keys() <= entry.queries().keys() and registry.oracle_sql().keys() <= entry.oracle_sql().keys()


def test_queries_are_listed_without_a_session():
    code = "import __spark_entry__ as e; assert len(e.queries()) > 200 and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
