"""Each text query with SQL gives the same rows in DuckDB."""

import os

import duckdb
import pytest

from tidemark.llm import queries

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in (r[k] for k in order)) for r in data), key=str)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    df = queries.queries()[name](spark, SF)
    rel = duck.sql(queries.oracle_sql()[name])
    assert rows(df.columns, map(tuple, df.collect())) == rows(rel.columns, rel.fetchall())


def test_all_text_queries_are_registered():
    import __spark_entry__ as entry

    assert queries.queries().keys() <= entry.queries().keys() and queries.oracle_sql().keys() <= entry.oracle_sql().keys()
