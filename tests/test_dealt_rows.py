"""Aggregates that keep nearly all rows are dealt into parts by the number of rows, not by a setting."""

import re

from tidemark.plans import registry, relations


def test_distinct_accounting_deals_by_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(relations, "DEALT", 100, raising=False)
    # each fifth order's lines come twice, and so do equal rows of order 7 and null keys
    rows = [(k, j, float(k % 3)) for k in range(400) for j in range(5)] + [(7, 0, 1.0)] * 50 + [(None, 1, 1.0)] * 2 + [(None, 1, None)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    df = registry.queries()["a7_distinct_accounting"](spark, str(tmp_path))
    x = rows + [(k, j, q + k % 3) for k, j, q in rows if k is not None and k % 5 == 0]
    assert df.collect()[0].asDict() == {"n": len(x), "rows_distinct": len(set(x)), "keys_distinct": len({r[:2] for r in x})}
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    parts = [int(n) for n in re.findall(r"hashpartitioning\(l_orderkey#\d+L?, l_linenumber#\d+[^)]*?, (\d+)\)", plan)]
    assert parts and min(parts) >= len(rows) // 100
