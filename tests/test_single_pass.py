"""Queries that read and parse their rows once: what their plans must not hold."""

import pytest
from pyspark.sql import functions as F

from tidemark.plans import registry


@pytest.fixture
def folder(spark, tmp_path):
    x = spark.range(2000).selectExpr("id as event_id", "timestamp_seconds(1700000000 + id * 60) as ts", "id % 7 as user_id", "array('view','click','purchase','signup','error')[id % 5] as event_type", "cast(id % 50 as double) as value", "concat('{\"k\": ', id % 5, '}') as props")
    x.write.parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path)


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_payloads_are_read_before_they_are_exploded(spark, folder):
    plan = optimized(registry.queries()["m2_payload_items"](spark, folder))
    above = plan[: plan.index("Generate")]
    assert "from_json" not in above and "jsontostructs" not in above.lower()


def test_books_are_replayed_once(spark, folder):
    plan = optimized(registry.queries()["m14_net_depletion"](spark, folder))
    assert "FlatMapCoGroups" not in plan


def test_book_payloads_are_parsed_once(spark, folder):
    plan = optimized(registry.queries()["m4_book_messages"](spark, folder))
    assert plan.count("Relation [") == 1 and plan.count("from_json") + plan.count("jsontostructs") == 1


def test_session_files_are_read_once(spark, folder):
    plan = optimized(registry.queries()["s16_session_tables"](spark, folder))
    assert "Union" not in plan and plan.count("Relation [") == 1
