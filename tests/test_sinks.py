import pytest
from pyspark.sql import functions as F

from tidemark.operators import joins
from tidemark.plans import guards
from tidemark.sources import landed, sinks


def test_shards_are_written_once(spark, tmp_path):
    df = spark.createDataFrame([(k, k % 3, f"v{k}") for k in range(30)], "k long, part int, v string")
    path = str(tmp_path / "shard")
    assert sinks.publish_shard(df, path, ["part"]) is True
    assert sinks.publish_shard(df.repartition(5), path, ["part"]) is False
    with pytest.raises(ValueError, match="other rows"):
        sinks.publish_shard(df.union(df.limit(1)), path, ["part"])
    assert spark.read.parquet(path).count() == 30


def test_merges_add_what_is_missing(spark, tmp_path):
    path = str(tmp_path / "table")
    rows = lambda ks, v: spark.createDataFrame([(k, v) for k in ks], "k long, v string")
    assert sinks.merge_into(rows(range(5), "a"), path, ["k"]) == 5
    assert sinks.merge_into(rows(range(3, 9), "b"), path, ["k"]) == 4
    assert sinks.merge_into(rows(range(3, 9), "c"), path, ["k"]) == 0
    last = spark.read.parquet(f"{path}/version={sinks.latest_version(spark, path)}")
    assert sorted(map(tuple, last.collect())) == [(k, "a" if k < 5 else "b") for k in range(9)]


def test_ledgers_refuse_a_second_record_and_raw_appends(spark, tmp_path):
    row = spark.createDataFrame([("x", 1.5)], "name string, value double")
    sinks.record_run(row, str(tmp_path / "runs"), "R1")
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.record_run(row, str(tmp_path / "runs"), "R1")
    for _ in range(2):
        sinks.append_raw(row, str(tmp_path / "raw"))
    assert spark.read.json(str(tmp_path / "raw")).count() == 2
    sinks.rebuild(row, str(tmp_path / "built"), ["name"])
    sinks.rebuild(row.withColumn("name", F.lit("y")), str(tmp_path / "built"), ["name"])
    assert [r.name for r in spark.read.parquet(str(tmp_path / "built")).collect()] == ["y"]


def test_series_parts_have_to_agree(spark):
    part = lambda ks, v=0: spark.createDataFrame([(k, k + v) for k in ks], "day long, n long")
    assert sinks.merged_series([part(range(5)), part(range(3, 8))], "day").count() == 8
    with pytest.raises(ValueError):
        sinks.merged_series([part(range(5)), part(range(3, 8), 1)], "day")
    with pytest.raises(ValueError):
        sinks.merged_series([part(range(5)), part(range(6, 8))], "day")
    assert sinks.same_rows(part([1, 2, 2]), part([2, 1, 2])) and not sinks.same_rows(part([1, 2, 2]), part([1, 1, 2]))


def test_next_row_however_far_and_chunks(spark):
    left = spark.createDataFrame([(k % 2, 10 * k) for k in range(40)], "s int, t long")
    right = spark.createDataFrame([(0, 100, "a"), (0, 100 + 250, "b"), (1, 15, "c")], "s int, t long, v string")
    want = sorted(((r.s, r.t, min((x.t for x in right.collect() if x.s == r.s and x.t > r.t), default=None)) for r in left.collect()), key=str)
    for chunk in (7, 60, 10_000):
        got = sorted(((r.s, r.t, r.match_t) for r in joins.next_any(left, right, ["s"], ["v"], chunk=chunk).collect()), key=str)
        assert got == want


def test_sealed_inputs(spark):
    df = spark.createDataFrame([(1,), (5,)], "t long")
    assert guards.sealed_input(df, 6) is df
    with pytest.raises(ValueError, match="seal"):
        guards.sealed_input(df, 5)
    with pytest.raises(ValueError, match="label"):
        guards.sealed_input(df.withColumn("fwd_x", F.lit(1)), 6)


def test_quoted_commas_stay_in_their_cell(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "a-2024-01.zip", "w") as z:
        z.writestr("a.csv", 'id,name\n1,"x, y"\n2,""\n3,a,b\n')
    rows = sorted((r.row_no, r.id, r.name, r.problem) for r in landed.zipped_csv(spark, str(tmp_path), ["id", "name"]).collect())
    assert rows == [(1, "1", "x, y", None), (2, "2", None, None), (3, None, None, "3 cells")]


def test_availability_is_declared_and_kept(spark):
    df = spark.createDataFrame([(1, 2.0)], "t long, close double")
    known = {"t": "bar start", "close": "bar end"}
    assert guards.availability(guards.available(df, known).where("close > 1")) == known
    with pytest.raises(ValueError, match="undeclared"):
        guards.available(df.withColumn("x", F.lit(1)), known)
