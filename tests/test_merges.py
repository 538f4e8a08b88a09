"""Merges by partition write what changes and nothing else."""

import os
import shutil

import pytest

from tidemark.sources import merges, sinks

SCHEMA = "day string, k long, v double"


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet") and "/data/" in d}


def rows(spark, *them):
    return spark.createDataFrame(list(them), SCHEMA)


def table(spark, path, parts=None):
    return sorted(map(tuple, merges.read_table(spark, path, rows(spark, ("a", 1, None)).schema, "day", parts).collect()), key=str)


@pytest.fixture
def path(spark, tmp_path):
    path = str(tmp_path / "table")
    start = [(d, k, k / 3) for d in ("mon", "tue", "wed") for k in range(5)]
    assert merges.merge_partitions(rows(spark, *start, ("mon", 0, 0.0)), path, ["day", "k"], "day") == {"added": 15, "written": 3}
    return path


def test_one_day_writes_one_day(spark, path):
    before = files(path)
    assert merges.merge_partitions(rows(spark, ("tue", 4, 9.0), ("tue", 9, None), ("wed", 1, 5.0)), path, ["day", "k"], "day") == {"added": 1, "written": 1}
    after = files(path)
    assert before.items() <= after.items()
    assert {f.split("day=")[1].split("/")[0] for f in after.keys() - before.keys()} == {"tue"}
    assert table(spark, path, ["tue"]) == sorted([*(("tue", k, k / 3) for k in range(5)), ("tue", 9, None)], key=str)
    assert len(table(spark, path)) == 16 and merges.differing(spark, path, rows(spark, ("a", 1, 1.0)).schema, "day") == []


def test_again_writes_nothing(spark, path):
    before = files(path)
    for new in (rows(spark, ("mon", 3, 7.0)), rows(spark, ("mon", 1, 1.0)).where("false")):
        assert merges.merge_partitions(new, path, ["day", "k"], "day") == {"added": 0, "written": 0}
    assert files(path) == before and sinks.latest_version(spark, f"{path}/manifest") == 1


def test_a_merge_that_died_is_done_again(spark, path):
    new = rows(spark, ("thu", 1, 1.0))
    merges.merge_partitions(new, path, ["day", "k"], "day")
    shard = merges.manifest(spark, path)["thu"].shard
    shutil.rmtree(f"{path}/manifest/version=2")  # it died before the pointer moved
    assert table(spark, path, ["thu"]) == [] and len(table(spark, path)) == 15
    os.remove(f"{path}/data/shard={shard}/_SUCCESS")  # and before the shard was whole
    assert merges.merge_partitions(new, path, ["day", "k"], "day") == {"added": 1, "written": 1}
    assert table(spark, path, ["thu"]) == [("thu", 1, 1.0)]


def test_a_shard_with_other_rows_is_refused(spark, path):
    new = rows(spark, ("thu", 1, 1.0))
    merges.merge_partitions(new, path, ["day", "k"], "day")
    shard = merges.manifest(spark, path)["thu"].shard
    shutil.rmtree(f"{path}/manifest/version=2")
    rows(spark, ("thu", 1, 2.0)).write.mode("overwrite").partitionBy("day").parquet(f"{path}/data/shard={shard}")
    with pytest.raises(ValueError, match="other rows"):
        merges.merge_partitions(new, path, ["day", "k"], "day")


def test_digests_see_values_and_repetitions_but_not_order(spark):
    one = [("a", 1, 1.0), ("a", 2, None), ("a", 2, None)]
    digest = lambda *r: merges.digests(rows(spark, *r), "day").first().digest
    assert digest(*one) == digest(*one[::-1]) != digest(*one[:2]) and digest(("a", 1, 1.0)) != digest(("a", 1, 2.0)) != digest(("a", 1, None))


def test_partitions_need_a_key_and_a_value(spark, tmp_path):
    with pytest.raises(ValueError, match="keys"):
        merges.merge_partitions(rows(spark, ("a", 1, 1.0)), str(tmp_path / "t"), ["k"], "day")
    with pytest.raises(ValueError, match="without"):
        merges.merge_partitions(rows(spark, (None, 1, 1.0)), str(tmp_path / "t"), ["day", "k"], "day")
