"""Refinement gives what sorting gives, whatever the distribution, and no task sees a group's values."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators.quantiles import at_ranks, quantiles
from tidemark.operators.store import stored

WANTED = {"low": ("cont", 0.1), "mid": ("cont", 0.5), "high": ("disc", 0.99), "first": ("disc", 0.0), "last": ("cont", 1.0)}


def exact(values, kind, p):
    s = sorted(values)
    if kind == "disc":
        return s[max(1, math.ceil(len(s) * p)) - 1]
    at = (len(s) - 1) * p
    return s[int(at)] + (s[math.ceil(at)] - s[int(at)]) * (at - int(at))


def groups(seed):
    rng = random.Random(seed)
    return {
        "skewed": [math.exp(rng.gauss(0, 8)) for _ in range(3000)],
        "ties": [float(rng.choice([1, 1, 1, 2, 7])) for _ in range(2000)],
        "one": [5.0],
        "flat": [3.25] * 700,
        "signs": [rng.uniform(-1e-9, 1e-9) for _ in range(900)] + [-1e300, 1e300],
        None: [float(k) for k in range(101)],
    }


@pytest.mark.parametrize("few, buckets", [(1, 256), (4096, 1024)])
def test_refinement_matches_sorting(spark, few, buckets):
    g = groups(few)
    rows = [(k, x) for k, xs in g.items() for x in xs] + [("ties", None), ("ties", float("nan")), ("none", None)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(7)
    for direct in (0, 10**9):
        got = {r.k: r for r in quantiles(df, ["k"], "x", WANTED, direct, buckets, few).collect()}
        assert got.keys() == g.keys() | {"none"} and got["none"].n == 0 and got["none"].mid is None
        for k, xs in g.items():
            assert got[k].n == len(xs)
            for name, (kind, p) in WANTED.items():
                assert got[k][name] == pytest.approx(exact(xs, kind, p), rel=1e-12), (k, name, direct)


def test_no_groups_and_no_rows(spark):
    df = spark.range(1000).select((F.col("id") * F.col("id")).alias("x"))
    assert quantiles(df, [], "x", {"m": ("cont", 0.5)}, direct=0, few=10).collect()[0].m == (499**2 + 500**2) / 2
    assert quantiles(df.where("x < 0"), [], "x", {"m": ("cont", 0.5)}, direct=0).collect() == []


def test_last_buckets_stay_small(spark):
    """On log-normal values equal-width buckets hold nearly all rows at first; refinement goes on inside."""
    df = spark.range(20_000).select(F.struct(F.lit(0).alias("all")).alias("g"), F.exp(F.randn(3) * 6).alias("v"))
    rows = stored(df)
    targets = spark.createDataFrame([((0,), 10_000)], "g struct<all:int>, rank long")
    want = rows.orderBy("v").collect()[9_999].v
    assert at_ranks(rows, targets, buckets=512, few=20).first().value == want
