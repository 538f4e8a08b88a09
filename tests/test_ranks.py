"""Ranks over buckets bounded by a sketch."""

import math
import random

from pyspark.sql import functions as F

from tidemark.operators import statistics as st


def test_ranks_match_sorting_and_skew_fills_no_bucket(spark):
    rng = random.Random(4)
    rows = [(g, k, math.exp(rng.gauss(0, 5)) if g == "skewed" else float(rng.choice([1, 1, 2, 9]))) for g in ("skewed", "ties") for k in range(3000)]
    df = spark.createDataFrame([*rows, ("ties", 5000, None)], "g string, k long, v double")
    got = st.value_ranks(df, ["g"], "v", "k", "r").collect()
    for g in ("skewed", "ties"):
        order = sorted((v, k) for h, k, v in rows if h == g)
        assert {r.k: r.r for r in got if r.g == g} == {k: i for i, (_, k) in enumerate(order, 1)}
    bounds = df.where("g = 'skewed'").agg(F.percentile_approx("v", [k / 256 for k in range(1, 256)], 10_000).alias("b")).first().b
    sizes = {}
    for g, _, v in rows:
        if g == "skewed":
            k = sum(b < v for b in bounds)
            sizes[k] = sizes.get(k, 0) + 1
    assert max(sizes.values()) < 3000 / 64


def test_the_most_influential_cluster_goes(spark):
    df = spark.createDataFrame([(1, 2.0), (2, -5.0), (3, 5.0), (4, None)], "k long, v double")
    assert {r.k for r in st.without_most_influential(df, "k", "v").collect()} == {1, 3, 4}
    assert st.without_most_influential(df.where("k > 9"), "k", "v").collect() == []
