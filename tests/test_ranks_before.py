"""Ranks among the rows before, and greedy choices, against plain loops."""

import random

import numpy as np
import pytest

from tidemark.operators import ledger, ranks


def test_counts_below_match_a_loop():
    rng = np.random.default_rng(5)
    for n, top in ((1, 1), (40, 3), (500, 1000)):
        v, own = rng.integers(0, top, n), rng.integers(0, top + 1, 60)
        a, b = np.sort(rng.integers(0, n + 1, (60, 2)), axis=1).T
        assert list(ranks.count_below(v, a, b, own)) == [int((v[x:y] < w).sum()) for x, y, w in zip(a, b, own, strict=True)]
    none = np.zeros(0, np.int64)
    assert list(ranks.count_below(none, np.zeros(2, int), np.zeros(2, int), np.zeros(2, int))) == [0, 0]


def test_ranks_before_match_pairs_at_any_chunk(spark):
    rng = random.Random(6)
    rows = [(s, rng.randrange(-300, 900), rng.choice([None, float("nan"), 1.0, 2.0, rng.random()]), k) for s in ("a", None) for k in range(150)]
    df = spark.createDataFrame(rows, "s string, t long, v double, id long")
    ok = lambda v: v is not None and v == v
    want = []
    for s, t, v, k in rows:
        w = [x for q, u, x, _ in rows if q == s and t - 100 <= u < t and ok(x)]
        want.append((str(s), k, len(w), sum(x < v for x in w) if ok(v) else None))
    for chunk in (30, 400, 100_000):
        got = ranks.below_before(df, ["s"], "v", 100, chunk=chunk)
        assert got.columns == [*df.columns, "seen", "below"]
        assert sorted((str(r.s), r.id, r.seen, r.below) for r in got.collect()) == sorted(want)
    assert ranks.below_before(df.where("false"), ["s"], "v", 100).collect() == []


def greedy(times, wait):
    out = []
    for t in sorted(times):
        if not out or t - out[-1] >= wait:
            out.append(t)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_cooldown_matches_a_fold_on_dense_and_sparse_series(spark, seed):
    rng = random.Random(seed)
    dense = [("dense", t) for t in range(-500, 2500) if rng.random() < 0.7]  # no pause of the wait anywhere
    sparse = [("sparse", rng.randrange(20_000)) for _ in range(120)] + [(None, rng.randrange(900)) for _ in range(60)]
    rows = [(s, t, k) for k, (s, t) in enumerate(dense + sparse + dense[:40])]
    df = spark.createDataFrame([*rows, ("dense", None, 9)], "s string, t long, id long")
    first = {}
    for s, t, k in rows:
        first[s, t] = min(k, first.get((s, t), k))
    want = sorted((str(s), t, first[s, t]) for s in ("dense", "sparse", None) for t in greedy({u for q, u, _ in rows if q == s}, 37))
    for chunk in (37, 100, None):
        assert sorted((str(r.s), r.t, r.id) for r in ledger.cooled(df, ["s"], 37, chunk=chunk).collect()) == want


def test_cooldown_of_nothing(spark):
    df = spark.createDataFrame([], "s string, t long")
    assert ledger.cooled(df, ["s"], 5).collect() == []
    with pytest.raises(ValueError):
        ledger.cooled(df, ["s"], 0)
