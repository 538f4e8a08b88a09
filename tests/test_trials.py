"""Fits by group, thinned signals, random entries and stationary bootstraps, against plain loops."""

import hashlib
import math
import random
import statistics as plain

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import ledger, trials


def drawn(seed, *parts):
    return int(hashlib.md5("|".join(map(str, (seed, *parts))).encode()).hexdigest()[:8], 16) / 2**32


def test_logistic_fits_match_newton(spark):
    rng = np.random.default_rng(8)
    x, g = rng.normal(size=(400, 2)) * [1, 50] + [3, -7], rng.integers(0, 3, 400)
    y = (x[:, 0] - 3 + rng.normal(size=400) > 0).astype(int)
    rows = [(int(k), *map(float, r), int(v)) for k, r, v in zip(g, x, y, strict=True)] + [(0, None, 1.0, 1), (1, 1.0, 1.0, None)] + [(9, 2.0, 2.0, k) for k in (0, 1)]
    df = spark.createDataFrame(rows, "g int, a double, b double, y int")
    fits = {r.g: r for r in trials.logistic_fits(df, ["g"], ["a", "b"], "y", 0.01).collect()}
    assert fits.keys() == {0, 1, 2, 9}
    for k in range(3):
        own = x[g == k]
        z = np.column_stack([np.ones(len(own)), (own - own.mean(0)) / own.std(0)])
        w, ridge = np.zeros(3), np.diag([0, 0.01, 0.01])
        for _ in range(30):
            p = 1 / (1 + np.exp(-z @ w))
            w = w - np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z / len(z) + ridge, z.T @ (p - y[g == k]) / len(z) + ridge @ w)
        assert np.allclose(w, fits[k].weights, atol=1e-7) and fits[k].n == len(own)
    assert fits[9].deviation == [1.0, 1.0] and np.allclose(fits[9].weights, 0, atol=1e-6)
    scored = df.join(spark.createDataFrame(fits.values()), "g").withColumn("p", trials.chance(["a", "b"]))
    assert scored.where("a is null").first().p is None and scored.where("a is not null and not p between 0 and 1").isEmpty()
    assert trials.logistic_fits(df.where("false"), ["g"], ["a", "b"], "y", 0.01).collect() == []


def test_whole_separation_stays_finite(spark):
    df = spark.createDataFrame([(1, float(k), int(k > 4)) for k in range(10)], "g int, a double, y int")
    w = trials.logistic_fits(df, ["g"], ["a"], "y", 1e-3).first().weights
    assert all(map(math.isfinite, w)) and w[1] > 1


def test_controls_keep_whole_runs_of_the_signal(spark):
    rng = random.Random(2)
    rows = [(f, s, t, rng.choice([0, 1, 1, 1, -1, None]), 0) for f in (1, 2, 3) for s in "ab" for t in range(120)]
    rows = [(f, s, t, v, v if f == 2 or (f == 1 and rng.random() < 0.5) else 0) for f, s, t, v, _ in rows]
    df = spark.createDataFrame(rows, "f int, s string, t long, side int, kept int")
    want = {}
    for f in (1, 2, 3):
        signals, survive = (sum(bool(r[k]) for r in rows if r[0] == f) for k in (3, 4))
        for s in "ab":
            run, last = None, None
            for _, _, t, v, _ in sorted((r for r in rows if r[:2] == (f, s)), key=lambda r: r[2]):
                v = v or 0
                run, last = (run, last) if v == last else (t, v)
                want[f, s, t] = v if drawn(5, f, s, run) < survive / signals else 0
    for chunk in (7, 100_000):
        got = trials.exposure_matched(df, ["f", "s"], ["f"], "side", "kept", 5, chunk=chunk)
        assert {(r.f, r.s, r.t): r.control for r in got.collect()} == want
    assert all(v == 0 for (f, _, _), v in want.items() if f == 3) and any(want.values())


def test_stationary_bootstrap_matches_a_loop(spark):
    rng = random.Random(3)
    values = [rng.gauss(0, 1) for _ in range(40)]
    df = spark.createDataFrame([(7 * k, v) for k, v in enumerate(values)] + [(3, None)], "t long, v double")
    got = {r.rep: r.mean for r in trials.stationary_bootstrap(df, "t", "v", 15, 4, 9, chunk=50).collect()}
    for rep in range(1, 16):
        out = []
        for i in range(1, 41):
            if i == 1 or drawn(9, rep, i) < 0.25:
                at = math.floor(drawn(10, rep, i) * 40)
            out.append(values[at % 40])
            at += 1
        assert math.isclose(got[rep], plain.fmean(out), abs_tol=1e-12)
    assert got.keys() == set(range(1, 16))
    assert trials.stationary_bootstrap(df.where("v is null"), "t", "v", 3, 4, 9).collect() == []


def test_random_entries_keep_counts_by_kind(spark):
    trades = spark.createDataFrame([(k, "long" if k % 3 else "short") for k in range(30)] + [(99, "none")], "id long, kind string")
    slots = spark.createDataFrame([(k, t, 100.0 if k == "long" else 1.0) for k in ("long", "short") for t in range(11)] + [("long", 50, None)], "kind string, t long, outcome double")
    got = trials.random_entries(trades, slots, "kind", 6, 1, chunk=4).collect()
    assert len(got) == 6 and all(r.n == 30 and math.isclose(r.mean, (20 * 100 + 10) / 30) for r in got)
    own = spark.createDataFrame([("k", t, float(t)) for t in range(9)], "kind string, t long, outcome double")
    means = [r.mean for r in trials.random_entries(own.selectExpr("t as id", "kind"), own, "kind", 50, 1).collect()]
    assert len(set(means)) > 20 and abs(plain.fmean(means) - 4) < 0.5


def test_least_detectable(spark):
    df = spark.createDataFrame([(11, 2.0), (31, 1.0), (2, 1.0)], "n long, sd double")
    got = [r[0] for r in df.orderBy("n").select(trials.least_detectable(F.col("n"), F.col("sd"))).collect()]
    assert got[0] is None and math.isclose(got[1], 2.228139 * 2 / math.sqrt(11), rel_tol=2e-4) and math.isclose(got[2], 2.042272 / math.sqrt(31), rel_tol=1e-4)


def test_two_stages_draw_for_candidates_only_and_go_on(spark):
    rng = random.Random(4)
    observed = spark.createDataFrame([("strong", 0.99), ("middle", 0.9), ("weak", 0.2), ("none", None)], "cell string, v double")
    asked = []
    table = {(c, k): rng.random() * 0.95 for c in ("strong", "middle", "weak") for k in range(200)}

    def draws(n):
        def of(cells):
            names = sorted(r.cell for r in cells.collect())
            asked.append((n, names))
            return spark.createDataFrame([(c, table[c, k]) for c in names for k in range(n)] + [("strong", None)], "cell string, v double")
        return of

    got = {r.cell: r for r in trials.two_stages(observed, draws(20), draws(200), ["cell"], "v", 2).collect()}
    exceed = lambda c, n, v: sum(table[c, k] >= v for k in range(n))
    names = [c for c, v in (("middle", 0.9), ("strong", 0.99)) if exceed(c, 20, v) <= 2]
    assert asked == [(20, ["middle", "strong", "weak"]), (200, names)] and "strong" in names and got.keys() == {"strong", "middle", "weak"}
    assert got["strong"].p == 1 / 201 and got["weak"].p == (1 + exceed("weak", 20, 0.2)) / 21 and got["weak"].k_2 is None and not got["weak"].candidate
    done = trials.two_stages(observed.where("cell = 'weak'"), draws(20), draws(200), ["cell"], "v", 2)
    asked.clear()
    again = trials.two_stages(observed, draws(20), draws(200), ["cell"], "v", 2, done)
    assert asked[0] == (20, ["middle", "strong"]) and {tuple(r) for r in again.collect()} == {tuple(r) for r in got.values()}


def test_barriers_match_a_loop_under_each_policy(spark):
    rng = random.Random(5)
    path, price = [], 100.0
    for k in range(300):
        o = price * rng.choice([1, 1, 1.15, 0.85])
        c = o * rng.uniform(0.9, 1.1)
        path.append((k, o, max(o, c) * rng.uniform(1, 1.15), min(o, c) / rng.uniform(1, 1.15)))
        price = c
    path = [r for r in path if r[0] % 97]
    df = spark.createDataFrame([("x", *r) for r in path], "s string, t long, open double, high double, low double")
    at = {r[0]: r for r in path}
    for policy in ("stop", "take", "exclude"):
        want = {}
        for t, entry, _, _ in path:
            if any(t + k not in at for k in range(6)):
                continue
            up, down, hit = entry * 1.1, entry * 0.9, ("timeout", t + 5, at[t + 5][1], False)
            for k in range(5):
                _, o, high, low = at[t + k]
                both = high >= up and low <= down
                if o >= up:
                    hit = ("stop", t + k, o, False)
                elif o <= down:
                    hit = ("take", t + k, down, False)
                elif both:
                    hit = {"stop": ("stop", t + k, up, True), "take": ("take", t + k, down, True), "exclude": ("excluded", t + k, None, True)}[policy]
                elif high >= up:
                    hit = ("stop", t + k, up, False)
                elif low <= down:
                    hit = ("take", t + k, down, False)
                else:
                    continue
                break
            want[t] = hit
        got = {r.id: (r.outcome, r.exit_t, r.exit_price, r.ambiguous) for r in ledger.first_touch(df.withColumn("id", F.col("t")), df, ["s"], 5, 1, 0.1, 0.1, ambiguous=policy).collect()}
        assert got.keys() == want.keys() and any(w[3] for w in want.values())
        for t, w in want.items():
            assert got[t][:2] == w[:2] and got[t][3] == w[3] and (got[t][2] is w[2] is None or math.isclose(got[t][2], w[2], rel_tol=1e-12))
    with pytest.raises(ValueError):
        ledger.first_touch(df.withColumn("id", F.col("t")), df, ["s"], 5, 1, 0.1, 0.1, ambiguous="both")
