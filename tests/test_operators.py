import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import rules
from tidemark.operators import bars, joins, ledger, statistics
from tidemark.plans import guards

SF = "/root/testdata/sf0.01"
H = bars.BAR


def series(spark, seed=1, n=300):
    rng = random.Random(seed)
    t, rows = 0, []
    for _ in range(n):
        t += H * rng.choice([1, 1, 1, 2, 5])
        o, c = rng.uniform(1, 9), rng.uniform(1, 9)
        rows.append(("x", t, o, max(o, c) + 1, min(o, c) - 0.5, c, rng.randint(1, 9), rng.choice([-1, 0, 1])))
    return spark.createDataFrame(rows, "symbol string, t long, open double, high double, low double, close double, volume long, target int")


def test_chunk_width_changes_nothing(spark):
    df = series(spark)
    spec = {"a": (F.sum("volume"), -20 * H, -1), "b": (F.max("close"), H, 3 * H)}
    one, two = (sorted(map(tuple, bars.rolling(df, ["symbol"], spec, chunk=c).collect())) for c in (30 * H, 10_000 * H))
    assert one == two and len(one) == 300
    for f in (lambda c: bars.prefix(df, ["symbol"], {"s": ("sum", "volume"), "m": ("max", "close"), "n": ("count", "close")}, chunk=c), lambda c: bars.ordered(df, ["symbol"], {"p": ("lag", "t"), "q": ("lead", "close")}, chunk=c)):
        a, b = (sorted(map(tuple, f(c).select(sorted(f(c).columns)).collect())) for c in (7 * H, 10_000 * H))
        assert a == b


def test_the_future_does_not_change_the_past(spark):
    df = series(spark)
    spec = {"a": (F.avg("close"), -20 * H, 0), "z": (F.stddev_samp("close"), -50 * H, -1)}
    cut = 200 * H
    changed = df.withColumn("close", F.when(F.col("t") > cut, 1e6).otherwise(F.col("close")))
    past = lambda x: sorted(map(tuple, bars.rolling(x, ["symbol"], spec).where(F.col("t") <= cut).collect()))
    assert past(df) == past(changed)


def test_positions_equal_a_fold(spark):
    df = series(spark, 4)
    rows = df.orderBy("t").collect()
    want, now = [], 0
    for k, r in enumerate(rows):
        if k and r.t - rows[k - 1].t - H <= ledger.DELAY:
            now = rows[k - 1].target
        want.append(now)
    got = [r.position for r in ledger.positions(df, ["symbol"], H).orderBy("t").collect()]
    assert got == want
    state, want = 0, []
    for r in rows:
        state = 1 if r.close > 7 else 0 if r.close <= 3 else state
        want.append(state)
    assert [r.state for r in ledger.hysteresis(df, ["symbol"], "close", 7, 3).orderBy("t").collect()] == want


def test_longest_holding(spark):
    df = spark.createDataFrame([("x", k, 1) for k in range(9)], "symbol string, t long, target int")
    assert [r.position for r in ledger.held_for_at_most(df, ["symbol"], 3).orderBy("t").collect()] == [0, 1, 1, 1, 0, 1, 1, 1, 0]


def test_as_of_boundaries(spark):
    left = spark.createDataFrame([(1, 100), (2, 110), (3, 111), (4, 90)], "id long, t long")
    right = spark.createDataFrame([(100, 5.0)], "t long, v double")
    got = {r.id: r.v for r in joins.as_of(left, right, [], 10, ["v"]).collect()}
    assert got == {1: 5.0, 2: 5.0, 3: None, 4: None}
    assert {r.id: r.v for r in joins.as_of(left, right, [], 10, ["v"], strict=True).collect()} == {1: None, 2: 5.0, 3: None, 4: None}
    assert {r.id: r.v for r in joins.as_of(left, right, [], 10, ["v"], forward=True).collect()} == {1: 5.0, 2: None, 3: None, 4: 5.0}


def test_matched_controls_are_not_reused(spark):
    events = spark.createDataFrame([(1, 0, 100), (2, 0, 120)], "id long, h long, t long")
    pool = spark.createDataFrame([(10, 0, 90), (11, 0, 110), (12, 0, 400)], "id long, h long, t long")
    got = sorted(map(tuple, joins.matched_controls(events, pool, ["h"], 500, 50).select("event_id", "control_id").collect()))
    assert got == [(1, 10), (2, 12)]


def test_matched_controls_match_brute_force(spark):
    rng = random.Random(14)
    events = [(k, rng.randrange(3), rng.choice([0, 5000, 20_000]) + rng.randrange(900)) for k in range(60)]
    pool = [(1000 + k, rng.randrange(3), rng.choice([0, 5000, 20_000]) + rng.randrange(900)) for k in range(120)]
    want = []
    for h in range(3):
        taken: list[int] = []
        for e, g, t in sorted(events, key=lambda x: (x[2], x[0])):
            if g != h:
                continue
            near = sorted((abs(c - t), c, k) for k, q, c in pool if q == h and 0 < abs(c - t) <= 200)
            best = next(((c, k) for _, c, k in near if all(abs(c - x) >= 50 for x in taken)), None)
            if best:
                taken.append(best[0])
                want.append((e, best[1]))
    one, two = (spark.createDataFrame(x, "id long, h int, t long") for x in (events, pool))
    got = sorted(map(tuple, joins.matched_controls(one, two, ["h"], 200, 50).select("event_id", "control_id").collect()))
    assert got == sorted(want)


def test_ridge_matches_numpy(spark):
    rng = np.random.default_rng(3)
    x, fold = rng.normal(size=(300, 3)), rng.integers(0, 4, 300)
    y = x @ [1.0, -2.0, 0.5] + rng.normal(size=300)
    df = spark.createDataFrame([(int(f), *map(float, r), float(v)) for f, r, v in zip(fold, x, y, strict=True)], "fold int, a double, b double, c double, y double")
    for r in statistics.ridge(statistics.gram(df, ["fold"], ["a", "b", "c"], "y"), "fold", ["a", "b", "c"], 2.0).collect():
        train, test = fold != r.fold, fold == r.fold
        one = np.column_stack([np.ones(300), x])
        w = np.linalg.solve(one[train].T @ one[train] + np.diag([0, 2.0, 2.0, 2.0]), one[train].T @ y[train])
        assert np.allclose(w, r.weights) and np.isclose(((y[test] - one[test] @ w) ** 2).sum(), r.sse) and np.isclose(((y[test] - y[train].mean()) ** 2).sum(), r.sst)


def test_guards(spark):
    df = spark.createDataFrame([(1, 2.0)], "t long, fwd_x double")
    with pytest.raises(ValueError):
        guards.observable(df)
    with pytest.raises(ValueError):
        guards.declared(df.drop("fwd_x"), [])
    with pytest.raises(PermissionError):
        guards.split(df, {"final": (0, None)}, "final", sealed=["final"])
    assert guards.split(df, {"final": (0, None)}, "final", ["final"], True).count() == 1
    kept, account = guards.below_seal(df, 1)
    assert kept.count() == 0 and tuple(account.first()) == (0, 1)


def test_rule_specs():
    a, b = {"op": "greater", "arg": {"op": "return", "window": 3}, "than": 0}, {"op": "clock_is", "period": 60, "phase": 0}
    assert rules.rule_hash({"op": "and", "args": [a, b]}) == rules.rule_hash({"op": "and", "args": [b, a]})
    assert rules.problem(a) is None and rules.problem({"op": "eval"}) and rules.problem({"op": "greater", "arg": {"op": "return", "window": 0}, "than": 0})


def test_statistics(spark):
    days = spark.range(60).select(F.col("id").alias("day"), (F.lit(3.0) + F.sin("id")).alias("num"), F.lit(1.0).alias("den"))
    reps = statistics.cluster_bootstrap(days, "day", 200, 1)
    lo, hi = reps.selectExpr("percentile(ratio, 0.01)", "percentile(ratio, 0.99)").first()
    mean = days.agg(F.avg("num")).first()[0]
    assert lo < mean < hi and hi - lo < 1
    again = statistics.cluster_bootstrap(days.repartition(7), "day", 200, 1)
    assert abs(again.agg(F.sum("ratio")).first()[0] - reps.agg(F.sum("ratio")).first()[0]) < 1e-9
    assert statistics.sign_flip_p(days, "day", "num", 200, 1).first().p < 0.05
    planted = spark.range(600).select((F.col("id") % 6).cast("int").alias("g"), F.col("id").alias("k"), (F.when(F.col("id") % 6 == 2, 5.0).otherwise(0.0) + F.sin("id")).alias("x"))
    null = statistics.permutation_null(planted, "g", "x", "k", 50, 1)
    assert statistics.empirical_p(null, "largest", 4.0).first().p < 0.05
    effects = {r.g: r.effect for r in statistics.group_effects(planted, "g", "x").collect()}
    assert max(effects, key=effects.get) == 2 and abs(effects[2] - 5) < 0.3


def test_ridge_finds_weights(spark):
    df = spark.range(500).select((F.col("id") % 5).cast("int").alias("fold"), F.sin("id").alias("a"), F.cos(F.col("id") * 3).alias("b")).withColumn("y", 2 * F.col("a") - F.col("b") + 1)
    for r in statistics.ridge(statistics.gram(df, ["fold"], ["a", "b"], "y"), "fold", ["a", "b"], 1e-6).collect():
        assert all(abs(x - w) < 1e-3 for x, w in zip(r.weights, [1, 2, -1], strict=True)) and r.sse < 1e-3 * r.sst
