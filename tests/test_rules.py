import random

import pytest

from tidemark.functions import rules
from tidemark.operators import ledger

back = lambda w: {"op": "return", "window": w}
above = lambda arg, x: {"op": "greater", "arg": arg, "than": x}


def nested(n):
    node = above(back(3), 0)
    for _ in range(n):
        node = {"op": "not", "args": [node]}
    return node


@pytest.mark.parametrize(
    "strategy, why",
    [
        ({"long_if": above(back(3), 0)}, None),
        ({"long_if": above({"op": "zscore", "arg": {"op": "rolling_mean", "arg": back(2), "window": 4}, "window": 5}, 1.5)}, None),
        ({"long_if": {"op": "holds_for", "arg": above(back(3), 0), "bars": 3}, "max_holding_bars": 12}, None),
        ({}, "neither long_if nor short_if"),
        ({"long_if": above(back(289), 0)}, "window of return out of range"),
        ({"long_if": above({"op": "trend", "window": 1}, 0)}, "window of trend out of range"),
        ({"long_if": above(back(True), 0)}, "window of return out of range"),
        ({"long_if": {"op": "holds_for", "arg": above(back(3), 0), "bars": 1}}, "bars of holds_for out of range"),
        ({"long_if": above(back(3), 2e6)}, "no threshold"),
        ({"long_if": {"op": "clock_is", "period": 15, "phase": 3}}, "no such clock phase"),
        ({"long_if": {"op": "clock_is", "period": 15, "phase": 5}}, "no feature"),
        ({"long_if": nested(4)}, "deeper than 5"),
        ({"long_if": nested(3)}, None),
        ({"long_if": back(3)}, "operation 'return' not allowed here"),
        ({"long_if": {"op": "xor", "args": []}}, "operation 'xor' not allowed here"),
        ({"long_if": above(back(3), 0), "max_holding_bars": 49}, "max_holding_bars out of range"),
        ({"long_if": above(back(3), 0), "note": 1}, "unknown keys"),
        ({"long_if": {"op": "greater", "arg": back(3), "than": 0, "more": 1}}, "greater takes ['arg', 'op', 'than']"),
        ({"long_if": {"op": "or", "args": [above(back(k), 0) for k in range(1, 6)]}}, "5 features"),
        ({"long_if": {"op": "or", "args": [above(back(k), 0) for k in range(1, 5)]}}, "8 parameters"),
    ],
)
def test_limits(strategy, why):
    assert rules.strategy_problem(strategy) == why


def test_reference_rules_are_allowed_and_hashes_ignore_order():
    assert len(rules.reference_rules()) == 10 and not any(map(rules.strategy_problem, rules.reference_rules().values()))
    a, b = above(back(3), 0), above(back(5), 1)
    assert rules.rule_hash({"op": "and", "args": [a, b]}) == rules.rule_hash({"op": "and", "args": [b, a]}) != rules.rule_hash({"op": "or", "args": [a, b]})
    assert rules.rule_hash({"op": "holds_for", "arg": {"op": "and", "args": [a, b]}, "bars": 2}) == rules.rule_hash({"op": "holds_for", "arg": {"op": "and", "args": [b, a]}, "bars": 2})


def test_plans_become_strategies(spark):
    """As before plans were rows: the short side is the entry turned around, thresholds go to their menus."""
    plans = spark.createDataFrame(
        [
            ("both", "both", ("return", 12, "greater", 0.0018), None, (60, 0), 3, 12),
            ("only", "short", ("volatility", 24, "less", -0.004), None, None, None, None),
            ("with", "long", ("volume_z", 24, "greater", -0.8), [("range", 48, "less", -0.004), ("volume_z", 12, "less", -0.74)], None, None, None),
        ],
        rules.PLANS,
    )
    got = rules.strategies_of(rules.plan_conditions(plans))
    clock = {"op": "clock_is", "period": 60, "phase": 0}
    lasting = lambda node: {"op": "holds_for", "arg": node, "bars": 3}
    assert got["both"] == {"long_if": {"op": "and", "args": [clock, lasting(above(back(12), 0.002))]}, "short_if": {"op": "and", "args": [clock, lasting({"op": "less", "arg": back(12), "than": -0.002})]}, "max_holding_bars": 12}
    assert got["only"] == {"short_if": {"op": "greater", "arg": {"op": "volatility", "window": 24}, "than": -0.005}}
    assert [c["than"] for c in got["with"]["long_if"]["args"]] == [0.005, -0.5, -1.0]


def test_compiling_rejects_what_is_not_allowed(spark):
    bars = spark.createDataFrame([("s", 0, 1.0, 1.0, 1.0, 1.0, 1)], "symbol string, t long, open double, high double, low double, close double, volume long")
    with pytest.raises(ValueError, match="window of return"):
        rules.compile_rules(bars, {"x": {"long_if": above(back(0), 0)}}, ["symbol"])


def fold(targets, most):
    out, now, held = [], 0, 0
    for target in [0, *targets[:-1]]:
        if now and held >= most:
            now, held = 0, 0
        elif target != now:
            now, held = target, 1 if target else 0
        elif now:
            held += 1
        out.append(now)
    return out


def test_forced_exits_match_the_fold(spark):
    rng = random.Random(11)
    rows, want = [], {}
    for k in range(60):
        targets = []
        while len(targets) < 60:
            targets += [rng.choice([-1, 0, 1])] * rng.choice([1, 1, 2, 3, 4, 5, 8, 12])
        rows += [(k, t * 7, v) for t, v in enumerate(targets)]
        want[k] = targets
    df = spark.createDataFrame(rows, "s int, t long, target int")
    for most in (1, 2, 3):
        got: dict[int, list] = {}
        for r in ledger.held_for_at_most(df, ["s"], most).orderBy("s", "t").collect():
            got.setdefault(r.s, []).append(r.position)
        assert got == {k: fold(v, most) for k, v in want.items()}


def test_cooldown_matches_the_fold(spark):
    rng = random.Random(12)
    rows = sorted({(k, rng.randrange(2000)) for k in range(20) for _ in range(rng.randrange(1, 60))})
    df = spark.createDataFrame(rows, "s int, t long")
    want = []
    for k in range(20):
        last = None
        for s, t in rows:
            if s == k and (last is None or t - last >= 50):
                want.append((s, t))
                last = t
    assert sorted(map(tuple, ledger.cooled(df, ["s"], 50).collect())) == want
