"""Rules as data: JSON-like trees of whitelisted operations that compile to columns.

A numeric node needs windows, a boolean node compares or combines. Windows over bars make one pass, shared by all rules;
windows over other nodes (rolling_mean, rolling_std, zscore, holds_for) make one more for each level of nesting.
compile_rules() returns one target column per rule: -1, 0 or 1."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.bars import BAR, rolling
from .scalars import nearest_choice

FEATURES = {"return", "trend", "volatility", "range", "volume_z", "ma_slope"}
TRANSFORMS = {"rolling_mean", "rolling_std", "zscore"}
NUMERIC = FEATURES | TRANSFORMS | {"column"}
BOOLEAN = {"greater", "less", "and", "or", "not", "clock_is", "holds_for"}
COMMUTATIVE = {"and", "or"}
CONDITIONS = ("long_if", "short_if", "flat_if", "abstain_unless")


@dataclass(frozen=True)
class Limits:
    """What a strategy may hold. The defaults."""

    depth: int = 5
    features: int = 4
    parameters: int = 6
    window: int = 288
    holding: int = 48
    threshold: float = 1e6
    periods: tuple[int, ...] = (15, 60)
    phase_step: int = 5


def canonical(node: dict) -> dict:
    """The node with the children of commutative operations in order of their hash."""
    out = dict(node)
    if "args" in node:
        args = [canonical(x) for x in node["args"]]
        out["args"] = sorted(args, key=rule_hash) if node["op"] in COMMUTATIVE else args
    if "arg" in node:
        out["arg"] = canonical(node["arg"])
    return out


def rule_hash(node: dict) -> str:
    return hashlib.sha256(json.dumps(canonical(node), sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def _children(node: dict) -> list[dict]:
    return [*node.get("args", []), *([node["arg"]] if "arg" in node else [])]


def _nodes(node: dict) -> Iterator[dict]:
    yield node
    for x in _children(node):
        yield from _nodes(x)


def _whole(x, lo: float, hi: float) -> bool:
    return isinstance(x, int) and not isinstance(x, bool) and lo <= x <= hi


def problem(node: dict, boolean: bool = True, depth: int = 1, limits: Limits = Limits()) -> str | None:
    """Why a node is not allowed, or None."""
    op = node.get("op") if isinstance(node, dict) else None
    if op not in (BOOLEAN if boolean else NUMERIC):
        return f"operation {op!r} not allowed here"
    if depth > limits.depth:
        return f"deeper than {limits.depth}"
    inside = {"column": {"name"}, "greater": {"arg", "than"}, "less": {"arg", "than"}, "and": {"args"}, "or": {"args"}, "not": {"args"}, "clock_is": {"period", "phase"}, "holds_for": {"arg", "bars"}}
    keys = {"op"} | inside.get(op, {"window", "arg"} if op in TRANSFORMS else {"window"})
    if set(node) != keys:
        return f"{op} takes {sorted(keys)}"
    if "window" in keys and not _whole(node["window"], 1 if op == "return" else 2, limits.window):
        return f"window of {op} out of range"
    if op == "holds_for" and not _whole(node["bars"], 2, limits.holding):
        return "bars of holds_for out of range"
    if op == "clock_is" and not (node["period"] in limits.periods and _whole(node["phase"], 0, node["period"] - 1) and node["phase"] % limits.phase_step == 0):
        return "no such clock phase"
    if "than" in keys and (isinstance(node["than"], bool) or not isinstance(node["than"], (int, float)) or not abs(node["than"]) <= limits.threshold):
        return "no threshold"
    if "args" in keys and (len(node["args"]) != 1 if op == "not" else len(node["args"]) < 2):
        return f"{op} of {len(node['args'])}"
    return next((p for x in _children(node) if (p := problem(x, op in ("and", "or", "not", "holds_for"), depth + 1, limits))), None)


def strategy_problem(strategy: dict, limits: Limits = Limits()) -> str | None:
    """Why a strategy is not allowed, or None: its conditions, and how much they hold in all."""
    if set(strategy) - {*CONDITIONS, "max_holding_bars"}:
        return "unknown keys"
    conditions = [strategy[k] for k in CONDITIONS if strategy.get(k) is not None]
    if strategy.get("long_if") is None and strategy.get("short_if") is None:
        return "neither long_if nor short_if"
    if (why := next((p for c in conditions if (p := problem(c, limits=limits))), None)) is not None:
        return why
    holding = strategy.get("max_holding_bars")
    if holding is not None and not _whole(holding, 1, limits.holding):
        return "max_holding_bars out of range"
    nodes = [x for c in conditions for x in _nodes(c)]
    features = {json.dumps(x, sort_keys=True) for x in nodes if x["op"] in FEATURES}
    parameters = sum(("window" in x) + ("than" in x) + ("bars" in x) + ("phase" in x) for x in nodes) + (holding is not None)
    if not features:
        return "no feature"
    if len(features) > limits.features:
        return f"{len(features)} features"
    return f"{parameters} parameters" if parameters > limits.parameters else None


def _windows(node: dict, out: dict[str, tuple[Column, int, int]]) -> None:
    """Windows over bars of a node and all below it."""
    n, op = node.get("window", 0), node["op"]
    whole = (-(n - 1) * BAR, 0)
    prior = (-n * BAR, -1)
    if op == "return":
        out[f"close_at_{n}"] = (F.max("close"), -n * BAR, -n * BAR)
    if op in ("trend", "ma_slope"):
        out[f"sma_{n}"], out[f"n_{n}"] = (F.avg("close"), *whole), (F.count("*"), *whole)
    if op == "ma_slope":
        out[f"sma_prev_{n}"], out[f"n_prev_{n}"] = (F.avg("close"), -n * BAR, -BAR), (F.count("*"), -n * BAR, -BAR)
    if op == "range":
        out[f"hi_{n}"], out[f"lo_{n}"], out[f"n_{n}"] = (F.max("high"), *whole), (F.min("low"), *whole), (F.count("*"), *whole)
    if op == "volume_z":
        out[f"vm_{n}"], out[f"vs_{n}"], out[f"np_{n}"] = (F.avg("volume"), *prior), (F.stddev_samp("volume"), *prior), (F.count("*"), *prior)
    if op == "volatility":
        out[f"rs_{n}"], out[f"rn_{n}"] = (F.stddev_samp("ret_1"), *whole), (F.count("ret_1"), *whole)
    for x in _children(node):
        _windows(x, out)


def _level(node: dict) -> int:
    """How many windows over other nodes lie on each other in a node."""
    below = max(map(_level, _children(node)), default=0)
    return below + (node["op"] in TRANSFORMS or node["op"] == "holds_for")


def _name(node: dict, part: str) -> str:
    return f"_{part}_{rule_hash(node)[:16]}"


def with_windows(bars: DataFrame, nodes: list[dict], keys: list[str]) -> tuple[DataFrame, list[str]]:
    """The bars with all columns that numeric() and boolean() need for the nodes, and the names of these."""
    first = rolling(bars, keys, {"_c1": (F.max("close"), -BAR, -BAR)}).withColumn("ret_1", F.when(F.col("_c1") != 0, F.col("close") / F.col("_c1") - 1)).drop("_c1")
    windows: dict[str, tuple[Column, int, int]] = {}
    for node in nodes:
        _windows(node, windows)
    out, added = rolling(first, keys, windows) if windows else first, ["ret_1", *windows]
    outer = {rule_hash(x): x for node in nodes for x in _nodes(node) if x["op"] in TRANSFORMS or x["op"] == "holds_for"}
    for level in range(1, max(map(_level, outer.values()), default=0) + 1):
        mine = [x for x in outer.values() if _level(x) == level]
        inner = {_name(x, "x"): boolean(x["arg"]).cast("int") if x["op"] == "holds_for" else numeric(x["arg"]) for x in mine}
        windows = {}
        for x in mine:
            reach = (-(x.get("window", x.get("bars")) - 1) * BAR, 0)
            value = _name(x, "x")
            windows[_name(x, "n")] = (F.count(value), *reach)
            if x["op"] == "holds_for":
                windows[_name(x, "s")] = (F.sum(value), *reach)
            if x["op"] in ("rolling_mean", "zscore"):
                windows[_name(x, "m")] = (F.avg(value), *reach)
            if x["op"] in ("rolling_std", "zscore"):
                windows[_name(x, "d")] = (F.stddev_samp(value), *reach)
        out = rolling(out.withColumns(inner), keys, windows)
        added += [*inner, *windows]
    return out, added


def numeric(node: dict) -> Column:
    """The node's value; null unless its window is whole."""
    n, op = node.get("window", 0), node["op"]
    c = lambda name: F.col(f"{name}_{n}")
    if op == "column":
        return F.col(node["name"])
    if op == "return":
        return F.when(F.col(f"close_at_{n}") != 0, F.col("close") / F.col(f"close_at_{n}") - 1)
    if op == "trend":
        return F.when((c("n") == n) & (c("sma") != 0), F.col("close") / c("sma") - 1)
    if op == "ma_slope":
        return F.when((c("n") == n) & (c("n_prev") == n) & (c("sma_prev") != 0), c("sma") / c("sma_prev") - 1)
    if op == "range":
        return F.when((c("n") == n) & (F.col("close") != 0), (c("hi") - c("lo")) / F.col("close"))
    if op == "volume_z":
        return F.when((c("np") == n) & (c("vs") > 0), (F.col("volume") - c("vm")) / c("vs"))
    if op == "volatility":
        return F.when(c("rn") == n, c("rs"))
    whole = F.col(_name(node, "n")) == n
    if op == "rolling_mean":
        return F.when(whole, F.col(_name(node, "m")))
    if op == "rolling_std":
        return F.when(whole, F.col(_name(node, "d")))
    return F.when(whole & (F.col(_name(node, "d")) > 0), (F.col(_name(node, "x")) - F.col(_name(node, "m"))) / F.col(_name(node, "d")))


def boolean(node: dict) -> Column:
    """The node's truth in three-valued logic."""
    op = node["op"]
    if op == "greater":
        return numeric(node["arg"]) > node["than"]
    if op == "less":
        return numeric(node["arg"]) < node["than"]
    if op == "clock_is":
        return F.floor(F.col("t") / 60) % node["period"] == node["phase"]
    if op == "holds_for":
        return F.when(F.col(_name(node, "n")) == node["bars"], F.col(_name(node, "s")) == node["bars"])
    parts = [boolean(x) for x in node["args"]]
    if op == "not":
        return ~parts[0]
    out = parts[0]
    for p in parts[1:]:
        out = out & p if op == "and" else out | p
    return out


def target(strategy: dict) -> Column:
    """1 for long, -1 for short, 0 for neither, both, flat or an abstention; a null condition is false."""
    on = lambda k, other: F.coalesce(boolean(strategy[k]), F.lit(False)) if strategy.get(k) else F.lit(other)
    up, down = on("long_if", False), on("short_if", False)
    side = F.when(up & ~down, 1).when(down & ~up, -1).otherwise(0)
    return F.when(on("flat_if", False) | ~on("abstain_unless", True), 0).otherwise(side)


def compile_rules(bars: DataFrame, strategies: dict[str, dict], keys: list[str], limits: Limits = Limits()) -> DataFrame:
    """The bars with one target column for each strategy; raises ValueError for one that is not allowed."""
    for name, s in strategies.items():
        if (why := strategy_problem(s, limits)) is not None:
            raise ValueError(f"{name}: {why}")
    out, added = with_windows(bars, [s[k] for s in strategies.values() for k in CONDITIONS if s.get(k)], keys)
    return out.withColumns({name: target(s) for name, s in strategies.items()}).drop(*added)


def momentum(window: int = 12) -> dict:
    """Both sides of the return over ``window`` bars."""
    now = {"op": "return", "window": window}
    return {"long_if": {"op": "greater", "arg": now, "than": 0}, "short_if": {"op": "less", "arg": now, "than": 0}}


def drawn_side(seed: int, *parts: Column) -> Column:
    """-1, 0 or 1 by the first byte of an MD5, so that each engine draws the same."""
    return (F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), *parts)), 1, 2), 16, 10).cast("int") % 3 - 1).cast("int")


def baseline_targets(bars: DataFrame, keys: list[str], seed: int = 7) -> DataFrame:
    """The bars with targets that any rule has to beat: flat, hold, momentum and random."""
    out = compile_rules(bars, {"momentum": momentum()}, keys)
    return out.withColumns({"flat": F.lit(0), "hold": F.lit(1), "random": drawn_side(seed, *(F.col(k) for k in keys), F.col("t"))})


#: Menus that thresholds are moved to, whether they keep their sign, and steps of windows and holding.
THRESHOLDS = {
    "return": ((0.0005, 0.001, 0.002, 0.005), True),
    "trend": ((0.0005, 0.001, 0.002, 0.005), True),
    "ma_slope": ((0.0001, 0.0002, 0.0005, 0.001), True),
    "volatility": ((0.0005, 0.001, 0.002, 0.005), False),
    "range": ((0.002, 0.005, 0.01, 0.02), False),
    "volume_z": ((0.5, 1.0, 2.0, 3.0), True),
}


#: A table of plans, a row each; clock and whatever else is null is not asked for.
PLANS = """plan string, side string, entry struct<feature:string,window:int,op:string,threshold:double>, filters array<struct<feature:string,window:int,op:string,threshold:double>>,
    clock struct<period:int,phase:int>, persistence_bars int, holding_bars int"""


def on_menu(feature: Column, value: Column, menus: dict = THRESHOLDS) -> Column:
    """The nearest threshold of the feature's menu (of equals the smaller), with the value's sign where the menu keeps it;
    null for a feature without a menu."""
    tries = [F.when(feature == name, nearest_choice(F.abs(value), menu) * (F.when(value < 0, -1.0).otherwise(1.0) if signed else F.lit(1.0))) for name, (menu, signed) in menus.items()]
    return F.coalesce(*tries)


def plan_conditions(plans: DataFrame, menus: dict = THRESHOLDS) -> DataFrame:
    """(plan, stance, place, op, feature, window, than, bars, holding_bars): each condition of each stance of PLANS rows as a row,
    thresholds on their menus. A stance is long_if or short_if. Filters come first, then the clock (period as window, phase
    as than), then the entry, which the short stance turns around and which may have to last for ``bars``."""
    stances = F.filter(F.array(F.struct(F.lit("long_if").alias("stance"), F.lit(1.0).alias("way")), F.struct(F.lit("short_if").alias("stance"), F.lit(-1.0).alias("way"))), lambda s: (F.col("side") == "both") | F.startswith(s["stance"], F.col("side")))
    x = plans.select("*", F.explode(stances).alias("s"))
    row = lambda op, feature, window, than, bars, turned: F.struct(op.alias("op"), feature.alias("feature"), window.alias("window"), than.cast("double").alias("than"), bars.alias("bars"), turned.alias("turned"))
    none, text = F.lit(None).cast("int"), F.lit(None).cast("string")
    filters = F.transform(F.coalesce("filters", F.filter(F.array("entry"), lambda _: F.lit(False))), lambda c: row(c["op"], c["feature"], c["window"], c["threshold"], none, F.lit(False)))
    clock = F.filter(F.array(F.when(F.col("clock").isNotNull(), row(F.lit("clock_is"), text, F.col("clock.period"), F.coalesce("clock.phase", F.lit(0)), none, F.lit(False)))), lambda c: c.isNotNull())
    entry = F.array(row(F.col("entry.op"), F.col("entry.feature"), F.col("entry.window"), F.col("entry.threshold"), F.col("persistence_bars"), F.col("s.way") < 0))
    x = x.select("plan", F.col("s.stance").alias("stance"), "holding_bars", F.posexplode(F.concat(filters, clock, entry)).alias("place", "c")).select("plan", "stance", "holding_bars", "place", "c.*")
    than = F.when(F.col("op") == "clock_is", F.col("than")).otherwise(on_menu(F.col("feature"), F.col("than"), menus))
    op = F.when(F.col("turned"), F.when(F.col("op") == "less", "greater").otherwise("less")).otherwise(F.col("op"))
    return x.select("plan", "stance", "place", op.alias("op"), "feature", "window", (than * F.when(F.col("turned"), -1.0).otherwise(1.0)).alias("than"), "bars", "holding_bars")


def strategies_of(conditions: DataFrame) -> dict[str, dict]:
    """Strategies for compile_rules() from plan_conditions() of a batch of plans, which the caller bounds as it bounds its rules."""
    trees: dict[str, dict] = {}
    for r in conditions.orderBy("plan", "stance", "place").collect():
        leaf = {"op": r.op, "period": r.window, "phase": int(r.than)} if r.op == "clock_is" else {"op": r.op, "arg": {"op": r.feature, "window": r.window}, "than": r.than}
        leaf = leaf if r.bars is None else {"op": "holds_for", "arg": leaf, "bars": r.bars}
        own = trees.setdefault(r.plan, {} if r.holding_bars is None else {"max_holding_bars": r.holding_bars})
        own.setdefault(r.stance, {"op": "and", "args": []})["args"].append(leaf)
    alone = lambda node: node["args"][0] if isinstance(node, dict) and len(node["args"]) == 1 else node
    return {plan: {k: alone(v) for k, v in own.items()} for plan, own in trees.items()}


def reference_rules() -> dict[str, dict]:
    """Ten rules to compare others with. Names, windows and thresholds."""
    back = lambda w: {"op": "return", "window": w}
    above = lambda arg, x: {"op": "greater", "arg": arg, "than": x}
    below = lambda arg, x: {"op": "less", "arg": arg, "than": x}
    lasting = lambda node: {"op": "holds_for", "arg": node, "bars": 3}
    return {
        "always_long": {"long_if": above(back(1), -1.0)},
        "always_short": {"short_if": below(back(1), 1.0)},
        "momentum_1h": momentum(12),
        "momentum_4h": momentum(48),
        "momentum_1d": momentum(288),
        "reversal_1h": {"long_if": below(back(12), 0.0), "short_if": above(back(12), 0.0)},
        "momentum_1h_persist3": {"long_if": lasting(above(back(12), 0.0)), "short_if": lasting(below(back(12), 0.0))},
        "momentum_1h_hold12": momentum(12) | {"max_holding_bars": 12},
        "lowvol_momentum_long": {"long_if": {"op": "and", "args": [above(back(12), 0.0), below({"op": "volatility", "window": 48}, 0.002)]}},
        "volume_shock_fade": {"short_if": above({"op": "volume_z", "window": 24}, 3.0), "max_holding_bars": 12},
    }


#: The vocabulary of hypothesis records.
VOCABULARY = {
    "event": ("momentum", "reversal", "volatility_shock", "volume_shock", "breakout", "clock_boundary"),
    "context": ("high_volatility", "low_volatility", "trend", "range", "high_volume", "low_volume"),
    "quality": ("persistence", "acceleration", "exhaustion", "divergence", "confirmation"),
    "direction": ("continuation", "reversal"),
    "action": ("long", "short", "flat", "abstain", "exit"),
}


def record_problems(single: tuple[str, ...] = ("event", "direction", "action"), several: tuple[str, ...] = ("context", "quality"), texts: tuple[str, ...] = ("hypothesis_id", "hypothesis", "expected_failure_mode")) -> Column:
    """What is wrong with a hypothesis record, as an array of <field>:<reason>; empty if nothing is."""
    words = lambda k: F.array(*map(F.lit, VOCABULARY[k]))
    found = [F.when(F.col(k).isNull(), f"{k}:missing").when(~F.col(k).isin(*VOCABULARY[k]), f"{k}:unknown") for k in single]
    found += [F.when(F.col(k).isNull() | (F.size(k) == 0), f"{k}:missing").when(F.size(F.array_except(k, words(k))) > 0, f"{k}:unknown") for k in several]
    found += [F.when(F.col(k).isNull() | (F.trim(F.col(k)) == ""), f"{k}:missing") for k in texts]
    return F.filter(F.array(*found), lambda x: x.isNotNull())
