"""Queries of rules, positions, trades, costs, barriers and carry."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules as fn
from ..functions.rules import Limits, baseline_targets, boolean, compile_rules, numeric, record_problems, reference_rules, with_windows
from ..operators import ledger
from ..operators.bars import BAR, ordered, rolling
from .common import events, market, r6, stored, with_bars
from .registry import query

KEYS = ["symbol"]
NODES = {
    "e1_return": {"op": "return", "window": 3},
    "e2_trend": {"op": "trend", "window": 6},
    "e3_volatility": {"op": "volatility", "window": 5},
    "e4_range": {"op": "range", "window": 4},
    "e5_volume_z": {"op": "volume_z", "window": 8},
    "e6_ma_slope": {"op": "ma_slope", "window": 6},
    "e7_rolling_mean": {"op": "rolling_mean", "arg": {"op": "return", "window": 2}, "window": 4},
    "e7_rolling_std": {"op": "rolling_std", "arg": {"op": "range", "window": 3}, "window": 5},
    "e7_zscore": {"op": "zscore", "arg": {"op": "rolling_mean", "arg": {"op": "column", "name": "close"}, "window": 3}, "window": 6},
}
_W = lambda lo, hi: f"(partition by symbol order by t range between {lo * BAR} preceding and {hi})"
_SQL = {
    "e1_return": f"select b.symbol, b.t, round(b.close / nullif(p.close, 0) - 1, 6) as x from b left join b p on p.symbol = b.symbol and p.t = b.t - {3 * BAR}",
    "e2_trend": f"select symbol, t, case when count(*) over w = 6 then round(close / nullif(avg(close) over w, 0) - 1, 6) end as x from b window w as {_W(5, 'current row')}",
    "e3_volatility": f"select symbol, t, case when count(r) over w = 5 then round(stddev_samp(r) over w, 6) end as x from (select b.symbol, b.t, b.close / nullif(p.close, 0) - 1 as r from b left join b p on p.symbol = b.symbol and p.t = b.t - {BAR}) window w as {_W(4, 'current row')}",
    "e4_range": f"select symbol, t, case when count(*) over w = 4 then round((max(high) over w - min(low) over w) / nullif(close, 0), 6) end as x from b window w as {_W(3, 'current row')}",
    "e5_volume_z": f"select symbol, t, case when count(*) over w = 8 and stddev_samp(volume) over w > 0 then round((volume - avg(volume) over w) / stddev_samp(volume) over w, 6) end as x from b window w as {_W(8, '1 preceding')}",
    "e6_ma_slope": f"select symbol, t, case when count(*) over w = 6 and count(*) over v = 6 then round(avg(close) over w / nullif(avg(close) over v, 0) - 1, 6) end as x from b window w as {_W(5, 'current row')}, v as {_W(6, f'{BAR} preceding')}",
    "e7_rolling_mean": f"select symbol, t, case when count(r) over w = 4 then round(avg(r) over w, 6) end as x from (select b.symbol, b.t, b.close / nullif(p.close, 0) - 1 as r from b left join b p on p.symbol = b.symbol and p.t = b.t - {2 * BAR}) window w as {_W(3, 'current row')}",
    "e7_rolling_std": f"select symbol, t, case when count(r) over w = 5 then round(stddev_samp(r) over w, 6) end as x from (select symbol, t, case when count(*) over v = 3 then (max(high) over v - min(low) over v) / nullif(close, 0) end as r from b window v as {_W(2, 'current row')}) window w as {_W(4, 'current row')}",
    "e7_zscore": f"select symbol, t, case when count(r) over w = 6 and stddev_samp(r) over w > 0 then round((r - avg(r) over w) / stddev_samp(r) over w, 5) end as x from (select symbol, t, case when count(*) over v = 3 then avg(close) over v end as r from b window v as {_W(2, 'current row')}) window w as {_W(5, 'current row')}",
}


def _node(name: str):
    def run(spark, d):
        df, _ = with_windows(market(spark, d), [NODES[name]], KEYS)
        return df.select("symbol", "t", F.round(numeric(NODES[name]), 5 if name == "e7_zscore" else 6).alias("x"))

    return run


for _name in NODES:
    query(_name, with_bars(_SQL[_name]))(_node(_name))

RULE = {
    "long_if": {"op": "and", "args": [{"op": "greater", "arg": {"op": "trend", "window": 4}, "than": 0.0}, {"op": "not", "args": [{"op": "clock_is", "period": 180, "phase": 0}]}]},
    "short_if": {"op": "less", "arg": {"op": "return", "window": 2}, "than": -0.2},
}
_TARGET = f"""x as (select b.*, p.close as c2, case when count(*) over w = 4 then b.close / nullif(avg(b.close) over w, 0) - 1 end as trend from b left join b p on p.symbol = b.symbol and p.t = b.t - {2 * BAR} window w as (partition by b.symbol order by b.t range between {3 * BAR} preceding and current row)),
 y as (select *, coalesce(trend > 0 and not ((t // 60) % 180 = 0), false) as up, coalesce(close / nullif(c2, 0) - 1 < -0.2, false) as down from x),
 g as (select symbol, t, open, high, low, close, case when up and not down then 1 when down and not up then -1 else 0 end as target from y)"""
_POSITION = f"""q as (select *, lag(target) over o as lt, lag(t) over o as lb from g window o as (partition by symbol order by t)),
 s as (select *, case when t - lb - {BAR} <= {ledger.DELAY} then lt end as put, coalesce(t - lb - {BAR} > {ledger.DELAY} and lt is not null, false) as cancelled from q),
 p as (select *, coalesce(last_value(put ignore nulls) over (partition by symbol order by t rows between unbounded preceding and current row), 0)::int as position from s)"""
_FILLS = "f as (select symbol, lag(t) over o as signal_t, t as fill_t, open as price, coalesce(lag(position) over o, 0) as from_position, position as to_position from p window o as (partition by symbol order by t) qualify position <> coalesce(lag(position) over o, 0))"
_RETURNS = "n as (select symbol, t, position, case when lead(open) over o is not null and open <> 0 then position * (lead(open) over o / open - 1) else 0 end as gross, abs(position - coalesce(lag(position) over o, 0)) as turnover from p window o as (partition by symbol order by t))"


#: Bars of an hour: clock phases count in hours too.
HOURLY = Limits(periods=(15, 60, 180))


def targets(spark, d):
    return compile_rules(market(spark, d), {"target": RULE}, KEYS, HOURLY).select("symbol", "t", "open", "high", "low", "close", "target")


def held(spark, d):
    return stored(ledger.positions(stored(targets(spark, d)), KEYS, BAR))


@query("e12_strategy_target", with_bars("select symbol, t, target from g", _TARGET))
def e12(spark, d):
    return targets(spark, d).select("symbol", "t", "target")


@query("e17_baselines", with_bars(f"""select b.symbol, b.t, 0 as flat, 1 as hold, coalesce(case when b.close / nullif(p.close, 0) - 1 > 0 then 1 when b.close / nullif(p.close, 0) - 1 < 0 then -1 end, 0) as momentum,
 (('0x' || md5('7|' || b.symbol || '|' || b.t)[1:2])::int % 3 - 1) as random from b left join b p on p.symbol = b.symbol and p.t = b.t - {12 * BAR}"""))
def e17(spark, d):
    return baseline_targets(market(spark, d), KEYS).select("symbol", "t", "flat", "hold", "momentum", "random")


_TREE = "(close > 50 and volume < 6) or not (low > 10)"


def _tree() -> dict:
    col = lambda op, name, x: {"op": op, "arg": {"op": "column", "name": name}, "than": x}
    return {"op": "or", "args": [{"op": "and", "args": [col("greater", "close", 50), col("less", "volume", 6)]}, {"op": "not", "args": [col("greater", "low", 10)]}]}


@query("e9_boolean_node", with_bars(f"select symbol, t, {_TREE} as hit from b"))
def e9(spark, d):
    return market(spark, d).select("symbol", "t", boolean(_tree()).alias("hit"))


@query("e11_holds_for", with_bars(f"select symbol, t, case when count(x) over w = 2 then sum(x) over w = 2 end as hit from (select *, ({_TREE})::int as x from b) window w as {_W(1, 'current row')}"))
def e11(spark, d):
    node = {"op": "holds_for", "arg": _tree(), "bars": 2}
    df, _ = with_windows(market(spark, d), [node], KEYS)
    return df.select("symbol", "t", boolean(node).alias("hit"))


_BACK = lambda w: f"r{w} as (select b.symbol, b.t, b.close / nullif(p.close, 0) - 1 as r from b left join b p on p.symbol = b.symbol and p.t = b.t - {w * BAR})"
_SIDE = lambda name, up, down, source: f"select symbol, t, '{name}' as rule, case when coalesce({up}, false) and not coalesce({down}, false) then 1 when coalesce({down}, false) and not coalesce({up}, false) then -1 else 0 end as target from {source}"
_LASTING = f"(select symbol, t, case when count(r) over w = 3 then sum((r > 0)::int) over w = 3 end as up, case when count(r) over w = 3 then sum((r < 0)::int) over w = 3 end as down from r12 window w as {_W(2, 'current row')})"
_CALM = f"(select r12.symbol, r12.t, r12.r, v from r12 join (select symbol, t, case when count(r) over w = 48 then stddev_samp(r) over w end as v from r1 window w as {_W(47, 'current row')}) using (symbol, t))"
_SHOCK = f"(select symbol, t, case when count(*) over w = 24 and stddev_samp(volume) over w > 0 then (volume - avg(volume) over w) / stddev_samp(volume) over w end as z from b window w as {_W(24, '1 preceding')})"


@query("e16_reference_rules", with_bars(" union all ".join([
    _SIDE("always_long", "r > -1", "false", "r1"), _SIDE("always_short", "false", "r < 1", "r1"), _SIDE("momentum_1h", "r > 0", "r < 0", "r12"), _SIDE("momentum_4h", "r > 0", "r < 0", "r48"),
    _SIDE("momentum_1d", "r > 0", "r < 0", "r288"), _SIDE("reversal_1h", "r < 0", "r > 0", "r12"), _SIDE("momentum_1h_persist3", "up", "down", _LASTING), _SIDE("momentum_1h_hold12", "r > 0", "r < 0", "r12"),
    _SIDE("lowvol_momentum_long", "r > 0 and v < 0.002", "false", _CALM), _SIDE("volume_shock_fade", "false", "z > 3", _SHOCK),
]), *map(_BACK, (1, 12, 48, 288))))
def e16(spark, d):
    """Targets of the ten rules, from one pass over the bars and one more for the rule that has to last."""
    rules = reference_rules()
    df = compile_rules(market(spark, d), rules, KEYS)
    return df.select("symbol", "t", F.explode(F.array(*(F.struct(F.lit(k).alias("rule"), F.col(k).alias("target")) for k in rules))).alias("x")).select("symbol", "t", "x.*")


@query("e14_record_problems", """select event_id, array_to_string(list_filter([
 case when event_type is null then 'event:missing' when event_type not in ('momentum', 'reversal', 'volatility_shock', 'volume_shock', 'breakout', 'clock_boundary') then 'event:unknown' end,
 case when direction is null then 'direction:missing' when direction not in ('continuation', 'reversal') then 'direction:unknown' end, case when action is null then 'action:missing' when action not in ('long', 'short', 'flat', 'abstain', 'exit') then 'action:unknown' end,
 case when len(context) = 0 then 'context:missing' when len(list_filter(context, lambda x: x not in ('high_volatility', 'low_volatility', 'trend', 'range', 'high_volume', 'low_volume'))) > 0 then 'context:unknown' end,
 case when len(list_filter(quality, lambda x: x not in ('persistence', 'acceleration', 'exhaustion', 'divergence', 'confirmation'))) > 0 then 'quality:unknown' end,
 case when trim(hypothesis) = '' then 'hypothesis:missing' end], lambda x: x is not null), ',') as problems from (select event_id, case when event_id % 3 = 0 then 'momentum' else event_type end as event_type,
 case when event_id % 5 = 0 then null when event_id % 2 = 0 then 'reversal' else 'sideways' end as direction, case when event_id % 7 = 0 then 'buy' else 'long' end as action,
 case when event_id % 4 = 0 then []::varchar[] else ['trend', event_type] end as context, ['persistence'] as quality, case when event_id % 11 = 0 then ' ' else 'x' end as hypothesis from events)""")
def e14(spark, d):
    """Records made of events, many of them wrong on purpose."""
    i = F.col("event_id")
    rec = events(spark, d).select(
        "event_id",
        F.when(i % 3 == 0, "momentum").otherwise(F.col("event_type")).alias("event"),
        F.when(i % 5 == 0, None).when(i % 2 == 0, "reversal").otherwise("sideways").alias("direction"),
        F.when(i % 7 == 0, "buy").otherwise("long").alias("action"),
        F.when(i % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("trend"), F.col("event_type"))).alias("context"),
        F.array(F.lit("persistence")).alias("quality"),
        F.when(i % 11 == 0, " ").otherwise("x").alias("hypothesis"),
        F.lit("h").alias("hypothesis_id"), F.lit("f").alias("expected_failure_mode"),
    )
    return rec.select("event_id", F.array_join(record_problems(), ",").alias("problems"))


@query("b1_positions", with_bars("select symbol, t, position, cancelled from p", _TARGET, _POSITION))
def b1(spark, d):
    return held(spark, d).select("symbol", "t", "position", "cancelled")


@query("b3_fills", with_bars("select * from f", _TARGET, _POSITION, _FILLS))
def b3(spark, d):
    return ledger.fills(held(spark, d), KEYS)


@query("b4_trades", with_bars("select symbol, fill_t as entry_t, exit_t, to_position as side, price as entry_price, exit_price, round(to_position * (exit_price / nullif(price, 0) - 1), 6) as gross, exit_t is not null as closed from (select *, lead(fill_t) over o as exit_t, lead(price) over o as exit_price from f window o as (partition by symbol order by fill_t)) where to_position <> 0", _TARGET, _POSITION, _FILLS))
def b4(spark, d):
    return ledger.trades(ledger.fills(held(spark, d), KEYS), KEYS).withColumn("gross", r6(F.col("gross")))


@query("b5_bar_returns", with_bars("select symbol, t, round(gross, 6) as gross, turnover from n", _TARGET, _POSITION, _RETURNS))
def b5(spark, d):
    return ledger.bar_returns(held(spark, d), KEYS).select("symbol", "t", r6(F.col("gross")).alias("gross"), "turnover")


_COSTS = [("low", 0.0005), ("high", 0.0020)]


@query("b7_backtest", with_bars("""select symbol, scenario, count(*) as bars, round(sum(net), 3) as total, round(avg(net) / stddev_samp(net), 5) as sharpe, round(avg(net) / sqrt(avg(case when net < 0 then net * net else 0 end)), 5) as sortino, sum(turnover)::bigint as turnover,
 round(avg((position <> 0)::int), 5) as exposure, round(sum(case when net > 0 then net else 0 end) / -sum(case when net < 0 then net else 0 end), 5) as profit_factor, round(sum(gross) / sum(turnover) * 10000, 2) as break_even_bps from (select *, gross - turnover * per_side as net from n, (values ('low', 0.0005::double), ('high', 0.0020::double)) c(scenario, per_side)) group by 1, 2""", _TARGET, _POSITION, _RETURNS))
def b7(spark, d):
    costs = spark.createDataFrame(_COSTS, "scenario string, per_side double")
    m = ledger.net(ledger.bar_returns(held(spark, d), KEYS), costs).groupBy("symbol", "scenario").agg(*ledger.metrics(KEYS))
    digits = {"total": 3, "sharpe": 5, "sortino": 5, "exposure": 5, "profit_factor": 5, "break_even_bps": 2}
    return m.withColumns({k: F.round(k, n) for k, n in digits.items()})


_TOUCH = 6


@query("b9_first_touch", with_bars(f"""select symbol, id, outcome, exit_t, round(price, 6) as exit_price, round(mae, 6) as mae, round(mfe, 6) as mfe from (
 select symbol, id, count(*) as n, arg_min(hit, t) filter (where hit is not null) as outcome, arg_min(price, t) filter (where hit is not null) as price, min(t) filter (where hit is not null) as exit_t, max(high) filter (where not last) / any_value(e) - 1 as mae, 1 - min(low) filter (where not last) / any_value(e) as mfe from (
 select a.symbol, a.t as id, p.t, p.high, p.low, a.open as e, p.t = a.t + {_TOUCH * BAR} as last,
 case when p.t = a.t + {_TOUCH * BAR} then 'timeout' when p.open >= a.open * 1.5 then 'stop' when p.open <= a.open * 0.5 and p.t > a.t then 'take' when p.high >= a.open * 1.5 then 'stop' when p.low <= a.open * 0.5 then 'take' end as hit,
 case when p.t = a.t + {_TOUCH * BAR} then p.open when p.open >= a.open * 1.5 then p.open when p.open <= a.open * 0.5 and p.t > a.t then a.open * 0.5 when p.high >= a.open * 1.5 then a.open * 1.5 when p.low <= a.open * 0.5 then a.open * 0.5 end as price
 from b a join b p on p.symbol = a.symbol and p.t between a.t and a.t + {_TOUCH * BAR} where a.volume > 6) group by 1, 2) where n = {_TOUCH + 1}"""))
def b9(spark, d):
    b = market(spark, d)
    e = b.where("volume > 6").withColumn("id", F.col("t"))
    out = ledger.first_touch(e, b, KEYS, _TOUCH, BAR, 0.5, 0.5)
    return out.select("symbol", "id", "outcome", "exit_t", *(r6(F.col(c)).alias(c) for c in ("exit_price", "mae", "mfe")))


_POLICIES = {"stop": "stop", "take": "take", "exclude": "excluded"}
_TOUCHED_SQL = f"p.t < a.t + {_TOUCH * BAR} and p.open < a.open * 1.2 and not (p.open <= a.open * 0.8 and p.t > a.t) and p.high >= a.open * 1.2 and p.low <= a.open * 0.8"


@query("b9_barrier_policies", with_bars(
    "select policy, h.outcome as outcome, h.two as ambiguous, count(*) as n, round(avg((e - h.price) / e), 6) as mean_return from g group by 1, 2, 3",
    f"""x as (select a.symbol, a.t as id, a.open as e, p.t, p.open, p.high, p.low, p.t = a.t + {_TOUCH * BAR} as last, {_TOUCHED_SQL} as two, p.open >= a.open * 1.2 as gap_up, p.open <= a.open * 0.8 and p.t > a.t as gap_down, p.high >= a.open * 1.2 as up, p.low <= a.open * 0.8 as down
 from b a join b p on p.symbol = a.symbol and p.t between a.t and a.t + {_TOUCH * BAR} where a.open > 0)""",
    f"y as (select *, case when last then 'timeout' when gap_up then 'stop' when gap_down then 'take' when two then word when up then 'stop' when down then 'take' end as hit from x, (values {', '.join(f"('{k}', '{v}')" for k, v in _POLICIES.items())}) w(policy, word))",
    "z as (select *, case when last or gap_up then open when hit = 'stop' then e * 1.2 when hit = 'take' then e * 0.8 end as price from y)",
    f"g as (select policy, symbol, id, any_value(e) as e, min_by(struct_pack(outcome := hit, price := price, two := two), t) filter (where hit is not null) as h from z group by 1, 2, 3 having count(*) = {_TOUCH + 1})",
))
def b9_policies(spark, d):
    """What a bar that touches both barriers counts as: outcomes and mean returns under each policy, over all bars."""
    b = stored(market(spark, d))
    e = b.where("open > 0").withColumn("id", F.col("t"))
    parts = [ledger.first_touch(e, b, KEYS, _TOUCH, BAR, 0.2, 0.2, ambiguous=k).withColumn("policy", F.lit(k)) for k in _POLICIES]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return every.groupBy("policy", "outcome", "ambiguous").agg(F.count("*").alias("n"), r6(F.avg((F.col("entry_price") - F.col("exit_price")) / F.col("entry_price"))).alias("mean_return"))


@query("b10_whole_paths", with_bars(f"select symbol, t from b qualify count(*) over (partition by symbol order by t range between current row and {8 * BAR} following) = 9"))
def b10(spark, d):
    return rolling(market(spark, d), KEYS, {"n": (F.count("*"), 0, 8 * BAR)}).where("n = 9").select("symbol", "t")


@query("b13_hysteresis", with_bars("select symbol, t, coalesce(last_value(x ignore nulls) over (partition by symbol order by t rows between unbounded preceding and current row), 0)::int as state from (select symbol, t, case when close / nullif(open, 0) - 1 > 0.5 then 1 when close / nullif(open, 0) - 1 <= -0.2 then 0 end as x from b)"))
def b13(spark, d):
    rho = market(spark, d).select("symbol", "t", F.when(F.col("open") != 0, F.col("close") / F.col("open") - 1).alias("rho"))
    return ledger.hysteresis(rho, KEYS, "rho", 0.5, -0.2).select("symbol", "t", "state")


@query("w9_event_intervals", with_bars("select symbol, t, (t - lag(t) over (partition by symbol order by t)) / 3600.0 as hours, coalesce((t - lag(t) over (partition by symbol order by t)) <> 28800, false) as differs from b where t % 28800 = 0"))
def w9(spark, d):
    x = ordered(market(spark, d).where("t % 28800 = 0").select("symbol", "t"), KEYS, {"p": ("lag", "t")})
    return x.select("symbol", "t", ((F.col("t") - F.col("p")) / 3600.0).alias("hours"), F.coalesce(F.col("t") - F.col("p") != 28800, F.lit(False)).alias("differs"))


_MENU = "case feature " + " ".join(f"when '{k}' then [{', '.join(map(str, m))}]" for k, (m, _) in fn.THRESHOLDS.items()) + " end"
_SIGNED = ", ".join(f"'{k}'" for k, (_, signed) in fn.THRESHOLDS.items() if signed)


@query("e15_plan_conditions", f"""with p as (select event_id, ['return', 'volatility', 'volume_z', 'range'][event_id % 4 + 1] as f, (value - 50) / 1000 as v, case event_id % 3 when 0 then 'long' when 1 then 'short' else 'both' end as side, event_id % 5 = 0 as filtered, event_id % 7 = 0 as timed, case when event_id % 2 = 0 then 3 end as bars from events),
 s as (select p.*, stance from p, (select unnest(['long_if', 'short_if']) as stance) where side = 'both' or starts_with(stance, side)),
 c as (select event_id, stance, 0 as part, 'less' as op, 'trend' as feature, 48 as w, -v as v, null::int as bars, false as turned from s where filtered
  union all select event_id, stance, 1, 'clock_is', null, 60, 15, null, false from s where timed
  union all select event_id, stance, 2, 'greater', f, 12, v, bars, stance = 'short_if' from s),
 m as (select *, case when op = 'clock_is' then v else list_min(list_transform({_MENU}, lambda x: {{'d': abs(abs(v) - x), 'm': x}})).m * case when v < 0 and feature in ({_SIGNED}) then -1 else 1 end end as than from c)
 select event_id::varchar as plan, stance, row_number() over (partition by event_id, stance order by part) - 1 as place, case when turned then 'less' else op end as op, feature, w as "window", round(case when turned then -than else than end, 6)::double as than, bars from m""")
def e15(spark, d):
    """A plan for each event, as conditions on menus; the short side mirrors its entry."""
    i, v = F.col("event_id"), (F.col("value") - 50) / 1000
    cond = lambda feature, window, op, x: F.struct(feature.alias("feature"), F.lit(window).alias("window"), F.lit(op).alias("op"), x.alias("threshold"))
    names = F.array(*map(F.lit, ("return", "volatility", "volume_z", "range")))
    entry = cond(F.get(names, (i % 4).cast("int")), 12, "greater", v)
    plans = events(spark, d).select(
        i.cast("string").alias("plan"), F.when(i % 3 == 0, "long").when(i % 3 == 1, "short").otherwise("both").alias("side"), entry.alias("entry"), F.when(i % 5 == 0, F.array(cond(F.lit("trend"), 48, "less", -v))).alias("filters"),
        F.when(i % 7 == 0, F.struct(F.lit(60).alias("period"), F.lit(15).alias("phase"))).alias("clock"), F.when(i % 2 == 0, 3).alias("persistence_bars"), F.lit(None).cast("int").alias("holding_bars"),
    )
    return fn.plan_conditions(plans).select("plan", "stance", "place", "op", "feature", "window", F.round("than", 6).alias("than"), "bars")
