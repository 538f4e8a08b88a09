"""Queries of guards, accounts, identities and whole feature tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..operators import carry, joins, sessions
from ..operators.bars import BAR, at_offset, complete, rolling
from . import guards
from .common import events, market, r6, with_bars
from .micro import _F, frames
from .registry import query

KEYS = ["symbol"]
DAY = 86400
#: Named splits of the month of events; the last is open and sealed.
SPLITS = {"research": (1704067200, 1705276800), "validation": (1705276800, 1706054400), "final": (1706054400, None)}


@query("p2_split", with_bars("select symbol, t, close from b where t >= 1705276800 and t < 1706054400"))
def p2(spark, d):
    return guards.split(market(spark, d).select("symbol", "t", "close"), SPLITS, "validation", sealed=("final",))


@query("p3_declared_columns", with_bars("select symbol, count(*) as n from b where t >= 1706054400 group by 1"))
def p3(spark, d):
    """A sealed split, acknowledged, of a table whose columns are all declared."""
    x = guards.declared(market(spark, d).select("symbol", "t", "close"), ["symbol", "t", "close"])
    return guards.split(x, SPLITS, "final", sealed=("final",), acknowledged=True).groupBy("symbol").agg(F.count("*").alias("n"))


@query("p4_below_seal", with_bars("select count(*) filter (where t < 1706054400) as kept, count(*) filter (where t >= 1706054400) as dropped from b"))
def p4(spark, d):
    return guards.below_seal(market(spark, d), 1706054400)[1]


@query("p10_complete_cases", with_bars(f"select b.symbol, b.t from b join b p on p.symbol = b.symbol and p.t = b.t - {BAR} join b q on q.symbol = b.symbol and q.t = b.t - {6 * BAR} where p.close > 0"))
def p10(spark, d):
    """Rows whose inputs are all there and finite."""
    x = rolling(market(spark, d), KEYS, {"c1": at_offset("close", -BAR), "c6": at_offset("close", -6 * BAR)})
    x = x.withColumn("r", F.when(F.col("c1") > 0, F.col("close") / F.col("c1")))
    return guards.complete_cases(x, ["r", "c6"]).select("symbol", "t")


_GATE = "g as (select symbol, t // 604800 as week, count(*) as n, count(*) filter (where volume > 2) as good from b group by 1, 2)"


@query("p14_coverage_gate", with_bars("select symbol, (sum(n) filter (where good >= 0.55 * n))::bigint as rows, coalesce(array_to_string(list_sort(list(week) filter (where good < 0.55 * n)), ','), '') as excluded from g group by 1", _GATE))
def p14_gate(spark, d):
    """Whole periods with too few valid rows are left out and named."""
    kept, excluded = guards.coverage_gate(market(spark, d), KEYS, F.floor(F.col("t") / 604800), F.col("volume") > 2, 0.55)
    rows = kept.groupBy("symbol").agg(F.count("*").alias("rows"))
    return excluded.join(rows, "symbol", "left").select("symbol", "rows", F.array_join("excluded", ",").alias("excluded"))


@query("p15_reason_codes", "select event_id, array_to_string(list_filter([case when value <= 1 then 'value_low' end, case when event_type not in ('click', 'view', 'purchase') then 'type_unknown' end, case when user_id % 10 = 0 then 'user_reserved' end], lambda x: x is not null), ',') as reasons from events")
def p15(spark, d):
    rules = {"value_low": F.col("value") <= 1, "type_unknown": ~F.col("event_type").isin("click", "view", "purchase"), "user_reserved": F.col("user_id") % 10 == 0}
    return events(spark, d).select("event_id", F.array_join(guards.reasons(rules), ",").alias("reasons"))


@query("a8_conflict_account", "with x as (select l_orderkey as k, l_suppkey as v, month(l_shipdate) = 1 as owns from lineitem where l_linenumber = 1 union all select l_orderkey, l_suppkey + l_orderkey % 2, true from lineitem where l_linenumber = 1 and l_orderkey % 3 = 0), g as (select k, count(*) as n, sum(owns::int) as o, count(distinct v) as d from x group by 1) select sum(n)::bigint as rows, count(*) as keys, count(*) filter (where n > 1) as repeated, count(*) filter (where n > 1 and o = 1) as one_owner, count(*) filter (where d > 1) as conflicts from g")
def a8(spark, d):
    """How keys with several rows are settled: those that one row owns, and those whose rows differ."""
    li = spark.read.parquet(f"{d}/lineitem.parquet").where("l_linenumber = 1")
    x = li.select(F.col("l_orderkey").alias("k"), F.col("l_suppkey").alias("v"), (F.month("l_shipdate") == 1).alias("owns"))
    x = x.union(li.where("l_orderkey % 3 = 0").select("l_orderkey", F.col("l_suppkey") + F.col("l_orderkey") % 2, F.lit(True)))
    g = x.groupBy("k").agg(F.count("*").alias("n"), F.count_if("owns").alias("o"), F.count_distinct("v").alias("d"))
    return g.agg(F.sum("n").alias("rows"), F.count("*").alias("keys"), F.count_if(F.col("n") > 1).alias("repeated"), F.count_if((F.col("n") > 1) & (F.col("o") == 1)).alias("one_owner"), F.count_if(F.col("d") > 1).alias("conflicts"))


@query("x18_cost_scenarios", with_bars("select symbol, scenario, round(sum(volume) * per_side * 2, 6) as round_trip, round(sum(volume) * per_side * 4, 6) as two_legs from b, (values ('low', 0.0005::double), ('high', 0.002::double)) c(scenario, per_side) group by symbol, scenario, per_side"))
def x18(spark, d):
    """Costs of one and two legs in each scenario; one whose rate is only a placeholder is refused."""
    costs = fn.known_costs({"low": 0.0005, "high": 0.002})
    x = market(spark, d).groupBy("symbol").agg(F.sum("volume").alias("q"))
    each = x.select("symbol", "q", F.explode(F.array(*(F.struct(F.lit(k).alias("scenario"), F.lit(v).alias("per_side")) for k, v in costs.items()))).alias("c")).select("symbol", "q", "c.*")
    return each.select("symbol", "scenario", r6(F.col("q") * F.col("per_side") * 2).alias("round_trip"), r6(F.col("q") * F.col("per_side") * 4).alias("two_legs"))


@query("x21_row_identity", "select event_id, sha256('{\"event_id\":' || event_id || ',\"event_type\":\"' || event_type || '\"}') as identity from events")
def x21(spark, d):
    return events(spark, d).select("event_id", fn.identity("event_id", "event_type").alias("identity"))


@query("x22_sorted_json", "select event_id, '{\"a\":' || (props->>'k') || ',\"z\":' || event_id || '}' as canonical from events where props->>'k' is not null")
def x22(spark, d):
    """JSON read and written again with its keys in order."""
    text = F.to_json(F.struct(F.col("event_id").alias("z"), F.from_json("props", "k long")["k"].alias("a")))
    return events(spark, d).select("event_id", fn.sorted_json(text, ["a", "z"]).alias("canonical")).where("canonical is not null")


@query("x23_hex_words", "select event_id, unnest([0, 1]) as idx, unnest([event_id, event_id * 3 + 1]) as number from events")
def x23(spark, d):
    """Words of 32 bytes in hex, as contracts answer, split into numbers."""
    word = lambda c: F.lpad(F.lower(F.hex(c)), 64, "0")
    data = F.concat(F.lit("0x"), word(F.col("event_id")), word(F.col("event_id") * 3 + 1))
    return events(spark, d).select("event_id", F.posexplode(carry.hex_words(data)).alias("idx", "w")).select("event_id", "idx", carry.word_number(F.col("w")).alias("number"))


@query("s19_daily_rates", with_bars("select day, case when n = 3 and k = 3 and bad = 0 then round(mean, 9) end as mean_apr, case when k < 3 then 'missing_asset' when n > 3 then 'repeated_asset' when bad > 0 then 'bad_word' end as reason from (select t // 86400 as day, count(distinct symbol) as k, count(*) as n, count(*) filter (where volume % 7 = 0) as bad, avg(case when volume % 7 <> 0 then volume / 1000.0 end)::double as mean from (select * from b where symbol in ('click', 'view', 'error') and t % 86400 = 0 union all select * from b where symbol = 'view' and t % 604800 = 0) group by 1)"))
def s19(spark, d):
    """Daily mean of three assets' rates from contract words, or why there is none."""
    b = market(spark, d).where("symbol in ('click', 'view', 'error') and t % 86400 = 0")
    b = b.union(b.where("symbol = 'view' and t % 604800 = 0"))
    rows = b.select(F.floor(F.col("t") / 86400).alias("date"), F.col("symbol").alias("asset"), F.when(F.col("volume") % 7 == 0, "0xzz").otherwise(carry.ray_word(F.col("volume") / 1000.0)).alias("word"))
    return carry.daily_rates(rows, ["click", "view", "error"]).select(F.col("date").alias("day"), F.round("mean_apr", 9).alias("mean_apr"), "reason")


@query("r27_result_table", with_bars("select symbol, horizon, n, round(mean, 5) as mean, round(t, 4) as t from (" + " union all ".join(f"select b.symbol, {h} as horizon, count(*) as n, avg(greatest(-2, least(2, f.close / b.close - 1))) as mean, avg(greatest(-2, least(2, f.close / b.close - 1))) / stddev_samp(greatest(-2, least(2, f.close / b.close - 1))) * sqrt(count(*)) as t from b join b f on f.symbol = b.symbol and f.t = b.t + {h * BAR} where b.close > 0 group by 1" for h in (1, 3, 12)) + ")"))
def r27(spark, d):
    """All cells of a result table, none selected: outcome by series and horizon."""
    x = rolling(market(spark, d), KEYS, {f"f{h}": at_offset("close", h * BAR) for h in (1, 3, 12)}).where("close > 0")
    y = lambda h: F.when(F.col(f"f{h}").isNotNull(), F.greatest(F.lit(-2.0), F.least(F.lit(2.0), F.col(f"f{h}") / F.col("close") - 1)))
    cells = x.select("symbol", F.explode(F.array(*(F.struct(F.lit(h).alias("horizon"), y(h).alias("y")) for h in (1, 3, 12)))).alias("c")).select("symbol", "c.*").where("y is not null")
    return cells.groupBy("symbol", "horizon").agg(F.count("*").alias("n"), F.round(F.avg("y"), 5).alias("mean"), F.round(F.avg("y") / F.stddev_samp("y") * F.sqrt(F.count("*")), 4).alias("t"))


@query("m1_envelope", f"with {_F} select session, count(*) as frames, count(*) filter (where event_id % 97 = 0) as bad_version, bool_and(event_id % 101 <> 0) as one_stream, bool_and(frame_no = p + 1 or p is null) as contiguous from (select *, lag(frame_no) over (partition by session order by frame_no) as p from f) group by 1")
def m1_envelope(spark, d):
    """Versions, streams and numbers of each session's frames."""
    f = frames(spark, d).withColumns({"version": F.when(F.col("event_id") % 97 == 0, 2).otherwise(1), "stream": F.when(F.col("event_id") % 101 == 0, F.concat(F.lit("s"), F.col("event_id").cast("string"))).otherwise("s")})
    return sessions.envelopes(f, ["session"], 1)


@query("f1_observable_whole", with_bars(f"""select r.symbol, r.t, round(r.ret, 6) as return_1, case when count(r.ret) over v >= 100 then round(stddev_samp(r.ret) over v, 6) end as realised_vol, case when r.t - s.t <= {9 * BAR} then s.volume end as funding, round(r.taker_volume::double, 6) as open_interest from r asof left join (select symbol, t, volume from b where t % 28800 = 0) s on s.symbol = r.symbol and r.t >= s.t
 window v as (partition by r.symbol order by r.t range between {5 * DAY} preceding and 1 preceding)""", f"r as (select b.*, b.close / nullif(p.close, 0) - 1 as ret from b left join b p on p.symbol = b.symbol and p.t = b.t - {BAR})"))
def f1_whole(spark, d):
    """The rest of the observable features: realised volatility, the last settlement and a snapshot of the same time."""
    b = market(spark, d)
    x = rolling(b, KEYS, {"c1": at_offset("close", -BAR)}).withColumn("ret", fn.simple_return(F.col("close"), F.col("c1")))
    v = (-5 * DAY, -1)
    x = rolling(x, KEYS, {"s": (F.stddev_samp("ret"), *v), "n": (F.count("ret"), *v)})
    x = joins.as_of(x, b.where("t % 28800 = 0").select("symbol", "t", F.col("volume").alias("funding")), KEYS, 9 * BAR, ["funding"])
    out = x.select("symbol", "t", r6(F.col("ret")).alias("return_1"), r6(complete(F.col("s"), F.col("n"), 100)).alias("realised_vol"), "funding", r6(F.col("taker_volume").cast("double")).alias("open_interest"))
    return guards.observable(out)


@query("f2_flow_whole", with_bars(f"select b.symbol, b.t, b.volume as trade_count, round(b.volume_quote / b.volume, 6) as mean_size, case when s.taker_volume > 0 then s.taker_volume end as snapshot, round(p.close - q.close, 6) as premium from b left join (select * from b where t % 10800 = 0) s on s.symbol = b.symbol and s.t = b.t left join b p on p.symbol = 'click' and p.t = b.t left join b q on q.symbol = 'view' and q.t = b.t"))
def f2_whole(spark, d):
    """Flows with snapshots of exactly the same time, impossible values left out, and a premium of two series."""
    b = market(spark, d)
    snap = b.where("t % 10800 = 0").select("symbol", "t", F.when(F.col("taker_volume") > 0, F.col("taker_volume")).alias("snapshot"))
    take = lambda s, c: b.where(F.col("symbol") == s).select("t", F.col("close").alias(c))
    premium = take("click", "p").join(take("view", "q"), "t").select("t", r6(F.col("p") - F.col("q")).alias("premium"))
    return b.select("symbol", "t", F.col("volume").alias("trade_count"), r6(F.col("volume_quote") / F.col("volume")).alias("mean_size")).join(snap, ["symbol", "t"], "left").join(premium, "t", "left").select("symbol", "t", "trade_count", "mean_size", "snapshot", "premium")
