"""Queries of joins on published, candidate and registered times, of folds, and of conditions evaluated together."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import carry, joins, sessions
from ..operators import statistics as st
from ..operators.bars import BAR, at_offset, grid, rolling, seconds
from .common import events, market, r6, with_bars
from .registry import query

KEYS = ["symbol"]
_DELAY, _STALE = 2 * BAR, 12 * BAR


def sparse(spark, d):
    """Bars at every eighth hour: what is settled or published."""
    return market(spark, d).where("t % 28800 = 0").select("symbol", "t", "close", "volume")


@query("j3_point_in_time", with_bars(f"select l.symbol, l.t, r.t as match_t, r.volume as found from b l asof left join (select * from b where t % 28800 = 0) r on l.symbol = r.symbol and l.t >= r.t qualify true").replace(" qualify true", "").replace("r.t as match_t, r.volume as found", f"case when l.t - r.t <= {4 * BAR} then r.t end as match_t, case when l.t - r.t <= {4 * BAR} then r.volume end as found"))
def j3(spark, d):
    """The latest observation at most four hours old; one exactly that old still counts."""
    r = sparse(spark, d).select("symbol", "t", F.col("volume").alias("found"))
    return joins.as_of(market(spark, d).select("symbol", "t"), r, KEYS, 4 * BAR, ["found"])


@query("j4_publication_delay", with_bars(f"select l.symbol, l.t, case when l.t - r.known <= {_STALE} then r.t end as match_t, case when l.t - r.known <= {_STALE} then r.volume end as found from b l asof left join (select *, t + {_DELAY} as known from b where t % 28800 = 0) r on l.symbol = r.symbol and l.t >= r.known"))
def j4(spark, d):
    r = sparse(spark, d).select("symbol", "t", F.col("volume").alias("found"))
    return joins.published_as_of(market(spark, d).select("symbol", "t"), r, KEYS, _DELAY, _STALE, ["found"]).select("symbol", "t", "match_t", "found")


@query("j6_next_however_far", with_bars("select l.symbol, l.t, r.t as match_t, r.volume as found from (select * from b where volume > 4) l asof left join (select * from b where t % 259200 = 0) r on l.symbol = r.symbol and l.t < r.t"))
def j6(spark, d):
    b = market(spark, d)
    return joins.next_any(b.where("volume > 4").select("symbol", "t"), b.where("t % 259200 = 0").select("symbol", "t", F.col("volume").alias("found")), KEYS, ["found"], chunk=2 * 86400)


@query("j15_event_and_control", with_bars(f"select e.symbol, count(*) as pairs, round(avg(e.close - c.close), 6) as difference, round(avg((e.close > c.close)::int), 6) as share from (select * from b where volume > 6) e join b c on c.symbol = e.symbol and c.t = e.t - {24 * BAR} group by 1"))
def j15(spark, d):
    """Events against the bar of the same hour a day before: both sides' outcomes by exact joins."""
    b = market(spark, d)
    control = b.select("symbol", (F.col("t") + 24 * BAR).alias("t"), F.col("close").alias("other"))
    x = b.where("volume > 6").join(control, ["symbol", "t"])
    return x.groupBy("symbol").agg(F.count("*").alias("pairs"), r6(F.avg(F.col("close") - F.col("other"))).alias("difference"), r6(F.avg((F.col("close") > F.col("other")).cast("int"))).alias("share"))


@query("j16_features_and_labels", with_bars(f"select b.symbol, b.t, b.close, round(f.close / nullif(b.close, 0) - 1, 6) as fwd_return from b left join b f on f.symbol = b.symbol and f.t = b.t + {BAR}"))
def j16(spark, d):
    b = market(spark, d)
    labels = rolling(b, KEYS, {"n": at_offset("close", BAR)}).select("symbol", "t", r6(F.when(F.col("close") != 0, F.col("n") / F.col("close") - 1)).alias("fwd_return"))
    return b.select("symbol", "t", "close").join(labels, KEYS + ["t"], "left")


_TIMELINE = f"""g as (select symbol, unnest(generate_series(lo, hi, {BAR})) as t from (select symbol, min(t) as lo, max(t) as hi from b group by 1)), probe as (select distinct symbol, t // 86400 as day, case when (t // 86400) % 3 = 0 then 'verified_repair' else 'source_unobservable' end as status from b where (t // 86400) % 2 = 0),
 line as (select g.symbol, g.t, b.close, case when b.t is null then coalesce(p.status, 'route_unverified') when b.volume = 1 then 'stale_unverified' else 'observed' end as status from g left join b on b.symbol = g.symbol and b.t = g.t left join probe p on p.symbol = g.symbol and p.day = g.t // 86400)"""


def timeline(spark, d):
    """The whole grid with each bar's status: gaps take what a registry of probed times says of them."""
    b = market(spark, d)
    days = b.select("symbol", F.floor(F.col("t") / 86400).alias("day")).distinct().where("day % 2 = 0")
    probes = days.select("symbol", F.sequence(F.col("day") * 86400, F.col("day") * 86400 + 86400 - BAR, F.lit(BAR).cast("long")).alias("times"), F.when(F.col("day") % 3 == 0, "verified_repair").otherwise("source_unobservable").alias("verdict"))
    return carry.mark_timeline(grid(b, KEYS, BAR), probes, KEYS, F.col("volume") == 1)


@query("j18_probe_registry", with_bars("select symbol, t, status from line where close is null", _TIMELINE))
def j18(spark, d):
    return timeline(spark, d).where("not present").select("symbol", "t", "status")


@query("b17_mark_timeline", with_bars("select symbol, t, close, status from line", _TIMELINE))
def b17(spark, d):
    return timeline(spark, d).select("symbol", "t", "close", "status")


@query("b16_gate_ladder", with_bars(f"select symbol, t // 86400 as day, count(*) as bars, bool_and(status in ('observed', 'verified_repair')) as path_ok, count(*) filter (where close > 95) as liquidations, case when not bool_and(status in ('observed', 'verified_repair')) then 'liquidation_state_unknown' when count(*) filter (where close > 95) = 0 then 'evaluate' when (t // 86400) % 2 = 0 then 'liquidation_model_blocked' else 'evaluate' end as disposition from line group by 1, 2", _TIMELINE))
def b16(spark, d):
    """Gates in their fixed order: a path that can't be observed comes before any count of liquidations."""
    x = timeline(spark, d).groupBy("symbol", F.floor(F.col("t") / 86400).alias("day")).agg(F.count("*").alias("bars"), F.bool_and(F.col("status").isin("observed", "verified_repair")).alias("path_ok"), F.count_if(F.col("close") > 95).alias("liquidations"))
    return x.withColumn("disposition", F.coalesce(carry.disposition(F.col("path_ok"), F.col("liquidations"), F.col("day") % 2 == 1), F.lit("evaluate")))


_RULES = [("same_open", 0, "open"), ("same_close", 0, "close"), ("same_high", 0, "high"), ("same_low", 0, "low"), ("before_close", -1, "close"), ("after_open", 1, "open")]


@query("j19_candidate_rules", with_bars(" union all ".join(f"select '{k}' as rule, count(*) filter (where e.value = p.{c}) as exact, count(p.t) as compared, count(*) as events from events e left join b p on p.symbol = e.event_type and p.t = epoch_us(e.ts) // 1000000 // {BAR} * {BAR} + {o * BAR}" for k, o, c in _RULES)))
def j19(spark, d):
    """How many events each rule would price exactly, from one join of bars with three offsets."""
    return joins.candidate_rules(events(spark, d).select(F.col("event_type").alias("symbol"), seconds(F.col("ts")).alias("at"), "value"), market(spark, d), KEYS, BAR, _RULES)


@query("u4_union_of_matches", with_bars(f"select count(*) filter (where e.value = s.open or coalesce(e.value = p.close, false)) as either, count(*) filter (where e.value = s.open) as primary_only, count(*) as events from events e join b s on s.symbol = e.event_type and s.t = epoch_us(e.ts) // 1000000 // {BAR} * {BAR} left join b p on p.symbol = s.symbol and p.t = s.t - {BAR}"))
def u4(spark, d):
    """Events that either of two rules prices exactly, counted once."""
    e = events(spark, d).select(F.col("event_type").alias("symbol"), (F.floor(seconds(F.col("ts")) / BAR) * BAR).alias("t"), "value")
    b = rolling(market(spark, d), KEYS, {"before": at_offset("close", -BAR)}).select("symbol", "t", "open", "before")
    same, other = F.col("value") == F.col("open"), F.coalesce(F.col("value") == F.col("before"), F.lit(False))
    return e.join(b, ["symbol", "t"]).agg(F.count_if(same | other).alias("either"), F.count_if(same).alias("primary_only"), F.count("*").alias("events"))


@query("j21_fold_rows", with_bars("select fold, count(*) as n, round(avg(close), 6) as mean from b join (select * from (values (1, 1704067200, 1704931200), (2, 1704067200, 1705795200), (3, 1704067200, 1706659200)) v(fold, train_start, train_end)) f on t >= train_start and t < train_end group by 1"))
def j21(spark, d):
    folds = [(1, 1704067200, 1704931200), (2, 1704067200, 1705795200), (3, 1704067200, 1706659200)]
    return st.in_folds(market(spark, d), spark.createDataFrame(folds, "fold int, train_start long, train_end long")).groupBy("fold").agg(F.count("*").alias("n"), r6(F.avg("close")).alias("mean"))


#: Conditions and sides, as text that both engines read.
_CONDITIONS = {
    "rise_long": ("r1 > 0", "1"), "rise_fade": ("r1 > 0.5", "-1"), "fall_long": ("r1 < -0.5", "1"), "fall_short": ("r1 < 0", "-1"), "busy_follow": ("volume > 5", "sign(r1)"), "calm_fade": ("volume < 3", "-sign(r1)"),
    "wide_long": ("high - low > 60", "1"), "narrow_short": ("high - low < 20", "-1"), "top_fade": ("close > 90", "-1"), "bottom_long": ("close < 10", "1"), "never": ("close > 1000", "1"),
}
_CASES = " union all ".join(f"select '{k}' as name, symbol, t, third, ({s}) * (y - m) as o, ({s}) * (y - m3) as o3 from w where {c}" for k, (c, s) in _CONDITIONS.items())
_EVALUATED = [
    f"v as (select b.*, b.close / nullif(p.close, 0) - 1 as r1, greatest(-2, least(2, f.close / nullif(b.close, 0) - 1)) as y from b left join b p on p.symbol = b.symbol and p.t = b.t - {BAR} join b f on f.symbol = b.symbol and f.t = b.t + {BAR} where b.close <> 0)",
    "a as (select min(t) as lo, max(t) as hi, avg(y) as m from v)",
    "w0 as (select v.*, a.m, least(2, (t - lo) * 3 // (hi - lo + 1))::int as third from v, a)",
    "w as (select *, avg(y) over (partition by third) as m3 from w0)",
    f"h as ({_CASES})",
    f"e as (select *, (coalesce(t - lag(t) over (partition by name, symbol order by t) >= {3 * BAR}, true))::int as fresh from h)",
    "p3 as (select name, third, avg(o3) as m from e group by 1, 2)",
    "c as (select name, count(*) as n, sum(fresh)::bigint as episodes, sum(o) as s, sum(o * o) as q from e group by 1)",
    "r as (select c.name, n, episodes, s / n as effect, case when n > 1 and (q - s * s / n) / (n - 1) > 1e-18 then s / n / sqrt((q - s * s / n) / (n - 1)) * sqrt(least(n / 2.0, episodes)) end as t, (select count(*) from p3 where p3.name = c.name and m > 0) as positive_thirds from c)",
]


def evaluated(spark, d):
    x = rolling(market(spark, d), KEYS, {"c1": at_offset("close", -BAR), "n1": at_offset("close", BAR)}).where("close <> 0")
    x = x.withColumns({"r1": F.when(F.col("c1") != 0, F.col("close") / F.col("c1") - 1), "y": F.greatest(F.lit(-2.0), F.least(F.lit(2.0), F.col("n1") / F.col("close") - 1))}).where("n1 is not null")
    return st.conditions_outcome(x, {k: (F.expr(c), F.expr(s)) for k, (c, s) in _CONDITIONS.items()}, "y", KEYS, 2, 3 * BAR)


@query("r9_conditions", with_bars("select name, n, episodes, round(effect, 6) as effect, round(t, 5) as t, positive_thirds from r", *_EVALUATED))
def r9(spark, d):
    """Eleven conditions over one pass of the bars."""
    return evaluated(spark, d).select("name", "n", "episodes", r6(F.col("effect")).alias("effect"), F.round("t", 5).alias("t"), "positive_thirds")


@query("t3_best_candidates", with_bars("select name, round(t, 5) as t, round(effect, 6) as effect from r where n >= 20 and episodes >= 10 and effect > 0 and positive_thirds >= 2 order by round(t, 5) desc, round(effect, 6) desc, name limit 5", *_EVALUATED))
def t3(spark, d):
    """A top-five report of the conditions that pass all gates."""
    x = evaluated(spark, d).where("n >= 20 and episodes >= 10 and effect > 0 and positive_thirds >= 2")
    return x.select("name", F.round("t", 5).alias("t"), r6(F.col("effect")).alias("effect")).orderBy(F.desc("t"), F.desc("effect"), "name").limit(5)
