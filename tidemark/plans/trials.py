"""Queries of statistical trials: draws, placebos, folds, spreads and verdicts. Draws are MD5s, so SQL draws alike."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import carry, ledger
from ..operators import statistics as st
from ..operators.bars import BAR, at_offset, rolling, seconds
from .common import events, market, r6, stored, with_bars
from .registry import query
from .rules import KEYS

_U = lambda seed, *parts: f"(('0x' || md5('{seed}|' || {' || chr(124) || '.join(parts)})[1:8])::bigint / 4294967296.0)"
_DAYS = "d as (select epoch_us(ts) // 86400000000 as day, sum(value) as num, count(*) as den from events group by 1)"


def days(spark, d):
    return events(spark, d).groupBy(F.floor(seconds(F.col("ts")) / 86400).alias("day")).agg(F.sum("value").alias("num"), F.count("*").alias("den"))


_TARGET_H = f"""h as (select symbol, t, close, case when close / nullif(open, 0) - 1 > 0.2 then 1 when close / nullif(open, 0) - 1 < -0.2 then -1 else 0 end as target, row_number() over (partition by symbol order by t) as i from b)"""


@query("b2_longest_holding", with_bars("""select symbol, t, target, position from (with recursive f as (select symbol, i, t, target, 0 as position, 0 as held from h where i = 1 union all
 select h.symbol, h.i, h.t, h.target, case when f.position <> 0 and f.held >= 3 then 0 else q.target end as position, case when f.position <> 0 and f.held >= 3 then 0 when q.target <> f.position then (q.target <> 0)::int when f.position <> 0 then f.held + 1 else 0 end as held
 from f join h on h.symbol = f.symbol and h.i = f.i + 1 join h q on q.symbol = f.symbol and q.i = f.i) select * from f)""", _TARGET_H))
def b2(spark, d):
    r = F.when(F.col("open") != 0, F.col("close") / F.col("open") - 1)
    x = market(spark, d).select("symbol", "t", F.when(r > 0.2, 1).when(r < -0.2, -1).otherwise(0).alias("target"))
    return ledger.held_for_at_most(x, KEYS, 3)


@query("b11_cooldown", with_bars(f"""select symbol, t, close from (with recursive e as (select symbol, t, close, row_number() over (partition by symbol order by t) as i from b where close > open and volume > 4), f as (select symbol, i, t, close, t as last, true as ok from e where i = 1 union all
 select e.symbol, e.i, e.t, e.close, case when e.t - f.last >= {4 * BAR} then e.t else f.last end, e.t - f.last >= {4 * BAR} from f join e on e.symbol = f.symbol and e.i = f.i + 1) select * from f) where ok"""))
def b11(spark, d):
    return ledger.cooled(market(spark, d).where("close > open and volume > 4").select("symbol", "t", "close"), KEYS, 4 * BAR)


@query("b12_filtered_events", with_bars(f"select symbol, t from (select *, count(*) over (partition by symbol order by t range between {12 * BAR} preceding and 1 preceding) as n, max(high) over (partition by symbol order by t range between {12 * BAR} preceding and 1 preceding) as top from b) where n >= 10 and close >= 0.95 * top and volume > 4"))
def b12(spark, d):
    """Events near the top of their trailing range, if enough of it is there."""
    x = rolling(market(spark, d), KEYS, {"n": (F.count("*"), -12 * BAR, -1), "top": (F.max("high"), -12 * BAR, -1)})
    return x.where("n >= 10 and close >= 0.95 * top and volume > 4").select("symbol", "t")


@query("r2_permutation_null", f"""with x as (select epoch_us(ts) // 86400000000 as day, (epoch_us(ts) // 3600000000 % 6)::int as phase, avg(value) as x from events group by 1, 2), k as (select *, day * 6 + phase as k from x), n as (select *, row_number() over (order by {_U(7, "0", "k")}, k) as i from k),
 r as (select rep, k.x, row_number() over (partition by rep order by {_U(7, "rep", "k")}, k) as i from k, (select unnest(range(1, 201)) as rep)), m as (select rep, n.phase, avg(r.x) as m from r join n using (i) group by 1, 2) select rep, round(max(abs(m - (select avg(x) from x))), 6) as largest from m group by 1""")
def r2(spark, d):
    x = events(spark, d).select("value", F.floor(seconds(F.col("ts")) / 86400).alias("day"), (F.floor(seconds(F.col("ts")) / 3600) % 6).cast("int").alias("phase"))
    cells = x.groupBy("day", "phase").agg(F.avg("value").alias("x")).withColumn("k", F.col("day") * 6 + F.col("phase"))
    return st.permutation_null(cells, "phase", "x", "k", 200, 7).withColumn("largest", r6(F.col("largest")))


@query("r15_empirical_p", f"""with x as (select epoch_us(ts) // 86400000000 as day, (epoch_us(ts) // 3600000000 % 6)::int as phase, avg(value) as x from events group by 1, 2), k as (select *, day * 6 + phase as k from x), n as (select *, row_number() over (order by {_U(7, "0", "k")}, k) as i from k),
 r as (select rep, k.x, row_number() over (partition by rep order by {_U(7, "rep", "k")}, k) as i from k, (select unnest(range(1, 201)) as rep)), m as (select rep, n.phase, avg(r.x) as m from r join n using (i) group by 1, 2), l as (select rep, max(abs(m - (select avg(x) from x))) as largest from m group by 1)
 select round((1 + count(*) filter (where largest >= 2.5)) / (1.0 + count(*)), 6) as p, round(quantile_cont(largest, 0.95), 5) as detectable from l""")
def r15(spark, d):
    null = r2(spark, d)
    return st.empirical_p(null, "largest", 2.5).select(r6(F.col("p")).alias("p"), F.round("detectable", 5).alias("detectable"))


@query("r16_day_bootstrap", f"""with {_DAYS}, u as (select rep, num, den, {_U(3, "rep", "day")} as u from d, (select unnest(range(1, 501)) as rep)), w as (select rep, num, den, (u >= exp(-1))::int + (u >= exp(-1) * 2)::int + (u >= exp(-1) * 2.5)::int + (u >= exp(-1) * (2.5 + 1 / 6.0))::int + (u >= exp(-1) * (2.5 + 1 / 6.0 + 1 / 24.0))::int + (u >= exp(-1) * (2.5 + 1 / 6.0 + 1 / 24.0 + 1 / 120.0))::int + (u >= exp(-1) * (2.5 + 1 / 6.0 + 1 / 24.0 + 1 / 120.0 + 1 / 720.0))::int + (u >= exp(-1) * (2.5 + 1 / 6.0 + 1 / 24.0 + 1 / 120.0 + 1 / 720.0 + 1 / 5040.0))::int as w from u),
 r as (select rep, sum(w * num) / nullif(sum(w * den), 0) as ratio from w group by 1) select round(quantile_cont(ratio, 0.025), 5) as low, round(quantile_cont(ratio, 0.5), 5) as middle, round(quantile_cont(ratio, 0.975), 5) as high from r""")
def r16(spark, d):
    """Interval of a daily ratio from 500 draws of days."""
    reps = st.cluster_bootstrap(days(spark, d), "day", 500, 3)
    return reps.agg(*(F.round(F.expr(f"percentile_cont({p}) within group (order by ratio)"), 5).alias(k) for k, p in {"low": 0.025, "middle": 0.5, "high": 0.975}.items()))


@query("r17_sign_flips", f"with x as (select epoch_us(ts) // 86400000000 as day, avg(value) - 50 as x from events group by 1), r as (select rep, abs(sum(case when {_U(5, 'rep', 'day')} < 0.5 then -x else x end)) as s from x, (select unnest(range(1, 501)) as rep) group by 1) select round((1 + count(*) filter (where s >= (select abs(sum(x)) from x))) / (1.0 + count(*)), 6) as p from r")
def r17(spark, d):
    x = days(spark, d).select("day", (F.col("num") / F.col("den") - 50).alias("x"))
    return st.sign_flip_p(x, "day", "x", 500, 5).withColumn("p", r6(F.col("p")))


@query("r17_without_largest_day", f"with a as (select epoch_us(ts) // 86400000000 as day, avg(value) - 50 as x from events group by 1), x as (select * from a where day <> (select day from a order by abs(x) desc, day limit 1)), r as (select rep, abs(sum(case when {_U(5, 'rep', 'day')} < 0.5 then -x else x end)) as s from x, (select unnest(range(1, 501)) as rep) group by 1) select round((1 + count(*) filter (where s >= (select abs(sum(x)) from x))) / (1.0 + count(*)), 6) as p, (select count(*) from x) as days from r")
def r17_without(spark, d):
    """The same test without the day that moves the sum most."""
    x = stored(st.without_most_influential(days(spark, d).select("day", (F.col("num") / F.col("den") - 50).alias("x")), "day", "x"))
    return st.sign_flip_p(x, "day", "x", 500, 5).select(r6(F.col("p")).alias("p")).crossJoin(F.broadcast(x.agg(F.count("*").alias("days"))))  # one row each


@query("r18_block_bootstrap", f"""with {_DAYS}, x as (select row_number() over (order by day) - 1 as i, num, den, count(*) over () as size from d), g as (select rep, j, floor({_U(11, "rep", "j")} * size)::bigint as start, size from (select unnest(range(1, 301)) as rep), (select distinct size from x), (select unnest(range(1, 1000)) as j) where j <= ceil(size / 4.0)),
 r as (select rep, sum(num) / sum(den) as ratio from (select rep, (start + k) % size as i from g, (select unnest(range(4)) as k)) join x using (i) group by 1) select round(quantile_cont(ratio, 0.025), 5) as low, round(quantile_cont(ratio, 0.975), 5) as high, count(*) as reps from r""")
def r18(spark, d):
    """Interval of a mean from circular blocks of four days."""
    reps = st.block_bootstrap(days(spark, d), "day", "num", "den", 300, 4, 11)
    return reps.agg(*(F.round(F.expr(f"percentile_cont({p}) within group (order by ratio)"), 5).alias(k) for k, p in {"low": 0.025, "high": 0.975}.items()), F.count("*").alias("reps"))


_PAIR = f"j as (select b.symbol, b.t, ln(b.volume) as x, greatest(-2, least(2, n.close / nullif(b.close, 0) - 1)) as y, b.taker_volume / b.volume::double as z from b join b n on n.symbol = b.symbol and n.t = b.t + {BAR} where b.close <> 0)"


def paired(spark, d):
    x = rolling(market(spark, d), KEYS, {"n": at_offset("close", BAR)}).where("close <> 0 and n is not null")
    return x.select("symbol", "t", F.ln("volume").alias("x"), F.greatest(F.lit(-2.0), F.least(F.lit(2.0), F.col("n") / F.col("close") - 1)).alias("y"), (F.col("taker_volume") / F.col("volume")).alias("z"))


@query("r13_projection_residual", with_bars("select j.symbol, j.t, round(y - slope * x - base, 5) as residual from j join (select symbol, regr_slope(y, x) as slope, regr_intercept(y, x) as base from j where t < 1705276800 group by 1) f on f.symbol = j.symbol", _PAIR))
def r13(spark, d):
    return st.residual(paired(spark, d), KEYS, "x", "y", F.col("t") < 1705276800).select("symbol", "t", F.round("residual", 5).alias("residual"))


@query("r19_partial_correlation", with_bars("""select f.symbol, j.t // 604800 as fold, round(corr(j.y - f.sy * j.x, j.z - f.sz * j.x), 5) as partial, count(*) as n from j join (select symbol, regr_slope(y, x) as sy, regr_slope(z, x) as sz from j group by 1) f on f.symbol = j.symbol group by 1, 2""", _PAIR))
def r19(spark, d):
    """Correlation of two columns with a third taken out of both, by week."""
    everywhere = F.lit(True)
    p = st.residual(paired(spark, d), KEYS, "x", "y", everywhere).withColumnRenamed("residual", "ry")
    p = st.residual(p, KEYS, "x", "z", everywhere)
    return p.groupBy("symbol", F.floor(F.col("t") / 604800).alias("fold")).agg(F.round(F.corr("ry", "residual"), 5).alias("partial"), F.count("*").alias("n"))


_SHIFTS = [0, 1, 3, 7, 11]


@query("r14_day_shift_placebo", with_bars(f"select l.symbol, shift, round(corr(l.y, r.x), 5) as corr, count(*) as n from j l join (select symbol, x, t % 86400 as s, (t // 86400 % 30 + shift) % 30 as day, shift from j, (select unnest({_SHIFTS}) as shift)) r on r.symbol = l.symbol and r.s = l.t % 86400 and r.day = l.t // 86400 % 30 group by 1, 2", _PAIR))
def r14(spark, d):
    return st.day_shift_placebo(paired(spark, d), KEYS, "x", "y", 30, _SHIFTS).select("symbol", "shift", F.round("corr", 5).alias("corr"), "n")


@query("r11_standardised", with_bars("select j.symbol, j.t, round(greatest(-10, least(10, (x - mx) / sx)), 5) as x, round(greatest(-10, least(10, (z - mz) / sz)), 5) as z from j join (select symbol, avg(x) as mx, stddev_pop(x) as sx, avg(z) as mz, stddev_pop(z) as sz from j where t < 1705276800 group by 1) f on f.symbol = j.symbol", _PAIR))
def r11(spark, d):
    z = st.standardised_on(paired(spark, d), KEYS, ["x", "z"], F.col("t") < 1705276800)
    return z.select("symbol", "t", F.round("x", 5).alias("x"), F.round("z", 5).alias("z"))


@query("r21_decile_spread", with_bars("select symbol, round((avg(y) filter (where r > c - c // 10) - avg(y) filter (where r <= c // 10)) * 10000, 3) as spread_bps, coalesce((avg(y) filter (where r > c - c // 10) - avg(y) filter (where r <= c // 10)) * 10000 > 10, false) as beats_cost from (select *, row_number() over (partition by symbol order by x, t) as r, count(*) over (partition by symbol) as c from j) group by 1", _PAIR))
def r21(spark, d):
    """Outcome of the top tenth by a prediction less that of the bottom tenth, against the cost of a round trip."""
    x = st.value_ranks(paired(spark, d), KEYS, "x", "t", "r")
    x = x.join(x.groupBy("symbol").agg(F.count("*").alias("c")), "symbol")
    tenth = F.floor(F.col("c") / 10)
    spread = (F.avg(F.when(F.col("r") > F.col("c") - tenth, F.col("y"))) - F.avg(F.when(F.col("r") <= tenth, F.col("y")))) * 10_000
    return x.groupBy("symbol").agg(spread.alias("s")).select("symbol", F.round("s", 3).alias("spread_bps"), F.coalesce(F.col("s") > 10, F.lit(False)).alias("beats_cost"))


@query("r23_stability", with_bars("select symbol, count(*) as parts, round((case when sum(e) >= 0 then count(*) filter (where e > 0) else count(*) filter (where e < 0) end) / count(*)::double, 6) as share, (case when sum(e) >= 0 then count(*) filter (where e > 0) else count(*) filter (where e < 0) end) / count(*)::double >= 0.75 as stable from (select symbol, t // 259200 as part, avg(y) as e from j group by 1, 2) group by 1", _PAIR))
def r23(spark, d):
    parts = paired(spark, d).groupBy("symbol", F.floor(F.col("t") / 259200).alias("part")).agg(F.avg("y").alias("e"))
    return st.stability(parts, KEYS, "e", "part").withColumn("share", r6(F.col("share")))


@query("r26_series_class", "select epoch_us(ts) // 86400000000 as day, case when count(*) % 5 <> 0 then 'complete' when count(*) % 2 = 0 then 'integrity_error' when count(*) % 3 = 0 then 'missing_by_protocol' when count(*) % 7 = 0 then 'transport_failure' else 'missing_by_protocol' end as class from events group by 1")
def r26(spark, d):
    x = events(spark, d).groupBy(F.floor(seconds(F.col("ts")) / 86400).alias("day")).agg(F.count("*").alias("n"))
    n = F.col("n")
    kind = carry.series_class(n % 5 != 0, n % 2 == 0, F.when(n % 3 != 0, F.lit("v2")), F.when(n % 7 != 0, n), F.lit(False))
    return x.select("day", kind.alias("class"))


_FOLDS = [(k, 1704067200 + k * 5 * 86400, 1704067200 + (k + 1) * 5 * 86400) for k in range(1, 5)]


@query("r7_walk_forward", with_bars(f"""select fold, arm, count(*) as n, round(avg(side * y), 6) as mean from (select fold, unnest(['model', 'abstain', 'always', 'random']) as arm, unnest([sign(x - m)::int, case when abs(x - m) > s then sign(x - m)::int else 0 end, 1, case when {_U(13, 'symbol', 't')} < 0.5 then -1 else 1 end]) as side, y
 from (select f.fold, j.*, g.m, g.s from j join (select * from (values {', '.join(map(str, _FOLDS))}) v(fold, lo, hi)) f on j.t >= lo and j.t < hi join (select fold, avg(x) as m, stddev_pop(x) as s from j join (select * from (values {', '.join(map(str, _FOLDS))}) v(fold, lo, hi)) on t < lo - 3600 group by 1) g on g.fold = f.fold)) where side <> 0 group by 1, 2""", _PAIR))
def r7(spark, d):
    """Four arms by fold: a side from the model, one that abstains near its threshold, always in, and a random one; thresholds
    come from rows before the fold, less an embargo."""
    folds = spark.createDataFrame(_FOLDS, "fold int, lo long, hi long")
    j = paired(spark, d)
    test = st.in_folds(j, folds.withColumnsRenamed({"lo": "train_start", "hi": "train_end"}))
    train = st.in_folds(j, folds.select("fold", F.lit(0).cast("long").alias("train_start"), F.col("lo").alias("train_end")), 3600).groupBy("fold").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    gap = F.col("x") - F.col("m")
    sides = {"model": F.signum(gap), "abstain": F.when(F.abs(gap) > F.col("s"), F.signum(gap)).otherwise(0.0), "always": F.lit(1.0), "random": F.when(st.uniform(13, F.col("symbol"), F.col("t")) < 0.5, -1.0).otherwise(1.0)}
    x = test.join(F.broadcast(train), "fold").select("fold", "y", F.explode(F.array(*(F.struct(F.lit(k).alias("arm"), s.alias("side")) for k, s in sides.items()))).alias("a"))  # a row a fold
    return x.select("fold", "y", "a.*").where("side <> 0").groupBy("fold", "arm").agg(F.count("*").alias("n"), r6(F.avg(F.col("side") * F.col("y"))).alias("mean"))


@query("r8_fold_verdict", with_bars("select symbol, count(*) as folds, round(avg((e > 0)::int), 6) as share_up, round(median(e), 5) as median_effect, case when avg((e > 0)::int) >= 0.6 and median(e) > 0 then 'pass' when avg((e > 0)::int) <= 0.4 then 'fail' else 'open' end as verdict from (select symbol, t // 432000 as fold, avg(y) as e from j group by 1, 2) group by 1", _PAIR))
def r8(spark, d):
    e = paired(spark, d).groupBy("symbol", F.floor(F.col("t") / 432000).alias("fold")).agg(F.avg("y").alias("e"))
    up, mid = F.avg((F.col("e") > 0).cast("int")), F.median("e")
    return e.groupBy("symbol").agg(F.count("*").alias("folds"), r6(up).alias("share_up"), F.round(mid, 5).alias("median_effect"), F.when((up >= 0.6) & (mid > 0), "pass").when(up <= 0.4, "fail").otherwise("open").alias("verdict"))


@query("r24_conformance", with_bars(f"select symbol, count(*) as claims, count(*) filter (where n = 1 and value = close) as exact, count(*) filter (where n = 1 and value <> close) as differing, count(*) filter (where n > 1) as ambiguous, count(*) filter (where close is null) as unmappable from (select e.event_type as symbol, e.value, b.close, count(*) over (partition by e.event_type, epoch_us(e.ts) // 1000000 // {BAR}) as n from events e left join b on b.symbol = e.event_type and b.t = epoch_us(e.ts) // 1000000 // {BAR} * {BAR}) group by 1"))
def r24(spark, d):
    """Claims that a bar's close explains exactly; bars that several claims share are ambiguous."""
    e = events(spark, d).select(F.col("event_type").alias("symbol"), (F.floor(seconds(F.col("ts")) / BAR) * BAR).alias("t"), "value")
    many = e.groupBy("symbol", "t").agg(F.count("*").alias("n"))
    x = e.join(many, ["symbol", "t"]).join(market(spark, d).select("symbol", "t", "close"), ["symbol", "t"], "left")
    one, same = F.col("n") == 1, F.col("value") == F.col("close")
    return x.groupBy("symbol").agg(F.count("*").alias("claims"), F.count_if(one & same).alias("exact"), F.count_if(one & ~same).alias("differing"), F.count_if(F.col("n") > 1).alias("ambiguous"), F.count_if(F.col("close").isNull()).alias("unmappable"))


@query("r25_probe_verdict", with_bars("""select day, count(*) as targets, count(p) as recovered, round(max(abs(p - c)), 6) as largest_gap, case when count(p) = 0 then 'not_recovered' when count(p) < count(*) then 'partial' when max(abs(p - c)) > 0 then 'recovered_differs' else 'recovered_exact' end as class
 from (select x.t // 86400 as day, x.close as c, case when x.t % 7 <> 0 or (x.t // 86400) % 2 = 0 then case when (x.t // 86400) % 3 = 0 then y.close else x.close end end as p from b x left join b y on y.symbol = 'view' and y.t = x.t where x.symbol = 'click') group by 1"""))
def r25(spark, d):
    """A probe's answers against the canonical bars, by day."""
    b = market(spark, d)
    day = F.floor(F.col("t") / 86400)
    x = b.where("symbol = 'click'").select("t", F.col("close").alias("c")).join(b.where("symbol = 'view'").select("t", F.col("close").alias("o")), "t", "left")
    x = x.select(day.alias("day"), "c", F.when((F.col("t") % 7 != 0) | (day % 2 == 0), F.when(day % 3 == 0, F.col("o")).otherwise(F.col("c"))).alias("p"))
    gap = F.max(F.abs(F.col("p") - F.col("c")))
    kind = F.when(F.count("p") == 0, "not_recovered").when(F.count("p") < F.count("*"), "partial").when(gap > 0, "recovered_differs").otherwise("recovered_exact")
    return x.groupBy("day").agg(F.count("*").alias("targets"), F.count("p").alias("recovered"), r6(gap).alias("largest_gap"), kind.alias("class"))


@query("r28_regimes", with_bars("""select day, case when v is null then 'unknown' when n > 1.05 * v then 'busy' when n < 0.95 * v then 'quiet' else 'normal' end as regime from (select day, n, case when count(*) over w >= 5 then median(n) over w end as v from (select t // 86400 as day, sum(volume)::bigint as n from b group by 1) window w as (order by day rows between 10 preceding and 1 preceding))"""))
def r28(spark, d):
    from pyspark.sql import Window

    x = market(spark, d).groupBy(F.floor(F.col("t") / 86400).alias("day")).agg(F.sum("volume").alias("n"))
    w = Window.partitionBy().orderBy("day").rowsBetween(-10, -1)  # one row a day
    x = x.withColumn("v", F.when(F.count("*").over(w) >= 5, F.expr("percentile(n, 0.5)").over(w)))
    return x.select("day", F.when(F.col("v").isNull(), "unknown").when(F.col("n") > 1.05 * F.col("v"), "busy").when(F.col("n") < 0.95 * F.col("v"), "quiet").otherwise("normal").alias("regime"))


@query("r29_phenomena", with_bars("""select symbol, t // 604800 as week, round(avg(y) filter (where (t // 86400 + 3) % 7 >= 5) - avg(y) filter (where (t // 86400 + 3) % 7 < 5), 5) as weekend_gap, round(avg(volume) filter (where t // 3600 % 24 between 13 and 20) / avg(volume), 5) as busy_hours, coalesce(avg(y) filter (where x > 1.5) > avg(y) filter (where x <= 1.5), false) as volume_helps
 from (select j.*, b.volume from j join b on b.symbol = j.symbol and b.t = j.t) group by 1, 2""", _PAIR))
def r29(spark, d):
    """Three tendencies by week: weekend against weekdays, busy hours, and what follows high volume."""
    x = paired(spark, d).join(market(spark, d).select("symbol", "t", "volume"), ["symbol", "t"])
    late = (F.floor(F.col("t") / 86400) + 3) % 7 >= 5
    mean = lambda c, on: F.avg(F.when(on, F.col(c)))
    return x.groupBy("symbol", F.floor(F.col("t") / 604800).alias("week")).agg(
        F.round(mean("y", late) - mean("y", ~late), 5).alias("weekend_gap"),
        F.round(mean("volume", (F.floor(F.col("t") / 3600) % 24).between(13, 20)) / F.avg("volume"), 5).alias("busy_hours"),
        F.coalesce(mean("y", F.col("x") > 1.5) > mean("y", F.col("x") <= 1.5), F.lit(False)).alias("volume_helps"),
    )


@query("r30_carry_statistics", with_bars(f"""select count(*) as settlements, round(corr(f.volume, m.basis), 5) as corr, round(avg(abs(m.basis)), 5) as mean_abs, round(avg((m.basis > 0)::int), 5) as share_positive from (select t, volume from b where symbol = 'purchase' and t % 28800 = 0) f join (select x.t as st, avg(p.close - s.close) as basis from (select t from b where symbol = 'purchase' and t % 28800 = 0) x join b p on p.symbol = 'click' and p.t >= x.t - 28800 and p.t < x.t join b s on s.symbol = 'view' and s.t = p.t group by 1) m on m.st = f.t"""))
def r30(spark, d):
    """Settlements against the mean basis of the eight hours before."""
    from ..operators.joins import interval_join

    b = market(spark, d)
    take = lambda s, c: b.where(F.col("symbol") == s).select("t", F.col("close").alias(c))
    basis = take("click", "p").join(take("view", "s"), "t").select(F.lit(1).alias("k"), "t", (F.col("p") - F.col("s")).alias("basis"))
    f = b.where("symbol = 'purchase' and t % 28800 = 0").select(F.lit(1).alias("k"), F.col("t").alias("end_t"), (F.col("t") - 28800).alias("start_t"), "volume")
    m = interval_join(f, basis, ["k"], "start_t", "end_t", "t", 28800).groupBy("end_t", "volume").agg(F.avg("basis").alias("basis"))
    return m.agg(F.count("*").alias("settlements"), F.round(F.corr("volume", "basis"), 5).alias("corr"), F.round(F.avg(F.abs("basis")), 5).alias("mean_abs"), F.round(F.avg((F.col("basis") > 0).cast("int")), 5).alias("share_positive"))


_BATCH = {"trend_4": ("trend", 4), "trend_8": ("trend", 8), "return_2": ("return", 2), "return_6": ("return", 6)}


def _signal_sql(name: str, op: str, w: int) -> str:
    over = f"over (partition by b.symbol order by b.t range between {(w - 1) * BAR} preceding and current row)"
    value = f"case when count(*) {over} = {w} then b.close / nullif(avg(b.close) {over}, 0) - 1 end" if op == "trend" else "b.close / nullif(p.close, 0) - 1"
    before = "" if op == "trend" else f" left join b p on p.symbol = b.symbol and p.t = b.t - {w * BAR}"
    return f"select '{name}' as rule, symbol, t, case when v > 0 then 1 when v < 0 then -1 else 0 end as side, y from (select b.symbol, b.t, {value} as v, case when n.close is not null and b.close <> 0 then greatest(-2, least(2, n.close / b.close - 1)) end as y from b left join b n on n.symbol = b.symbol and n.t = b.t + {BAR}{before})"


@query("b8_batch_evaluation", with_bars(
    "select rule, n, round(research, 6) as research, round(validation, 6) as validation, case when n < 100 then 'too_few' when research <= 0 then 'rejected' when validation <= 0 then 'not_confirmed' else 'survivor' end as status from x",
    "s as (" + " union all ".join(_signal_sql(k, op, w) for k, (op, w) in _BATCH.items()) + ")",
    "g as (select rule, case when t < 1705276800 then 'research' else 'validation' end as split, avg(side * y) as e, count(*) as n from s where side <> 0 and y is not null group by 1, 2)",
    "x as (select rule, max(e) filter (where split = 'research') as research, max(e) filter (where split = 'validation') as validation, max(n) filter (where split = 'research') as n from g group by 1)",
))
def b8(spark, d):
    """Many rules at once: targets from one pass, effects by rule and split, and a status for every one."""
    from ..functions.rules import compile_rules

    up = lambda op, w: {"long_if": {"op": "greater", "arg": {"op": op, "window": w}, "than": 0}, "short_if": {"op": "less", "arg": {"op": op, "window": w}, "than": 0}}
    rules = {k: up(op, w) for k, (op, w) in _BATCH.items()}
    x = rolling(compile_rules(market(spark, d), rules, KEYS), KEYS, {"n1": at_offset("close", BAR)}).where("close <> 0 and n1 is not null")
    y = F.greatest(F.lit(-2.0), F.least(F.lit(2.0), F.col("n1") / F.col("close") - 1))
    return st.batch_status(x.withColumns({"y": y, "split": F.when(F.col("t") < 1705276800, "research").otherwise("validation")}), list(rules), "y", 100).select("rule", "n", r6(F.col("research")).alias("research"), r6(F.col("validation")).alias("validation"), "status")


@query("b14_carry_trades", with_bars("""select x.t as id, round(q * (xs.close - x.spot) - q * (xp.close - x.perp), 5) as legs, x.n as settlements, round(x.funding, 5) as funding, round(0.0004 * q * (x.spot + xs.close + x.perp + xp.close), 5) as cost from (
 select e.t, e.spot, e.perp, 10.0 as q, count(f.t) as n, coalesce(sum(10.0 * f.close * 0.01), 0) as funding from (select p.t, s.close as spot, p.close as perp from b p join b s on s.symbol = 'view' and s.t = p.t where p.symbol = 'click' and p.t % 86400 = 0) e left join b f on f.symbol = 'click' and f.t % 28800 = 0 and f.t > e.t and f.t <= e.t + 172800 group by 1, 2, 3) x
 join b xs on xs.symbol = 'view' and xs.t = x.t + 172800 join b xp on xp.symbol = 'click' and xp.t = x.t + 172800"""))
def b14(spark, d):
    """Two-leg trades of two days: both legs, funding in between, four fills."""
    b = market(spark, d)
    spot, perp = (b.where(F.col("symbol") == s).select("t", F.col("close").alias(c)) for s, c in (("view", "spot"), ("click", "perp")))
    both = perp.join(spot, "t")
    out = both.select((F.col("t") - 172800).alias("t"), F.col("spot").alias("spot_exit"), F.col("perp").alias("perp_exit"))
    x = both.where("t % 86400 = 0").join(out, "t").select(F.lit(1).alias("k"), F.col("t").alias("id"), F.col("t").alias("entry_t"), (F.col("t") + 172800).alias("exit_t"), F.lit(10.0).alias("quantity"), F.col("spot").alias("spot_entry"), F.col("perp").alias("perp_entry"), "spot_exit", "perp_exit")
    paid = perp.where("t % 28800 = 0").select(F.lit(1).alias("k"), "t", F.lit(0.01).alias("rate"), F.col("perp").alias("mark"))
    y = carry.trade_pnl(carry.funding_cash(x, paid, ["k"]), 0.0004).where("identity_ok")
    return y.select("id", F.round(F.col("pnl") - F.col("funding") + F.col("cost"), 5).alias("legs"), "settlements", F.round("funding", 5).alias("funding"), F.round("cost", 5).alias("cost"))


_CANCEL, _CAPITAL = 3 * BAR, 250.0


@query("b14_two_leg_fills", with_bars(
    """select x.id, x.reason, x.entry_t, x.exit_kind, x.exit_t, round(x.q, 6) as quantity, round(x.q * (x.so - x.si) - x.q * (x.po - x.pi), 5) as legs, case when x.exit_t is not null then count(f.t) end as settlements, round(case when x.exit_t is not null then coalesce(sum(x.q * f.close * 0.01), 0) end, 5) as funding
 from x left join b f on f.symbol = 'click' and f.t % 28800 = 0 and f.t > x.entry_t and f.t <= x.exit_t group by x.id, x.reason, x.entry_t, x.exit_kind, x.exit_t, x.q, x.so, x.si, x.po, x.pi""",
    "two as (select p.t, s.open as spot, p.open as perp from b p join b s on s.symbol = 'view' and s.t = p.t where p.symbol = 'click' and p.t % 25200 <> 0 and s.open > 0 and p.open > 0)",
    f"s as (select t as id, t as a, t + 172800 as z from b where symbol = 'click' and t % 21600 = 0), i as (select s.*, case when n.t <= s.a + {_CANCEL} then n.t end as et, n.spot as si, n.perp as pi from s asof left join two n on s.a < n.t)",
    f"""q as (select *, greatest(z, et) as zz, floor({_CAPITAL} * 2 / (3 * si) / 0.5) * 0.5 as q from i),
 o as (select q.*, case when n.t <= q.zz + {_CANCEL} then n.t end as xt, n.spot as so, n.perp as po from q asof left join two n on q.zz < n.t), l as (select max(t) as t, arg_max(spot, t) as spot, arg_max(perp, t) as perp from two)""",
    """k as (select o.*, case when et is null then 'no_entry_fill' when q <= 0 then 'rounds_to_zero' when q * pi < 20 then 'below_least' end as reason, l.t as lt, l.spot as ls, l.perp as lp from o, l),
 m as (select *, case when reason is null then case when xt is not null then 'signal' when lt > et then 'last' else 'none' end end as exit_kind from k),
 x as (select id, reason, exit_kind, case when reason is null then et end as entry_t, case when reason is null then q end as q, si, pi, case exit_kind when 'signal' then xt when 'last' then lt end as exit_t, case exit_kind when 'signal' then so when 'last' then ls end as so, case exit_kind when 'signal' then po when 'last' then lp end as po from m)""",
))
def b14_fills(spark, d):
    """Two-leg trades from signals every six hours: fills at the next bars that have both legs, sizes in lots, and what holding paid."""
    b = stored(market(spark, d))
    spot, perp = (b.where(F.col("symbol") == s).select("t", F.col("open").alias(f"{c}_open")) for s, c in (("view", "spot"), ("click", "perp")))
    legs = perp.join(spot, "t", "full").withColumn("spot_open", F.when(F.col("t") % 25200 != 0, F.col("spot_open"))).withColumn("k", F.lit(1))
    signals = perp.where("t % 21600 = 0").select(F.lit(1).alias("k"), F.col("t").alias("id"), F.col("t").alias("entry_signal"), (F.col("t") + 172800).alias("exit_signal"))
    x = stored(carry.two_leg_fills(signals, legs, ["k"], _CANCEL, _CAPITAL, 2.0, 0.5, 20.0))
    paid = b.where("symbol = 'click' and t % 28800 = 0").select(F.lit(1).alias("k"), "t", F.lit(0.01).alias("rate"), F.col("close").alias("mark"))
    held = carry.funding_cash(x.where("exit_t is not null").select("k", "id", "entry_t", "exit_t", "quantity"), paid, ["k"]).select("id", "settlements", "funding")
    gain = F.col("quantity") * (F.col("spot_exit") - F.col("spot_entry")) - F.col("quantity") * (F.col("perp_exit") - F.col("perp_entry"))
    return x.join(held, "id", "left").select("id", "reason", "entry_t", "exit_kind", "exit_t", r6(F.col("quantity")).alias("quantity"), F.round(gain, 5).alias("legs"), "settlements", F.round("funding", 5).alias("funding"))


def _legs(spark, d):
    """A day's short leg of one series from its first open."""
    x = market(spark, d).where("symbol = 'click'").withColumn("trade", F.floor(F.col("t") / 86400))
    first = x.groupBy("trade").agg(F.min_by("open", "t").alias("entry"))
    cash = F.when(F.col("t") % 28800 == 0, 1.0).otherwise(0.0)
    return x.join(first, "trade").select("trade", F.col("t").alias("k"), F.lit(1.0).alias("quantity"), "entry", F.col("high").alias("mark_high"), F.col("close").alias("mark_close"), cash.alias("cash"))


_LEGS = """legs as (select *, 60 + sum(cash) over (partition by trade order by k) + q * (entry - high) as worst, q * high as notional, row_number() over (partition by trade order by k) as i
 from (select t // 86400 as trade, t as k, 1.0::double as q, first_value(open) over (partition by t // 86400 order by t) as entry, high, (case when t % 28800 = 0 then 1 else 0 end)::double as cash from b where symbol = 'click'))"""


@query("b15_margin_path", with_bars("select trade, k, case when hit is null or k <= hit then round(worst, 5) end as worst_margin, case when k = hit then 'liquidated' when k > hit then 'closed' else 'open' end as state from (select *, min(case when worst < 0.05 * notional then k end) over (partition by trade) as hit from legs)", _LEGS))
def b15(spark, d):
    """Bar by bar until the leg is liquidated."""
    return carry.margin_path(_legs(spark, d), "trade", "k", 60.0, 0.05).withColumn("worst_margin", F.round("worst_margin", 5))


_MORE = "case when not gone and l.worst + paid < 0.4 * l.notional then least(greatest(0.8 * l.notional - l.worst - paid, 0), 50 - paid) else 0 end"


@query("b15_topped_margin", with_bars(f"""select trade, k, round(topped, 5) as topped, round(ratio, 5) as ratio, state from (with recursive f as (select trade, 0::bigint as i, null::bigint as k, 0::double as paid, false as gone, 0::double as topped, null::double as ratio, '' as state from (select distinct trade from legs) union all
 select trade, i, k, paid + more, gone or (worst + paid + more) / notional <= 0.05, more, case when not gone then (worst + paid + more) / notional end, case when gone then 'closed' when (worst + paid + more) / notional <= 0.05 then 'liquidated' else 'open' end
 from (select f.trade, l.i, l.k, f.paid, f.gone, l.worst, l.notional, ({_MORE})::double as more from f join legs l on l.trade = f.trade and l.i = f.i + 1)) select * from f) where k is not null""", _LEGS))
def b15_topped(spark, d):
    """The same with a reserve that fills the margin up while it lasts."""
    x = carry.topped_margin(_legs(spark, d), "trade", "k", 60.0, 50.0, 0.4, 0.8, 0.05)
    return x.withColumns({c: F.round(c, 5) for c in ("topped", "ratio")})


@query("b18_resolved_mark", with_bars("""select symbol, t, case when r is not null and r not in ('', 'x') and try_cast(r as double) > 0 then round(try_cast(r as double), 6) when volume > 1 and open > 0 then round(open, 6) end as mark, case when r is not null and r not in ('', 'x') and try_cast(r as double) > 0 then 'published' when volume > 1 and open > 0 then 'bar_open' else 'unavailable' end as mark_source,
 case when r is null or r = '' then 'absent' when r = 'x' then 'unparseable' when try_cast(r as double) <= 0 then 'non_positive' else 'valid' end as mark_reason from (select *, case when t // 3600 % 7 = 0 then null when t // 3600 % 5 = 0 then '' when t // 3600 % 3 = 0 then 'x' when t // 3600 % 11 = 0 then '-1' else close::decimal(18,6)::varchar end as r from b where t % 28800 = 0)"""))
def b18(spark, d):
    h = F.floor(F.col("t") / 3600)
    rest = F.when(h % 7 == 0, None).when(h % 5 == 0, "").when(h % 3 == 0, "x").when(h % 11 == 0, "-1").otherwise(F.col("close").cast("decimal(18,6)").cast("string"))
    x = market(spark, d).where("t % 28800 = 0").select("symbol", "t", *(c.alias(k) for k, c in carry.resolved_mark(rest, F.col("open"), F.when(F.col("volume") > 1, "complete").otherwise("route_unverified")).items()))
    return x.withColumn("mark", r6(F.col("mark")))
