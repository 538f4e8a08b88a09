"""Queries of fitted folds and their controls: walk-forward arms, thinned signals, random entries, stationary bootstraps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import statistics as st
from ..operators import trials
from ..operators.bars import BAR, at_offset, rolling
from .common import market, r6, stored, with_bars
from .registry import query
from .rules import KEYS
from .trials import _FOLDS, _PAIR, _U, paired

_PENALTY, _LEAST_BPS = 1e-3, 60.0
_FOLD_SQL = f"folds as (select * from (values {', '.join(map(str, _FOLDS))}) v(fold, lo, hi))"
_TRAIN_SQL = "tr as (select fold, x, y, (y > 0)::int as up from j join folds on t < lo - 3600)"


def _newton_sql(steps: int) -> list[str]:
    """A fit of one feature, step by step."""
    out = ["w0 as (select fold, count(*)::double as n, avg(x) as m, case when stddev_pop(x) > 0 then stddev_pop(x) else 1 end as s, avg(abs(y)) * 10000 as size, 0.0::double as a, 0.0::double as b from tr group by 1)"]
    for k in range(steps):
        out.append(f"""w{k + 1} as (select fold, n, m, s, size, a - (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01) as a, b - (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) as b from
 (select fold, any_value(n) as n, any_value(m) as m, any_value(s) as s, any_value(size) as size, any_value(a) as a, any_value(b) as b, avg(p - up) as g0, avg((p - up) * z) + {_PENALTY} * any_value(b) as g1, avg(p * (1 - p)) as h00, avg(p * (1 - p) * z) as h01, avg(p * (1 - p) * z * z) + {_PENALTY} as h11
  from (select w.*, tr.up, (tr.x - w.m) / w.s as z, 1 / (1 + exp(-(w.a + w.b * (tr.x - w.m) / w.s))) as p from tr join w{k} w using (fold)) group by 1))""")
    return out


_FITTED_SQL = [_PAIR, _FOLD_SQL, _TRAIN_SQL, *_newton_sql(7)]
_SIDES_SQL = [
    "e as (select fold, symbol, t, y, (2 / (1 + exp(-(a + b * (x - m) / s))) - 1) * size as edge from j join folds on t >= lo and t < hi join w7 using (fold))",
    f"g as (select *, case when edge > 0 then 1 when edge < 0 then -1 else 0 end as model, case when edge > {_LEAST_BPS} then 1 when edge < -{_LEAST_BPS} then -1 else 0 end as abstain from e)",
    "h as (select *, max(start) over (partition by fold, symbol order by t rows between unbounded preceding and current row) as run from (select *, case when model is distinct from lag(model) over (partition by fold, symbol order by t) then t end as start from g))",
    f"c as (select h.*, case when {_U(29, 'fold', 'symbol', 'run')} < rate then model else 0 end as control from h join (select fold, coalesce(count(*) filter (where abstain <> 0) / nullif(count(*) filter (where model <> 0), 0)::double, 0) as rate from h group by 1) using (fold))",
]


def _fitted(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Test rows and training rows by fold, and the fold's fit on its training rows."""
    folds = spark.createDataFrame(_FOLDS, "fold int, lo long, hi long")
    j = stored(paired(spark, d))
    test = st.in_folds(j, folds.withColumnsRenamed({"lo": "train_start", "hi": "train_end"})).drop("train_start", "train_end")
    train = st.in_folds(j, folds.select("fold", F.lit(0).cast("long").alias("train_start"), F.col("lo").alias("train_end")), 3600)
    train = stored(train.select("fold", "x", "y", (F.col("y") > 0).cast("int").alias("up")))
    return test, train, trials.logistic_fits(train, ["fold"], ["x"], "up", _PENALTY)


@query("r5_logistic_folds", with_bars("select fold, n::bigint as n, round(m, 6) as mean, round(s, 6) as deviation, round(a, 5) as base, round(b, 5) as weight from w7", *_FITTED_SQL))
def r5_folds(spark, d):
    """Direction of the next bar from one feature, fitted by fold on the rows before it less an embargo."""
    fits = _fitted(spark, d)[2]
    at = lambda k, i, digits: F.round(F.get(k, F.lit(i)), digits)
    return fits.select("fold", "n", at("mean", 0, 6).alias("mean"), at("deviation", 0, 6).alias("deviation"), at("weights", 0, 5).alias("base"), at("weights", 1, 5).alias("weight"))


@query("r7_fitted_arms", with_bars("select fold, arm, count(*) filter (where side <> 0) as active, round(avg(side * y), 6) as mean, round(avg(side * y) filter (where side <> 0), 6) as mean_active from (select fold, y, unnest(['model', 'abstain', 'control', 'always']) as arm, unnest([model, abstain, control, 1]) as side from c) group by 1, 2", *_FITTED_SQL, *_SIDES_SQL))
def r7_fitted(spark, d):
    """Four arms by fold: the fitted model's side, the side where its edge exceeds the cost, the model's runs thinned to that exposure,
    and always in."""
    test, train, fits = _fitted(spark, d)
    size = train.groupBy("fold").agg((F.avg(F.abs("y")) * 10_000).alias("size"))
    edge = (2 * trials.chance(["x"]) - 1) * F.col("size")
    side = lambda least: F.when(F.col("edge") > least, 1).when(F.col("edge") < -least, -1).otherwise(0)
    x = test.join(fits, "fold").join(size, "fold").select("fold", "symbol", "t", "y", edge.alias("edge")).withColumns({"model": side(0.0), "abstain": side(_LEAST_BPS)})
    x = trials.exposure_matched(stored(x), ["fold", "symbol"], ["fold"], "model", "abstain", 29)
    arms = F.explode(F.array(*(F.struct(F.lit(k).alias("arm"), s.alias("side")) for k, s in {"model": F.col("model"), "abstain": F.col("abstain"), "control": F.col("control"), "always": F.lit(1)}.items())))
    x = x.select("fold", "y", arms.alias("a")).select("fold", "y", "a.*")
    gain = F.col("side") * F.col("y")
    return x.groupBy("fold", "arm").agg(F.count_if(F.col("side") != 0).alias("active"), r6(F.avg(gain)).alias("mean"), r6(F.avg(F.when(F.col("side") != 0, gain))).alias("mean_active"))


_REPS, _BLOCK = 200, 5
_TRADES_SQL = [
    f"o as (select b.t, b.close > b.open as long_hold, q.close / b.close - 1 as r4, n.close / b.close - 1 as r1 from b left join b q on q.symbol = b.symbol and q.t = b.t + {4 * BAR} left join b n on n.symbol = b.symbol and n.t = b.t + {BAR} where b.symbol = 'click' and b.close > 0)",
    "s as (select t, '4h' as hold, greatest(-3, least(3, r4)) as outcome from o where r4 is not null union all select t, '1h', greatest(-3, least(3, r1)) from o where r1 is not null)",
    f"x as (select s.t as id, s.* from s join o using (t) where s.t % {4 * BAR} = 0 and hold = case when long_hold then '4h' else '1h' end)",
]


def _trades(spark, d) -> tuple[DataFrame, DataFrame]:
    """Trades entered every four hours, held for four hours after a rise and for one otherwise, so that none overlaps; and all slots."""
    b = rolling(market(spark, d).where("symbol = 'click'"), KEYS, {"c4": at_offset("close", 4 * BAR), "c1": at_offset("close", BAR)}).where("close > 0")
    cut = lambda c: F.greatest(F.lit(-3.0), F.least(F.lit(3.0), F.col(c) / F.col("close") - 1))
    kinds = F.array(*(F.struct(F.lit(k).alias("hold"), F.when(F.col(c).isNotNull(), cut(c)).alias("outcome")) for k, c in {"4h": "c4", "1h": "c1"}.items()))
    s = stored(b.select("t", (F.col("close") > F.col("open")).alias("up"), F.explode(kinds).alias("k")).select("t", "up", "k.*").where("outcome is not null"))
    return s.where((F.col("t") % (4 * BAR) == 0) & (F.col("hold") == F.when(F.col("up"), "4h").otherwise("1h"))).select(F.col("t").alias("id"), "t", "hold", "outcome"), s.drop("up")


_Z = 1.959963984540054


@query("r30_stationary_bootstrap", with_bars(
    f"""select (select count(*) from x) as n, round((select avg(outcome) from x), 6) as mean, round(quantile_cont(m, 0.025), 5) as low, round(quantile_cont(m, 0.975), 5) as high, count(*) as reps,
 (select case when count(*) >= 3 then round(({_Z} + {_Z**3 + _Z} / (4 * (count(*) - 1)) + {5 * _Z**5 + 16 * _Z**3 + 3 * _Z} / (96 * (count(*) - 1) ** 2) + {3 * _Z**7 + 19 * _Z**5 + 17 * _Z**3 - 15 * _Z} / (384 * (count(*) - 1) ** 3)) * stddev_samp(outcome) / sqrt(count(*)), 5) end from x) as detectable from m""",
    *_TRADES_SQL,
    "k as (select row_number() over (order by t) as i, outcome, count(*) over () as size from x)",
    f"f as (select rep, i, size, max(case when i = 1 or {_U(31, 'rep', 'i')} < {1 / _BLOCK} then i end) over (partition by rep order by i rows between unbounded preceding and current row) as b from k, (select unnest(range(1, {_REPS + 1})) as rep))",
    f"m as (select rep, avg(k.outcome) as m from (select rep, (floor({_U(32, 'rep', 'b')} * size)::bigint + i - b) % size + 1 as i from f) d join k using (i) group by 1)",
))
def r30_stationary(spark, d):
    """Interval of the trades' mean by a stationary bootstrap of trades, and the smallest mean that they could tell from 0."""
    x = _trades(spark, d)[0]
    reps = trials.stationary_bootstrap(x, "t", "outcome", _REPS, _BLOCK, 31)
    own = x.agg(F.count("*").alias("n"), r6(F.avg("outcome")).alias("mean"), F.stddev_samp("outcome").alias("sd"))
    own = own.select("n", "mean", F.round(trials.least_detectable(F.col("n"), F.col("sd")), 5).alias("detectable"))
    ends = reps.agg(*(F.round(F.expr(f"percentile_cont({p}) within group (order by mean)"), 5).alias(k) for k, p in {"low": 0.025, "high": 0.975}.items()), F.count("*").alias("reps"))
    return own.crossJoin(F.broadcast(ends))  # one row


@query("r30_random_entries", with_bars(
    "select round((1 + count(*) filter (where round(m, 9) >= round((select avg(outcome) from x), 9))) / (1 + count(*)), 6) as p, round(avg(m), 6) as null_mean, min(n) as trades, count(*) as reps from m",
    *_TRADES_SQL,
    "k as (select hold, outcome, row_number() over (partition by hold order by t) as i, count(*) over (partition by hold) as size from s)",
    f"q as (select rep, x.hold, floor({_U(37, 'rep', 'id')} * size)::bigint + 1 as i from x join (select distinct hold, size from k) using (hold), (select unnest(range(1, {_REPS + 1})) as rep))",
    "m as (select rep, count(*) as n, avg(outcome) as m from q join k using (hold, i) group by 1)",
))
def r30_random(spark, d):
    """Trades against the same number of entries at random times, held as long."""
    x, slots = _trades(spark, d)
    null = trials.random_entries(x, slots, "hold", _REPS, 37)
    seen = x.agg(F.avg("outcome").alias("o"))
    reach = F.round("mean", 9) >= F.round("o", 9)
    return null.crossJoin(F.broadcast(seen)).agg(F.round((1 + F.count_if(reach)) / (1 + F.count("*")), 6).alias("p"), r6(F.avg("mean")).alias("null_mean"), F.min("n").alias("trades"), F.count("*").alias("reps"))  # one row


_FEW, _ALL, _MOST = [2, 5, 9, 14, 18, 23, 27], list(range(1, 30)), 1


@query("r15_two_stages", with_bars(
    f"""select o.symbol, round(o.corr, 5) as corr, k_1, e_1 as exceed_1, e_1 <= {_MOST} as candidate, case when e_1 <= {_MOST} then k_2 end as k_2, case when e_1 <= {_MOST} then e_2 end as exceed_2, round(case when e_1 <= {_MOST} then (1 + e_2) / (1.0 + k_2) else (1 + e_1) / (1.0 + k_1) end, 6) as p, round(case when e_1 <= {_MOST} then d_2 else d_1 end, 5) as detectable
 from o join (select symbol, count(*) filter (where few) as k_1, count(*) as k_2, count(*) filter (where few and n.corr >= o.corr) as e_1, count(*) filter (where n.corr >= o.corr) as e_2, quantile_cont(n.corr, 0.95) filter (where few) as d_1, quantile_cont(n.corr, 0.95) as d_2 from n join o using (symbol) group by 1) using (symbol)""",
    _PAIR,
    f"c as (select l.symbol, shift, abs(corr(l.y, r.x)) as corr from j l join (select symbol, x, t % 86400 as s, (t // 86400 % 30 + shift) % 30 as day, shift from j, (select unnest({[0, *_ALL]}) as shift)) r on r.symbol = l.symbol and r.s = l.t % 86400 and r.day = l.t // 86400 % 30 group by 1, 2)",
    "o as (select symbol, corr from c where shift = 0)",
    f"n as (select symbol, corr, shift in ({', '.join(map(str, _FEW))}) as few from c where shift <> 0)",
))
def r15_stages(spark, d):
    """Correlations against day shifts: few shifts for all series, all shifts for those whose rank can reach the floor."""
    j = stored(paired(spark, d))
    draws = lambda cells, shifts: st.day_shift_placebo(j.join(cells, KEYS, "left_semi"), KEYS, "x", "y", 30, shifts).select(*KEYS, F.abs("corr").alias("corr"))
    observed = draws(j.select(*KEYS).distinct(), [0])
    x = trials.two_stages(observed, lambda cells: draws(cells, _FEW), lambda cells: draws(cells, _ALL), KEYS, "corr", _MOST)
    return x.select("symbol", F.round("corr", 5).alias("corr"), "k_1", "exceed_1", "candidate", "k_2", "exceed_2", r6(F.col("p")).alias("p"), F.round("detectable", 5).alias("detectable"))
