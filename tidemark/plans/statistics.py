"""Queries of statistical operators; those with drawn numbers have no SQL and are tested on their own."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import statistics as st
from ..operators.bars import BAR, MONEY, at_offset, rolling, seconds
from ..operators.quantiles import quantiles
from .common import events, market, r6, with_bars
from .registry import query

KEYS = ["symbol"]


def hourly(spark, d):
    return events(spark, d).select("event_id", F.col("value").alias("x"), (F.floor(seconds(F.col("ts")) / 3600) % 6).cast("int").alias("phase"), F.floor(seconds(F.col("ts")) / 86400).alias("day"))


@query("r1_phase_effects", """with x as (select (epoch_us(ts) // 3600000000 % 6)::int as phase, value as x from events), g as (select phase, count(*) as n, sum(x) as s, sum(x * x) as q from x group by 1), a as (select sum(n) as n, sum(s) as s, sum(q) as q from g),
 r as (select phase, g.n, g.s, g.q, a.n - g.n as rn, a.s - g.s as rs, a.q - g.q as rq from g, a) select phase, n, round(s / n - rs / rn, 5) as effect, round((s / n - rs / rn) / sqrt((q - s * s / n) / (n - 1) / n + (rq - rs * rs / rn) / (rn - 1) / rn), 5) as welch_t from r""")
def r1(spark, d):
    return st.group_effects(hourly(spark, d), "phase", "x").withColumns({c: F.round(c, 5) for c in ("effect", "welch_t")})


@query("r3_largest_phase", "with g as (select (epoch_us(ts) // 3600000000 % 6)::int as phase, round(avg(value), 6) as m from events group by 1) select phase, m from g order by m desc, phase limit 1")
def r3(spark, d):
    g = hourly(spark, d).groupBy("phase").agg(r6(F.avg("x")).alias("m"))
    return g.orderBy(F.desc("m"), "phase").limit(1)


@query("r4_regime_cells", "with x as (select (epoch_us(ts) // 3600000000 % 6)::int as phase, user_id, value from events), m as (select median(user_id) as m from x) select phase, user_id > m as high, count(*) as n, round(avg(value), 6) as mean from x, m group by 1, 2")
def r4(spark, d):
    x = events(spark, d).select((F.floor(seconds(F.col("ts")) / 3600) % 6).cast("int").alias("phase"), "user_id", "value")
    m = quantiles(x, [], "user_id", {"m": ("cont", 0.5)}).select("m")
    return x.crossJoin(F.broadcast(m)).groupBy("phase", (F.col("user_id") > F.col("m")).alias("high")).agg(F.count("*").alias("n"), r6(F.avg("value")).alias("mean"))  # one row


def labelled(spark, d):
    df = rolling(market(spark, d), KEYS, {"c1": at_offset("close", -BAR), "n1": at_offset("close", BAR), "m": (F.avg("close"), -6 * BAR, -1), "v": (F.avg("volume"), -6 * BAR, -1)})
    ok = df.where("c1 > 0 and n1 is not null and close > 0 and m > 0 and v > 0")
    clip = lambda c: F.greatest(F.least(F.ln(c), F.lit(3.0)), F.lit(-3.0))
    return ok.select("symbol", "t", clip(F.col("close") / F.col("c1")).alias("f1"), clip(F.col("close") / F.col("m")).alias("f2"), clip(F.col("volume") / F.col("v")).alias("f3"), clip(F.greatest(F.col("n1"), F.lit(0.01)) / F.col("close")).alias("y"), (F.floor(F.col("t") / 604800) % 5).cast("int").alias("fold"))


@query("r5_logistic")
def r5(spark, d):
    """Direction of the next bar from three features; weights of a ridge logistic fit."""
    x = VectorAssembler(inputCols=["f1", "f2", "f3"], outputCol="features").transform(labelled(spark, d).withColumn("label", (F.col("y") > 0).cast("double")))
    m = LogisticRegression(regParam=0.01, elasticNetParam=0.0).fit(x)
    return x.limit(1).select(F.lit([*m.coefficients.toArray().tolist(), m.intercept]).cast("array<double>").alias("weights"))


@query("r6_standardised", with_bars("select symbol, t, round((close - m) / s, 5) as z from b join (select symbol as k, avg(close) as m, stddev_pop(close) as s from b where t < 1705276800 group by 1) f on f.k = b.symbol and s > 0"))
def r6_standardised(spark, d):
    """By the mean and population deviation of the training rows alone."""
    b = market(spark, d)
    f = b.where("t < 1705276800").groupBy("symbol").agg(F.avg("close").alias("m"), F.stddev_pop("close").alias("s")).where("s > 0")
    return b.join(f, "symbol").select("symbol", "t", F.round((F.col("close") - F.col("m")) / F.col("s"), 5).alias("z"))


@query("r10_ridge_folds")
def r10(spark, d):
    features = ["f1", "f2", "f3"]
    return st.ridge(st.gram(labelled(spark, d), ["fold"], features, "y"), "fold", features, 1.0)


@query("r12_out_of_sample_r2")
def r12(spark, d):
    return r10(spark, d).agg((1 - F.sum("sse") / F.sum("sst")).alias("r2"), F.min(1 - F.col("sse") / F.col("sst")).alias("worst_fold"), F.sum("n").alias("n"))


@query("r20_correlations", with_bars("select symbol, round(corr(close, volume), 5) as pearson, round(corr(rc, rv), 5) as spearman from (select *, row_number() over (partition by symbol order by close, t) as rc, row_number() over (partition by symbol order by volume, t) as rv from b) group by 1"))
def r20(spark, d):
    x = st.value_ranks(market(spark, d).select("symbol", "t", "close", "volume"), KEYS, "close", "t", "rc")
    x = st.value_ranks(x, KEYS, "volume", "t", "rv")
    return x.groupBy("symbol").agg(F.round(F.corr("close", "volume"), 5).alias("pearson"), F.round(F.corr("rc", "rv"), 5).alias("spearman"))


_P = "p as (select event_type as test, case when event_type = 'view' then null else count(*) filter (where value > 95) / count(*)::double end as p from events group by 1)"


@query("r22_many_tests", f"with {_P}, x as (select test, coalesce(p, 1.0) as p, row_number() over (order by coalesce(p, 1.0), test) as r, count(*) over () as m from p) select test, round(least(1, max((m - r + 1) * p) over (order by r)), 6) as holm, round(least(1, min(m * p / r) over (order by r rows between current row and unbounded following)), 6) as bh from x")
def r22(spark, d):
    tests = events(spark, d).groupBy(F.col("event_type").alias("test")).agg((F.count_if(F.col("value") > 95) / F.count("*")).alias("q")).select("test", F.when(F.col("test") != "view", F.col("q")).alias("p"))
    return st.adjusted(tests).select("test", r6(F.col("holm")).alias("holm"), r6(F.col("bh")).alias("bh"))


@query("w18_trailing_median", "with d as (select epoch_us(ts) // 86400000000 as day, count(*) as n from events group by 1) select day, case when count(*) over w >= 5 then median(n) over w end as med from d window w as (order by day rows between 10 preceding and 1 preceding)")
def w18(spark, d):
    days = events(spark, d).groupBy(F.floor(seconds(F.col("ts")) / 86400).alias("day")).agg(F.count("*").alias("n"))
    w = Window.partitionBy().orderBy("day").rowsBetween(-10, -1)  # one row a day
    return days.select("day", F.when(F.count("*").over(w) >= 5, F.expr("percentile(n, 0.5)").over(w)).alias("med"))


_LABELLED = f"""l as (select (b.t // 604800 % 5)::int as fold, greatest(-3, least(3, ln(b.close / p.close))) as x, greatest(-3, least(3, ln(greatest(n.close, 0.01) / b.close))) as y from (select *, avg(close) over w as m, avg(volume) over w as v from b window w as (partition by symbol order by t range between {6 * BAR} preceding and 1 preceding)) b
 join b p on p.symbol = b.symbol and p.t = b.t - {BAR} join b n on n.symbol = b.symbol and n.t = b.t + {BAR} where p.close > 0 and b.close > 0 and b.m > 0 and b.v > 0)"""
_ONE_FEATURE = [
    _LABELLED,
    "s as (select fold, count(*) as n, sum(x) as sx, sum(y) as sy, sum(x * x) as sxx, sum(x * y) as sxy, sum(y * y) as syy from l group by 1)",
    "a as (select s.*, o.n - s.n as tn, o.sx - s.sx as tx, o.sy - s.sy as ty, o.sxx - s.sxx as txx, o.sxy - s.sxy as txy from s, (select sum(n) as n, sum(sx) as sx, sum(sy) as sy, sum(sxx) as sxx, sum(sxy) as sxy from s) o)",
    "w as (select *, (txy - tx * ty / tn) / (txx - tx * tx / tn + 1.0) as slope from a)",
    "f as (select *, (ty - slope * tx) / tn as base, ty / tn as mean from w)",
    "e as (select fold, n, slope, base, syy - 2 * (base * sy + slope * sxy) + base * base * n + 2 * base * slope * sx + slope * slope * sxx as sse, syy - 2 * mean * sy + mean * mean * n as sst from f)",
]


def _one_feature(spark, d):
    return st.ridge(st.gram(labelled(spark, d), ["fold"], ["f1"], "y"), "fold", ["f1"], 1.0)


@query("r10_ridge_one_feature", with_bars("select fold, n, round(base, 5) as base, round(slope, 5) as slope, round(sse, 4) as sse, round(sst, 4) as sst from e", *_ONE_FEATURE))
def r10_one(spark, d):
    """The ridge folds with a single feature, whose solution SQL can write down."""
    return _one_feature(spark, d).select("fold", "n", F.round(F.get("weights", 0), 5).alias("base"), F.round(F.get("weights", 1), 5).alias("slope"), F.round("sse", 4).alias("sse"), F.round("sst", 4).alias("sst"))


@query("r12_r2_one_feature", with_bars("select round(1 - sum(sse) / sum(sst), 6) as r2, round(min(1 - sse / sst), 6) as worst_fold, sum(n)::bigint as n from e", *_ONE_FEATURE))
def r12_one(spark, d):
    return _one_feature(spark, d).agg(r6(1 - F.sum("sse") / F.sum("sst")).alias("r2"), r6(F.min(1 - F.col("sse") / F.col("sst"))).alias("worst_fold"), F.sum("n").alias("n"))


@query("r12_leave_one_fold_out", with_bars("select fold, round(1 - ((select sum(sse) from e) - sse) / ((select sum(sst) from e) - sst), 6) as r2_without, round((1 - sse / sst) - (1 - (select sum(sse) from e) / (select sum(sst) from e)), 6) as delta from e", *_ONE_FEATURE))
def r12_without(spark, d):
    """R2 with each fold left out, and each fold's own R2 less the whole's."""
    x = _one_feature(spark, d)
    total = x.agg(F.sum("sse").alias("a"), F.sum("sst").alias("b"))
    x = x.crossJoin(F.broadcast(total))  # one row
    return x.select("fold", r6(1 - (F.col("a") - F.col("sse")) / (F.col("b") - F.col("sst"))).alias("r2_without"), r6(F.col("a") / F.col("b") - F.col("sse") / F.col("sst")).alias("delta"))
