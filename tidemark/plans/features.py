"""Queries over bars: features, labels, windows, gaps and scalar functions."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..operators.bars import BAR, at_offset, complete, gaps, grid, ordered, prefix, rolling
from ..operators.quantiles import quantiles
from ..operators.ranks import below_before
from .common import events, market, r6, stored, with_bars
from .registry import query

KEYS = ["symbol"]
DAY = 86400


def _ret(df: DataFrame, bars: int = 1) -> DataFrame:
    return rolling(df, KEYS, {"before": at_offset("close", -bars * BAR)}).withColumn("ret", fn.simple_return(F.col("close"), F.col("before")))


_RET_SQL = f"r as (select b.*, b.close / nullif(p.close, 0) - 1 as ret from b left join b p on p.symbol = b.symbol and p.t = b.t - {BAR})"


@query("s1_scan_projection", "select event_id, event_type from events where value > 90")
def s1(spark, d):
    return events(spark, d).where("value > 90").select("event_id", "event_type")


@query("s2_warm_scan", with_bars(f"select symbol, t, round(avg(close) over (partition by symbol order by t range between {20 * BAR - BAR} preceding and current row), 6) as sma from b qualify t >= 1705276800"))
def s2(spark, d):
    """Reads 20 bars more than asked for, then trims, so that the first windows are whole."""
    from ..operators.bars import bars

    start = 1705276800
    warm = events(spark, d).where(F.col("ts") >= F.lit(datetime.fromtimestamp(start - 20 * BAR, UTC).replace(tzinfo=None)).cast("timestamp_ntz"))
    return rolling(bars(warm), KEYS, {"sma": (F.avg("close"), -19 * BAR, 0)}).where(F.col("t") >= start).select("symbol", "t", r6(F.col("sma")).alias("sma"))


@query("bars", with_bars("select * from b"))
def bars_query(spark, d):
    return market(spark, d)


@query("a1_condition_outcome", with_bars(
    f"select count(*) as n, round(avg(y), 6) as mean, round(median(y), 6) as median, round(avg((y > 0)::int), 6) as win_rate, round(quantile_cont(y, 0.1), 6) as p10, round(quantile_cont(y, 0.9), 6) as p90 from l where ret > 0 and vr > 1 and y is not null",
    _RET_SQL,
    f"v as (select *, volume / nullif(case when count(*) over w >= 15 then sum(volume) over w end / count(*) over w, 0) as vr from r window w as (partition by symbol order by t range between {20 * BAR} preceding and 1 preceding))",
    f"l as (select v.*, n.close / nullif(v.close, 0) - 1 as y from v left join b n on n.symbol = v.symbol and n.t = v.t + {BAR})",
))
def a1(spark, d):
    """How often a rise on above-average volume occurred, and the next bar's return."""
    df = rolling(market(spark, d), KEYS, {"before": at_offset("close", -BAR), "after": at_offset("close", BAR), "vol": (F.sum("volume"), -20 * BAR, -1), "n": (F.count("*"), -20 * BAR, -1)})
    ret, y = fn.simple_return(F.col("close"), F.col("before")), fn.simple_return(F.col("after"), F.col("close"))
    ratio = fn.ratio(F.col("volume"), complete(F.col("vol"), F.col("n"), 15) / F.col("n"))
    hits = stored(df.where((ret > 0) & (ratio > 1)).select(y.alias("y")).where("y is not null"))
    ranks = quantiles(hits, [], "y", {"median": ("cont", 0.5), "p10": ("cont", 0.1), "p90": ("cont", 0.9)}).drop("n")
    sums = hits.agg(F.count("*").alias("n"), r6(F.avg("y")).alias("mean"), r6(F.avg((F.col("y") > 0).cast("int"))).alias("win_rate"))
    return sums.join(F.broadcast(ranks), F.lit(True), "left").select("n", "mean", r6(F.col("median")).alias("median"), "win_rate", r6(F.col("p10")).alias("p10"), r6(F.col("p90")).alias("p90"))  # one row each


@query("j1_offset_join", with_bars(f"select b.symbol, b.t, p.close as close_1, q.close as close_3, f.open as open_next from b left join b p on p.symbol=b.symbol and p.t=b.t-{BAR} left join b q on q.symbol=b.symbol and q.t=b.t-{3 * BAR} left join b f on f.symbol=b.symbol and f.t=b.t+{BAR}"))
def j1(spark, d):
    return rolling(market(spark, d), KEYS, {"close_1": at_offset("close", -BAR), "close_3": at_offset("close", -3 * BAR), "open_next": at_offset("open", BAR)}).select("symbol", "t", "close_1", "close_3", "open_next")


@query("w1_volume_ratio", with_bars(f"select symbol, t, case when count(*) over w = 20 then round(volume / (sum(volume) over w / 20.0), 6) end as volume_ratio_20 from b window w as (partition by symbol order by t range between {20 * BAR} preceding and 1 preceding)"))
def w1(spark, d):
    df = rolling(market(spark, d), KEYS, {"s": (F.sum("volume"), -20 * BAR, -1), "n": (F.count("*"), -20 * BAR, -1)})
    return df.select("symbol", "t", r6(complete(F.col("volume") / (F.col("s") / 20), F.col("n"), 20)).alias("volume_ratio_20"))


@query("w2_realized_vol", with_bars(f"select symbol, t, case when count(ret) over w >= 100 then round(stddev_samp(ret) over w, 6) end as realized_vol from r window w as (partition by symbol order by t range between {5 * DAY} preceding and 1 preceding)", _RET_SQL))
def w2(spark, d):
    df = rolling(_ret(market(spark, d)), KEYS, {"sd": (F.stddev_samp("ret"), -5 * DAY, -1), "n": (F.count("ret"), -5 * DAY, -1)})
    return df.select("symbol", "t", r6(complete(F.col("sd"), F.col("n"), 100)).alias("realized_vol"))


@query("w3_complete_rolling", with_bars(f"select symbol, t, case when count(*) over w = 12 then round(avg(close) over w, 6) end as mean_12, case when count(*) over w = 12 then max(high) over w end as max_12, case when count(*) over w = 12 then min(low) over w end as min_12 from b window w as (partition by symbol order by t range between {11 * BAR} preceding and current row)"))
def w3(spark, d):
    lo = -11 * BAR
    df = rolling(market(spark, d), KEYS, {"m": (F.avg("close"), lo, 0), "hi": (F.max("high"), lo, 0), "li": (F.min("low"), lo, 0), "n": (F.count("*"), lo, 0)})
    return df.select("symbol", "t", r6(complete(F.col("m"), F.col("n"), 12)).alias("mean_12"), complete(F.col("hi"), F.col("n"), 12).alias("max_12"), complete(F.col("li"), F.col("n"), 12).alias("min_12"))


@query("w4_z_score", with_bars(f"select symbol, t, case when count(*) over w >= 100 and stddev_samp(close) over w > 0 then round((close - avg(close) over w) / stddev_samp(close) over w, 6) end as z from b window w as (partition by symbol order by t range between {5 * DAY} preceding and 1 preceding)"))
def w4(spark, d):
    df = rolling(market(spark, d), KEYS, {"m": (F.avg("close"), -5 * DAY, -1), "sd": (F.stddev_samp("close"), -5 * DAY, -1), "n": (F.count("*"), -5 * DAY, -1)})
    return df.select("symbol", "t", r6(F.when((F.col("n") >= 100) & (F.col("sd") > 0), (F.col("close") - F.col("m")) / F.col("sd"))).alias("z"))


_LOG_SQL = f"u as (select b.*, case when b.close > 0 and p.close > 0 then ln(b.close / p.close) end as u from b left join b p on p.symbol = b.symbol and p.t = b.t - {BAR})"


def _log(df):
    return rolling(df, KEYS, {"before": at_offset("close", -BAR)}).withColumn("u", fn.log_return(F.col("close"), F.col("before")))


@query("w5_realized_variance", with_bars(f"select symbol, t, case when count(u) over w = 6 then round(sqrt(sum(u * u) over w), 6) end as rv_6 from u window w as (partition by symbol order by t range between {6 * BAR} preceding and 1 preceding)", _LOG_SQL))
def w5(spark, d):
    df = rolling(_log(market(spark, d)), KEYS, {"s": (F.sum(F.col("u") * F.col("u")), -6 * BAR, -1), "n": (F.count("u"), -6 * BAR, -1)})
    return df.select("symbol", "t", r6(complete(F.sqrt("s"), F.col("n"), 6)).alias("rv_6"))


@query("l2_forward_labels", with_bars(
    f"select u.symbol, u.t, round(f.open / nullif(n.open, 0) - 1, 6) as fwd_y1, case when count(u) over w = 4 then round(ln(1 + sqrt(sum(u * u) over w)), 6) end as fwd_y2, case when count(low) over w = 4 then round(min(low) over w / nullif(n.open, 0) - 1, 6) end as fwd_y3 from u left join b n on n.symbol = u.symbol and n.t = u.t + {BAR} left join b f on f.symbol = u.symbol and f.t = u.t + {5 * BAR} window w as (partition by u.symbol order by u.t range between {BAR} following and {4 * BAR} following)".replace("count(low)", "count(u.low)").replace("min(low)", "min(u.low)"), _LOG_SQL))
def l2(spark, d):
    ahead = (BAR, 4 * BAR)
    df = rolling(_log(market(spark, d)), KEYS, {"o1": at_offset("open", BAR), "o5": at_offset("open", 5 * BAR), "s": (F.sum(F.col("u") * F.col("u")), *ahead), "nu": (F.count("u"), *ahead), "nl": (F.count("low"), *ahead), "ml": (F.min("low"), *ahead)})
    return df.select("symbol", "t", r6(fn.simple_return(F.col("o5"), F.col("o1"))).alias("fwd_y1"), r6(complete(F.log1p(F.sqrt("s")), F.col("nu"), 4)).alias("fwd_y2"), r6(complete(fn.simple_return(F.col("ml"), F.col("o1")), F.col("nl"), 4)).alias("fwd_y3"))


@query("l1_forward_returns", with_bars(f"select b.symbol, b.t, round(f1.close / nullif(b.close, 0) - 1, 6) as fwd_return_1, round(f4.close / nullif(b.close, 0) - 1, 6) as fwd_return_4, round(f4.open / nullif(f1.open, 0) - 1, 6) as fwd_open_return from b left join b f1 on f1.symbol=b.symbol and f1.t=b.t+{BAR} left join b f4 on f4.symbol=b.symbol and f4.t=b.t+{4 * BAR}"))
def l1(spark, d):
    df = rolling(market(spark, d), KEYS, {"c1": at_offset("close", BAR), "c4": at_offset("close", 4 * BAR), "o1": at_offset("open", BAR), "o4": at_offset("open", 4 * BAR)})
    return df.select("symbol", "t", r6(fn.simple_return(F.col("c1"), F.col("close"))).alias("fwd_return_1"), r6(fn.simple_return(F.col("c4"), F.col("close"))).alias("fwd_return_4"), r6(fn.simple_return(F.col("o4"), F.col("o1"))).alias("fwd_open_return"))


@query("w7_drawdown", with_bars("select symbol, t, c as total_bps, greatest(max(c) over (partition by symbol order by t), 0) - c as drawdown_bps from c", _RET_SQL, "c as (select symbol, t, (sum(floor(ret * 10000)::bigint) over (partition by symbol order by t))::bigint as c from r where ret is not null)"))
def w7(spark, d):
    ret = _ret(market(spark, d)).where("ret is not null").select("symbol", "t", F.floor(F.col("ret") * 10000).alias("x"))
    run = prefix(ret, KEYS, {"total_bps": ("sum", "x")})
    top = prefix(run.select("symbol", "t", "total_bps"), KEYS, {"peak": ("max", "total_bps")})
    return top.select("symbol", "t", "total_bps", (F.greatest("peak", F.lit(0)) - F.col("total_bps")).alias("drawdown_bps"))


@query("w8_row_lag", with_bars("select symbol, t, lag(close) over w as prev_close, lead(open) over w as next_open, t - lag(t) over w as step from b window w as (partition by symbol order by t)"))
def w8(spark, d):
    return ordered(market(spark, d), KEYS, {"prev_close": ("lag", "close"), "next_open": ("lead", "open"), "before": ("lag", "t")}).select("symbol", "t", "prev_close", "next_open", (F.col("t") - F.col("before")).alias("step"))


@query("w10_causal_rank", with_bars(f"select a.symbol, a.t, case when count(*) >= 20 then round(sum((p.close < a.close)::int) / count(*), 6) end as rank from b a join b p on p.symbol = a.symbol and p.t >= a.t - {DAY} and p.t < a.t group by a.symbol, a.t"))
def w10(spark, d):
    """Share of the previous day's closes below this one; bars without any before them are left out."""
    x = below_before(market(spark, d).select("symbol", "t", "close"), KEYS, "close", DAY)
    return x.where("seen > 0").select("symbol", "t", r6(complete(F.col("below") / F.col("seen"), F.col("seen"), 20)).alias("rank"))


@query("w11_prior_range", with_bars(f"select symbol, t, max(high) over w as prior_high, min(low) over w as prior_low, round(avg(high - low) over w, 6) as mean_range, round(avg((close > open)::int) over w, 6) as up_share from b window w as (partition by symbol order by t range between {4 * BAR} preceding and 1 preceding)"))
def w11(spark, d):
    s = (-4 * BAR, -1)
    return rolling(market(spark, d), KEYS, {"prior_high": (F.max("high"), *s), "prior_low": (F.min("low"), *s), "m": (F.avg(F.col("high") - F.col("low")), *s), "u": (F.avg((F.col("close") > F.col("open")).cast("int")), *s)}).select("symbol", "t", "prior_high", "prior_low", r6(F.col("m")).alias("mean_range"), r6(F.col("u")).alias("up_share"))


@query("w12_holds_for", with_bars(f"select symbol, t, (sum((close > open)::int) over w = 3 and count(*) over w = 3) as holds from b window w as (partition by symbol order by t range between {2 * BAR} preceding and current row)"))
def w12(spark, d):
    s = (-2 * BAR, 0)
    return rolling(market(spark, d), KEYS, {"k": (F.sum((F.col("close") > F.col("open")).cast("int")), *s), "n": (F.count("*"), *s)}).select("symbol", "t", ((F.col("k") == 3) & (F.col("n") == 3)).alias("holds"))


@query("w14_gap_runs", with_bars(f"select symbol, t as last_before, n as resume, (n - t) // {BAR} - 1 as missing from (select symbol, t, lead(t) over (partition by symbol order by t) as n from b) where n > t + {BAR}"))
def w14(spark, d):
    return gaps(market(spark, d), KEYS, BAR)


_EPISODE = 2 * BAR


@query("w15_episodes", with_bars(f"select symbol, count(*) as events, sum((p is null or t - p >= {_EPISODE})::int)::bigint as episodes from (select symbol, t, lag(t) over (partition by symbol order by t) as p from b where close > 60) group by 1"))
def w15(spark, d):
    df = ordered(market(spark, d).where("close > 60"), KEYS, {"p": ("lag", "t")})
    return df.groupBy("symbol").agg(F.count("*").alias("events"), F.sum((F.col("p").isNull() | (F.col("t") - F.col("p") >= _EPISODE)).cast("int")).alias("episodes"))


@query("w16_signal_runs", with_bars("select symbol, run::bigint as run, min(t) as first_t, max(t) as last_t, count(*) as bars, any_value(side) as side from (select *, sum(f) over (partition by symbol order by t) as run from (select symbol, t, side, coalesce((side <> lag(side) over (partition by symbol order by t))::int, 1) as f from (select symbol, t, sign(close - open)::int as side from b))) group by 1, 2"))
def w16(spark, d):
    side = market(spark, d).select("symbol", "t", F.signum(F.col("close") - F.col("open")).cast("int").alias("side"))
    flag = ordered(side, KEYS, {"before": ("lag", "side")}).withColumn("f", F.coalesce((F.col("side") != F.col("before")).cast("int"), F.lit(1)))
    run = prefix(flag, KEYS, {"run": ("sum", "f")})
    return run.groupBy("symbol", "run").agg(F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.count("*").alias("bars"), F.first("side").alias("side"))


@query("j17_grid", with_bars(f"select g.symbol, g.t, (b.t is not null) as present, b.close from (select symbol, unnest(generate_series(min(t), max(t), {BAR})) as t from b group by symbol) g left join b on b.symbol = g.symbol and b.t = g.t"))
def j17(spark, d):
    return grid(market(spark, d), KEYS, BAR).select("symbol", "t", "present", "close")


@query("x3_clock", with_bars("select symbol, t, ((t // 60) % 15)::int as minute_15, ((t // 60) % 60)::int as minute, ((t // 3600) % 24)::int as hour, ((t // 86400 + 3) % 7)::int as weekday from b"))
def x3(spark, d):
    return market(spark, d).select("symbol", "t", *(c.alias(k) for k, c in fn.clock(F.col("t")).items()))


@query("x4_harmonics", with_bars("select symbol, t, round(sin(2 * pi() * (t % 86400) / 86400), 6) + 0 as day_sin, round(cos(2 * pi() * (t % 86400) / 86400), 6) + 0 as day_cos, round(sin(2 * pi() * ((t + 259200) % 604800) / 604800), 6) + 0 as week_sin, round(cos(2 * pi() * ((t + 259200) % 604800) / 604800), 6) + 0 as week_cos, ((t // 86400 + 3) % 7 >= 5)::int as weekend from b"))
def x4(spark, d):
    h = fn.harmonics(F.col("t"))
    return market(spark, d).select("symbol", "t", *((r6(c) + 0).alias(k) if k != "weekend" else c.alias(k) for k, c in h.items()))


@query("x5_clip_and_square", with_bars("select symbol, t, round(greatest(least((close - 50) / 4, 10), -10), 6) as clipped, round(greatest(least((close - 50) / 4, 10), -10) ** 2, 6) as squared from b"))
def x5(spark, d):
    c = fn.clipped((F.col("close") - 50) / 4)
    return market(spark, d).select("symbol", "t", r6(c).alias("clipped"), r6(c * c).alias("squared"))


@query("x7_candle_shape", with_bars("select symbol, t, round(high - low, 6) as span, round((close - low) / nullif(high - low, 0), 6) as close_place, round((high - greatest(open, close)) / nullif(high - low, 0), 6) as upper_wick, round((least(open, close) - low) / nullif(high - low, 0), 6) as lower_wick from b"))
def x7(spark, d):
    shape = fn.candle(*(F.col(c) for c in ("open", "high", "low", "close")))
    return market(spark, d).select("symbol", "t", *(r6(c).alias(k) for k, c in shape.items()))


@query("x10_cost_aware_side", with_bars("select symbol, t, (case when abs(close - open) > 20 then sign(close - open) else 0 end)::int as side from b"))
def x10(spark, d):
    return market(spark, d).select("symbol", "t", fn.cost_aware_side(F.col("close") - F.col("open"), F.lit(20)).alias("side"))


@query("x11_contract_quantity", "select event_id, case when event_id % 3 = 0 then round(event_id * 0.01, 6) when event_id % 3 = 1 and value > 0 then round(event_id * 100 / value, 6) end as quantity from events")
def x11(spark, d):
    kind = F.when(F.col("event_id") % 3 == 0, "base").when(F.col("event_id") % 3 == 1, "quote").otherwise("none")
    value = F.when(F.col("event_id") % 3 == 0, F.lit(0.01)).otherwise(F.lit(100.0))
    return events(spark, d).select("event_id", r6(fn.contract_quantity(F.col("event_id"), F.col("value"), value, kind)).alias("quantity"))


@query("x12_deviation", with_bars("select symbol, t, round(3 * (1 - exp(-(ln(close) - ln(open)))) - 0.01, 6) as rho, round(3 * ln(1 - 0.002), 6) as low_bound, round(3 * ln(1 + 0.002), 6) as high_bound from b where open > 0 and close > 0"))
def x12(spark, d):
    lo, hi = fn.no_arbitrage_bounds(3.0, F.lit(0.002))
    return market(spark, d).where("open > 0 and close > 0").select("symbol", "t", r6(fn.deviation(F.col("close"), F.col("open"), 3.0, F.lit(0.03), F.lit(0.02))).alias("rho"), r6(lo).alias("low_bound"), r6(hi).alias("high_bound"))


@query("x14_decimal_text", "select event_id, case when s is null or trim(s) = '' then 'absent' when not regexp_matches(s, '^[+-]?[0-9]+(\\.[0-9]+)?$') then 'unparseable' when s::decimal(38,18) <= 0 then 'non_positive' else 'valid' end as class from (select event_id, case event_id % 6 when 0 then null when 1 then ' ' when 2 then '1_0' when 3 then '-' || value::decimal(18,2)::varchar when 4 then '0.00' else value::decimal(18,2)::varchar end as s from events)")
def x14(spark, d):
    k, text = F.col("event_id") % 6, F.col("value").cast("decimal(18,2)").cast("string")
    s = F.when(k == 0, F.lit(None)).when(k == 1, " ").when(k == 2, "1_0").when(k == 3, F.concat(F.lit("-"), text)).when(k == 4, "0.00").otherwise(text)
    return events(spark, d).select("event_id", s.alias("s")).select("event_id", fn.decimal_text_class(F.col("s")).alias("class"))


@query("x16_lots", "select event_id, round(floor(value / 2.5) * 2.5, 6) as lots, round(value - floor(value / 2.5) * 2.5, 6) as rest, round((1000 - 100) * 3.0 / (4.0 * value), 6) as size from events where value > 0")
def x16(spark, d):
    lots, rest = fn.to_lot(F.col("value"), F.lit(2.5))
    return events(spark, d).where("value > 0").select("event_id", r6(lots).alias("lots"), r6(rest).alias("rest"), r6(fn.position_size(F.lit(1000.0), F.lit(100.0), 3.0, F.col("value"))).alias("size"))


@query("x17_liquidation_fill", with_bars("select symbol, t, least(greatest(open, high), 80) as fill, case when greatest(open, high) >= 80 then 'cap' when high > open then 'high' else 'trigger' end as binding from b"))
def x17(spark, d):
    fill, binding = fn.liquidation_fill(F.col("open"), F.col("high"), F.lit(80))
    return market(spark, d).select("symbol", "t", fill.cast("double").alias("fill"), binding.alias("binding"))


@query("x20_bands", "select event_id, (value >= 25)::int + (value >= 50)::int + (value >= 75)::int as quartile from events")
def x20(spark, d):
    return events(spark, d).select("event_id", fn.band(F.col("value"), [25, 50, 75]).alias("quartile"))


@query("x27_nearest_choice", "select event_id, (select m from (values (10.0), (25.0), (50.0), (90.0)) x(m) order by abs(value - m), m limit 1)::double as choice from events")
def x27(spark, d):
    return events(spark, d).select("event_id", fn.nearest_choice(F.col("value"), [10.0, 25.0, 50.0, 90.0]).alias("choice"))


@query("p5_era", with_bars("select symbol, t, case when t >= 1705708800 then 'late' when t >= 1704844800 then 'middle' when t >= 1704067200 then 'early' end as era from b"))
def p5(spark, d):
    return market(spark, d).select("symbol", "t", fn.era(F.col("t"), [("early", 1704067200), ("middle", 1704844800), ("late", 1705708800)]).alias("era"))


@query("p7_condition_mask", with_bars("select symbol, t, coalesce(close > open and volume > 5, false) as hit from b"))
def p7(spark, d):
    return market(spark, d).select("symbol", "t", F.coalesce(F.expr("close > open and volume > 5"), F.lit(False)).alias("hit"))


@query("p9_positive_only", "select event_id, case when value - 50 > 0 then round(value - 50, 6) end as value from events")
def p9(spark, d):
    return events(spark, d).select("event_id", r6(fn.positive(F.col("value") - 50)).alias("value"))


@query("p12_matured_labels", with_bars(f"select symbol, t from b where t + {4 * BAR} <= (select max(t) from b)"))
def p12(spark, d):
    b = market(spark, d)
    last = b.agg(F.max("t").alias("m"))
    return b.join(F.broadcast(last), F.col("t") + 4 * BAR <= F.col("m")).select("symbol", "t")  # one row


@query("p14_month_coverage", with_bars(f"select symbol, t from b semi join (select symbol, t // {DAY} as day from b group by 1, 2 having count(*) >= 23) k on k.symbol = b.symbol and k.day = b.t // {DAY}"))
def p14(spark, d):
    b = market(spark, d).withColumn("day", F.floor(F.col("t") / DAY))
    good = b.groupBy("symbol", "day").agg(F.count("*").alias("n")).where("n >= 23")
    return b.join(good, ["symbol", "day"], "left_semi").select("symbol", "t")


@query("f1_observable_features", with_bars(
    f"select r.symbol, r.t, round(r.ret, 6) as return_1, round(r.close / nullif(p.close, 0) - 1, 6) as return_12, case when count(*) over w = 20 then round(r.volume / (sum(r.volume) over w / 20.0), 6) end as volume_ratio_20, case when count(r.ret) over v >= 100 then round(avg(r.ret) over v, 6) end as drift, ((r.t // 3600) % 24)::int as hour from r left join b p on p.symbol = r.symbol and p.t = r.t - {12 * BAR} window w as (partition by r.symbol order by r.t range between {20 * BAR} preceding and 1 preceding), v as (partition by r.symbol order by r.t range between {5 * DAY} preceding and 1 preceding)", _RET_SQL))
def f1(spark, d):
    from ..plans.guards import observable

    df = _ret(market(spark, d))
    w, v = (-20 * BAR, -1), (-5 * DAY, -1)
    df = rolling(df, KEYS, {"c12": at_offset("close", -12 * BAR), "s": (F.sum("volume"), *w), "n": (F.count("*"), *w), "m": (F.avg("ret"), *v), "nr": (F.count("ret"), *v)})
    return observable(df.select("symbol", "t", r6(F.col("ret")).alias("return_1"), r6(fn.simple_return(F.col("close"), F.col("c12"))).alias("return_12"), r6(complete(F.col("volume") / (F.col("s") / 20), F.col("n"), 20)).alias("volume_ratio_20"), r6(complete(F.col("m"), F.col("nr"), 100)).alias("drift"), fn.clock(F.col("t"))["hour"].alias("hour")))


@query("f2_flow_features", with_bars("select symbol, t, round(taker_volume / volume, 6) as taker_share, round((2 * taker_quote - volume_quote) / nullif(volume_quote, 0), 6) as imbalance, round(volume_quote / volume, 6) as mean_size from b"))
def f2(spark, d):
    return market(spark, d).select("symbol", "t", r6(fn.ratio(F.col("taker_volume"), F.col("volume"))).alias("taker_share"), r6(fn.ratio(2 * F.col("taker_quote") - F.col("volume_quote"), F.col("volume_quote"))).alias("imbalance"), r6(fn.ratio(F.col("volume_quote"), F.col("volume"))).alias("mean_size"))
