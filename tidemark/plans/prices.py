"""Queries of scalar functions and wide tables of features over bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..operators.bars import BAR, MONEY, at_offset, complete, ordered, rolling, seconds
from ..operators.ranks import below_before
from .common import events, market, r6, with_bars
from .guards import observable
from .registry import query

KEYS = ["symbol"]


@query("x6_log_state", with_bars(
    "select symbol, t, round(ln(volume), 6) as log_volume, case when taker_volume > 0 then round(ln(taker_volume), 6) end as log_taker, case when close > 0 then round(ln(close), 6) end as log_close from b"
))
def x6(spark, d):
    return market(spark, d).select("symbol", "t", *(r6(fn.logged(F.col(c).cast("double"))).alias(k) for k, c in (("log_volume", "volume"), ("log_taker", "taker_volume"), ("log_close", "close"))))


_MOVES = [
    f"r as (select b.*, b.close / nullif(p.close, 0) - 1 as r1, b.close / nullif(q.close, 0) - 1 as r4 from b left join b p on p.symbol = b.symbol and p.t = b.t - {BAR} left join b q on q.symbol = b.symbol and q.t = b.t - {4 * BAR})",
    f"v as (select *, case when count(r1) over w >= 18 then stddev_samp(r1) over w end as vol, avg(high - low) over w as span_before from r window w as (partition by symbol order by t range between {24 * BAR} preceding and 1 preceding))",
]


def moves(spark, d):
    """Bars with returns over 1 and 4 bars, volatility and mean range of the day before."""
    r = rolling(market(spark, d), KEYS, {"c1": at_offset("close", -BAR), "c4": at_offset("close", -4 * BAR)})
    r = r.withColumns({"r1": fn.simple_return(F.col("close"), F.col("c1")), "r4": fn.simple_return(F.col("close"), F.col("c4"))})
    prior = (-24 * BAR, -1)
    v = rolling(r, KEYS, {"s": (F.stddev_samp("r1"), *prior), "n": (F.count("r1"), *prior), "span_before": (F.avg(F.col("high") - F.col("low")), *prior)})
    return v.withColumn("vol", complete(F.col("s"), F.col("n"), 18))


@query("x8_normalised_moves", with_bars("select symbol, t, case when vol > 0 then round(r1 / vol, 5) end as z1, case when vol > 0 then round(r4 / (vol * 2), 5) end as z4, case when span_before > 0 then round((high - low) / span_before, 5) end as range_ratio from v", *_MOVES))
def x8(spark, d):
    x = moves(spark, d)
    return x.select("symbol", "t", F.round(fn.ratio(F.col("r1"), F.col("vol")), 5).alias("z1"), F.round(fn.ratio(F.col("r4"), F.col("vol") * 2), 5).alias("z4"), F.round(fn.ratio(F.col("high") - F.col("low"), F.col("span_before")), 5).alias("range_ratio"))


@query("x9_side_in_words", """select event_id, case event_id % 5 when 0 then 1 when 1 then -1 when 2 then sign(value - 50)::int when 3 then -sign(value - 50)::int end as side from events""")
def x9(spark, d):
    modes = F.array(*map(F.lit, ("long", "short", "continuation", "fade", "other")))
    return events(spark, d).select("event_id", fn.side_of(F.get(modes, (F.col("event_id") % 5).cast("int")), F.col("value") - 50).alias("side"))


@query("x15_decimal_gap", """select event_id, a = b as equal, (b - a)::double as difference, round((b - a)::double / nullif(a::double, 0) * 10000, 4) as bps
 from (select event_id, value::decimal(18,6) as a, (value::decimal(18,6) + (event_id % 3) * 0.01::decimal(18,6))::decimal(18,6) as b from events)""")
def x15(spark, d):
    a = F.col("value").cast(MONEY)
    b = a + (F.col("event_id") % 3).cast("int") * F.lit("0.01").cast(MONEY)
    gap = fn.decimal_gap(a.cast("string"), b.cast(MONEY).cast("string"))
    return events(spark, d).select("event_id", gap["equal"].alias("equal"), gap["difference"].alias("difference"), F.round(gap["bps"], 4).alias("bps"))


@query("x19_week_and_month", "select event_id, isoyear(ts)::varchar || '-W' || lpad(week(ts)::varchar, 2, '0') as week, strftime(ts, '%Y-%m') as month from events")
def x19(spark, d):
    return events(spark, d).select("event_id", fn.iso_week(F.col("ts")).alias("week"), F.date_format("ts", "yyyy-MM").alias("month"))


@query("x24_arrival_partition", "select event_id, ts::date as arrival_date, hour(ts)::int as arrival_hour from events")
def x24(spark, d):
    ns = seconds(F.col("ts")) * 10**9 + F.col("event_id")
    return events(spark, d).select("event_id", *(c.alias(k) for k, c in fn.arrival_partition(ns).items()))


@query("x26_months", "select user_id, unnest(generate_series(date_trunc('month', min(ts)), date_trunc('month', max(ts)) + interval 2 month, interval 1 month))::date as month from events group by 1")
def x26(spark, d):
    span = events(spark, d).groupBy("user_id").agg(F.to_date(F.min("ts")).alias("a"), F.to_date(F.max("ts")).alias("b"))
    return span.select("user_id", F.explode(fn.months_between(F.col("a"), F.add_months("b", 2))).alias("month"))


@query("f4_event_base", with_bars(f"""select symbol, t, round(r4, 6) as r4, round(high - low, 6) as span, case when high > low then round((close - low) / (high - low), 6) end as close_place, case when high > low then round((high - greatest(open, close)) / (high - low), 6) end as upper_wick,
 case when high > low then round((least(open, close) - low) / (high - low), 6) end as lower_wick, max(high) over h as high_before, min(low) over h as low_before, round(avg((r1 > 0)::int) over u, 6) as share_up, case when vol > 0 then round(r1 / vol, 5) end as z1, case when span_before > 0 then round((high - low) / span_before, 5) end as range_ratio
 from v window h as (partition by symbol order by t range between {12 * BAR} preceding and 1 preceding), u as (partition by symbol order by t range between {11 * BAR} preceding and current row)""", *_MOVES))
def f4(spark, d):
    """What deep moves are told by: candle shape, earlier extremes, share of rising bars, moves in units of volatility."""
    x = rolling(moves(spark, d).withColumn("up", (F.col("r1") > 0).cast("int")), KEYS, {"high_before": (F.max("high"), -12 * BAR, -1), "low_before": (F.min("low"), -12 * BAR, -1), "share": (F.avg("up"), -11 * BAR, 0)})
    shape = fn.candle(F.col("open"), F.col("high"), F.col("low"), F.col("close"))
    return x.select(
        "symbol", "t", r6(F.col("r4")).alias("r4"), *(r6(c).alias(k) for k, c in shape.items()), "high_before", "low_before", r6(F.col("share")).alias("share_up"),
        F.round(fn.ratio(F.col("r1"), F.col("vol")), 5).alias("z1"), F.round(fn.ratio(F.col("high") - F.col("low"), F.col("span_before")), 5).alias("range_ratio"),
    )


#: A day's window stands for the twenty days of five-minute bars, and so many bars of it have to be there.
_Z, _Z_LEAST = 48 * BAR, 40
_SCORED = {"hl": "hl_range_z", "lv": "log_volume_z", "lc": "log_close_z", "r4": "return_z", "imb": "imbalance_z", "lt": "log_trades_z", "la": "log_size_z"}


@query("f3_design", with_bars(
    "select symbol, t, " + ", ".join(f"round({c}, 5) as {c}" for c in ["r1", "r4", "rv_6", "rv_24", *_SCORED.values(), "move", "move_sq", "return_z_sq", "imbalance_x_move", "sham_vol", "sham_rank", "sham_lag"]) + """,
 round(sin(2 * pi() * (t % 86400) / 86400), 5) as tod_sin_1, round(cos(2 * pi() * (t % 86400) / 86400), 5) as tod_cos_1, round(sin(4 * pi() * (t % 86400) / 86400), 5) as tod_sin_2, round(cos(4 * pi() * (t % 86400) / 86400), 5) as tod_cos_2,
 round(sin(2 * pi() * ((t // 86400 + 3) % 7) / 7), 5) as dow_sin_1, round(cos(2 * pi() * ((t // 86400 + 3) % 7) / 7), 5) as dow_cos_1, ((t // 86400 + 3) % 7 >= 5)::int as weekend, (t % 10800 = 0)::int as third_hour from e""",
    _MOVES[0],
    "u as (select *, ln(close / nullif(lag(close) over (partition by symbol order by t), 0)) as u, (high - low) / nullif(close, 0) as hl, ln(volume + 1) as lv, ln(nullif(close, 0)) as lc, 2 * taker_volume / volume::double - 1 as imb, ln(volume) as lt, ln(nullif(volume_quote / volume, 0)) as la from r)",
    f"s as (select *, case when count(u) over (partition by symbol order by t range between {6 * BAR} preceding and 1 preceding) = 6 then sqrt(sum(u * u) over (partition by symbol order by t range between {6 * BAR} preceding and 1 preceding)) end as rv_6, case when count(u) over y = 24 then sqrt(sum(u * u) over y) end as rv_24, "
    + ", ".join(f"case when count({c}) over w >= {_Z_LEAST} and stddev_samp({c}) over w > 0 then ({c} - avg({c}) over w) / stddev_samp({c}) over w end as {k}" for c, k in _SCORED.items())
    + f", count(*) over w as seen from u window w as (partition by symbol order by t range between {_Z} preceding and 1 preceding), y as (partition by symbol order by t range between {24 * BAR} preceding and 1 preceding))",
    "m as (select *, case when rv_6 > 0 then greatest(-10, least(10, r1 / rv_6)) end as move from s)",
    f"e as (select m.*, m.move * m.move as move_sq, m.return_z * m.return_z as return_z_sq, m.imb * m.move as imbalance_x_move, case when m.rv_24 > 0 then greatest(-10, least(10, m.rv_6 / m.rv_24 - 1)) end as sham_vol, l.move as sham_lag, case when m.seen >= {_Z_LEAST} then (select count(*) filter (where x.volume < m.volume) from b x where x.symbol = m.symbol and x.t >= m.t - {_Z} and x.t < m.t) / m.seen::double - 0.5 end as sham_rank from m left join m l on l.symbol = m.symbol and l.t = m.t - {BAR})",
))
def f3(spark, d):
    """Baseline columns, an information set of flows, interactions and shams: all from trailing windows, with the current bar
    left out of whatever it is compared with."""
    b = market(spark, d)
    x = rolling(b, KEYS, {"c1": at_offset("close", -BAR), "c4": at_offset("close", -4 * BAR)})
    x = ordered(x, KEYS, {"before": ("lag", "close")})
    c = F.col
    x = x.withColumns({
        "r1": fn.simple_return(c("close"), c("c1")), "r4": fn.simple_return(c("close"), c("c4")), "u": fn.log_return(c("close"), c("before")),
        "hl": F.when(c("close") != 0, (c("high") - c("low")) / c("close")), "lv": F.ln(c("volume") + 1), "lc": fn.logged(c("close")), "imb": 2 * c("taker_volume") / c("volume") - 1, "lt": fn.logged(c("volume").cast("double")), "la": fn.logged(c("volume_quote") / c("volume")),
    })
    prior = (-_Z, -1)
    windows = {f"{s}_{k}": (f(k), *prior) for k in _SCORED for s, f in (("n", F.count), ("m", F.avg), ("s", F.stddev_samp))}
    windows |= {f"{s}_{n}": (e, -n * BAR, -1) for n in (6, 24) for s, e in (("q", F.sum(c("u") * c("u"))), ("k", F.count("u")))}
    x = below_before(rolling(x, KEYS, windows), KEYS, "volume", _Z)
    x = x.withColumns({k: F.when((c(f"n_{s}") >= _Z_LEAST) & (c(f"s_{s}") > 0), (c(s) - c(f"m_{s}")) / c(f"s_{s}")) for s, k in _SCORED.items()} | {f"rv_{n}": complete(F.sqrt(f"q_{n}"), c(f"k_{n}"), n) for n in (6, 24)})
    x = x.withColumns({"move": F.when(c("rv_6") > 0, fn.clipped(c("r1") / c("rv_6"))), "sham_vol": F.when(c("rv_24") > 0, fn.clipped(c("rv_6") / c("rv_24") - 1)), "sham_rank": F.when(c("seen") >= _Z_LEAST, c("below") / c("seen") - 0.5)}).drop("seen", "below", *windows)
    x = rolling(x, KEYS, {"sham_lag": at_offset("move", -BAR)})
    x = x.withColumns({"move_sq": c("move") ** 2, "return_z_sq": c("return_z") ** 2, "imbalance_x_move": c("imb") * c("move")})
    tod, dow = 2 * F.pi() * (c("t") % 86400) / 86400, 2 * F.pi() * ((F.floor(c("t") / 86400) + 3) % 7) / 7
    clock = {"tod_sin_1": F.sin(tod), "tod_cos_1": F.cos(tod), "tod_sin_2": F.sin(2 * tod), "tod_cos_2": F.cos(2 * tod), "dow_sin_1": F.sin(dow), "dow_cos_1": F.cos(dow)}
    names = ["r1", "r4", "rv_6", "rv_24", *_SCORED.values(), "move", "move_sq", "return_z_sq", "imbalance_x_move", "sham_vol", "sham_rank", "sham_lag"]
    return x.select("symbol", "t", *(F.round(k, 5).alias(k) for k in names), *(F.round(e, 5).alias(k) for k, e in clock.items()), ((F.floor(c("t") / 86400) + 3) % 7 >= 5).cast("int").alias("weekend"), (c("t") % 10800 == 0).cast("int").alias("third_hour"))


_PAIR = "j as (select p.t, p.close as perp, s.close as spot from b p join b s on s.t = p.t and p.symbol = 'click' and s.symbol = 'view')"


@query("l3_basis", with_bars(f"select j.t, round(perp - spot, 6) as basis, case when spot > 0 then round(perp / spot - 1, 6) end as relative, case when count(*) over w >= 4 then round(avg(perp - spot) over w, 6) end as mean_before, (select round(arg_max(f.value, f.at), 6) from (select value, epoch_us(ts) // 1000000 + 60 as at from events where event_type = 'purchase') f where f.at <= j.t and f.at >= j.t - 7200) is not null as settled from j window w as (order by j.t range between {8 * BAR} preceding and 1 preceding)", _PAIR))
def l3(spark, d):
    """Absolute and relative difference of two series, its trailing mean, and whether a settlement was published of late."""
    from ..operators.joins import as_of

    b = market(spark, d)
    p = b.where("symbol = 'click'").select("t", F.col("close").alias("perp"))
    j = p.join(b.where("symbol = 'view'").select("t", F.col("close").alias("spot")), "t").withColumns({"k": F.lit(1), "basis": F.col("perp") - F.col("spot")})
    j = rolling(j, ["k"], {"m": (F.avg("basis"), -8 * BAR, -1), "n": (F.count("*"), -8 * BAR, -1)})
    rate = events(spark, d).where("event_type = 'purchase'").select(F.lit(1).alias("k"), (seconds(F.col("ts")) + 60).alias("t"), "value")
    j = as_of(j, rate.groupBy("k", "t").agg(F.max("value").alias("value")), ["k"], 7200, ["value"])
    return j.select("t", r6(F.col("basis")).alias("basis"), r6(F.when(F.col("spot") > 0, F.col("perp") / F.col("spot") - 1)).alias("relative"), r6(complete(F.col("m"), F.col("n"), 4)).alias("mean_before"), F.col("match_t").isNotNull().alias("settled"))


@query("p1_provenance", with_bars("select 'events' as source, symbol, 'bar_3600' as series_kind, t, close from b"))
def p1(spark, d):
    from ..sources.landed import with_provenance

    return with_provenance(market(spark, d).select("symbol", "t", "close"), source="events", series_kind="bar_3600").select("source", "symbol", "series_kind", "t", "close")


@query("p11_sealed_input", with_bars("select symbol, count(*) as n, max(t) as last_t from b where t < 1705276800 group by 1"))
def p11(spark, d):
    """Label inputs pass only if no column looks ahead and no row lies behind the seal."""
    from .guards import sealed_input

    x = observable(market(spark, d).where("t < 1705276800"))
    return sealed_input(x, 1705276800).groupBy("symbol").agg(F.count("*").alias("n"), F.max("t").alias("last_t"))


@query("p13_embargoed_folds", with_bars(f"select f.fold, symbol, count(*) as n, min(t) as first_t, max(t) as last_t from b join (select * from (values (1, 1704067200, 1704931200), (2, 1704067200, 1705795200), (3, 1704067200, 1706227200)) v(fold, train_start, train_end)) f on t >= train_start and t < train_end - {14 * BAR} group by 1, 2"))
def p13(spark, d):
    """Training rows of expanding folds, less an embargo before the fold's end."""
    from ..operators.statistics import in_folds

    folds = [(1, 1704067200, 1704931200), (2, 1704067200, 1705795200), (3, 1704067200, 1706227200)]
    x = in_folds(market(spark, d), spark.createDataFrame(folds, "fold int, train_start long, train_end long"), 14 * BAR)
    return x.groupBy("fold", "symbol").agg(F.count("*").alias("n"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))
