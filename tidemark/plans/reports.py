"""Queries of reports: manifests, fingerprints, quantiles, inventories, trade summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import carry, ledger, reports
from ..operators.bars import BAR, MONEY, at_offset, ordered, rolling, seconds
from ..operators.quantiles import quantiles
from .common import events, market, r6, stored, with_bars
from .registry import query
from .rules import _POSITION, _RETURNS, _TARGET, held

KEYS = ["symbol"]


@query("a4_mean_return", with_bars("select symbol, round(avg(close / nullif(p, 0) - 1), 5) as mean_return, round(median(close / nullif(p, 0) - 1), 5) as median_return, round(avg(volume), 5) as mean_volume from (select *, lag(close) over (partition by symbol order by t) as p from b) group by 1"))
def a4(spark, d):
    """By row order: the bar before, however far."""
    x = ordered(market(spark, d), KEYS, {"p": ("lag", "close")}).withColumn("r", F.when(F.col("p") != 0, F.col("close") / F.col("p") - 1))
    return x.groupBy("symbol").agg(F.round(F.avg("r"), 5).alias("mean_return"), F.round(F.median("r"), 5).alias("median_return"), F.round(F.avg("volume"), 5).alias("mean_volume"))


@query("a5_manifest", with_bars(f"select symbol, count(*) as rows, min(t) as first_t, max(t) as last_t, (max(t) - min(t)) // {BAR} + 1 as expected, (max(t) - min(t)) // {BAR} + 1 - count(*) as missing, sum(('0x' || md5(symbol || '|' || t || '|' || volume)[1:8])::bigint)::bigint as content from b group by 1"))
def a5(spark, d):
    return reports.manifest(market(spark, d), BAR, [F.col("symbol"), F.col("t").cast("string"), F.col("volume").cast("string")], KEYS)


@query("a6_source_digest", "with l as (select event_type, epoch_us(ts) // 86400000000 as day, arg_max(md5(event_id::varchar), event_id) as sha from events group by 1, 2) select event_type, count(*) as periods, sha256(string_agg(day || ' ' || sha, chr(10) order by day || ' ' || sha)) as digest from l group by 1")
def a6(spark, d):
    rows = events(spark, d).select("event_type", F.floor(seconds(F.col("ts")) / 86400).alias("day"), F.md5(F.col("event_id").cast("string")).alias("sha"), "event_id")
    return reports.source_digest(rows, ["event_type"], "day", "sha", "event_id")


@query("a10_ratio_counts", with_bars("select symbol, count(*) filter (where taker_volume = 0) as none, count(*) filter (where 2 * taker_volume > volume) as above_half, count(*) filter (where close < open) as falling, round(median(taker_volume / volume::double), 6) as median_share, quantile_disc(volume, 0.9) as p90_volume from b group by 1"))
def a10(spark, d):
    b = stored(market(spark, d).withColumn("share", F.col("taker_volume") / F.col("volume")))
    median, high = quantiles(b, ["symbol"], "share", {"m": ("cont", 0.5)}).select("symbol", r6(F.col("m")).alias("median_share")), quantiles(b, ["symbol"], "volume", {"p": ("disc", 0.9)}).select("symbol", F.col("p").cast("long").alias("p90_volume"))
    return b.groupBy("symbol").agg(F.count_if(F.col("taker_volume") == 0).alias("none"), F.count_if(2 * F.col("taker_volume") > F.col("volume")).alias("above_half"), F.count_if(F.col("close") < F.col("open")).alias("falling")).join(median, "symbol").join(high, "symbol")


@query("a13_cross_source_whole", with_bars("""select count(*) as n, round(median(d), 6) as median_bps, round(quantile_cont(d, 0.99), 6) as p99_bps, round(max(d), 6) as max_bps, round(corr(rx, ry), 6) as return_corr, round(median(vx / vy::double), 6) as volume_ratio from (
 select abs(x.close / y.close - 1) * 10000 as d, case when x.t - lag(x.t) over o = 3600 then ln(x.close / lag(x.close) over o) end as rx, case when x.t - lag(x.t) over o = 3600 then ln(y.close / lag(y.close) over o) end as ry, x.volume as vx, y.volume as vy
 from b x join b y on x.t = y.t and x.symbol = 'click' and y.symbol = 'view' and y.close > 0 and x.close > 0 window o as (order by x.t))"""))
def a13_whole(spark, d):
    """Two sources of one series: differences, correlation of returns between adjacent bars, ratio of volumes."""
    b = market(spark, d).where("close > 0")
    take = lambda s, p: b.where(F.col("symbol") == s).select("t", F.col("close").alias(p), F.col("volume").alias(f"v{p}"))
    x = take("click", "x").join(take("view", "y"), "t").withColumn("k", F.lit(1))
    x = ordered(x, ["k"], {"pt": ("lag", "t"), "px": ("lag", "x"), "py": ("lag", "y")}).withColumn("d", F.abs(F.col("x") / F.col("y") - 1) * 10_000)
    near = F.col("t") - F.col("pt") == BAR
    x = stored(x.withColumn("v", F.col("vx") / F.col("vy")))
    d_ranks, v_ranks = quantiles(x, [], "d", {"median_bps": ("cont", 0.5), "p99_bps": ("cont", 0.99)}).drop("n"), quantiles(x, [], "v", {"volume_ratio": ("cont", 0.5)}).drop("n")
    sums = x.agg(F.count("*").alias("n"), r6(F.max("d")).alias("max_bps"), r6(F.corr(F.when(near, F.ln(F.col("x") / F.col("px"))), F.when(near, F.ln(F.col("y") / F.col("py"))))).alias("return_corr"))
    both = sums.join(F.broadcast(d_ranks), F.lit(True), "left").join(F.broadcast(v_ranks), F.lit(True), "left")  # one row each
    return both.withColumns({c: r6(F.col(c)) for c in ("median_bps", "p99_bps", "volume_ratio")})


@query("a18_offsets", with_bars("select t % 86400 // 3600 - 12 as offset_h, count(*) as n from b where volume > 5 group by 1"))
def a18(spark, d):
    return market(spark, d).where("volume > 5").groupBy((F.floor(F.col("t") % 86400 / 3600) - 12).alias("offset_h")).agg(F.count("*").alias("n"))


_Q = {"p01": 0.01, "p05": 0.05, "p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}


@query("a19_exact_summary", "with x as (select event_type, value::decimal(18,6) as v, row_number() over (partition by event_type order by value) as r, count(*) over (partition by event_type) as c from events) select event_type, count(*) as n, min(v)::double as min, " + ", ".join(f"min(v) filter (where r >= greatest(1, ceil({q} * c)))::double as {k}" for k, q in _Q.items()) + ", max(v)::double as max, sum(v)::double as sum, sum(abs(v))::double as sum_abs, round(sum(v)::double / count(*), 6) as mean from x group by 1")
def a19_exact(spark, d):
    """All ten statistics, on exact decimals."""
    x = reports.nearest_ranks(events(spark, d), ["event_type"], F.col("value").cast(MONEY), _Q)
    return x.select("event_type", "n", *(F.col(c).cast("double").alias(c) for c in ["min", *_Q, "max", "sum", "sum_abs"]), r6(F.col("mean")).alias("mean"))


@query("a22_availability_cube", "select coalesce(event_type, 'all') as kind, coalesce((epoch_us(ts) // 604800000000)::int, -1) as week, count(*) as n, count(*) filter (where value >= 50) as usable from (select * from events) group by cube (event_type, (epoch_us(ts) // 604800000000)::int)")
def a22(spark, d):
    x = events(spark, d).select("event_type", F.floor(seconds(F.col("ts")) / 604800).cast("int").alias("week"), "value")
    return x.cube("event_type", "week").agg(F.count("*").alias("n"), F.count_if(F.col("value") >= 50).alias("usable")).select(F.coalesce("event_type", F.lit("all")).alias("kind"), F.coalesce("week", F.lit(-1)).alias("week"), "n", "usable")


@query("a23_layer_fidelity", "with l as (select unnest(['click', 'view', 'purchase', 'refund']) as layer), f as (select event_type as layer, count(*) as events, count(*) filter (where value > 1 or event_type = 'click') as exact from events group by 1) select layer, coalesce(events, 0) as events, coalesce(exact, 0) as exact, case when coalesce(events, 0) = 0 then 'unknown_until_observed' when exact = events then 'exact' else 'partial_proxy' end as class from l left join f using (layer)")
def a23(spark, d):
    x = events(spark, d).select(F.col("event_type").alias("layer"), F.when((F.col("value") > 1) | (F.col("event_type") == "click"), "published").otherwise("bar_open").alias("source"))
    return carry.layer_fidelity(x, ["click", "view", "purchase", "refund"])


@query("a24_strategy_metrics", with_bars(f"""select n.symbol, count(*) as bars, round(avg(net) * {24 * 365}, 4) as annualised, round(avg(net) / stddev_samp(net) * sqrt({24 * 365}), 4) as sharpe, round(max(top - equity), 5) as max_drawdown, round(sum(gross), 5) as gross_total, round(sum(turnover * 0.0005), 5)::double as cost_total, any_value(k.trades) as trades, any_value(k.hit_rate) as hit_rate
 from (select *, max(equity) over (partition by symbol order by t) as top from (select *, sum(net) over (partition by symbol order by t) as equity from (select *, gross - turnover * 0.0005 as net from n))) n
 join (select symbol, count(*) as trades, round(avg((to_position * (exit_price / nullif(price, 0) - 1) - 0.001 > 0)::int), 5)::double as hit_rate from (select *, lead(price) over (partition by symbol order by fill_t) as exit_price from f) where to_position <> 0 and exit_price is not null group by 1) k on k.symbol = n.symbol group by 1""", _TARGET, _POSITION, _RETURNS, "f as (select symbol, t as fill_t, open as price, position as to_position from p window o as (partition by symbol order by t) qualify position <> coalesce(lag(position) over o, 0))"))
def a24(spark, d):
    """Metrics of a strategy's bars with those of its closed trades: annualised, drawdown, hit rate and costs."""
    position = held(spark, d)
    bars = ledger.bar_returns(position, KEYS).withColumn("net", F.col("gross") - F.col("turnover") * 0.0005)
    year = 24 * 365
    m = bars.groupBy("symbol").agg(F.count("*").alias("bars"), F.round(F.avg("net") * year, 4).alias("annualised"), F.round(F.avg("net") / F.stddev_samp("net") * F.sqrt(F.lit(year)), 4).alias("sharpe"), F.round(F.sum("gross"), 5).alias("gross_total"), F.round(F.sum(F.col("turnover") * 0.0005), 5).alias("cost_total"))
    trades = ledger.trades(ledger.fills(position, KEYS), KEYS).where("closed")
    k = trades.groupBy("symbol").agg(F.count("*").alias("trades"), F.round(F.avg((F.col("gross") - 0.001 > 0).cast("int")), 5).alias("hit_rate"))
    return m.join(reports.drawdown(bars, KEYS, "net").withColumn("max_drawdown", F.round("max_drawdown", 5)), "symbol").join(k, "symbol")


@query("a25_trade_summary", with_bars("""select symbol, count(*) as n, round(avg(net), 5) as mean_net, round(median(net), 5) as median_net, round(avg((net > 0)::int), 5) as win_rate, round(avg((status = 'take')::int), 5) as take_rate, round(avg((status = 'stop')::int), 5) as stop_rate, round(avg((status = 'timeout')::int), 5) as timeout_rate, round(avg(holding), 4) as mean_holding,
 round(sum(case when net > 0 then net else 0 end) / -sum(case when net < 0 then net else 0 end), 4) as profit_factor from (select symbol, greatest(-1, least(3, close / open - 1)) - 0.001 as net, case when close >= open * 1.5 then 'take' when close <= open * 0.5 then 'stop' else 'timeout' end as status, volume * 60.0 as holding from b where open > 0) group by 1"""))
def a25(spark, d):
    b = market(spark, d).where("open > 0")
    net = F.greatest(F.lit(-1.0), F.least(F.lit(3.0), F.col("close") / F.col("open") - 1)) - 0.001
    status = F.when(F.col("close") >= F.col("open") * 1.5, "take").when(F.col("close") <= F.col("open") * 0.5, "stop").otherwise("timeout")
    x = reports.trade_summary(b.select("symbol", net.alias("net"), status.alias("status"), (F.col("volume") * 60.0).alias("holding")), KEYS, "net", "status", F.col("holding"))
    return x.select("symbol", "n", *(F.round(c, 5).alias(c) for c in ("mean_net", "median_net", "win_rate", "take_rate", "stop_rate", "timeout_rate")), *(F.round(c, 4).alias(c) for c in ("mean_holding", "profit_factor")))


@query("a27_arm_counters", "select coalesce(lang, 'total') as arm, count(*) as runs, round(avg(n_chars), 4) as mean_chars, count(*) filter (where doc_id % 2 = 0) as even, array_to_string(list_sort(list(distinct source)), ',') as sources from documents where lang is not null group by rollup (lang)")
def a27(spark, d):
    x = spark.read.parquet(f"{d}/documents.parquet").where("lang is not null").select("lang", "n_chars", "doc_id", "source")
    return x.rollup("lang").agg(F.count("*").alias("runs"), F.round(F.avg("n_chars"), 4).alias("mean_chars"), F.count_if(F.col("doc_id") % 2 == 0).alias("even"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources")).select(F.coalesce("lang", F.lit("total")).alias("arm"), "runs", "mean_chars", "even", "sources")


@query("a30_lag_distribution", "select event_type, count(*) as n, count(*) filter (where x < 0) as negative, min(x) as min, max(x) as max from (select event_type, floor(value * 10)::bigint - 200 as x from events) group by 1")
def a30(spark, d):
    """Delays by feed; the approximate quantiles are tested on their own."""
    return reports.lags(events(spark, d), ["event_type"], F.floor(F.col("value") * 10) - 200).drop("q")


@query("a32_repeated_sessions", "select user_id as session, count(*) as frames, count(distinct event_type) as paths from events group by 1 having count(distinct event_type) > 1")
def a32(spark, d):
    """Sessions that more than one file holds; a feed stands for a file."""
    x = events(spark, d).groupBy(F.col("user_id").alias("session")).agg(F.count("*").alias("frames"), F.count_distinct("event_type").alias("paths"))
    return x.where("paths > 1")


@query("a33_inventory", "select event_type as dataset, count(distinct epoch_us(ts) // 86400000000) as files, sum(length(props))::bigint as bytes, min(ts)::date as first_day, max(ts)::date as last_day from events group by 1")
def a33(spark, d):
    x = events(spark, d)
    return x.groupBy(F.col("event_type").alias("dataset")).agg(F.count_distinct(F.floor(seconds(F.col("ts")) / 86400)).alias("files"), F.sum(F.length("props")).alias("bytes"), F.to_date(F.min("ts")).alias("first_day"), F.to_date(F.max("ts")).alias("last_day"))


@query("a35_daily_series", "with f as (select epoch_us(ts) // 86400000000 as day, count(*) as v from events group by 1 union all select epoch_us(ts) // 86400000000 as day, count(*) + (epoch_us(ts) // 86400000000 % 11 = 0)::int as v from events where epoch_us(ts) // 86400000000 % 2 = 0 group by 1, epoch_us(ts) // 86400000000 % 11), e as (select day // 7 as period, day, count(*) as n, count(distinct v) as d from f group by 1, 2) select period, sum(n)::bigint as rows, count(*) as days, max(d) = 1 as consistent, max(day) - min(day) + 1 = count(*) as gapless from e group by 1")
def a35(spark, d):
    """Fragments of a daily series merged: days that two of them hold have to agree, and none may be missing."""
    days = events(spark, d).groupBy(F.floor(seconds(F.col("ts")) / 86400).alias("day")).agg(F.count("*").alias("v"))
    other = days.where("day % 2 = 0").withColumn("v", F.col("v") + (F.col("day") % 11 == 0).cast("int"))
    return reports.complete_series(days.union(other), "day", [F.col("v")], F.floor(F.col("day") / 7))


@query("a36_effective_n", with_bars(f"select symbol, count(*) as n, count(distinct t // 86400) as days, round(count(*) * (1 - c) / (1 + c), 3) as n_eff from (select b.symbol, b.t, (select corr(x.volume, y.volume) from b x join b y on y.symbol = x.symbol and y.t = x.t + {BAR} where x.symbol = b.symbol) as c from b) group by symbol, c"))
def a36_effective(spark, d):
    """Sample sizes less what the lag-one correlation takes away."""
    x = rolling(market(spark, d), KEYS, {"next": at_offset("volume", BAR)})
    c = F.corr("volume", "next")
    return x.groupBy("symbol").agg(F.count("*").alias("n"), F.count_distinct(F.floor(F.col("t") / 86400)).alias("days"), F.round(F.count("*") * (1 - c) / (1 + c), 3).alias("n_eff"))


@query("a37_input_inventory", with_bars(f"select 'events' as dataset, symbol, count(*) as rows, (max(t) - min(t)) // {BAR} + 1 - count(*) as missing, count(*) filter (where n > t + {BAR}) as gaps, max((n - t) // {BAR} - 1) as longest_gap, sum(volume)::bigint as raw_rows, count(*) filter (where volume = 1) as single from (select *, lead(t) over (partition by symbol order by t) as n from b) group by 2"))
def a37(spark, d):
    """One record a dataset: manifest, gaps and raw accounting together."""
    x = ordered(market(spark, d), KEYS, {"n": ("lead", "t")})
    return x.groupBy(F.lit("events").alias("dataset"), "symbol").agg(F.count("*").alias("rows"), (F.floor((F.max("t") - F.min("t")) / BAR) + 1 - F.count("*")).alias("missing"), F.count_if(F.col("n") > F.col("t") + BAR).alias("gaps"), F.floor(F.max((F.col("n") - F.col("t")) / BAR - 1)).alias("longest_gap"), F.sum("volume").alias("raw_rows"), F.count_if(F.col("volume") == 1).alias("single"))


@query("w14_stale_runs", with_bars("select symbol, min(t) as start, max(t) as end, count(*) as bars from (select *, sum(new) over (partition by symbol order by t) as run from (select *, (coalesce(lag(volume <= 3) over (partition by symbol order by t) is distinct from (volume <= 3), true))::int as new from b)) where volume <= 3 group by symbol, run"))
def w14_stale(spark, d):
    return reports.stale_runs(market(spark, d), KEYS, F.col("volume") <= 3)
