"""Queries of quotes, depth, flows, instrument metadata, controls and clocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sessions
from ..operators.bars import BAR, seconds
from ..sources import landed
from .common import events, market, r6, with_bars
from .micro import frames
from .registry import query

KEYS = ["symbol"]


def _id():
    return F.col("event_id")


def raw_frames(spark, d, payload):
    """A frame for each event, with the given payload as JSON."""
    return events(spark, d).select(F.col("user_id").cast("string").alias("session_id"), _id().alias("frame_no"), (seconds(F.col("ts")) * 10**9).alias("received_at_ns"), payload.alias("payload"))


@query("m3_best_quotes", "select event_id as frame_no, case when event_id % 6 in (1, 2) then 'ok' when event_id % 6 = 3 then 'both_sides_empty' when event_id % 6 = 4 then 'bad_number' else 'ok' end as status, case when event_id % 6 in (0, 1, 5) then value::decimal(18,6)::double end as bid, case when event_id % 6 in (0, 2, 5) then (value::decimal(18,6) + 1)::double end as ask from events")
def m3(spark, d):
    k, v = _id() % 6, F.col("value").cast("decimal(18,6)")
    level = lambda x: F.array(F.array(x.cast("string"), F.lit("2"), F.lit("0"), F.lit("1")))
    none = F.array().cast("array<array<string>>")
    bids, asks = F.when(k.isin(0, 1, 5), level(v)).when(k == 4, level(F.lit("x"))).otherwise(none), F.when(k.isin(0, 2, 5), level(v + 1)).otherwise(none)
    payload = F.to_json(F.struct(F.struct(F.lit("bbo-tbt").alias("channel"), F.lit("I").alias("instId")).alias("arg"), F.array(F.struct(asks.alias("asks"), bids.alias("bids"), F.lit("5").alias("ts"))).alias("data")))
    good, bad = landed.bbo(raw_frames(spark, d, payload))
    return good.select("frame_no", F.lit("ok").alias("status"), "bid", "ask").union(bad.select("frame_no", "reason", F.lit(None).cast("double"), F.lit(None).cast("double")))


@query("m5_instruments", "select event_id as frame_no, epoch_us(ts) // 1000000 * 1000000000 as effective_ns, case when event_id % 3 = 0 then 0.1 when event_id % 3 = 1 then 0.01 end::double as tick_size, 'live' as state from events where event_id % 2 = 0")
def m5(spark, d):
    tick = F.when(_id() % 3 == 0, "0.1").when(_id() % 3 == 1, "0.01").otherwise("")
    data = F.array(F.struct(F.lit("I").alias("instId"), tick.alias("tickSz"), F.lit("1").alias("lotSz"), F.lit("0.01").alias("ctVal"), F.lit("live").alias("state")))
    payload = F.to_json(F.struct(F.struct(F.when(_id() % 2 == 0, "instruments").otherwise("trades").alias("channel")).alias("arg"), data.alias("data")))
    return landed.instruments(raw_frames(spark, d, payload)).select("frame_no", "effective_ns", "tick_size", "state")


@query("s17_rest_instruments", "select event_id, case when event_id % 4 = 0 then 0 when event_id % 4 = 1 then 2 else 1 end as rows, case when event_id % 4 > 1 then value::decimal(18,6)::double end as tick_size from events")
def s17(spark, d):
    item = F.struct(F.lit("I").alias("instId"), F.col("value").cast("decimal(18,6)").cast("string").alias("tickSz"))
    data = F.when(_id() % 4 == 0, F.array().cast("array<struct<instId:string,tickSz:string>>")).when(_id() % 4 == 1, F.array(item, item)).otherwise(F.array(item))
    value = F.to_json(F.struct(F.lit("/x").alias("endpoint"), _id().alias("received_at_ns"), F.struct(data.alias("data")).alias("body")))
    good, bad = landed.rest_instruments(events(spark, d).select(_id().cast("string").alias("path"), value.alias("value")))
    return good.select(F.col("effective_ns").alias("event_id"), F.lit(1).alias("rows"), "tick_size").union(bad.select(F.col("path").cast("long"), "rows", F.lit(None).cast("double")))


@query("m6_controls", "select event_id as frame_no, case event_id % 5 when 0 then 'control' when 1 then 'unknown_event' when 2 then 'unknown_channel' when 3 then 'malformed' end as kind from events where event_id % 5 <> 4")
def m6(spark, d):
    k = _id() % 5
    payload = F.when(k == 0, '{"event":"subscribe"}').when(k == 1, '{"event":"party"}').when(k == 2, '{"arg":{"channel":"candles"}}').when(k == 3, "{}").otherwise('{"arg":{"channel":"trades"}}')
    return landed.controls(raw_frames(spark, d, payload)).select("frame_no", "kind")


@query("m10_roll_up", "with s as (select user_id, count(*) as frames, count(*) filter (where event_type = 'click') as c, count(*) filter (where event_type = 'purchase') as p from events group by 1) select count(*) as sessions, count(*) filter (where c > 0 and p > 0 and frames >= 10) as ok, sum(frames)::bigint as frames, sum(c)::bigint as n_click, sum(p)::bigint as n_purchase, count(*) filter (where c = 0 or p = 0) as incomplete from s")
def m10(spark, d):
    """All sessions' quality in one row."""
    q = sessions.quality_report(frames(spark, d), ["session"], "event_type", ["click", "purchase"])
    return sessions.rolled_up(q, ["click", "purchase"])


@query("m11_clock_gate", "with x as (select event_type, epoch_us(ts) // 1000000 as t, event_id % 997 <> 0 as synced, round(value / 10 - 5, 6) as o, event_id from events), y as (select event_type, t, bool_and(synced) as synced, max(o) as o from x group by 1, 2), z as (select *, coalesce(t - lag(t) over (partition by event_type order by t) > 7200, false) as late from y) select event_type, count(*) as samples, bool_and(synced) as all_synced, round(avg(late::int), 6) as late_share, round(quantile_disc(abs(o), 0.99), 6) as p99_ms, round(max(abs(o)), 6) as max_ms, bool_and(synced) and avg(late::int) < 0.2 and quantile_disc(abs(o), 0.99) <= 20 and max(abs(o)) <= 100 as passed from z group by 1")
def m11(spark, d):
    x = events(spark, d).groupBy("event_type", seconds(F.col("ts")).alias("t")).agg(F.bool_and(_id() % 997 != 0).alias("synced"), F.max(F.round(F.col("value") / 10 - 5, 6)).alias("offset_ms"))
    return sessions.clock_gate(x, ["event_type"], 7200, share=0.2).withColumns({c: r6(F.col(c)) for c in ("late_share", "p99_ms", "max_ms")})


_QUOTES = "q as (select symbol, t, least(open, close) as bid, volume as bid_size, greatest(open, close) + 1 as ask, taker_volume + 1 as ask_size from b)"


def quotes(spark, d):
    return market(spark, d).select("symbol", "t", F.least("open", "close").alias("bid"), F.col("volume").alias("bid_size"), (F.greatest("open", "close") + 1).alias("ask"), (F.col("taker_volume") + 1).alias("ask_size"))


@query("m13_order_flow", with_bars(f"select symbol, t, sum(e) over w as ofi, count(e) over w as changes from (select *, case when pb is not null then (case when bid >= pb then bid_size else 0 end) - (case when bid <= pb then pbs else 0 end) - ((case when ask <= pa then ask_size else 0 end) - (case when ask >= pa then pas else 0 end)) end as e from (select *, lag(bid) over o as pb, lag(bid_size) over o as pbs, lag(ask) over o as pa, lag(ask_size) over o as pas from q window o as (partition by symbol order by t))) window w as (partition by symbol order by t range between {10 * BAR - 1} preceding and current row)", _QUOTES).replace("select symbol, t, sum(e) over w as ofi", "select symbol, t, (sum(e) over w)::bigint as ofi"))
def m13(spark, d):
    return sessions.order_flow(quotes(spark, d), KEYS, 10 * BAR).select("symbol", "t", "ofi", "changes")


@query("m14_depth_depletion", with_bars(f"""select symbol, t, depth, case when count(depth) over w >= 20 then median(depth) over w end as usual, case when count(depth) over w >= 20 and median(depth) over w > 0 then round(1 - depth / median(depth) over w, 6) end as depleted from (
 select symbol, t, sum(case when abs(price - mid) <= mid * 0.3 then size else 0 end)::double as depth from (select *, (max(case when side = 'bid' then price end) over p + min(case when side = 'ask' then price end) over p) / 2 as mid from (select symbol, t, 'bid' as side, low as price, volume as size from b union all select symbol, t, 'bid', open, taker_volume from b union all select symbol, t, 'ask', high + 1, volume from b) window p as (partition by symbol, t)) group by 1, 2) window w as (partition by symbol order by t range between {56 * BAR} preceding and 1 preceding)"""))
def m14(spark, d):
    """Size near the middle of each bar's small book, against the median of the 56 points before."""
    b = market(spark, d)
    side = lambda s, p, z: b.select("symbol", "t", F.lit(s).alias("side"), p.alias("price"), z.alias("size"))
    levels = side("bid", F.col("low"), F.col("volume")).union(side("bid", F.col("open"), F.col("taker_volume"))).union(side("ask", F.col("high") + 1, F.col("volume")))
    x = sessions.near_depth(levels, ["symbol", "t"], 3000.0).withColumn("depth", F.col("depth").cast("double"))
    return sessions.depletion(x, KEYS, 56 * BAR, 20).select("symbol", "t", "depth", "usual", r6(F.col("depleted")).alias("depleted"))


@query("m15_absorption", with_bars(f"select b.symbol, b.t, s.flow, case when p.mid > 0 then round(s.mid / p.mid - 1, 6) end as move, coalesce(abs(s.flow) >= 8 and abs(s.mid / nullif(p.mid, 0) - 1) <= 0.25 and p.mid > 0, false) as absorbed from b join (select symbol, t, (open + close) / 2 as mid, (sum(2 * taker_volume - volume) over (partition by symbol order by t range between {6 * BAR - 1} preceding and current row))::bigint as flow from b) s on s.symbol = b.symbol and s.t = b.t left join (select symbol, t, (open + close) / 2 as mid from b) p on p.symbol = b.symbol and p.t = b.t - {6 * BAR}"))
def m15(spark, d):
    """Heavy one-sided flow that hardly moves the middle."""
    x = market(spark, d).select("symbol", "t", ((F.col("open") + F.col("close")) / 2).alias("mid"), (2 * F.col("taker_volume") - F.col("volume")).alias("signed"))
    return sessions.absorption(x, KEYS, 6 * BAR, 8, 0.25).select("symbol", "t", "flow", r6(F.col("move")).alias("move"), "absorbed")


@query("m4_book_levels", "select event_id as frame_no, side, level, price from (select event_id, 'ask' as side, unnest(range(event_id % 4)) as level, value from events union all select event_id, 'bid', unnest(range(2)), value from events), lateral (select (case when side = 'ask' then value::decimal(18,6) + 1 + level else value::decimal(18,6) - level end)::double as price)")
def m4(spark, d):
    """Books landed as arrays of text, one row a side and level."""
    v = F.col("value").cast("decimal(18,6)")
    level = lambda sign, n: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.array((v + F.lit(sign) * k.cast("decimal(18,6)") + F.lit(1 if sign > 0 else 0)).cast("decimal(18,6)").cast("string"), F.lit("1")))
    asks, bids = F.slice(level(1, 4), F.lit(1), (_id() % 4).cast("int")), F.slice(level(-1, 2), 1, 2)
    payload = F.to_json(F.struct(F.struct(F.lit("books5").alias("channel"), F.lit("I").alias("instId")).alias("arg"), F.lit("snapshot").alias("action"), F.array(F.struct(asks.alias("asks"), bids.alias("bids"), _id().alias("seqId"), F.lit(-1).alias("prevSeqId"))).alias("data")))
    return landed.book_levels(raw_frames(spark, d, payload)).select("frame_no", "side", F.col("level").cast("long").alias("level"), "price")
