"""Queries of order books: messages, their sequence, states rebuilt from updates, depletion, and readiness of sessions.

Events stand in for messages, one book an event type: every 97th id is a snapshot, every 113th breaks the sequence, every
17th repeats its number (every 34th with levels, which breaks it too) and every 19th falls back to a smaller number."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins, sessions
from ..operators.bars import ordered
from ..operators.books import book_states, net_depletion
from ..sources import landed
from .common import events, r6, stored
from .depth import raw_frames
from .micro import _F, frames
from .registry import query

KEYS, BPS, STEP = ["symbol"], 500.0, 25

_MESSAGES = """e0 as (select event_type as symbol, event_id as id, case when event_id % 19 = 0 then event_id % 1000 else event_id end as s0 from events),
 e1 as (select *, case when id % 17 = 0 then coalesce(lag(s0) over (partition by symbol order by id), s0) else s0 end as seq, case when id % 17 = 0 then (id % 34 = 0)::int when id % 97 = 0 then 3 else 2 end as n from e0),
 e2 as (select *, case when id % 97 = 0 then -1 when id % 113 = 0 then coalesce(lag(seq) over o, 0) - 1 else coalesce(lag(seq) over o, 0) end as prev, lag(seq) over o as last from e1 window o as (partition by symbol order by id)),
 e3 as (select *, max(case when prev = -1 then id end) over o as began, max(case when prev <> -1 and (last is null or prev <> last or (seq = prev and n > 0)) then id end) over o as broke from e2 window o as (partition by symbol order by id rows between unbounded preceding and current row)),
 m as (select *, coalesce(began > coalesce(broke, -1), false) as valid, case when prev = -1 then 'snapshot' when not coalesce(began > coalesce(broke, -1), false) then 'gap' when seq = prev then 'heartbeat' when seq < prev then 'reset' else 'update' end as status from e3),
 v as (select symbol, id, k, 'bid' as side, (100 - (id * 7 + k * 3) % 20)::double as price, ((id + k) % 4)::double as size from m, (select unnest(range(3)) as k) where k < n
       union all select symbol, id, k, 'ask', (101 + (id * 11 + k * 5) % 20)::double, ((id + k + 1) % 4)::double from m, (select unnest(range(3)) as k) where k < n)"""
_STATES = f"""{_MESSAGES}, h as (select m.symbol, m.id, v.side, v.price, arg_max(v.size, (v.id, v.k)) as size from m join v on v.symbol = m.symbol and v.id between m.began and m.id where m.valid group by 1, 2, 3, 4),
 b as (select symbol, id, max(price) filter (where side = 'bid') as bid, min(price) filter (where side = 'ask') as ask, count(*) as held from h where size > 0 group by 1, 2),
 d as (select h.symbol, h.id, coalesce(sum(h.price * h.size) filter (where side = 'bid' and h.price >= (bid + ask) / 2 * {1 - BPS / 10_000}), 0) as bid_depth, coalesce(sum(h.price * h.size) filter (where side = 'ask' and h.price <= (bid + ask) / 2 * {1 + BPS / 10_000}), 0) as ask_depth
       from h join b using (symbol, id) where size > 0 and bid is not null and ask is not null group by 1, 2),
 st as (select m.symbol, m.id, m.status, m.valid, case when d.id is not null then bid end as bid, case when d.id is not null then ask end as ask, bid_depth, ask_depth, case when m.valid then coalesce(held, 0) end as levels_held
        from m left join b on b.symbol = m.symbol and b.id = m.id left join d on d.symbol = m.symbol and d.id = m.id)"""


def messages(spark, d):
    """(symbol, id, prev, seq, asks, bids)."""
    i = F.col("id")
    x = events(spark, d).select(F.col("event_type").alias("symbol"), F.col("event_id").alias("id")).withColumn("s0", F.when(i % 19 == 0, i % 1000).otherwise(i))
    x = ordered(x, KEYS, {"before": ("lag", "s0")}, "id", 10_000)
    x = x.withColumn("seq", F.when(i % 17 == 0, F.coalesce("before", "s0")).otherwise(F.col("s0"))).drop("before")
    x = ordered(x, KEYS, {"before": ("lag", "seq")}, "id", 10_000)
    last = F.coalesce("before", F.lit(0))
    n = F.when(i % 17 == 0, (i % 34 == 0).cast("int")).when(i % 97 == 0, 3).otherwise(2)
    level = lambda price, size: F.slice(F.transform(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda k: F.struct(price(k).cast("double").alias("price"), size(k).cast("double").alias("size"))), F.lit(1), n)
    bids, asks = level(lambda k: 100 - (i * 7 + k * 3) % 20, lambda k: (i + k) % 4), level(lambda k: 101 + (i * 11 + k * 5) % 20, lambda k: (i + k + 1) % 4)
    return x.select("symbol", "id", F.when(i % 97 == 0, -1).when(i % 113 == 0, last - 1).otherwise(last).cast("long").alias("prev"), "seq", asks.alias("asks"), bids.alias("bids"))


@query("m8_repeats_and_resets", f"with {_MESSAGES} select symbol, id, status, valid from m")
def m8_repeats(spark, d):
    """A gap lasts until the next snapshot; a repeated number with levels is a gap, one without a heartbeat."""
    x = messages(spark, d).withColumn("levels", F.size("asks") + F.size("bids"))
    return sessions.book_sequence(x, KEYS, "id", 10_000).select("symbol", "id", "status", "valid")


@query("m14_book_states", f"with {_STATES} select * from st")
def m14_states(spark, d):
    """The book after each message, from chunks that start from what is carried over."""
    return book_states(messages(spark, d), KEYS, BPS, "id", 2000)


@query("m14_net_depletion", f"""with {_STATES}, g as (select symbol, unnest(generate_series(lo // {STEP} * {STEP}, hi, {STEP})) as t from (select symbol, min(id) as lo, max(id) as hi from m group by 1)),
 q as (select g.symbol, g.t, st.bid_depth, st.ask_depth from g asof join st on st.symbol = g.symbol and st.id <= g.t),
 w as (select *, case when count(bid_depth) over r = 8 then nullif(median(bid_depth) over r, 0) end as ub, case when count(ask_depth) over r = 8 then nullif(median(ask_depth) over r, 0) end as ua from q window r as (partition by symbol order by t range between {12 * STEP} preceding and {5 * STEP} preceding))
 select symbol, t, round(1 - bid_depth / ub, 6) as bid_short, round(1 - ask_depth / ua, 6) as ask_short, round(1 - ask_depth / ua - (1 - bid_depth / ub), 6) as depletion from w""")
def m14_depletion(spark, d):
    """On a grid of ids, each point with the state in force: the shortfall from the median of eight points before."""
    states = book_states(messages(spark, d), KEYS, BPS, "id", 2000).select("symbol", F.col("id").alias("t"), F.col("id"), "bid_depth", "ask_depth")
    states = stored(states)  # replayed once, for the span and for the points
    span = states.groupBy("symbol").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    step = F.lit(STEP).cast("long")
    grid = span.select("symbol", F.explode(F.sequence(F.floor(F.col("lo") / step) * step, F.col("hi"), step)).alias("t"))
    held = joins.as_of(grid, states.select("symbol", "t", F.struct("bid_depth", "ask_depth").alias("s")), KEYS, 100_000, ["s"]).where("s is not null").select("symbol", "t", "s.*")
    x = net_depletion(held, KEYS, STEP, far=12)
    return x.select("symbol", "t", *(r6(F.col(c)).alias(c) for c in ("bid_short", "ask_short", "depletion")))


@query("m7_ready_once", f"with {_F} select session, count(*) filter (where event_type = 'signup') as readies, min(frame_no) filter (where event_type = 'signup') as first_ready, count(*) filter (where event_type = 'signup') <= 1 as ready_valid from f group by 1")
def m7_once(spark, d):
    return sessions.ready_once(frames(spark, d), ["session"], F.col("event_type") == "signup")


@query("m4_book_messages", """select event_id as frame_no, case event_id % 9 when 1 then 'no_action' when 2 then 'no_data' when 3 then 'sides_missing' when 4 then 'bad_sequence' when 5 then 'bad_time' when 6 then 'bad_level' else 'ok' end as status,
 case when event_id % 9 in (0, 7, 8) then event_id end as seq, case when event_id % 9 in (0, 7, 8) then (event_id % 9 = 0)::int end as ask_levels, case when event_id % 9 in (0, 7, 8) then event_id % 9 = 7 end as is_heartbeat, case when event_id % 9 in (0, 7, 8) then event_id % 9 = 8 end as is_reset from events""")
def m4_messages(spark, d):
    """Book frames of all kinds: each is a message with its flags or has a reason."""
    i = F.col("event_id")
    k = i % 9
    level = F.array(F.array(F.when(k == 6, "x").otherwise("10.5"), F.lit("2")))
    none = F.array().cast("array<array<string>>")
    side = F.when(k.isin(0, 6), level).when(k != 3, none)
    prev = F.when(k == 7, i).when(k == 8, i + 1).otherwise(i - 1)
    item = F.struct(side.alias("asks"), F.when(k == 0, level).otherwise(none).alias("bids"), F.when(k == 4, "x").otherwise(i.cast("string")).alias("seqId"), prev.cast("string").alias("prevSeqId"), F.when(k == 5, "").otherwise("5").alias("ts"))
    data = F.when(k == 2, F.slice(F.array(item), 1, 0)).otherwise(F.array(item))
    payload = F.to_json(F.struct(F.struct(F.lit("books").alias("channel"), F.lit("I").alias("instId")).alias("arg"), F.when(k == 1, "party").otherwise("update").alias("action"), data.alias("data")))
    x = landed.judged_book_messages(raw_frames(spark, d, payload))
    ok = F.col("reason").isNull()
    flags = [F.when(ok, F.col(c)).alias(c) for c in ("seq", "ask_levels", "is_heartbeat", "is_reset")]
    return x.select("frame_no", F.coalesce("reason", F.lit("ok")).alias("status"), *flags)
