"""Queries of sessions, books and streams; a user's events stand in for a session's frames."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import joins, sessions
from ..operators.bars import MONEY, seconds
from ..operators.quantiles import quantiles
from ..streaming import feeds
from .common import checkpoint_folder, events, r6, stored
from .registry import query

_F = "f as (select user_id as session, event_id, event_type, value, props, epoch_us(ts) // 1000000 as clock, row_number() over (partition by user_id order by ts, event_id) as frame_no from events)"


def frames(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return events(spark, d).select(F.col("user_id").alias("session"), "event_id", "event_type", "value", "props", seconds(F.col("ts")).alias("clock"), F.row_number().over(w).cast("long").alias("frame_no"))


@query("m1_continuity", f"with {_F}, g as (select * replace (frame_no + coalesce(sum((event_id % 50 = 0)::int) over (partition by session order by frame_no rows between unbounded preceding and 1 preceding), 0) as frame_no) from f) select session, count(*) as frames, coalesce(bool_and(frame_no = p + 1), true) as contiguous, count(*) filter (where clock < c) as clock_steps_back from (select *, lag(frame_no) over w as p, lag(clock) over w as c from g window w as (partition by session order by frame_no)) group by 1")
def m1(spark, d):
    """Numbers jump by one after every fiftieth event, so that some sessions have gaps; no frame is left out."""
    w = Window.partitionBy("session").orderBy("frame_no").rowsBetween(Window.unboundedPreceding, -1)
    jumps = F.coalesce(F.sum((F.col("event_id") % 50 == 0).cast("int")).over(w), F.lit(0))
    return sessions.continuity(frames(spark, d).withColumn("frame_no", F.col("frame_no") + jumps), ["session"])


@query("m1_continuity_whole", f"with {_F} select session, count(*) as frames, coalesce(bool_and(frame_no = p + 1), true) as contiguous, count(*) filter (where clock < c) as clock_steps_back from (select *, lag(frame_no) over w as p, lag(clock) over w as c from f window w as (partition by session order by frame_no)) group by 1")
def m1_whole(spark, d):
    """Frames numbered as they come, without gaps."""
    return sessions.continuity(frames(spark, d), ["session"])


@query("m2_payload_items", "select event_id, unnest(range((props->>'k')::bigint)) as idx, (props->>'k')::bigint as k from events")
def m2(spark, d):
    """Payloads are read before the explode; beside it Spark would read them again for each item."""
    read = events(spark, d).select("event_id", F.from_json("props", "k long")["k"].alias("k")).where("k > 0")
    return read.select("event_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("idx"), "k")


@query("m7_post_ready", f"with {_F} select session, frame_no, coalesce(max((event_type = 'signup')::int) over (partition by session order by frame_no) > 0, false) as post_ready from f")
def m7(spark, d):
    return sessions.after_ready(frames(spark, d), ["session"], F.col("event_type") == "signup").select("session", "frame_no", "post_ready")


_BOOK = f"{_F}, m as (select session, frame_no, event_id as seq, case when event_type = 'signup' then -1 when event_id % 13 = 0 then event_id - 1 else coalesce(lag(event_id) over (partition by session order by frame_no), 0) end as prev from f)"


def book(spark, d):
    w = Window.partitionBy("session").orderBy("frame_no")
    prev = F.when(F.col("event_type") == "signup", -1).when(F.col("event_id") % 13 == 0, F.col("event_id") - 1).otherwise(F.coalesce(F.lag("event_id").over(w), F.lit(0)))
    return frames(spark, d).select("session", "frame_no", F.col("event_id").alias("seq"), prev.cast("long").alias("prev"))


_BOOK_SQL = f"""with {_BOOK}, s as (select *, max(case when prev = -1 then frame_no end) over w as began, max(case when prev <> -1 and (l is null or prev <> l) then frame_no end) over w as broke
 from (select *, lag(seq) over (partition by session order by frame_no) as l from m) window w as (partition by session order by frame_no rows between unbounded preceding and current row))
 select session, frame_no, case when prev = -1 then 'snapshot' when not coalesce(began > coalesce(broke, -1), false) then 'gap' when seq = prev then 'heartbeat' when seq < prev then 'reset' else 'update' end as status, coalesce(began > coalesce(broke, -1), false) as valid from s"""


@query("m8_book_sequence", _BOOK_SQL)
def m8(spark, d):
    return sessions.book_sequence(stored(book(spark, d)), ["session"]).select("session", "frame_no", "status", "valid")


@query("m9_session_quality", f"with {_F} select session, count(*) as frames, count(*) filter (where event_type = 'click') as n_click, count(*) filter (where event_type = 'purchase') as n_purchase, array_to_string(list_sort(list_filter(['click', 'purchase'], lambda x: not list_contains(list(event_type), x))), ',') as missing, (count(*) >= 10 and bool_or(event_type = 'click') and bool_or(event_type = 'purchase')) as ok from f group by 1")
def m9(spark, d):
    q = sessions.quality_report(frames(spark, d), ["session"], "event_type", ["click", "purchase"])
    return q.select("session", "frames", "n_click", "n_purchase", F.array_join("missing", ",").alias("missing"), "ok")


@query("m9_session_quality_whole", f"with {_F} select session, count(*) as frames, count(*) filter (where event_type = 'click') as n_click, count(*) filter (where event_type = 'purchase') as n_purchase, array_to_string(list_sort(list_filter(['click', 'purchase'], lambda x: not list_contains(list(event_type), x))), ',') as missing, (count(*) >= 10 and bool_or(event_type = 'click') and bool_or(event_type = 'purchase')) as ok from f group by 1")
def m9_whole(spark, d):
    """Kept beside m9_session_quality, which once took a third of the frames."""
    q = sessions.quality_report(frames(spark, d), ["session"], "event_type", ["click", "purchase"])
    return q.select("session", "frames", "n_click", "n_purchase", F.array_join("missing", ",").alias("missing"), "ok")


@query("m12_decision_grid", f"with {_F}, g as (select session, unnest(generate_series(min(clock) // 21600 * 21600, (max(clock) // 21600 + 1) * 21600, 21600)) as q from f group by 1), s as (select session, clock, max(value) as v from f group by 1, 2) select g.session, g.q, case when g.q - s.clock <= 86400 then s.v end as v from g asof left join s on g.session = s.session and g.q > s.clock")
def m12(spark, d):
    return m12_whole(spark, d)


@query("m12_decision_grid_whole", f"with {_F}, g as (select session, unnest(generate_series(min(clock) // 21600 * 21600, (max(clock) // 21600 + 1) * 21600, 21600)) as q from f group by 1), s as (select session, clock, max(value) as v from f group by 1, 2) select g.session, g.q, case when g.q - s.clock <= 86400 then s.v end as v from g asof left join s on g.session = s.session and g.q > s.clock")
def m12_whole(spark, d):
    """A grid from each session's first to its last event, and the state strictly before each point."""
    f = frames(spark, d)
    step = F.lit(21600).cast("long")
    first, last = (F.floor(x("clock") / step).cast("long") for x in (F.min, F.max))
    grid = f.groupBy("session").agg(F.sequence(first * step, (last + 1) * step, step).alias("t")).select("session", F.explode("t").alias("t"))
    state = f.groupBy("session", F.col("clock").alias("t")).agg(F.max("value").alias("v"))
    return joins.as_of(grid, state, ["session"], 86400, ["v"], strict=True).select("session", F.col("t").alias("q"), "v")


@query("m16_strata_thresholds", "select (epoch_us(ts) // 3600000000 % 24)::int as hour, (epoch_us(ts) // 86400000000 + 3) % 7 >= 5 as weekend, quantile_disc(value, 0.95) as threshold from events group by 1, 2")
def m16(spark, d):
    s = seconds(F.col("ts"))
    x = events(spark, d).select((F.floor(s / 3600) % 24).cast("int").alias("hour"), ((F.floor(s / 86400) + 3) % 7 >= 5).alias("weekend"), "value")
    return quantiles(x, ["hour", "weekend"], "value", {"threshold": ("disc", 0.95)}).drop("n")


@query("m17_book_walk", "with l as (select l_orderkey, l_linenumber as level, min(floor(l_extendedprice / l_quantity)) as price, sum(l_quantity) as size from lineitem group by 1, 2), x as (select *, coalesce(sum(price * size) over (partition by l_orderkey order by level rows between unbounded preceding and 1 preceding), 0) as b from l) select l_orderkey, case when sum(price * size) >= 60000 then round(60000 / sum(greatest(0, least(price * size, 60000 - b)) / price), 4) end as mean_price, count(*) filter (where greatest(0, least(price * size, 60000 - b)) > 0) as levels from x group by 1")
def m17(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    price = F.floor(F.col("l_extendedprice") / F.col("l_quantity")).cast("double")
    levels = li.groupBy("l_orderkey", F.col("l_linenumber").alias("level")).agg(F.min(price).alias("price"), F.sum("l_quantity").cast("double").alias("size"))
    return sessions.book_walk(levels, ["l_orderkey"], 60000.0).withColumn("mean_price", F.round("mean_price", 4))


@query("m18_natural_keys", "with x as (select l_orderkey, l_linenumber, l_suppkey from lineitem union all select l_orderkey, l_linenumber, l_suppkey + l_orderkey % 2 from lineitem where l_orderkey % 5 = 0) select l_orderkey, l_linenumber, count(*) as n, count(distinct l_suppkey) > 1 as conflict, min(l_suppkey) as l_suppkey from x group by 1, 2")
def m18(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_suppkey")
    twice = li.where("l_orderkey % 5 = 0").withColumn("l_suppkey", F.col("l_suppkey") + F.col("l_orderkey") % 2)
    return sessions.natural_key_dedupe(li.union(twice), ["l_orderkey", "l_linenumber"], ["l_suppkey"])


def _streamed(spark, result, mode: str, keys: tuple[str, ...] = ()):
    import uuid

    at = f"{checkpoint_folder(spark)}/stream-{uuid.uuid4().hex}"
    return feeds.run_available(result, f"{at}/table", f"{at}/checkpoint", mode, keys)


@query("a31_streamed_counts", "select event_type, epoch_us(ts) // 3600000000 * 3600 as t, count(*) as n, sum(value::decimal(18,6))::double as total from events group by 1, 2")
def a31_streamed(spark, d):
    """Hourly counts of each feed, by Structured Streaming over the table's file."""
    return _streamed(spark, feeds.counts(feeds.stream(spark, d, "events.parquet")), "update", ("event_type", "t"))


@query("m8_streamed_books", _BOOK_SQL)
def m8_streamed(spark, d):
    """The book check with keyed state: messages are written as files and read as a stream, in one batch or many."""
    import uuid

    at = f"{checkpoint_folder(spark)}/messages-{uuid.uuid4().hex}"
    book(spark, d).select("session", "frame_no", F.lit("book").alias("kind"), "prev", "seq", F.lit(0).alias("levels")).write.parquet(at)
    return _streamed(spark, feeds.checked_books(feeds.stream(spark, at)), "append")
