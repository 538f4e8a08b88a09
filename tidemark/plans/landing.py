"""Queries of landed rows: text made of bars and events, with faults put in by rule, is normalised and judged."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.bars import BAR, MONEY, seconds
from ..sources import landed
from .common import events, market, with_bars
from .registry import query

MS = BAR * 1000


def raw_bars(spark, d):
    """Bars as a dump's text: some times off the grid, some numbers unreadable, some close times late, some flows missing."""
    b = market(spark, d)
    t, text = F.col("t"), lambda c: c.cast(MONEY).cast("string")
    odd = F.floor(t / BAR)
    return b.select(
        F.col("symbol").alias("of"), "t",
        F.when(odd % 17 == 0, (t * 1000 + 1).cast("string")).when(odd % 13 == 0, (t * 1_000_000).cast("string")).otherwise((t * 1000).cast("string")).alias("open_time"),
        text(F.col("open")).alias("open"), text(F.col("high")).alias("high"), text(F.col("low")).alias("low"), F.when(odd % 19 == 0, "n/a").otherwise(text(F.col("close"))).alias("close"),
        F.when(odd % 5 == 0, F.col("volume").cast("string")).otherwise("0").alias("volume"),
        F.when(odd % 11 == 0, (t * 1000 + 5000).cast("string")).otherwise((t * 1000 + MS - 1).cast("string")).alias("close_time"),
        F.lit("0").alias("quote_volume"), (F.col("volume") - 1).cast("string").alias("trades"), F.lit("0").alias("taker_base"), F.lit("0").alias("taker_quote"), F.lit("0").alias("ignore"), F.lit(None).cast("string").alias("problem"), F.lit("x").alias("path"), F.lit(0).cast("long").alias("row_no"),
    )


_ODD = f"t // {BAR}"
_MONEY = "::decimal(18,6)::double"
_GRID = f"when {_ODD} % 17 = 0 then 'off_grid'"


def _counted(good, bad, price: str):
    """Both outcomes as counts and sums by reason."""
    a = good.select(F.lit("ok").alias("reason"), F.col(price).alias("x"))
    b = bad.select("reason", F.lit(0.0).alias("x"))
    return a.union(b).groupBy("reason").agg(F.count("*").alias("n"), F.round(F.sum(F.col("x").cast(MONEY)).cast("double"), 4).alias("total"))


def _counted_sql(case: str, price: str = "close") -> str:
    return with_bars(f"select reason, count(*) as n, round(sum(case when reason = 'ok' then {price}::decimal(18,6) else 0 end)::double, 4) as total from (select *, case {case} else 'ok' end as reason from b) group by 1")


_LATE = f"when {_ODD} % 11 = 0 then 'bad_close_time'"
_TEXT = f"when {_ODD} % 19 = 0 then 'bad_number'"


@query("s8_klines_exact", _counted_sql(f"{_GRID} {_LATE} {_TEXT}"))
def s8(spark, d):
    return _counted(*landed.klines(raw_bars(spark, d), "x", MS), "close")


@query("s8_klines_last_trade", _counted_sql(f"{_GRID} {_TEXT}"))
def s8_last(spark, d):
    return _counted(*landed.klines(raw_bars(spark, d), "x", MS, close_time="last_trade"), "close")


@query("s9_mark_price", with_bars(f"select reason, count(*) as n, count(*) filter (where reason = 'ok' and volume = 1) as stale from (select *, case {_GRID} {_TEXT} when {_ODD} % 5 = 0 then 'flow_not_zero' else 'ok' end as reason from b) group by 1"))
def s9(spark, d):
    good, bad = landed.mark_price(raw_bars(spark, d), "x", MS)
    return good.select(F.lit("ok").alias("reason"), "stale").union(bad.select("reason", F.lit(False))).groupBy("reason").agg(F.count("*").alias("n"), F.count_if("stale").alias("stale"))


@query("s10_index_price", _counted_sql(f"{_GRID} {_TEXT} when {_ODD} % 5 = 0 then 'flow_not_zero' when low::decimal(18,6) <= 0 then 'not_positive'"))
def s10(spark, d):
    return _counted(*landed.index_price(raw_bars(spark, d), "x", MS), "index_close")


@query("s11_premium_index", _counted_sql(f"{_GRID} {_TEXT}", "high"))
def s11(spark, d):
    return _counted(*landed.premium_index(raw_bars(spark, d), "x", MS), "premium_high")


@query("s12_funding_events", with_bars(f"select symbol, t * 1000 as ts, round(close::decimal(18,6)::double, 6) as funding_rate, 8.0::double as declared_hours from b where t % 28800 = 0 and {_ODD} % 19 <> 0 and {_ODD} % 7 <> 0"))
def s12(spark, d):
    t = F.col("t")
    rows = market(spark, d).where("t % 28800 = 0").select(F.col("symbol").alias("of"), (t * 1000).cast("string").alias("calc_time"), F.when(F.floor(t / BAR) % 7 == 0, "0").otherwise("8").alias("funding_interval_hours"), F.when(F.floor(t / BAR) % 19 == 0, "").otherwise(F.col("close").cast(MONEY).cast("string")).alias("last_funding_rate"))
    good = None
    for s in ("click", "view", "purchase", "error", "signup"):
        part, _ = landed.funding_events(rows.where(F.col("of") == s), s)
        good = part if good is None else good.union(part)
    return good.withColumn("funding_rate", F.round("funding_rate", 6))


@query("s13_metrics", with_bars(f"select reason, count(*) as n, count(r) as ratios from (select case when {_ODD} % 17 = 0 then 'bad_time' when {_ODD} % 13 = 0 then 'other_symbol' when {_ODD} % 11 = 0 then 'no_open_interest' when {_ODD} % 19 = 0 then 'bad_ratio' else 'ok' end as reason, case when {_ODD} % 17 <> 0 and {_ODD} % 13 <> 0 and {_ODD} % 11 <> 0 and {_ODD} % 19 <> 0 and {_ODD} % 2 = 0 then 1 end as r from b) group by 1"))
def s13(spark, d):
    odd = F.floor(F.col("t") / BAR)
    stamp = F.date_format(F.timestamp_seconds("t"), "yyyy-MM-dd HH:mm:ss")
    rows = market(spark, d).select(F.when(odd % 17 == 0, "soon").otherwise(stamp).alias("create_time"), F.when(odd % 13 == 0, "Y").otherwise("X").alias("symbol"), F.when(odd % 11 == 0, "  ").otherwise(F.col("volume").cast("string")).alias("sum_open_interest"), F.when(odd % 19 == 0, "?").when(odd % 2 == 0, "1.5").otherwise("").alias("ratio"))
    good, bad = landed.metrics_rows(rows, "X", ["ratio"])
    return good.select(F.lit("ok").alias("reason"), "ratio").union(bad.select("reason", F.lit(None).cast("double"))).groupBy("reason").agg(F.count("*").alias("n"), F.count("ratio").alias("ratios"))


_PAGES = "pages as (select epoch_us(ts) // 86400000000 as page, min(epoch_us(ts) // 1000000) as first_t, max(epoch_us(ts) // 1000000) as last_t from events group by 1)"


@query("s14_rest_funding", f"with {_PAGES}, e as (select event_id as id, epoch_us(ts) // 1000000 as t, case when event_id % 7 = 0 then '' when event_id % 5 = 0 then 'a' when event_id % 3 = 0 then '-1' else value::decimal(18,6)::varchar end as mark_text, value from events) select id, case when mark_text = '' then 'absent' when mark_text = 'a' then 'unparseable' when mark_text = '-1' or value::decimal(18,6) <= 0 then 'non_positive' else 'valid' end as mark_status, case when mark_text not in ('', 'a', '-1') and value::decimal(18,6) > 0 then round(value, 6) end as mark_price, (select min(page) from pages p where e.t between p.first_t and p.last_t) as page from e")
def s14(spark, d):
    s = seconds(F.col("ts"))
    e = events(spark, d)
    i = F.col("event_id")
    text = F.when(i % 7 == 0, "").when(i % 5 == 0, "a").when(i % 3 == 0, "-1").otherwise(F.col("value").cast(MONEY).cast("string"))
    rows = e.select(i.alias("id"), s.alias("t"), text.alias("mark_text"))
    pages = e.groupBy(F.floor(s / 86400).alias("page")).agg(F.min(s).alias("first_t"), F.max(s).alias("last_t"))
    return landed.rest_funding(rows, pages, 86400).select("id", "mark_status", F.round("mark_price", 6).alias("mark_price"), "page")


@query("s15_pages_audit", """with r as (select event_type, user_id % 5 as page, event_id // 2 as id, epoch_us(ts) // 1000000 as t, case when event_id % 50 = 0 then 'y' else 'x' end as symbol from events), p as (select event_type, page, min(t) as lo, max(t) as hi from r group by 1, 2),
 back as (select event_type, count(*) filter (where lo <= q) as not_advancing from (select *, lag(hi) over (partition by event_type order by page) as q from p) group by 1), s as (select event_type, count(*) filter (where n > 1) as repeated_ids from (select event_type, id, count(*) as n from r group by 1, 2) group by 1)
 select event_type, count(*) as rows, count(*) filter (where not t between 1704153600 and 1706572800) as out_of_range, count(*) filter (where t >= 1706486400) as sealed, count(*) filter (where symbol <> 'x') as other_symbol, any_value(repeated_ids) as repeated_ids, any_value(not_advancing) as not_advancing from r join back using (event_type) join s using (event_type) group by 1""")
def s15(spark, d):
    rows = events(spark, d).select("event_type", (F.col("user_id") % 5).alias("page"), F.floor(F.col("event_id") / 2).alias("id"), seconds(F.col("ts")).alias("t"), F.when(F.col("event_id") % 50 == 0, "y").otherwise("x").alias("symbol"))
    return landed.pages_audit(rows, ["event_type"], 1704153600, 1706572800, 1706486400, "x")


@query("s18_archive_kind", "select event_id, case when event_id % 3 = 0 then 'rest' when event_id % 3 = 1 then 'ws' end as kind from events")
def s18(spark, d):
    i = F.col("event_id")
    record = F.when(i % 3 == 0, F.to_json(F.struct(F.lit("/v5/x").alias("endpoint"), i))).when(i % 3 == 1, F.to_json(F.struct(i.alias("frame_no")))).otherwise("{broken")
    return events(spark, d).select("event_id", landed.archive_kind(record).alias("kind"))


@query("s4_funding_objects", "select event_type as symbol, epoch_us(ts) // 1000000 * 1000 as ts, round(value, 6) as funding_rate from events")
def s4(spark, d):
    """Events landed as one response a day and feed, read back as settlements."""
    item = F.struct(F.col("event_type").alias("instId"), (seconds(F.col("ts")) * 1000).cast("string").alias("fundingTime"), F.col("value").cast("string").alias("fundingRate"))
    bodies = events(spark, d).groupBy("event_type", F.floor(seconds(F.col("ts")) / 86400).alias("day")).agg(F.collect_list(item).alias("data")).select(F.to_json(F.struct("data")).alias("body"))
    return landed.funding_objects(bodies).withColumn("funding_rate", F.round("funding_rate", 6))


@query("s5_open_interest", with_bars("select 'x' as symbol, t * 1000 as ts, volume::double as oi, taker_volume::double as oi_usd from b"))
def s5(spark, d):
    item = F.array((F.col("t") * 1000).cast("string"), F.col("volume").cast("string"), F.col("taker_volume").cast("string"))
    bodies = market(spark, d).groupBy("symbol", F.floor(F.col("t") / 86400).alias("day")).agg(F.collect_list(item).alias("data")).select(F.to_json(F.struct("data")).alias("body"))
    return landed.open_interest_arrays(bodies, "x")


@query("s3_candles", with_bars("select 'x' as symbol, t * 1000 as ts, round(close, 6) as close, volume::double as volume from b where volume > 2"))
def s3(spark, d):
    """Candle arrays of which only confirmed ones count."""
    text = lambda c: F.col(c).cast("string")
    item = F.array((F.col("t") * 1000).cast("string"), text("open"), text("high"), text("low"), text("close"), text("volume"), F.lit("0"), text("volume_quote"), F.when(F.col("volume") > 2, "1").otherwise("0"))
    bodies = market(spark, d).groupBy("symbol", F.floor(F.col("t") / 86400).alias("day")).agg(F.collect_list(item).alias("data")).select(F.to_json(F.struct("data")).alias("body"))
    return landed.candles(bodies, "x").select("symbol", "ts", F.round("close", 6).alias("close"), "volume")


@query("s7_epoch_units", "select event_id, case when event_id % 4 = 0 then null else epoch_us(ts) // 1000000 * 1000 end as ms from events")
def s7(spark, d):
    ms, i = seconds(F.col("ts")) * 1000, F.col("event_id")
    raw = F.when(i % 4 == 0, ms * 1000 + 500).when(i % 4 == 1, ms * 1000).when(i % 4 == 2, ms * 1000 + 999).otherwise(ms).cast("string")
    return events(spark, d).select("event_id", landed.epoch_ms(raw).alias("ms"))


@query("s22_flat_record", "select user_id, count(*) as n, count(*)::int as ids_count, sha256(string_agg(event_id::varchar, ',' order by event_id)) as ids_sha256 from events group by 1")
def s22(spark, d):
    x = events(spark, d).groupBy("user_id").agg(F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list("event_id")), lambda i: i.cast("string")).alias("ids"))
    return landed.flat_record(x, "ids")


@query("k1_merge_new", "with old as (select event_id, value from events where event_id % 3 <> 0), new as (select event_id, value + 1 as value from events where event_id % 2 = 0) select event_id, value from old union all select event_id, value from new where event_id not in (select event_id from old)")
def k1(spark, d):
    """New rows join a table only where their key is not there yet."""
    e = events(spark, d).select("event_id", "value")
    out, _ = landed.merge_new(e.where("event_id % 3 <> 0"), e.where("event_id % 2 = 0").withColumn("value", F.col("value") + 1), ["event_id"])
    return out


@query("k6_resume_plan", "select event_type, min(epoch_us(ts) // 1000000) as first_t, max(epoch_us(ts) // 1000000) as last_t, case when max(epoch_us(ts) // 1000000) >= 1706600000 then 'incremental' else 'backfill' end as mode from events group by 1")
def k6(spark, d):
    from ..sources.sinks import resume_plan

    return resume_plan(events(spark, d).withColumn("t", seconds(F.col("ts"))), ["event_type"], 1706600000)


@query("k8_merged_parts", "select epoch_us(ts) // 86400000000 as day, count(*) as n from events group by 1")
def k8(spark, d):
    """Two overlapping parts of a daily series merged into one; equal days must agree and none may be missing."""
    from ..sources.sinks import merged_series

    days = events(spark, d).groupBy(F.floor(seconds(F.col("ts")) / 86400).alias("day")).agg(F.count("*").alias("n"))
    return merged_series([days.where("day <= 19740"), days.where("day >= 19730")], "day")


_TWICE = "x as (select symbol, t * 1000 as ts, close, 'X-2024-01.zip' as path from b union all select symbol, t * 1000, close + 1, 'X-2024-02.zip' from b where t % 7200 = 0 union all select symbol, t * 1000, close, 'X-2024-02.zip' from b where t % 10800 = 0)"


def _landed_twice(spark, d):
    b = market(spark, d).select("symbol", (F.col("t") * 1000).alias("ts"), "close")
    own, other = F.lit("X-2024-01.zip"), F.lit("X-2024-02.zip")
    more = b.where("ts % 7200000 = 0").select("symbol", "ts", (F.col("close") + 1).alias("close")).union(b.where("ts % 10800000 = 0"))
    return b.withColumn("path", own).union(more.withColumn("path", other))


@query("x25_owner_first", with_bars("select symbol, ts, close, path from x where path = 'X-2024-01.zip'", _TWICE))
def x25(spark, d):
    """Of rows that several files hold, the one of the file whose month it is."""
    return landed.owned_first(_landed_twice(spark, d), ["symbol", "ts"])[0]


@query("a8_landed_account", with_bars("select count(*) as keys, sum(n)::bigint as rows, sum(d)::bigint as distinct_rows, count(*) filter (where d > 1) as conflicts from (select symbol, ts, count(*) as n, count(distinct close) as d from x group by 1, 2)", _TWICE))
def a8_landed(spark, d):
    return landed.owned_first(_landed_twice(spark, d), ["symbol", "ts"])[1]


@query("s21_text_rows", with_bars(f"select symbol, t * 1000 as ts, high::decimal(18,6)::varchar as high_text from b where t < 1706486400 and {_ODD} % 17 <> 0"))
def s21(spark, d):
    """Prices kept as the source's text, by epoch; rows behind the seal or off the grid are not read on."""
    return landed.text_rows(raw_bars(spark, d).withColumnRenamed("of", "symbol"), "open_time", ["symbol"], {"high_text": "high"}, 1706486400_000, MS)
