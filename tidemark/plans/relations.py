"""Queries of joins, aggregates, reconciliation and accounting."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from ..operators import joins
from ..operators.bars import BAR, MONEY, gaps, ordered, rolling, seconds
from ..operators.quantiles import quantiles
from .common import events, market, r6, with_bars
from .registry import query

#: Rows of a part where an aggregate keeps nearly all rows that it reads.
DEALT = 400_000

_E = "e as (select event_id as id, event_type, user_id, value, epoch_us(ts) // 1000000 as t from events)"


def timed(spark, d):
    return events(spark, d).select(F.col("event_id").alias("id"), "event_type", "user_id", "value", seconds(F.col("ts")).alias("t"))


@query("j2_as_of_backward", f"with {_E}, l as (select id, user_id % 10 as k, t from e where event_type = 'error'), p as (select user_id % 10 as k, t as match_t, max(value) as value from e where event_type = 'purchase' group by 1, 2) select l.id, case when l.t - p.match_t <= 32400 then p.match_t end as match_t, case when l.t - p.match_t <= 32400 then p.value end as value from l asof left join p on l.k = p.k and l.t >= p.match_t")
def j2(spark, d):
    e = timed(spark, d).withColumn("k", F.col("user_id") % 10)
    right = e.where("event_type = 'purchase'").groupBy("k", "t").agg(F.max("value").alias("value"))
    return joins.as_of(e.where("event_type = 'error'").select("id", "k", "t"), right, ["k"], 32400, ["value"]).select("id", "match_t", "value")


@query("j5_as_of_forward", f"with {_E}, l as (select id, user_id % 10 as k, t from e where event_type = 'error'), p as (select user_id % 10 as k, t as match_t, max(value) as value from e where event_type = 'purchase' group by 1, 2) select l.id, case when p.match_t - l.t <= 7200 then p.match_t end as match_t from l asof left join p on l.k = p.k and l.t < p.match_t")
def j5(spark, d):
    e = timed(spark, d).withColumn("k", F.col("user_id") % 10)
    right = e.where("event_type = 'purchase'").groupBy("k", "t").agg(F.max("value").alias("value"))
    return joins.first_after(e.where("event_type = 'error'").select("id", "k", "t"), right, ["k"], 7200, ["value"]).select("id", "match_t")


@query("j7_two_venues", with_bars("select x.symbol, x.t, round(x.v / x.n - y.v / y.n, 6) as spread from (select event_type as symbol, epoch_us(ts) // 3600000000 * 3600 as t, sum(value::decimal(18,6))::double as v, count(*) as n from events where user_id % 2 = 0 group by 1, 2) x join (select event_type as symbol, epoch_us(ts) // 3600000000 * 3600 as t, sum(value::decimal(18,6))::double as v, count(*) as n from events where user_id % 2 = 1 group by 1, 2) y using (symbol, t)"))
def j7(spark, d):
    from ..operators.bars import bars

    e = events(spark, d)
    a, b = (bars(e.where(F.col("user_id") % 2 == k)).select("symbol", "t", (F.col("volume_quote") / F.col("volume")).alias(f"m{k}")) for k in (0, 1))
    return a.join(b, ["symbol", "t"]).select("symbol", "t", r6(F.col("m0") - F.col("m1")).alias("spread"))


_HOURS = "select event_type as symbol, epoch_us(ts) // 3600000000 * 3600 as t from events where user_id % 2 = {k} group by 1, 2"


@query("j8_only_in_one", f"with x as ({_HOURS.format(k=0)}), y as ({_HOURS.format(k=1)}) select 'even' as side, * from x anti join y using (symbol, t) union all select 'odd' as side, * from y anti join x using (symbol, t)")
def j8(spark, d):
    t = seconds(F.col("ts"))
    a, b = (events(spark, d).where(F.col("user_id") % 2 == k).select(F.col("event_type").alias("symbol"), (t - t % BAR).alias("t")).distinct() for k in (0, 1))
    return a.join(b, ["symbol", "t"], "left_anti").withColumn("side", F.lit("even")).union(b.join(a, ["symbol", "t"], "left_anti").withColumn("side", F.lit("odd")))


@query("j9_on_grid_snapshots", with_bars(f"select count(*) as n from e semi join b on b.symbol = 'click' and b.t = e.t - e.t % 60 where e.event_type = 'signup'", _E))
def j9(spark, d):
    e = timed(spark, d).where("event_type = 'signup'").withColumn("t", F.col("t") - F.col("t") % 60)
    return e.join(market(spark, d).where("symbol = 'click'").select("t"), "t", "left_semi").agg(F.count("*").alias("n"))


_COPY = "c as (select 2 * id as id, t + id % 7 - 3 as t, case when id % 17 = 0 then value + 1 else value end as value from e where id % 11 <> 0 union all select 2 * id + 1, t + id % 7 - 3, value from e where id % 13 = 0 and id % 11 <> 0)"


@query("j10_one_to_one", f"""with {_E}, {_COPY}, p as (select e.id as lid, c.id as rid, e.t as lt, c.t as rt, e.value as lv, c.value as rv from e join c on c.t between e.t - 2 and e.t + 2),
 l as (select lid, count(*) as n, min((rid, rt, rv)) as m from p group by 1), r as (select rid, count(*) as n from p group by 1),
 s as (select e.id as left_id, e.t as left_t, l.m[1] as right_id, l.m[2] - e.t as "offset", case when l.n is null then 'unmatched' when l.n > 1 then 'ambiguous' when r.n > 1 then 'shared' when abs(e.value - l.m[3]) > 1e-9 then 'value_mismatch' else 'matched' end as status from e left join l on l.lid = e.id left join r on r.rid = l.m[1])
 select left_id, left_t, case when status in ('matched', 'value_mismatch') then right_id end as right_id, case when status in ('matched', 'value_mismatch') then "offset" end as "offset", status from s
 union all select null, null, c.id, null, 'unmatched_right' from c anti join r on r.rid = c.id""")
def j10(spark, d):
    e = timed(spark, d).select("id", "t", "value")
    moved = (F.col("t") + F.col("id") % 7 - 3).alias("t")
    base = e.where("id % 11 <> 0")
    copy = base.select((2 * F.col("id")).alias("id"), moved, F.when(F.col("id") % 17 == 0, F.col("value") + 1).otherwise(F.col("value")).alias("value"))
    copy = copy.union(base.where("id % 13 = 0").select((2 * F.col("id") + 1).alias("id"), moved, "value"))
    return joins.reconcile(e, copy, [], 2, "value")


@query("j11_events_in_window", f"with {_E} select a.id, count(b.id) as n, coalesce(sum(b.value::decimal(18,6)), 0)::double as total from (select * from e where event_type = 'purchase') a left join e b on b.t > a.t and b.t <= a.t + 7200 and b.event_type = 'error' group by a.id")
def j11(spark, d):
    e = timed(spark, d)
    points = e.where("event_type = 'error'").select("t", F.col("value").cast(MONEY).alias("value"))
    return joins.totals_after(e.where("event_type = 'purchase'").select("id", "t"), points, [], 7200, "value").select("id", "n", F.col("total").cast("double").alias("total"))


@query("j13_none_near", f"with {_E} select a.id from e a where event_type = 'signup' and not exists (select 1 from e b where b.event_type = 'error' and b.t between a.t - 900 and a.t + 900)")
def j13(spark, d):
    e = timed(spark, d)
    left = e.where("event_type = 'signup'").select("id", F.col("t").alias("lt"))
    return joins.band_join(left, e.where("event_type = 'error'").select(F.col("t").alias("rt")), [], 900, "lt", "rt", "left_anti").select("id")


@query("j14_matched_controls")
def j14(spark, d):
    e = timed(spark, d).withColumn("h", F.floor(F.col("t") / 3600) % 24)
    return joins.matched_controls(e.where("event_type = 'error' and value > 50"), e.where("event_type = 'view'"), ["h"], 2 * 86400, 4 * 3600)


@query("j20_bar_containment", with_bars("select e.id, b.close from e join b on b.symbol = e.event_type and b.t = e.t - e.t % 3600", _E))
def j20(spark, d):
    e = timed(spark, d).select("id", F.col("event_type").alias("symbol"), (F.col("t") - F.col("t") % BAR).alias("t"))
    return e.join(market(spark, d).select("symbol", "t", "close"), ["symbol", "t"]).select("id", "close")


@query("j22_circular_shift", "with d as (select dense_rank() over (order by epoch_us(ts) // 86400000000) - 1 as i, count(*) as n from events group by epoch_us(ts) // 86400000000) select a.i, a.n, b.n as shifted from d a join d b on b.i = (a.i - 5 + (select count(*) from d)) % (select count(*) from d)")
def j22(spark, d):
    days = events(spark, d).groupBy(F.floor(seconds(F.col("ts")) / 86400).alias("day")).agg(F.count("*").alias("n"))
    order = Window.orderBy("day")  # one row a day
    x = days.select((F.row_number().over(order) - 1).alias("i"), "n").withColumn("size", F.count("*").over(Window.partitionBy()))
    return x.join(x.select(F.pmod(F.col("i") + 5, F.col("size")).alias("i"), F.col("n").alias("shifted")), "i").select("i", "n", "shifted")


@query("a2_day_average", "select event_type, epoch_us(ts) // 86400000000 as day, round(sum(value::decimal(18,6))::double / count(*), 6) as mean from events group by 1, 2")
def a2(spark, d):
    return events(spark, d).groupBy("event_type", F.floor(seconds(F.col("ts")) / 86400).alias("day")).agg(r6(F.sum(F.col("value").cast(MONEY)).cast("double") / F.count("*")).alias("mean"))


@query("a3_series_summary", with_bars(f"select symbol, count(*) as bars, min(t) as first_t, max(t) as last_t, (max(t) - min(t)) // {BAR} + 1 as expected, (max(t) - min(t)) // {BAR} + 1 - count(*) as missing from b group by 1"))
def a3(spark, d):
    span = F.floor((F.max("t") - F.min("t")) / BAR) + 1
    return market(spark, d).groupBy("symbol").agg(F.count("*").alias("bars"), F.min("t").alias("first_t"), F.max("t").alias("last_t"), span.alias("expected"), (span - F.count("*")).alias("missing"))


@query("a7_distinct_accounting", "with x as (select l_orderkey, l_linenumber, l_quantity from lineitem union all select l_orderkey, l_linenumber, l_quantity + (l_orderkey % 3)::int from lineitem where l_orderkey % 5 = 0) select count(*) as n, (select count(*) from (select distinct * from x)) as rows_distinct, (select count(*) from (select distinct l_orderkey, l_linenumber from x)) as keys_distinct from x")
def a7(spark, d):
    """Rows, distinct rows and distinct keys. Rows are dealt once by key, into as many parts as their number asks for, and
    counted there by row and then by key: a task's tables hold about DEALT rows, however large the input is."""
    keys = ["l_orderkey", "l_linenumber"]
    li = spark.read.parquet(f"{d}/lineitem.parquet").select(*keys, "l_quantity")
    x = li.union(li.where("l_orderkey % 5 = 0").select(*keys, (F.col("l_quantity") + (F.col("l_orderkey") % 3).cast("int")).alias("l_quantity")))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), li.count() // DEALT + 1)
    by_row = x.repartition(parts, *keys).groupBy(*x.columns).agg(F.count("*").alias("n"))
    by_key = by_row.groupBy(*keys).agg(F.sum("n").alias("n"), F.count("*").alias("r"))
    return by_key.agg(F.sum("n").alias("n"), F.sum("r").alias("rows_distinct"), F.count("*").alias("keys_distinct"))


@query("w13_keep_first", "with x as (select l_orderkey, l_linenumber, l_suppkey, month(l_shipdate) = 1 as owns from lineitem union all select l_orderkey, l_linenumber, l_suppkey + 1, true from lineitem where l_orderkey % 7 = 0) select l_orderkey, l_linenumber, l_suppkey from x qualify row_number() over (partition by l_orderkey, l_linenumber order by owns desc, l_suppkey) = 1")
def w13(spark, d):
    """One row a key: the owner's first, then by a total order. An aggregate, so Spark combines before it shuffles."""
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    cols = ["l_orderkey", "l_linenumber", "l_suppkey"]
    x = li.select(*cols, (F.month("l_shipdate") == 1).alias("owns")).union(li.where("l_orderkey % 7 = 0").select(*cols[:2], F.col("l_suppkey") + 1, F.lit(True)))
    return x.groupBy(*cols[:2]).agg(F.min(F.struct((~F.col("owns")).alias("o"), "l_suppkey"))["l_suppkey"].alias("l_suppkey"))


@query("a9_rule_violations", with_bars("select count(*) filter (where high < greatest(open, close)) as high_low, count(*) filter (where low > least(open, close)) as low_high, count(*) filter (where volume <= 0) as no_volume, count(*) filter (where taker_volume > volume) as taker, count(*) filter (where t % 3600 <> 0) as off_grid, count(*) filter (where volume = taker_volume) as all_taker from b"))
def a9(spark, d):
    return market(spark, d).agg(*(F.count_if(F.expr(e)).alias(k) for k, e in {"high_low": "high < greatest(open, close)", "low_high": "low > least(open, close)", "no_volume": "volume <= 0", "taker": "taker_volume > volume", "off_grid": "t % 3600 <> 0", "all_taker": "volume = taker_volume"}.items()))


@query("a11_null_coverage", with_bars(f"select count(*) as n, count(p.close) as has_1, count(q.close) as has_12 from b left join b p on p.symbol=b.symbol and p.t=b.t-{BAR} left join b q on q.symbol=b.symbol and q.t=b.t-{12 * BAR}"))
def a11(spark, d):
    from ..operators.bars import at_offset

    return rolling(market(spark, d), ["symbol"], {"a": at_offset("close", -BAR), "b": at_offset("close", -12 * BAR)}).agg(F.count("*").alias("n"), F.count("a").alias("has_1"), F.count("b").alias("has_12"))


@query("a12_rows_by_month", "select year(l_shipdate)::int as y, month(l_shipdate)::int as m, count(*) as n from lineitem group by 1, 2")
def a12(spark, d):
    return spark.read.parquet(f"{d}/lineitem.parquet").groupBy(F.year("l_shipdate").alias("y"), F.month("l_shipdate").alias("m")).agg(F.count("*").alias("n"))


@query("a13_cross_source", with_bars("select count(*) as n, round(median(abs(x.close / y.close - 1)), 6) as median_diff, round(max(abs(x.close / y.close - 1)), 6) as max_diff, round(corr(x.close, y.close), 6) as corr from b x join b y on x.t = y.t and x.symbol = 'click' and y.symbol = 'view' and y.close > 0"))
def a13(spark, d):
    b = market(spark, d)
    x = b.where("symbol = 'click'").select("t", F.col("close").alias("x")).join(b.where("symbol = 'view' and close > 0").select("t", F.col("close").alias("y")), "t")
    diff = F.abs(F.col("x") / F.col("y") - 1)
    return x.agg(F.count("*").alias("n"), r6(F.median(diff)).alias("median_diff"), r6(F.max(diff)).alias("max_diff"), r6(F.corr("x", "y")).alias("corr"))


@query("a14_gates", with_bars("select gate, ok, bool_and(ok) over () as all_passed from (select unnest(['rows', 'order', 'coverage']) as gate, unnest([n > 100, bad = 0, n >= 0.9 * 3600]) as ok from (select count(*) as n, count(*) filter (where high < low) as bad from b))"))
def a14(spark, d):
    x = market(spark, d).agg(F.count("*").alias("n"), F.count_if(F.expr("high < low")).alias("bad"))
    g = x.select(F.expr("stack(3, 'rows', n > 100, 'order', bad = 0, 'coverage', n >= 0.9 * 3600) as (gate, ok)"))
    return g.withColumn("all_passed", F.bool_and("ok").over(Window.partitionBy()))


@query("a15_status_counts", "select event_type, count(*) as n from events group by 1")
def a15(spark, d):
    return events(spark, d).groupBy("event_type").agg(F.count("*").alias("n"))


@query("a16_order_report", with_bars("select symbol, count(*) filter (where s <= 0) as not_ascending, min(s) as min_gap, max(s) as max_gap from (select symbol, t - lag(t) over (partition by symbol order by t) as s from b) group by 1"))
def a16(spark, d):
    s = ordered(market(spark, d).select("symbol", "t"), ["symbol"], {"p": ("lag", "t")}).withColumn("s", F.col("t") - F.col("p"))
    return s.groupBy("symbol").agg(F.count_if(F.col("s") <= 0).alias("not_ascending"), F.min("s").alias("min_gap"), F.max("s").alias("max_gap"))


@query("a17_interval_distribution", with_bars("select symbol, round((t - p) / 3600.0, 2) as hours, count(*) as n from (select symbol, t, lag(t) over (partition by symbol order by t) as p from b) where p is not null group by 1, 2"))
def a17(spark, d):
    s = ordered(market(spark, d).select("symbol", "t"), ["symbol"], {"p": ("lag", "t")}).where("p is not null")
    return s.groupBy("symbol", F.round((F.col("t") - F.col("p")) / 3600.0, 2).alias("hours")).agg(F.count("*").alias("n"))


@query("a19_nearest_rank", "select event_type, count(*) as n, min(value) as min, max(value) as max, quantile_disc(value, 0.05) as p05, quantile_disc(value, 0.5) as p50, quantile_disc(value, 0.95) as p95, sum(value::decimal(18,6))::double as total from events group by 1")
def a19(spark, d):
    q = quantiles(events(spark, d), ["event_type"], "value", {"p05": ("disc", 0.05), "p50": ("disc", 0.5), "p95": ("disc", 0.95)}).drop("n")
    return events(spark, d).groupBy("event_type").agg(F.count("*").alias("n"), F.min("value").alias("min"), F.max("value").alias("max"), F.sum(F.col("value").cast(MONEY)).cast("double").alias("total")).join(q, "event_type")


@query("a20_strata", "select coalesce(event_type, 'all') as event_type, coalesce(q, -1)::int as quartile, count(*) as n from (select event_type, (value >= 25)::int + (value >= 50)::int + (value >= 75)::int as q from events) group by grouping sets ((event_type), (q), ())")
def a20(spark, d):
    from ..functions.scalars import band

    x = events(spark, d).select("event_type", band(F.col("value"), [25, 50, 75]).alias("q"))
    return x.groupingSets([["event_type"], ["q"], []], "event_type", "q").agg(F.count("*").alias("n")).select(F.coalesce("event_type", F.lit("all")).alias("event_type"), F.coalesce("q", F.lit(-1)).alias("quartile"), "n")


@query("a21_worst_rows", "select event_id, value from events order by value desc, event_id limit 25")
def a21(spark, d):
    return events(spark, d).orderBy(F.desc("value"), "event_id").limit(25).select("event_id", "value")


@query("a26_leave_one_out", "with m as (select epoch_us(ts) // 604800000000 as week, sum(value::decimal(18,6)) as s, count(*) as n from events group by 1) select week, round(((select sum(s) from m) - s)::double / ((select sum(n) from m) - n)::double, 6) as mean_without from m")
def a26(spark, d):
    m = events(spark, d).groupBy(F.floor(seconds(F.col("ts")) / 604800).alias("week")).agg(F.sum(F.col("value").cast(MONEY)).alias("s"), F.count("*").alias("n"))
    total = m.agg(F.sum("s").alias("all_s"), F.sum("n").alias("all_n"))
    return m.crossJoin(F.broadcast(total)).select("week", r6((F.col("all_s") - F.col("s")).cast("double") / (F.col("all_n") - F.col("n"))).alias("mean_without"))  # one row


@query("a28_keyword_scan", "select lang, count(*) as n, count(*) filter (where lower(text) like '%license%') as license, count(*) filter (where regexp_matches(lower(text), 'idiot|stupid')) as rude, count(distinct source) as sources from documents group by 1")
def a28(spark, d):
    low = F.lower("text")
    return spark.read.parquet(f"{d}/documents.parquet").groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.contains(low, F.lit("license"))).alias("license"), F.count_if(low.rlike("idiot|stupid")).alias("rude"), F.count_distinct("source").alias("sources"))


@query("a29_channel_totals", "select coalesce(user_id, -1) as session, coalesce(event_type, 'all') as channel, count(*) as messages, sum(length(props))::bigint as bytes from events group by rollup (user_id, event_type)")
def a29(spark, d):
    return events(spark, d).rollup("user_id", "event_type").agg(F.count("*").alias("messages"), F.sum(F.length("props")).alias("bytes")).select(F.coalesce("user_id", F.lit(-1)).alias("session"), F.coalesce("event_type", F.lit("all")).alias("channel"), "messages", "bytes")


@query("a31_two_feeds", "with x as (select epoch_us(ts) // 3600000000 as m, count(*) as n, sum(value::decimal(18,6)) as q from events where event_type = 'click' group by 1), y as (select epoch_us(ts) // 3600000000 as m, count(*) as n, sum(value::decimal(18,6)) as q from events where event_type = 'view' group by 1), w as (select greatest((select min(m) from x), (select min(m) from y)) as lo, least((select max(m) from x), (select max(m) from y)) as hi) select m, coalesce(x.n, 0) - coalesce(y.n, 0) as d_n, (coalesce(x.q, 0) - coalesce(y.q, 0))::double as d_q from x full join y using (m), w where m between lo and hi")
def a31(spark, d):
    """Hourly counts and quantities of two feeds over the time that both cover."""
    m = F.floor(seconds(F.col("ts")) / 3600).alias("m")
    x, y = (events(spark, d).where(F.col("event_type") == k).groupBy(m).agg(F.count("*").alias(f"n_{k}"), F.sum(F.col("value").cast(MONEY)).alias(f"q_{k}")) for k in ("click", "view"))
    span = x.agg(F.min("m").alias("a"), F.max("m").alias("b")).crossJoin(y.agg(F.min("m").alias("c"), F.max("m").alias("e"))).select(F.greatest("a", "c").alias("lo"), F.least("b", "e").alias("hi"))
    both = x.join(y, "m", "full").crossJoin(F.broadcast(span)).where("m between lo and hi")  # one row
    zero = F.lit(0)
    return both.select("m", (F.coalesce("n_click", zero) - F.coalesce("n_view", zero)).alias("d_n"), (F.coalesce("q_click", zero) - F.coalesce("q_view", zero)).cast("double").alias("d_q"))


@query("a34_basket_mean", with_bars("select t, case when count(*) = 3 then round(avg(close), 6) end as basket from b where symbol in ('click', 'view', 'error') group by t"))
def a34(spark, d):
    return market(spark, d).where(F.col("symbol").isin("click", "view", "error")).groupBy("t").agg(r6(F.when(F.count("*") == 3, F.avg("close"))).alias("basket"))


@query("a36_sample_gates", "select event_type, count(*) as n, count(distinct epoch_us(ts) // 86400000000) as days, (count(*) >= 500 and count(distinct epoch_us(ts) // 86400000000) >= 20) as enough from events group by 1")
def a36(spark, d):
    n, days = F.count("*"), F.count_distinct(F.floor(seconds(F.col("ts")) / 86400))
    return events(spark, d).groupBy("event_type").agg(n.alias("n"), days.alias("days")).withColumn("enough", F.expr("n >= 500 and days >= 20"))


@query("t2_longest_gaps", with_bars(f"select symbol, t as last_before, n - t as gap from (select symbol, t, lead(t) over (partition by symbol order by t) as n from b) where n > t + {BAR} order by gap desc, symbol, t limit 5"))
def t2(spark, d):
    g = gaps(market(spark, d), ["symbol"], BAR).withColumn("gap", F.col("resume") - F.col("last_before"))
    return g.orderBy(F.desc("gap"), "symbol", "last_before").limit(5).select("symbol", "last_before", "gap")


@query("t4_decile_selection", "select event_type, avg(case when r <= c // 10 then value end)::decimal(18,4)::double as low, avg(case when r > c - c // 10 then value end)::decimal(18,4)::double as high from (select event_type, value::decimal(18,6) as value, row_number() over (partition by event_type order by value, event_id) as r, count(*) over (partition by event_type) as c from events) group by 1")
def t4(spark, d):
    from ..operators.statistics import value_ranks

    x = value_ranks(events(spark, d).select("event_type", "event_id", "value", F.col("value").cast(MONEY).alias("v")), ["event_type"], "value", "event_id", "r")
    x = x.join(x.groupBy("event_type").agg(F.count("*").alias("c")), "event_type").withColumn("k", F.floor(F.col("c") / 10))
    cell = lambda cond: (F.sum(F.when(F.expr(cond), F.col("v"))) / F.count_if(F.expr(cond))).cast("double").cast("decimal(18,4)").cast("double")
    return x.groupBy("event_type").agg(cell("r <= k").alias("low"), cell("r > c - k").alias("high"))


@query("t5_argmax_group", "select arg_max(event_type, (m, event_type)) as best from (select event_type, sum(value::decimal(18,6)) as m from events group by 1)")
def t5(spark, d):
    x = events(spark, d).groupBy("event_type").agg(F.sum(F.col("value").cast(MONEY)).alias("m"))
    return x.agg(F.max_by("event_type", F.struct("m", "event_type")).alias("best"))


@query("u3_set_difference", "select distinct o_custkey from orders where o_orderstatus = 'F' except select o_custkey from orders where o_orderstatus = 'O'")
def u3(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    return o.where("o_orderstatus = 'F'").select("o_custkey").subtract(o.where("o_orderstatus = 'O'").select("o_custkey"))


@query("u5_frame_equality", "with a as (select l_orderkey, l_linenumber, l_suppkey, l_quantity from lineitem), b as (select l_orderkey, l_linenumber, l_suppkey, l_quantity + (l_orderkey % 97 = 0)::int as l_quantity from lineitem union all select l_orderkey, l_linenumber, l_suppkey, l_quantity from lineitem where l_orderkey % 89 = 0) select (select count(*) from (select * from a except all select * from b)) as only_left, (select count(*) from (select * from b except all select * from a)) as only_right")
def u5(spark, d):
    """Rows that only one of two tables has, with multiplicity: one signed count a row, no row twice in a shuffle."""
    a = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")
    b = a.withColumn("l_quantity", F.col("l_quantity") + (F.col("l_orderkey") % 97 == 0).cast("int")).union(a.where("l_orderkey % 89 = 0"))
    n = a.withColumn("n", F.lit(1)).union(b.withColumn("n", F.lit(-1))).groupBy(*a.columns).agg(F.sum("n").alias("n"))
    return n.agg(F.coalesce(F.sum(F.greatest("n", F.lit(0))), F.lit(0)).alias("only_left"), F.coalesce(F.sum(F.greatest(-F.col("n"), F.lit(0))), F.lit(0)).alias("only_right"))
