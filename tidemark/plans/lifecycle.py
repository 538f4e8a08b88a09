"""Queries of session lifecycles. A user's events stand in for a session's file: the first lines open it and subscribe, the
others carry data; faults of sessions go by user_id, faults of lines by event_id. All events take part."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lifecycle
from ..operators.bars import seconds
from .common import events, stored
from .registry import query

SESSION = ["session"]
REQUIRED, ALLOWED = ["trades", "bbo-tbt", "books"], ["trades", "bbo-tbt", "books", "instruments"]
KNOWN = [*ALLOWED, "trades-all"]


def _subscriptions(less: int, more: int) -> str:
    one = '{"channel":"%s"}'
    both, three, four = (",".join(one % c for c in x) for x in (("trades", "books"), ("books", "bbo-tbt", "trades"), ("trades", "bbo-tbt", "books", "funding")))
    return f"case f when {less} then '[{both}]' when {more} then '[{four}]' else '[{three}]' end"


#: Lines of sessions as expressions that both engines read: f is the session's fault, n a line's place among m.
_LINES = {
    "f": "session % 12",
    "n": "row_number() over (partition by session order by secs, event_id)",
    "m": "count(*) over (partition by session)",
    "place": """case when n > 8 or (n = 8 and f <> 10) then case when n = m and f <> 7 then 'end' else 'data' end when n = 8 or n = 3 then 'subscribe' when n = 1 then 'open'
      when n = 2 or (n = 7 and f = 2) then 'connect' when (n = 7 and f <> 8) or (n = 5 and f = 8) then 'ready' else 'ack' end""",
    "channel": """case when place <> 'data' then null when event_type = 'view' then 'trades' when event_type = 'click' then 'bbo-tbt' when event_type = 'purchase' then case when f = 9 then 'trades' else 'books' end
      when event_type = 'signup' then case when event_id % 211 = 0 then 'tickers' else 'instruments' end end""",
    "before": "lag(event_id) over (partition by session, channel order by n)",
    "acked": "case when n = 4 then 'trades' when n = 7 or (n = 5 and f <> 8) or f = 3 then 'bbo-tbt' when f = 11 then 'tickers' else 'books' end",
    "item": """concat('{"ts":"', case when event_id % 433 = 0 then 'x' else cast(1000 * secs + case when event_id % 439 = 0 then 5000 else 0 end as string) end, '","prevSeqId":', cast(coalesce(before, -1) as string), ',"seqId":', cast(event_id as string), '}')""",
    "market": """case when event_id % 421 = 0 then '{"arg":[],"data":[]}' when event_id % 419 = 0 then concat('{"arg":{"channel":"', channel, '"}}')
      else concat('{"arg":{"channel":"', channel, '"},"data":[', case when event_id % 431 = 0 then '7' else item end, ']}') end""",
    "payload": f"""case place when 'open' then concat('{{"subscriptions":', {_subscriptions(1, 4)}, '}}') when 'ready' then concat('{{"subscriptions":', {_subscriptions(6, 4)}, '}}')
      when 'subscribe' then concat('{{"op":"subscribe","args":', {_subscriptions(-1, 4)}, '}}') when 'ack' then concat('{{"event":"subscribe","arg":{{"channel":"', acked, '"}}}}') when 'data' then
      case when event_id % 401 = 0 then '{{' when event_id % 409 = 0 then '[1]' when channel is not null then market when event_id % 97 = 0 then '{{"event":"error","code":"1"}}' else 'pong' end else '{{}}' end""",
    "kind": "case place when 'open' then 'session_opening' when 'connect' then 'connected' when 'ready' then 'subscriptions_ready' when 'end' then case f when 5 then 'session_error' when 6 then 'fatal_error' else 'stopped' end when 'subscribe' then 'subscribe' else case payload when 'pong' then 'pong' else 'message' end end",
    "direction": "case when place in ('open', 'connect', 'ready', 'end') then 'local' when place = 'subscribe' then 'out' else 'in' end",
    "frame_no": "n - 1 + count(case when event_id % 443 = 0 then 1 end) over (partition by session order by n rows between unbounded preceding and 1 preceding)",
    "clock": "secs - case when event_id % 449 = 0 then 10000000 else 0 end",
    "received_ms": "1000 * secs + 1000",
}
_COLUMNS = ["session", "frame_no", "direction", "kind", "clock", "received_ms", "payload"]


def recorded(spark, d):
    """The lines of all sessions."""
    x = events(spark, d).select(F.col("user_id").alias("session"), "event_id", "event_type", seconds(F.col("ts")).alias("secs"))
    for name, e in _LINES.items():
        x = x.withColumn(name, F.expr(e))
    return x.select(F.col("n").cast("long").alias("line_no"), *_COLUMNS)


def _recorded_sql() -> str:
    sql = "select user_id as session, event_id, event_type, epoch_us(ts) // 1000000 as secs from events"
    for name, e in _LINES.items():
        sql = f"select *, {e} as {name} from ({sql})"
    return f"select n as line_no, {', '.join(_COLUMNS)} from ({sql})"


_REASONS_OF_LINES = {
    "frame_sequence_gap": "frame_no <> coalesce(pf + 1, 0)",
    "monotonic_clock_reversed": "clock < pc",
    "payload_json_invalid": "j is null and not pong",
    "exchange_error_event": "says = 'error'",
    "market_arg_invalid": "market and channel is null",
    "unexpected_channel": "channel = 'tickers'",
    "market_data_invalid": "channel is not null and data is null",
    "market_item_invalid": "json_type(data->0) <> 'OBJECT'",
    "exchange_ts_invalid": "json_type(data->0) = 'OBJECT' and ts is null",
    "negative_exchange_lag": "ts > received_ms",
}
_SETS = {"opened": "kind = 'session_opening'", "requested": "kind = 'subscribe'", "ready": "kind = 'subscriptions_ready'"}
_WHOLE = {
    "lifecycle_event_count_invalid": "(n_open <> 1)::int + (n_connect <> 1)::int + (n_ready <> 1)::int",
    "lifecycle_terminal_invalid": "(ends <> 1)::int",
    "fatal_session": "(ends = 1 and last_end = 'fatal_error')::int",
    "transport_session_error": "(ends = 1 and last_end = 'session_error')::int",
    "lifecycle_order_invalid": "(ends = 1 and at_open + at_connect + at_subscribe + at_ack + at_ready + at_end is not null and not (at_open <= at_connect and at_connect <= at_subscribe and at_subscribe <= at_ack and at_ack <= at_ready and at_ready <= at_end))::int",
    "subscribe_count_invalid": "(subscribes <> 1)::int",
    "session_opening_subscriptions_mismatch": "(opened <> requested)::int",
    "subscription_ack_missing": "len(list_filter(requested, lambda s: not list_contains(acknowledged, s)))",
    "subscription_ack_unexpected": "len(list_filter(acknowledged, lambda s: not list_contains(requested, s)))",
    "subscriptions_ready_mismatch": "(ready <> requested)::int",
    "collector_channel_set_invalid": "(not list_has_all(requested, ['trades', 'bbo-tbt', 'books']))::int + (not list_has_all(['trades', 'bbo-tbt', 'books', 'instruments'], requested))::int",
    "channel_has_no_data": "len(list_filter(requested, lambda s: not list_contains(channels, s)))",
    "books_sequence_gap": "coalesce(gaps, 0)",
    "books_snapshot_missing": "(list_contains(requested, 'books') and coalesce(snapshots, 0) = 0)::int",
    "books_state_invalid_at_close": "(list_contains(requested, 'books') and not coalesce(holds, false))::int",
    "duplicate_subscription_ack": "acks - len(acknowledged)",
}
_SET_SQL = ", ".join(f"coalesce(list_sort(list_distinct(flatten(list(topics) filter (where {w})))), []) as {k}" for k, w in _SETS.items())
_LEDGER_SQL = f"""with recorded as ({_recorded_sql()}), p as (select *, direction = 'in' and payload = 'pong' as pong, case when json_valid(payload) and payload like '{{%' then payload::json end as j, lag(frame_no) over w as pf, lag(clock) over w as pc from recorded window w as (partition by session order by line_no)),
 a as (select *, case when direction = 'in' then j->>'$.event' end as says, direction = 'in' and j is not null and (j->>'$.event') is null as market, coalesce(j->'$.args', j->'$.subscriptions')->>'$[*].channel' as topics from p),
 b as (select *, case when market then j->>'$.arg.channel' end as channel, case when says = 'subscribe' then j->>'$.arg.channel' end as ack from a),
 c as (select *, case when channel is not null then j->'$.data' end as data from b), l as (select *, try_cast(data->0->>'$.ts' as bigint) as ts from c),
 k as (select session, line_no, (data->0->>'$.prevSeqId')::bigint as prev, (data->0->>'$.seqId')::bigint as seq from l where channel = 'books' and json_type(data->0) = 'OBJECT'),
 q as (select *, case when prev = -1 then line_no end as start, case when prev <> -1 and (before is null or prev <> before) then line_no end as broken from (select *, lag(seq) over (partition by session order by line_no) as before from k)),
 r as (select *, coalesce(max(start) over w > coalesce(max(broken) over w, -1), false) as ok from q window w as (partition by session order by line_no rows between unbounded preceding and current row)),
 book as (select session, count(*) as book_messages, count(*) filter (where prev = -1) as snapshots, count(*) filter (where not ok) as gaps, min(line_no) filter (where not ok) as gap_line, arg_max(ok, line_no) as holds from r group by 1),
 s as (select session, count(*) as frames, count(*) filter (where kind = 'session_opening') as n_open, count(*) filter (where kind = 'connected') as n_connect, count(*) filter (where kind = 'subscriptions_ready') as n_ready,
  count(*) filter (where kind in ('stopped', 'session_error', 'fatal_error')) as ends, arg_max(kind, line_no) filter (where kind in ('stopped', 'session_error', 'fatal_error')) as last_end, arg_max(frame_no, line_no) filter (where kind in ('stopped', 'session_error', 'fatal_error')) as at_end,
  arg_max(frame_no, line_no) filter (where kind = 'session_opening') as at_open, arg_max(frame_no, line_no) filter (where kind = 'connected') as at_connect, arg_max(frame_no, line_no) filter (where kind = 'subscriptions_ready') as at_ready,
  count(*) filter (where kind = 'subscribe') as subscribes, arg_max(frame_no, line_no) filter (where kind = 'subscribe') as at_subscribe, count(ack) as acks, max(frame_no) filter (where ack is not null) as at_ack, {_SET_SQL},
  coalesce(list_sort(list(distinct ack) filter (where ack is not null)), []) as acknowledged, coalesce(list_sort(list(distinct channel) filter (where json_type(data) = 'ARRAY')), []) as channels, coalesce(sum(json_array_length(data)), 0)::bigint as items from l group by 1),
 whole as (select * from s left join book using (session)),
 codes as ({' union all '.join(f"select session, '{k}' as code, count(*) as n, min(line_no) as first_line from l where {w} group by 1" for k, w in _REASONS_OF_LINES.items())}
  union all {' union all '.join(f"select session, '{k}', ({e})::bigint, {'gap_line' if k == 'books_sequence_gap' else 'null'} from whole where ({e}) > 0" for k, e in _WHOLE.items())}),
 ledger as (select *, case when code in ('unexpected_channel', 'transport_session_error', 'channel_has_no_data', 'negative_exchange_lag', 'duplicate_subscription_ack') then 'warning' else 'reason' end as severity from codes)"""


def _judged(spark, d):
    lines = stored(lifecycle.read_lines(recorded(spark, d), SESSION, KNOWN))
    facts = stored(lifecycle.session_facts(lines, SESSION))
    return facts, lifecycle.session_ledger(lines, facts, SESSION, REQUIRED, ALLOWED)


@query("m9_session_ledger", f"{_LEDGER_SQL} select session, code, severity, n, first_line from ledger")
def m9_ledger(spark, d):
    """Every kind of issue of every session, how often it occurs and its first line."""
    return _judged(spark, d)[1].select("session", "code", "severity", "n", "first_line")


@query("m9_session_lifecycle", f"""{_LEDGER_SQL} select w.session, w.frames, w.items, coalesce(w.book_messages, 0) as book_messages, coalesce(w.snapshots, 0) as snapshots, w.last_end as "end", array_to_string(w.requested, ',') as requested, array_to_string(w.acknowledged, ',') as acknowledged,
 coalesce(g.reasons, '') as reasons, coalesce(g.warnings, '') as warnings, coalesce(g.reasons, '') = '' as valid from whole w left join (select session, string_agg(code, ',' order by code) filter (where severity = 'reason') as reasons, string_agg(code, ',' order by code) filter (where severity = 'warning') as warnings from ledger group by 1) g using (session)""")
def m9_lifecycle(spark, d):
    """One row a session: its events, subscriptions, books, reasons, warnings and whether it is valid."""
    facts, ledger = _judged(spark, d)
    x = lifecycle.session_reports(facts, ledger, SESSION)
    names = lambda k: F.array_join(F.transform(k, lambda s: s["channel"]), ",").alias(k)
    return x.select("session", "frames", "items", "book_messages", "snapshots", "end", names("requested"), names("acknowledged"), *(F.array_join(k, ",").alias(k) for k in ("reasons", "warnings")), "valid")


@query("m10_issue_counts", f"{_LEDGER_SQL} select code, severity, count(*) as sessions, sum(n)::bigint as n from ledger group by 1, 2")
def m10_issues(spark, d):
    """Issues over all sessions by their code."""
    return lifecycle.issue_counts(_judged(spark, d)[1])
