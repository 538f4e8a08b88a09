"""Lifecycles of recorded sessions: what each line of a session file breaks, what the session as a whole breaks, and reports.

Frames have the session's keys, line_no (their order, unique in a session), frame_no, direction (local, out, in), kind,
clock (monotonic), received_ms and payload. A session opens, connects, subscribes, is acknowledged, is ready and ends.

Payloads may hold anything; lines without a payload count as not JSON. Keys and line_no are not null (sources.landed.frames()
puts such lines aside with a reason). Lines are dealt into chunks by line_no, so a long session is no single task; what is kept a session are counts, first and last places,
and its few distinct subscriptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bars import ordered
from .sessions import book_sequence

#: Kinds of local events, and what ends a session.
OPENING, CONNECTED, READY = "session_opening", "connected", "subscriptions_ready"
ENDS = ["stopped", "session_error", "fatal_error"]

#: Codes that warn. All others make a session invalid.
WARNINGS = ["unexpected_channel", "transport_session_error", "channel_has_no_data", "negative_exchange_lag", "duplicate_subscription_ack"]

_NAMES = ["channel", "instId", "instType", "instFamily"]
_LINES = 100_000
_ITEMS = 1_000_000


def _field(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def _topic(v: Column) -> Column:
    """A subscription's name; the same whatever the order of its fields."""
    return F.struct(*(F.coalesce(_field(v, f"$.{k}", "string"), F.lit("")).alias(k) for k in _NAMES))


def _is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def _codes(**tests: Column) -> Column:
    return F.array_compact(F.array(*(F.when(test, F.lit(code)) for code, test in tests.items())))


def read_lines(frames: DataFrame, session: list[str], known: list[str]) -> DataFrame:
    """Each line with what it says (asked, of, acknowledged, channel, items, book) and the codes of what it breaks by itself.
    ``known`` are the channels that belong to the protocol at all."""
    c = F.col
    x = ordered(frames, session, {"_frame": ("lag", "frame_no"), "_clock": ("lag", "clock")}, "line_no", _LINES)
    x = x.withColumn("_v", F.when(c("payload").rlike(r"^\s*\{"), F.try_parse_json("payload")))
    local, out = c("direction") == "local", c("direction") == "out"
    pong = (c("payload") == "pong") & (c("kind") == "pong")
    spoken = ~local & ~out & ~F.coalesce(pong, F.lit(False))
    subscribe = out & (c("kind") == "subscribe")
    lists = local & c("kind").isin(OPENING, READY)
    x = x.withColumns({
        "_says": F.when(spoken, _field(c("_v"), "$.event", "string")),
        "_arg": F.when(spoken, _field(c("_v"), "$.arg", "variant")),
        "_list": F.when(subscribe & (_field(c("_v"), "$.op", "string") == "subscribe"), _field(c("_v"), "$.args", "array<variant>")).when(lists, _field(c("_v"), "$.subscriptions", "array<variant>")),
    })
    market = spoken & c("_v").isNotNull() & c("_says").isNull()
    x = x.withColumns({"_named": _is_object(c("_arg")), "channel": F.when(market, _field(c("_arg"), "$.channel", "string"))})
    x = x.withColumn("_data", F.when(c("channel").isNotNull(), _field(c("_v"), "$.data", "array<variant>")))
    x = x.withColumn("_items", F.transform("_data", lambda v: F.struct(
        _is_object(v).alias("whole"), _field(v, "$.ts", "string").alias("raw"), _field(v, "$.ts", "string").try_cast("long").alias("ts"),
        _field(v, "$.prevSeqId", "string").try_cast("long").alias("prev"), _field(v, "$.seqId", "string").try_cast("long").alias("seq"),
    )))
    timed = F.filter("_items", lambda i: i["whole"] & ((i["ts"] < 0) | (i["ts"].isNull() & ((c("channel") != "instruments") | i["raw"].isNotNull()))))
    odd = F.exists("_list", lambda v: ~_is_object(v))
    acked = spoken & (c("_says") == "subscribe")
    codes = _codes(
        frame_sequence_gap=c("frame_no") != F.coalesce(c("_frame") + 1, F.lit(0)),
        monotonic_clock_reversed=c("clock") < c("_clock"),
        payload_json_invalid=(local | subscribe | spoken) & c("_v").isNull(),
        opening_schema_invalid=local & (c("kind") == OPENING) & c("_v").isNotNull() & (c("_list").isNull() | odd),
        ready_schema_invalid=local & (c("kind") == READY) & c("_v").isNotNull() & (c("_list").isNull() | odd),
        subscribe_schema_invalid=subscribe & c("_v").isNotNull() & (c("_list").isNull() | odd),
        ping_payload_invalid=out & (c("kind") == "ping") & ~c("payload").eqNullSafe("ping"),
        ack_schema_invalid=acked & ~c("_named"),
        exchange_error_event=spoken & (c("_says") == "error"),
        market_arg_invalid=market & c("channel").isNull(),
        unexpected_channel=~c("channel").isin(known),
        market_data_invalid=c("channel").isNotNull() & c("_data").isNull(),
        market_item_invalid=F.exists("_items", lambda i: ~i["whole"]),
        exchange_ts_invalid=F.size(timed) > 0,
        negative_exchange_lag=F.exists("_items", lambda i: (i["ts"] >= 0) & (i["ts"] > c("received_ms"))),
    )
    return x.select(
        *session, "line_no", "frame_no", "direction", "kind", codes.alias("codes"), "channel",
        F.transform(F.filter("_list", _is_object), _topic).alias("topics"),
        F.when(acked & c("_named"), _topic(c("_arg"))).alias("ack"),
        F.when(c("_data").isNotNull(), F.size("_data")).alias("items"),
        F.when(c("channel") == "books", F.transform("_items", lambda i: F.struct(i["prev"].alias("prev"), i["seq"].alias("seq")))).alias("book"),
    )


def _books(lines: DataFrame, session: list[str]) -> DataFrame:
    """By session: book messages, snapshots, the first line that breaks the sequence and how many do, and whether the book holds at the end."""
    each = lines.where("book is not null").select(*session, "line_no", F.posexplode("book").alias("_i", "_b")).select(*session, "line_no", "_b.*", (F.col("line_no") * _ITEMS + F.col("_i")).alias("_at"))
    x = book_sequence(each.where("prev is not null and seq is not null"), session, "_at", _LINES * _ITEMS)
    gap = F.col("status") == "gap"
    return x.groupBy(*session).agg(F.count("*").alias("book_messages"), F.count_if(F.col("status") == "snapshot").alias("snapshots"), F.count_if(gap).alias("book_gaps"), F.min(F.when(gap, F.col("line_no"))).alias("_gap_line"), F.max_by("valid", "_at").alias("book_valid"))


def session_facts(lines: DataFrame, session: list[str]) -> DataFrame:
    """One row a session of read_lines(): counts and last places of its events, its sets of subscriptions, its books."""
    c = F.col
    is_local, subscribe = c("direction") == "local", (c("direction") == "out") & (c("kind") == "subscribe")
    local = lambda k: is_local & (c("kind") == k)
    last = lambda test: F.max_by(F.when(test, c("frame_no")), F.when(test, c("line_no")))
    topics = lambda test: F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(test, c("topics"))))))
    end = is_local & c("kind").isin(ENDS)
    x = lines.groupBy(*session).agg(
        F.count("*").alias("frames"),
        *(F.count_if(local(k)).alias(f"n_{k}") for k in (OPENING, CONNECTED, READY)),
        *(last(local(k)).alias(f"at_{k}") for k in (OPENING, CONNECTED, READY)),
        F.count_if(end).alias("ends"), F.max_by(F.when(end, c("kind")), F.when(end, c("line_no"))).alias("end"), last(end).alias("at_end"),
        F.count_if(subscribe).alias("subscribes"), last(subscribe).alias("at_subscribe"),
        F.count("ack").alias("acks"), F.max(F.when(c("ack").isNotNull(), c("frame_no"))).alias("at_ack"),
        topics(local(OPENING)).alias("opened"), topics(subscribe).alias("requested"), topics(local(READY)).alias("ready"),
        F.array_sort(F.collect_set("ack")).alias("acknowledged"), F.array_sort(F.collect_set(F.when(c("items").isNotNull(), c("channel")))).alias("channels"),
        F.coalesce(F.sum("items"), F.lit(0)).alias("items"),
    )
    x = x.join(_books(lines, session), session, "left")
    return x.fillna(0, ["book_messages", "snapshots", "book_gaps"]).withColumn("book_valid", F.coalesce("book_valid", F.lit(False)))


def session_issues(facts: DataFrame, session: list[str], required: list[str], allowed: list[str]) -> DataFrame:
    """(session..., code, n, first_line) of what sessions break as a whole; ``required`` and ``allowed`` are channels."""
    c = F.col
    names = lambda k: F.transform(k, lambda s: s["channel"])
    need = F.array(*map(F.lit, required))
    lacking = lambda a, b: F.size(F.array_except(a, b)).cast("long")
    places = [c(f"at_{OPENING}"), c(f"at_{CONNECTED}"), c("at_subscribe"), c("at_ack"), c(f"at_{READY}"), F.when(c("ends") == 1, c("at_end"))]
    all_there, mixed = F.lit(True), F.lit(False)
    for p in places:
        all_there = all_there & p.isNotNull()
    for a, b in zip(places, places[1:], strict=False):
        mixed = mixed | (a > b)
    flag = lambda test: F.coalesce(test, F.lit(False)).cast("long")
    counts = {
        "lifecycle_event_count_invalid": sum((flag(c(f"n_{k}") != 1) for k in (CONNECTED, READY)), flag(c(f"n_{OPENING}") != 1)),
        "lifecycle_terminal_invalid": flag(c("ends") != 1),
        "fatal_session": flag((c("ends") == 1) & (c("end") == "fatal_error")),
        "transport_session_error": flag((c("ends") == 1) & (c("end") == "session_error")),
        "lifecycle_order_invalid": flag(all_there & mixed),
        "subscriptions_missing": flag(F.size("requested") == 0),
        "subscribe_count_invalid": flag(c("subscribes") != 1),
        "session_opening_subscriptions_mismatch": flag(c("opened") != c("requested")),
        "subscription_ack_missing": lacking("requested", "acknowledged"),
        "subscription_ack_unexpected": lacking("acknowledged", "requested"),
        "subscriptions_ready_mismatch": flag(c("ready") != c("requested")),
        "collector_channel_set_invalid": flag(lacking(need, names("requested")) > 0) + flag(lacking(names("requested"), F.array(*map(F.lit, allowed))) > 0),
        "channel_has_no_data": lacking(names("requested"), c("channels")),
        "books_sequence_gap": c("book_gaps"),
        "books_snapshot_missing": flag(F.array_contains(names("requested"), "books") & (c("snapshots") == 0)),
        "books_state_invalid_at_close": flag(F.array_contains(names("requested"), "books") & ~c("book_valid")),
        "duplicate_subscription_ack": c("acks") - F.size("acknowledged"),
    }
    each = F.array(*(F.struct(F.lit(k).alias("code"), n.cast("long").alias("n"), (c("_gap_line") if k == "books_sequence_gap" else F.lit(None)).cast("long").alias("first_line")) for k, n in counts.items()))
    return facts.select(*session, F.explode(each).alias("_i")).select(*session, "_i.*").where("n > 0")


def session_ledger(lines: DataFrame, facts: DataFrame, session: list[str], required: list[str], allowed: list[str]) -> DataFrame:
    """(session..., code, severity, n, first_line): every kind of issue of every session, how often, and its first line (null where
    the session as a whole is meant)."""
    by_line = lines.select(*session, "line_no", F.explode("codes").alias("code")).groupBy(*session, "code").agg(F.count("*").alias("n"), F.min("line_no").cast("long").alias("first_line"))
    both = by_line.unionByName(session_issues(facts, session, required, allowed))
    return both.withColumn("severity", F.when(F.col("code").isin(WARNINGS), "warning").otherwise("reason"))


def session_reports(facts: DataFrame, ledger: DataFrame, session: list[str]) -> DataFrame:
    """The facts with reasons, warnings (sorted codes) and valid, whether there is no reason."""
    kinds = lambda s: F.array_sort(F.collect_set(F.when(F.col("severity") == s, F.col("code"))))
    codes = ledger.groupBy(*session).agg(kinds("reason").alias("reasons"), kinds("warning").alias("warnings"))
    none = F.array().cast("array<string>")
    x = facts.join(codes, session, "left").withColumns({k: F.coalesce(k, none) for k in ("reasons", "warnings")})
    return x.withColumn("valid", F.size("reasons") == 0).drop("_gap_line")


def issue_counts(ledger: DataFrame) -> DataFrame:
    """(code, severity, sessions, n) over all sessions."""
    return ledger.groupBy("code", "severity").agg(F.count("*").alias("sessions"), F.sum("n").alias("n"))
