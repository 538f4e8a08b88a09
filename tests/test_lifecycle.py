"""Session lifecycles: one sound session, and each fault by itself."""

import json

import pytest

from tidemark.operators import lifecycle

SESSION, NEED = ["path", "session"], ["trades", "books"]
TOPICS = [{"channel": "trades", "instId": "A"}, {"channel": "books", "instId": "A"}]
SCHEMA = "path string, session string, line_no long, frame_no long, direction string, kind string, clock long, received_ms long, payload string"


def book(prev, seq, ts=100):
    return ("in", "message", {"arg": {"channel": "books"}, "data": [{"ts": str(ts), "prevSeqId": prev, "seqId": seq}]})


def sound():
    subs = {"subscriptions": TOPICS}
    acks = [("in", "message", {"event": "subscribe", "arg": {"instId": "A", "channel": c}}) for c in ("trades", "books")]
    trade = ("in", "message", {"arg": {"channel": "trades"}, "data": [{"ts": "100"}, {"ts": "101"}]})
    return [("local", "session_opening", subs), ("local", "connected", {}), ("out", "subscribe", {"op": "subscribe", "args": TOPICS}), *acks, ("local", "subscriptions_ready", subs), trade, book(-1, 5), ("out", "ping", "ping"), ("in", "pong", "pong"), book(5, 7), ("local", "stopped", {})]


def with_line(k, *line):
    return [*sound()[:k], *line, *sound()[k + 1 :]]


CASES = {
    "sound": (sound(), [], []),
    "no_end": (sound()[:-1], ["lifecycle_terminal_invalid"], []),
    "two_ends": ([*sound(), ("local", "stopped", {})], ["lifecycle_terminal_invalid"], []),
    "fatal": (with_line(11, ("local", "fatal_error", {})), ["fatal_session"], []),
    "broken_off": (with_line(11, ("local", "session_error", {})), [], ["transport_session_error"]),
    "connected_twice": (with_line(1, ("local", "connected", {}), ("local", "connected", {})), ["lifecycle_event_count_invalid"], []),
    "ready_early": ([*sound()[:3], sound()[5], *sound()[3:5], *sound()[6:]], ["lifecycle_order_invalid"], []),
    "no_ack": ([*sound()[:4], *sound()[5:]], ["subscription_ack_missing"], []),
    "ack_of_another": (with_line(4, ("in", "message", {"event": "subscribe", "arg": {"channel": "x"}})), ["subscription_ack_missing", "subscription_ack_unexpected"], []),
    "ack_twice": (with_line(4, sound()[4], sound()[4]), [], ["duplicate_subscription_ack"]),
    "ack_of_nothing": (with_line(4, ("in", "message", {"event": "subscribe", "arg": 3})), ["ack_schema_invalid", "subscription_ack_missing"], []),
    "ready_for_less": (with_line(5, ("local", "subscriptions_ready", {"subscriptions": TOPICS[:1]})), ["subscriptions_ready_mismatch"], []),
    "opening_without": (with_line(0, ("local", "session_opening", {"subscriptions": 1})), ["opening_schema_invalid", "session_opening_subscriptions_mismatch"], []),
    "no_subscribe": ([*sound()[:2], *sound()[3:]], ["collector_channel_set_invalid", "session_opening_subscriptions_mismatch", "subscribe_count_invalid", "subscription_ack_unexpected", "subscriptions_missing", "subscriptions_ready_mismatch"], []),
    "no_trades": ([*sound()[:6], *sound()[7:]], [], ["channel_has_no_data"]),
    "no_snapshot": (with_line(7, book(5, 6)), ["books_sequence_gap", "books_snapshot_missing", "books_state_invalid_at_close"], []),
    "gap_mended": (with_line(10, book(9, 10), book(-1, 20)), ["books_sequence_gap"], []),
    "error": (with_line(8, ("in", "message", {"event": "error"})), ["exchange_error_event"], []),
    "other_event": (with_line(8, ("in", "message", {"event": "notice"})), [], []),
    "not_json": (with_line(8, ("in", "message", "{")), ["payload_json_invalid"], []),
    "no_payload": (with_line(8, ("in", "message", None)), ["payload_json_invalid"], []),
    "array": (with_line(8, ("in", "message", "[1]")), ["payload_json_invalid"], []),
    "no_channel": (with_line(8, ("in", "message", {"arg": {"channel": None}, "data": []})), ["market_arg_invalid"], []),
    "no_data": (with_line(8, ("in", "message", {"arg": {"channel": "trades"}, "data": {}})), ["market_data_invalid"], []),
    "bad_item": (with_line(8, ("in", "message", {"arg": {"channel": "trades"}, "data": [1]})), ["market_item_invalid"], []),
    "bad_time": (with_line(8, ("in", "message", {"arg": {"channel": "trades"}, "data": [{"ts": "-1"}]})), ["exchange_ts_invalid"], []),
    "untimed": (with_line(8, ("in", "message", {"arg": {"channel": "instruments"}, "data": [{"ts": None}, {}]})), [], []),
    "strange_channel": (with_line(8, ("in", "message", {"arg": {"channel": "x"}, "data": []})), [], ["unexpected_channel"]),
    "from_the_future": (with_line(10, book(5, 7, 10**9)), [], ["negative_exchange_lag"]),
    "bad_ping": (with_line(8, ("out", "ping", "pong")), ["ping_payload_invalid"], []),
}


@pytest.fixture(scope="module")
def judged(spark):
    text = lambda p: p if p is None or isinstance(p, str) else json.dumps(p)
    rows = [("f", name, n + 1, n, d, k, n, 1000, text(p)) for name, (lines, _, _) in CASES.items() for n, (d, k, p) in enumerate(lines)]
    rows += [("f", "gaps", n + 1, n + (n > 6), d, k, 5 if n == 8 else 10 + n, 1000, text(p)) for n, (d, k, p) in enumerate(sound())]
    lines = lifecycle.read_lines(spark.createDataFrame(rows, SCHEMA), SESSION, [*NEED, "instruments"]).cache()
    facts = lifecycle.session_facts(lines, SESSION)
    ledger = lifecycle.session_ledger(lines, facts, SESSION, NEED, [*NEED, "instruments"])
    return {r.session: r for r in lifecycle.session_reports(facts, ledger, SESSION).collect()}, {(r.session, r.code): r for r in ledger.collect()}, {r.code: r for r in lifecycle.issue_counts(ledger).collect()}


@pytest.mark.parametrize("name", CASES)
def test_each_fault_by_itself(judged, name):
    r = judged[0][name]
    assert (r.reasons, r.warnings, r.valid) == (*CASES[name][1:], not CASES[name][1])


def test_facts_and_first_lines(judged):
    reports, ledger, counts = judged
    assert reports.keys() == CASES.keys() | {"gaps"}
    r = reports["sound"]
    assert (r.frames, r.items, r.book_messages, r.snapshots, r.end, [s.channel for s in r.requested]) == (12, 4, 2, 1, "stopped", ["books", "trades"])
    assert reports["gaps"].reasons == ["frame_sequence_gap", "monotonic_clock_reversed"]
    assert ledger["gaps", "frame_sequence_gap"].first_line == 8 and ledger["gaps", "monotonic_clock_reversed"].first_line == 9
    assert ledger["gap_mended", "books_sequence_gap"].first_line == 11 and ledger["no_end", "lifecycle_terminal_invalid"].first_line is None
    assert counts["lifecycle_terminal_invalid"].sessions == 2 and counts["books_sequence_gap"].n == 3


def test_no_sessions(spark):
    lines = lifecycle.read_lines(spark.createDataFrame([], SCHEMA), SESSION, NEED)
    facts = lifecycle.session_facts(lines, SESSION)
    assert facts.collect() == [] and lifecycle.session_ledger(lines, facts, SESSION, NEED, NEED).collect() == []
