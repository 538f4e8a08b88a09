"""Books and their sequence against plain folds, in batches and in streams."""

import random
import uuid

import pytest

from tidemark.operators import books, sessions
from tidemark.operators.store import checkpoint_folder
from tidemark.sources import landed
from tidemark.streaming import feeds


def folded(messages):
    """(n, status, valid) of messages (n, prev, seq, levels) in order."""
    out, last, valid = [], None, False
    for n, prev, seq, levels in messages:
        if prev == -1:
            status, valid = "snapshot", True
        elif not valid or prev != last or (seq == prev and levels):
            status, valid = "gap", False
        else:
            status = "heartbeat" if seq == prev else "reset" if seq < prev else "update"
        last = seq
        out.append((n, status, valid))
    return out


def made(seed, n):
    rng, out, last = random.Random(seed), [], 0
    for k in range(1, n + 1):
        kind = rng.random()
        seq = last + 1
        prev, levels = last, 2
        if kind < 0.08 or k == 3:
            prev = -1
        elif kind < 0.14:
            prev = last - 1
        elif kind < 0.22:
            seq, levels = last, 0
        elif kind < 0.26:
            seq = last
        elif kind < 0.3:
            seq = max(0, last - 5)
        out.append((k, prev, seq, levels))
        last = seq
    return out


@pytest.mark.parametrize("chunk", [3, 1000])
def test_sequence_matches_a_fold(spark, chunk):
    rows = {s: made(s, 120) for s in range(4)}
    df = spark.createDataFrame([(s, *m) for s, ms in rows.items() for m in ms], "session long, frame_no long, prev long, seq long, levels int")
    got = sessions.book_sequence(df, ["session"], chunk=chunk).collect()
    for s, ms in rows.items():
        assert sorted((r.frame_no, r.status, r.valid) for r in got if r.session == s) == folded(ms)


def test_a_gap_lasts_until_the_next_snapshot(spark):
    rows = [(1, 1, -1, 5), (1, 2, 5, 6), (1, 3, 9, 10), (1, 4, 10, 11), (1, 5, -1, 20), (1, 6, 20, 21)]
    got = sessions.book_sequence(spark.createDataFrame(rows, "session long, frame_no long, prev long, seq long"), ["session"]).orderBy("frame_no").collect()
    assert [r.status for r in got] == ["snapshot", "update", "gap", "gap", "snapshot", "update"] and [r.valid for r in got] == [True, True, False, False, True, True]


def book_fold(rows, bps):
    out, held, sides = {}, {}, ("ask", "bid")
    status = {n: v for n, *v in folded([(n, p, q, len(a or []) + len(b or [])) for n, p, q, a, b in rows])}
    for n, prev, _, asks, bids in rows:
        if prev == -1:
            held = {}
        for side, levels in zip(sides, (asks, bids), strict=True):
            for price, size in levels or []:
                held[side, price] = size
        live = {k: v for k, v in held.items() if v}
        ask, bid = (sorted(p for s, p in live if s == side) for side in sides)
        if not status[n][1]:
            out[n] = (None,) * 5
        elif not ask or not bid:
            out[n] = (None, None, None, None, len(live))
        else:
            mid = (ask[0] + bid[-1]) / 2
            out[n] = (bid[-1], ask[0], sum(p * live["bid", p] for p in bid if p >= mid * (1 - bps / 1e4)), sum(p * live["ask", p] for p in ask if p <= mid * (1 + bps / 1e4)), len(live))
    return out


@pytest.mark.parametrize("chunk", [1, 7, 1000])
def test_states_match_a_fold(spark, chunk):
    rng, rows = random.Random(9), {}
    level = lambda low: [(float(low + rng.randrange(8)), float(rng.choice([0, 0, 1, 2, 5]))) for _ in range(rng.randrange(3))]
    for s in ("x", "y"):
        rows[s] = [(3 * n, p, q, None if quiet == 0 else level(100), level(92) if quiet else []) for n, p, q, quiet in made(len(s) + ord(s), 90)]
    data = [(s, *m) for s, ms in rows.items() for m in ms]
    level_kind = "array<struct<price:double,size:double>>"
    got = books.book_states(spark.createDataFrame(data, f"inst string, frame_no long, prev long, seq long, asks {level_kind}, bids {level_kind}"), ["inst"], 300.0, chunk=chunk).collect()
    for s, ms in rows.items():
        want = book_fold(ms, 300.0)
        mine = {r.frame_no: (r.bid, r.ask, r.bid_depth, r.ask_depth, r.levels_held) for r in got if r.inst == s}
        assert mine.keys() == want.keys()
        for n, v in want.items():
            assert mine[n] == pytest.approx(v) if None not in v else mine[n] == v


def test_depletion_needs_every_point(spark):
    rows = [("x", t, 10.0 if t != 70 else 4.0, 10.0) for t in range(80) if t != 3]
    got = {r.t: r for r in books.net_depletion(spark.createDataFrame(rows, "inst string, t long, bid_depth double, ask_depth double"), ["inst"], 1).collect()}
    assert got[63].depletion is None and got[64].depletion == 0.0 and got[70].bid_short == pytest.approx(0.6) and got[70].depletion == pytest.approx(-0.6)


def streamed(spark, batches, **options):
    """Runs the check over batches of files, one run a batch."""
    at = f"{checkpoint_folder(spark)}/books-{uuid.uuid4().hex}"
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, feeds.MESSAGE).coalesce(1).write.mode("append").parquet(f"{at}/in")
        result = feeds.run_available(feeds.checked_books(feeds.stream(spark, f"{at}/in"), **options), f"{at}/out", f"{at}/checkpoint")
    return sorted((r.session, r.frame_no, r.status, r.valid) for r in result.collect()), at


def test_streams_don_t_depend_on_batches_and_order(spark):
    rows = [(s, n, "book", p, q, v) for s in (1, 2) for n, p, q, v in made(s, 40)]
    want = sorted((s, *m) for s in (1, 2) for m in folded(made(s, 40)))
    shuffled = rows[:]
    random.Random(1).shuffle(shuffled)
    assert streamed(spark, [rows])[0] == want
    assert streamed(spark, [shuffled[:25], shuffled[25:60] + shuffled[:3], shuffled[60:]])[0] == want


def test_second_ready_is_invalid_and_ends_let_state_go(spark):
    rows = [(1, 1, "ready", None, None, None), (1, 2, "book", -1, 5, 2), (1, 3, "ready", None, None, None), (1, 4, "book", 5, 6, 1), (1, 5, "end", None, None, None), (2, 2, "book", 1, 2, 1)]
    got, at = streamed(spark, [rows])
    assert got == [(1, 2, "snapshot", True), (1, 3, "second_ready", False), (1, 4, "update", False)]
    more = [(1, 1, "book", -1, 9, 1)]  # a new session of that name starts anew
    spark.createDataFrame(more, feeds.MESSAGE).coalesce(1).write.mode("append").parquet(f"{at}/in")
    again = feeds.run_available(feeds.checked_books(feeds.stream(spark, f"{at}/in")), f"{at}/out", f"{at}/checkpoint")
    assert (1, 1, "snapshot", True) in {(r.session, r.frame_no, r.status, r.valid) for r in again.collect()}


def test_missing_numbers_are_passed_over_after_patience(spark):
    first = [(1, 1, "book", -1, 5, 2), (1, 3, "book", 6, 7, 1), (1, 4, "book", -1, 8, 1)]
    got, _ = streamed(spark, [first, [(2, 1, "book", -1, 1, 1)], [(2, 2, "book", 1, 2, 1)]], patience_ms=1)
    assert [r for r in got if r[0] == 1] == [(1, 1, "snapshot", True), (1, 3, "gap", False), (1, 4, "snapshot", True)]


def test_book_messages_have_flags_or_a_reason(spark):
    def frame(n, payload):
        return ("s", n, payload)

    ok = '{"arg":{"channel":"books"},"action":"%s","data":[{"asks":%s,"bids":[],"seqId":"%s","prevSeqId":"%s","ts":"1"}]}'
    rows = [frame(1, ok % ("snapshot", '[["1.5","2"]]', 5, -1)), frame(2, ok % ("update", "[]", 5, 5)), frame(3, ok % ("update", "[]", 2, 5)), frame(4, ok % ("party", "[]", 2, 5)), frame(5, ok % ("update", "null", 2, 5)), frame(6, ok % ("update", "[]", -2, 5)), frame(7, ok % ("update", '[["x","2"]]', 6, 5)), frame(8, '{"arg":{"channel":"books"},"action":"update"}'), frame(9, '{"event":"subscribe","arg":{"channel":"books"}}'), frame(10, '{"arg":{"channel":"trades"}}')]
    good, bad = landed.book_messages(spark.createDataFrame(rows, "session_id string, frame_no long, payload string"))
    assert [(r.frame_no, r.ask_levels, r.is_heartbeat, r.is_reset) for r in good.orderBy("frame_no").collect()] == [(1, 1, False, False), (2, 0, True, False), (3, 0, False, True)]
    assert {r.frame_no: r.reason for r in bad.collect()} == {4: "no_action", 5: "sides_missing", 6: "bad_sequence", 7: "bad_level", 8: "no_data"}
