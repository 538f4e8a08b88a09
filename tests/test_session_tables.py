"""From session files to typed tables: every frame and item ends somewhere, with a reason."""

import json

import pytest

from tidemark.sources import session_tables as st

TRADE = {"tradeId": "t", "px": "1.50", "sz": "2", "side": "buy", "ts": "7"}
BOOK = {"asks": [["2", "1"]], "bids": [["1", "3"], ["0.5", "0"]], "ts": "7", "prevSeqId": -1, "seqId": 5}


def data(channel, *items, **more):
    return {"arg": {"channel": channel, "instId": "A"}, "data": list(items), **more}


PAYLOADS = [
    (data("trades", TRADE, 7, TRADE | {"px": "x"}, TRADE | {"px": "Infinity"}, TRADE | {"sz": "-1"}, TRADE | {"side": None}, TRADE | {"ts": "later"}, TRADE | {"tradeId": ""}, None), [None, "not_an_object", "bad_price", "bad_price", "bad_size", "bad_side", "bad_time", "no_trade_id", "not_an_object"]),
    (data("bbo-tbt", {"asks": [["2", "1"]], "bids": [], "ts": "1"}, {"asks": [], "bids": [], "ts": "1"}, {"asks": [["2"]], "bids": [], "ts": "1"}, {"asks": [["2", "1"]], "ts": "1"}), [None, "both_sides_empty", "bad_level", "sides_missing"]),
    (data("books", BOOK, BOOK | {"seqId": "x"}, BOOK | {"asks": [["0", "1"]]}, BOOK | {"ts": None}, action="snapshot"), [None, "bad_sequence", "bad_level", "bad_time"]),
    (data("books", BOOK, action="replace"), ["no_action"]),
    (data("instruments", {"instId": "A", "tickSz": "0.1", "ctVal": ""}, {"tickSz": "1"}), [None, "no_instrument"]),
    ({"arg": {"channel": "trades"}, "data": {}}, "no_items"),
    (data("trades"), "no_items"),
    ("{", "malformed"), ("", "malformed"), (None, "malformed"), ("[1]", "malformed"), ({"data": []}, "malformed"),
    ("pong", None), ({"event": "subscribe", "arg": {"channel": "trades"}}, None), ({"event": "party"}, None), (data("candles", 1), None),
]


def frames(spark, payloads):
    text = lambda p: p if p is None or isinstance(p, str) else json.dumps(p)
    return spark.createDataFrame([("s", k, 10**9 + k, text(p)) for k, p in enumerate(payloads)], "session_id string, frame_no long, received_at_ns long, payload string")


def test_every_frame_and_item_ends_somewhere(spark):
    f = frames(spark, [p for p, _ in PAYLOADS])
    t = st.session_tables(f)
    want = {(k, i, r) for k, (_, rs) in enumerate(PAYLOADS) if isinstance(rs, list) for i, r in enumerate(rs) if r} | {(k, None, r) for k, (_, r) in enumerate(PAYLOADS) if isinstance(r, str)}
    got = [(r.frame_no, r.idx, r.reason) for r in t["rejected"].collect()]
    assert set(got) == want and len(got) == len(want)
    assert sorted((r.frame_no, r.kind) for r in t["controls"].collect()) == [(12, "control"), (13, "control"), (14, "unknown_event"), (15, "unknown_channel")]
    for r in st.account(f, t).collect():
        assert r.kept + r.rejected == r["items"] and r.kept == 1
    r = t["trades"].first()
    assert (r.trade_id, r.px_raw, r.px, r.sz, r.side, r.ts, r.inst, r.idx) == ("t", "1.50", 1.5, 2.0, "buy", 7, "A", 0)
    assert sorted((x.side, x.level, x.price, x["size"]) for x in t["book_levels"].collect()) == [("ask", 0, 2.0, 1.0), ("bid", 0, 1.0, 3.0), ("bid", 1, 0.5, 0.0)]
    q, i = t["quotes"].first(), t["instruments"].first()
    assert (q.bid, q.ask, q.ask_size) == (None, 2.0, 1.0) and (i.tick_size, i.contract_value) == (0.1, None)


def test_publishing_fails_closed_and_runs_again(spark, tmp_path):
    t = st.session_tables(frames(spark, [p for p, _ in PAYLOADS]))
    with pytest.raises(ValueError, match="bad_price"):
        st.publish(t, str(tmp_path / "bad"), ["session_id"])
    assert not (tmp_path / "bad").exists()
    good = st.session_tables(frames(spark, [data("trades", TRADE), data("books", BOOK, action="snapshot"), "pong"]))
    first, again = (st.publish(good, str(tmp_path / "good"), ["session_id"]) for _ in range(2))
    assert len(first) == 6 and all(first.values()) and not any(again.values())
    assert spark.read.parquet(str(tmp_path / "good" / "book_levels")).count() == 3


def test_no_frames(spark):
    t = st.session_tables(frames(spark, ["pong"]).where("false"))
    assert all(df.isEmpty() for df in t.values())


def test_fates_agree_with_the_tables(spark):
    f = frames(spark, [p for p, _ in PAYLOADS])
    t = st.session_tables(f)
    want = [(c, "kept") for c, table in st.TABLES.items() for _ in range(t[table].count())]
    want += [(r.channel, r.kind) for r in t["controls"].collect()] + [(r.channel, r.reason) for r in t["rejected"].collect()]
    got = st.fates(f).collect()
    assert sorted(((r.channel, r.fate) for r in got), key=str) == sorted(want, key=str)
    assert sum(r.levels for r in got) == t["book_levels"].count()
