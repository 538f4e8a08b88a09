import hashlib
import json
import zipfile

from pyspark.sql import functions as F

from tidemark.sources import landed


def kline(t, close="2.5", micro=False):
    k = 1000 if micro else 1
    return f'{t * k},1,3,0.5,{close},10,{(t + 299_999) * k + (999 if micro else 0)},20,7,4,8,0'


def test_zipped_klines(spark, tmp_path):
    t = 1_704_067_200_000
    files = {
        "X-2024-01.zip": [",".join(landed.KLINE), kline(t), kline(t + 300_000, micro=True), kline(t + 1), "1,2", kline(t + 600_000, close='"" ')],
        "X-2024-02.zip": [kline(t, close="9")],
    }
    for name, lines in files.items():
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            z.writestr("a.csv", "\n".join(lines))
    with zipfile.ZipFile(tmp_path / "X-2024-03.zip", "w") as z:
        z.writestr("readme.txt", "none")
    good, bad = landed.klines(landed.zipped_csv(spark, str(tmp_path), landed.KLINE), "X")
    assert sorted(r.reason for r in bad.collect()) == ["0 csv files", "2 cells", "bad_number", "off_grid"]
    one, account = landed.owned_first(good, ["symbol", "ts"])
    assert [(r.ts, r.close) for r in one.orderBy("ts").collect()] == [(t, 2.5), (t + 300_000, 2.5)]
    assert tuple(account.first()) == (3, 3, 2, 1)


def test_candles_frames_books(spark):
    body = json.dumps({"data": [["1", "1", "2", "0", "1.5", "9", "x", "13", "1"], ["2", "1", "2", "0", "1.5", "9", "x", "13", "0"]]})
    assert [tuple(r) for r in landed.candles(spark.createDataFrame([(body,)], "body string"), "S").collect()] == [("S", 1, 1.0, 2.0, 0.0, 1.5, 9.0, 13.0)]
    frame = lambda n, payload, version=1: json.dumps({"schema_version": version, "stream": "s", "session_id": "a", "frame_no": n, "kind": "m", "received_at_ns": 5, "payload": json.dumps(payload)})
    lines = [
        frame(1, {"arg": {"channel": "trades", "instId": "I"}, "data": [{"px": "1.10", "sz": "2", "side": "buy", "ts": "7", "tradeId": "t"}]}),
        frame(2, {"arg": {"channel": "books5", "instId": "I"}, "action": "snapshot", "data": [{"asks": [["2", "1", "0", "1"]], "bids": [["1", "3", "0", "1"], ["0.5", "4", "0", "1"]], "seqId": 4, "prevSeqId": -1}]}),
        frame(3, {}, version=9),
        "{broken",
    ]
    good, bad = landed.frames(spark.createDataFrame([("p", x) for x in lines], "path string, value string"))
    assert sorted(r.reason for r in bad.collect()) == ["bad_envelope", "unknown_version"]
    assert [(r.trade_id, r.px_raw, r.px, r.sz, r.ts) for r in landed.trades(good).collect()] == [("t", "1.10", 1.1, 2.0, 7)]
    assert sorted((r.side, r.level, r.price, r["size"]) for r in landed.book_levels(good).collect()) == [("ask", 0, 2.0, 1.0), ("bid", 0, 1.0, 3.0), ("bid", 1, 0.5, 4.0)]


def test_checksums_and_merge(spark, tmp_path):
    (tmp_path / "a.zip").write_bytes(b"one")
    (tmp_path / "b.zip").write_bytes(b"two")
    files = spark.read.format("binaryFile").load(str(tmp_path))
    known = spark.createDataFrame([("a.zip", hashlib.sha256(b"one").hexdigest()), ("b.zip", "x"), ("c.zip", "y")], "name string, sha256 string")
    assert {tuple(r) for r in landed.checksums(files, known).collect()} == {("a.zip", "match"), ("b.zip", "mismatch"), ("c.zip", "absent")}
    old = spark.createDataFrame([(1, 10), (2, 20)], "k int, v int")
    new = spark.createDataFrame([(2, 99), (3, 31), (3, 30)], "k int, v int")
    out, added = landed.merge_new(old, new, ["k"])
    assert sorted(map(tuple, out.collect())) == [(1, 10), (2, 20), (3, 30)] and added.first().added == 1
    again, none = landed.merge_new(out, new, ["k"])
    assert again.count() == 3 and none.first().added == 0


def test_epoch_units(spark):
    rows = spark.createDataFrame([("1704067200000",), ("1704067200000000",), ("1704067200000999",), ("1704067200000500",), ("x",)], "raw string")
    assert [r[0] for r in rows.select(landed.epoch_ms(F.col("raw"))).collect()] == [1704067200000, 1704067200000, 1704067200000, None, None]
