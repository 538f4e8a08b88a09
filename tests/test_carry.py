from pyspark.sql import functions as F

from tidemark.operators import carry


def test_funding_is_entry_exclusive_and_exit_inclusive(spark):
    trades = spark.createDataFrame([(1, 100, 300, 2.0), (2, 500, 600, 1.0)], "id long, entry_t long, exit_t long, quantity double")
    marks = spark.createDataFrame([(100, 0.1, 10.0), (200, 0.1, 10.0), (300, -0.05, 20.0)], "t long, rate double, mark double")
    got = {r.id: (round(r.funding, 9), r.settlements) for r in carry.funding_cash(trades, marks, [], 50).collect()}
    assert got == {1: (0.0, 2), 2: (0.0, 0)}


def test_pnl_identity(spark):
    df = spark.createDataFrame([(2.0, 100.0, 110.0, 102.0, 111.0, 1.5)], "quantity double, spot_entry double, spot_exit double, perp_entry double, perp_exit double, funding double")
    r = carry.trade_pnl(df, 0.001).first()
    assert r.identity_ok and abs(r.pnl - (2 * 10 - 2 * 9 + 1.5 - 0.001 * 2 * 423)) < 1e-9


def test_margin_path(spark):
    rows = [(1, k, 1.0, 100.0, h, h, 0.0) for k, h in enumerate([101.0, 105.0, 109.5, 100.0])] + [(2, 0, 1.0, 100.0, 100.0, 100.0, 1.0)]
    df = spark.createDataFrame(rows, "trade long, k long, quantity double, entry double, mark_high double, mark_close double, cash double")
    got = [(r.trade, r.k, r.state) for r in carry.margin_path(df, "trade", "k", 10.0, 0.01).orderBy("trade", "k").collect()]
    assert got == [(1, 0, "open"), (1, 1, "open"), (1, 2, "liquidated"), (1, 3, "closed"), (2, 0, "open")]


def test_marks_and_rates(spark):
    df = spark.createDataFrame([("1.5", 2.0, "complete"), ("", 2.0, "complete"), ("x", 2.0, "gap"), ("-1", None, "complete")], "rest string, o double, s string")
    got = [(r.mark, r.mark_source, r.mark_reason) for r in df.select(*(c.alias(k) for k, c in carry.resolved_mark(F.col("rest"), F.col("o"), F.col("s")).items())).collect()]
    assert got == [(1.5, "published", "valid"), (2.0, "bar_open", "absent"), (None, "unavailable", "unparseable"), (None, "unavailable", "non_positive")]
    word = lambda x: f"{int(x * 10**27):064x}"
    rows = [("d1", a, word(r)) for a, r in (("A", 0.03), ("B", 0.05))] + [("d2", "A", word(0.03))] + [("d3", "A", "zz"), ("d3", "B", word(0.01))]
    out = {r.date: (r.mean_apr and round(r.mean_apr, 9), r.reason) for r in carry.daily_rates(spark.createDataFrame(rows, "date string, asset string, word string"), ["A", "B"]).collect()}
    assert out == {"d1": (0.04, None), "d2": (None, "missing_asset"), "d3": (None, "bad_word")}
