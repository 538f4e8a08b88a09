"""Fills of two-leg trades: the next bar with both legs, or none."""

import random

from tidemark.operators import carry

BARS = "s string, t long, spot_open double, perp_open double"
SIGNALS = "s string, id long, entry_signal long, exit_signal long"


def fills(spark, signals, bars, **more):
    given = {"cancel": 30, "capital": 300.0, "leverage": 2.0, "lot": 0.5, "least": 5.0} | more
    return {r.id: r for r in carry.two_leg_fills(spark.createDataFrame(signals, SIGNALS), spark.createDataFrame(bars, BARS), ["s"], **given).collect()}


def test_edges_of_fills(spark):
    bars = [("a", t, 10.0 + t, 11.0 + t) for t in range(0, 200, 10) if t not in (50, 60, 70, 80)] + [("a", 50, None, 9.0), ("a", 60, 9.0, None), ("a", 70, 0.0, 9.0)]
    signals = [("a", 1, 0, 90), ("a", 2, 35, 100), ("a", 3, 41, 100), ("a", 4, 45, 100), ("a", 5, 90, 500), ("a", 6, 185, 190), ("a", 7, 90, 20), ("b", 8, 0, 10), ("a", 9, None, 10)]
    got = fills(spark, signals, bars)
    assert (got[1].entry_t, got[1].spot_entry, got[1].perp_entry, got[1].exit_t, got[1].exit_kind) == (10, 20.0, 21.0, 100, "signal")
    assert got[1].quantity == 10.0 and got[2].entry_t == 40 and got[2].quantity == 4.0
    assert [got[k].reason for k in (3, 4, 8, 9)] == ["no_entry_fill"] * 4 and got[3].exit_t is None and got[3].quantity is None
    assert (got[5].entry_t, got[5].exit_kind, got[5].exit_t, got[5].spot_exit) == (100, "last", 190, 200.0)
    assert (got[6].entry_t, got[6].exit_kind, got[6].exit_t) == (190, "none", None)
    assert (got[7].entry_t, got[7].exit_t) == (100, 110)
    assert fills(spark, signals[:1], bars, lot=50.0)[1].reason == "rounds_to_zero"
    assert fills(spark, signals[:1], bars, least=1e6)[1].reason == "below_least"


def test_fills_match_a_search(spark):
    rng = random.Random(7)
    bars = [(s, t, *(rng.choice([None, rng.uniform(5, 20), rng.uniform(5, 20)]) for _ in "xy")) for s in "ab" for t in range(0, 3000, 10)]
    signals = [(rng.choice("ab"), k, t, t + rng.randrange(400)) for k, t in enumerate(rng.randrange(3000) for _ in range(150))]
    got = fills(spark, signals, bars)

    def search(s, after):
        return next((b for b in bars if b[0] == s and after < b[1] <= after + 30 and b[2] and b[3]), None)

    assert len(got) == 150
    for s, k, a, z in signals:
        e = search(s, a)
        assert got[k].entry_t == (e and e[1])
        if e:
            x, tail = search(s, max(z, e[1])), max(b[1] for b in bars if b[0] == s and b[2] and b[3])
            assert got[k].exit_t == (x[1] if x else tail if tail > e[1] else None)
            raw = 300 * 2 / (3 * e[2])
            assert got[k].quantity == raw // 0.5 * 0.5 and abs(got[k].residual - raw % 0.5) < 1e-9
