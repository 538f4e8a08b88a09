"""Joins on time where rows are dense or share their times: same rows as a plain loop, and no pairs."""

import random

from tidemark.operators import joins


def plain_controls(events, pool, reach, cooldown):
    taken, out = [], []
    for h, t, i in sorted((h, t, i) for i, h, t in events):
        free = [(abs(c - t), c, k) for k, g, c in pool if g == h and 0 < abs(c - t) <= reach and all(g2 != h or abs(c - x) >= cooldown for g2, x in taken)]
        if free:
            _, c, k = min(free)
            taken.append((h, c))
            out.append((i, t, k, c))
    return sorted(out)


def test_controls_of_events_at_equal_times_are_chosen_as_by_a_loop(spark):
    draw = random.Random(3)
    for cooldown, span in ((30, 400), (7, 4000), (0, 400)):
        events = [(i, i % 2, draw.randrange(span)) for i in range(150)]
        events += [(1000 + i, h, t) for i, h, t in events[:60]]
        pool = [(i, i % 2, draw.randrange(span)) for i in range(300)]
        one, two = (spark.createDataFrame(x, "id long, h long, t long").repartition(3) for x in (events, pool))
        got = sorted(map(tuple, joins.matched_controls(one, two, ["h"], 20, cooldown).collect()))
        assert got == plain_controls(events, pool, 20, cooldown)


def test_controls_make_no_pairs_in_an_hour_that_holds_everything(spark):
    events = spark.range(20_000).selectExpr("id", "0 as h", "id % 3600 as t")
    pool = spark.range(40_000).selectExpr("id", "0 as h", "(id * 7) % 3600 as t")
    x = joins.matched_controls(events, pool, ["h"], 3600, 600)  # 800 million pairs
    assert 4 <= x.count() <= 7


def test_totals_after_match_a_loop(spark):
    draw = random.Random(4)
    left = [(i, draw.randrange(200_000) // 7 * 7) for i in range(200)] + [(999, None)]
    points = [(draw.randrange(200_000) // 7 * 7, draw.choice([None, 1.0, 2.5])) for _ in range(400)]
    one, two = spark.createDataFrame(left, "id long, t long"), spark.createDataFrame(points, "t long, v double").selectExpr("t", "cast(v as decimal(18,6)) as v")
    got = {r.id: (r.n, float(r.total)) for r in joins.totals_after(one, two, [], 700, "v").collect()}
    for i, t in left:
        inside = [v for p, v in points if t is not None and t < p <= t + 700]
        assert got[i] == (len(inside), sum(v or 0 for v in inside))


def test_totals_after_make_no_pairs_in_dense_seconds(spark):
    left = spark.range(100_000).selectExpr("id", "id % 60 as t")
    points = spark.range(400_000).selectExpr("id % 60 as t", "cast(1 as decimal(18,6)) as v")
    got = joins.totals_after(left, points, [], 600, "v").selectExpr("sum(n) as n", "sum(total) as total").first()
    each = 100_000 // 60 * 400_000 // 60
    assert abs(got.n / (each * 59 * 30) - 1) < 0.01 and got.total == got.n  # 20 billion pairs


def plain_reconcile(left, right, tolerance):
    near = {i: [r for r in right if r[1] is not None and t is not None and abs(r[1] - t) <= tolerance] for i, t, _ in left}
    serves = {k: sum(k in [r[0] for r in rs] for rs in near.values()) for k, _, _ in right}
    out = []
    for i, t, v in left:
        if len(near[i]) == 1:
            k, u, w = near[i][0]
            status = "shared" if serves[k] > 1 else "value_mismatch" if abs(v - w) > 1e-9 else "matched"
            out.append((i, t, k, u - t, status) if status != "shared" else (i, t, None, None, status))
        else:
            out.append((i, t, None, None, "ambiguous" if near[i] else "unmatched"))
    return out + [(None, None, k, None, "unmatched_right") for k, _, _ in right if not serves[k]]


def test_reconcile_matches_a_loop(spark):
    draw = random.Random(5)
    for span in (300, 3000):
        left, right = ([(i, draw.randrange(span), float(draw.randrange(2))) for i in range(150)] + [(999, None, 1.0)] for _ in range(2))
        one, two = (spark.createDataFrame(x, "id long, t long, value double").repartition(3) for x in (left, right))
        got = [tuple(r) for r in joins.reconcile(one, two, [], 2, "value").collect()]
        assert sorted(got, key=str) == sorted(plain_reconcile(left, right, 2), key=str)


def test_reconcile_makes_no_pairs_in_dense_seconds(spark):
    left = spark.range(300_000).selectExpr("id", "id % 3 as t", "1.0D as value")
    right = spark.range(400_000).selectExpr("id", "id % 3 + 2 as t", "1.0D as value")
    got = {r.status: r["count"] for r in joins.reconcile(left, right, [], 2, "value").groupBy("status").count().collect()}
    assert got == {"ambiguous": 300_000}  # 80 billion pairs
