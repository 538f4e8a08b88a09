"""Joins on time: as-of in both directions, bands, intervals, one-to-one matches and matched controls.

None sorts a whole series in one task: as-of joins work on chunks of time with a carried row, band and interval
joins on buckets with an equi-join, so that Spark can split skewed buckets."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bars import ordered, prefix, rolling


def as_of(left: DataFrame, right: DataFrame, keys: list[str], tolerance: int, take: list[str], t: str = "t", forward: bool = False, strict: bool = False) -> DataFrame:
    """Each left row with the ``take`` columns of the nearest right row at or before its time (``forward``: at or after;
    ``strict``: not at it), at most ``tolerance`` seconds away (inclusive), and ``match_t``; else null.

    Chunks are as wide as the tolerance, so a row can only match in its own chunk or the one beside it: right rows are
    copied into both, and each chunk is a window of its own."""
    chunk = max(int(tolerance), 1)
    home = F.floor(F.col(t) / chunk)
    sign = -1 if forward else 1
    got = F.struct(F.col(t).alias("match_t"), *take)
    r = right.select(*keys, t, got.alias("_r"), F.explode(F.array(home, home + sign)).alias("_chunk"))
    l = left.withColumn("_l", F.struct(*(F.col(f"`{c}`") for c in left.columns))).select(*keys, t, "_l", home.alias("_chunk"))  # noqa: E741
    both = l.withColumn("_r", F.lit(None).cast(r.schema["_r"].dataType)).unionByName(r.withColumn("_l", F.lit(None).cast(l.schema["_l"].dataType)))
    side = F.col("_l").isNotNull().cast("int")  # right rows first, so that equal times match, unless strict
    by = Window.partitionBy(*keys, "_chunk").orderBy(F.col(t) * sign, -side if strict else side).rowsBetween(Window.unboundedPreceding, 0)
    near = both.withColumn("_m", F.last("_r", ignorenulls=True).over(by)).where("_l is not null")
    ok = F.abs(F.col(t) - F.col("_m.match_t")) <= tolerance
    return near.select("_l.*", *(F.when(ok, F.col(f"_m.{c}")).alias(c) for c in ["match_t", *take]))


def next_any(left: DataFrame, right: DataFrame, keys: list[str], take: list[str], t: str = "t", chunk: int = 30 * 86400) -> DataFrame:
    """Each left row with the ``take`` columns of the first right row strictly after its time, however far, and ``match_t``.
    Each chunk of time is a window of its own; a small table of chunks carries the first right row of later ones."""
    home = F.floor(F.col(t) / chunk)
    got = F.struct(F.col(t).alias("match_t"), *take)
    r = right.select(*keys, t, got.alias("_r"), home.alias("_chunk"))
    l = left.withColumn("_l", F.struct(*(F.col(f"`{c}`") for c in left.columns))).select(*keys, t, "_l", home.alias("_chunk"))  # noqa: E741
    both = l.withColumn("_r", F.lit(None).cast(r.schema["_r"].dataType)).unionByName(r.withColumn("_l", F.lit(None).cast(l.schema["_l"].dataType)))
    later = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(1, Window.unboundedFollowing)
    carry = both.groupBy(*keys, "_chunk").agg(F.min_by("_r", F.when(F.col("_r").isNotNull(), F.col(t))).alias("_first")).withColumn("_carry", F.first("_first", ignorenulls=True).over(later)).drop("_first")
    by = Window.partitionBy(*keys, "_chunk").orderBy(-F.col(t), F.col("_r").isNotNull().cast("int")).rowsBetween(Window.unboundedPreceding, 0)
    near = both.withColumn("_m", F.last("_r", ignorenulls=True).over(by)).where("_l is not null").join(carry, [*keys, "_chunk"])
    return near.withColumn("_m", F.coalesce("_m", "_carry")).select("_l.*", *(F.col(f"_m.{c}").alias(c) for c in ["match_t", *take]))


def published_as_of(left: DataFrame, right: DataFrame, keys: list[str], delay: int, stale: int, take: list[str], t: str = "t") -> DataFrame:
    """As-of join on when right rows became known (their time plus ``delay``); a match older than ``stale`` seconds counts as
    none. match_t is the right row's own time."""
    known = right.withColumns({"_own": F.col(t), t: F.col(t) + delay})
    out = as_of(left, known, keys, stale, ["_own", *take], t)
    return out.drop("match_t").withColumnRenamed("_own", "match_t")


def band_join(left: DataFrame, right: DataFrame, keys: list[str], tolerance: int, left_t: str, right_t: str, how: str = "inner") -> DataFrame:
    """Pairs with |left_t - right_t| <= tolerance: right rows go to the buckets around theirs, then an equi-join."""
    width = max(int(tolerance), 1)
    home = F.floor(F.col(right_t) / width)
    r = right.withColumn("_bucket", F.explode(F.sequence(home - 1, home + 1)))
    l = left.withColumn("_bucket", F.floor(F.col(left_t) / width))  # noqa: E741
    near = F.abs(F.col(left_t) - F.col(right_t)) <= tolerance
    on = [l[k] == r[k] for k in [*keys, "_bucket"]] + [near]
    out = l.join(r.drop() if how in ("left_anti", "left_semi") else r, on, how)
    return out.drop(*(r[k] for k in [*keys, "_bucket"])).drop("_bucket") if how in ("inner", "left") else out.drop(l["_bucket"])


def interval_join(left: DataFrame, points: DataFrame, keys: list[str], start: str, end: str, t: str, bucket: int, closed: str = "left") -> DataFrame:
    """Pairs where the point's time lies in [start, end) or, closed='right', in (start, end]: intervals are copied
    to each bucket of time that they meet, then an equi-join."""
    l = left.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(start) / bucket), F.floor(F.col(end) / bucket))))  # noqa: E741
    r = points.withColumn("_bucket", F.floor(F.col(t) / bucket))
    inside = (r[t] >= l[start]) & (r[t] < l[end]) if closed == "left" else (r[t] > l[start]) & (r[t] <= l[end])
    out = l.join(r, [*(l[k] == r[k] for k in [*keys, "_bucket"]), inside])
    return out.drop(*(r[k] for k in [*keys, "_bucket"])).drop("_bucket")


def totals_after(left: DataFrame, points: DataFrame, keys: list[str], within: int, value: str, t: str = "t") -> DataFrame:
    """Left rows with ``n`` and ``total``: how many points have a time in (t, t + within], and the sum of a decimal column over
    them. From running totals at the seconds that matter, so that no pairs are made, however dense the points."""
    times = left.select(*keys, t).distinct()
    ends = times.select(*keys, F.explode(F.array(F.col(t), F.col(t) + within)).alias(t), F.lit(0).alias("n"), F.lit(0).alias("total"))
    ends = points.select(*keys, t, F.lit(1).alias("n"), F.coalesce(value, F.lit(0)).alias("total")).unionByName(ends)
    ends = ends.groupBy(*keys, t).agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    at = prefix(ends, keys, {"_n": ("sum", "n"), "_total": ("sum", "total")}, t, 86400).select(*keys, t, "_n", "_total")
    until = at.select(*keys, (F.col(t) - within).alias(t), F.col("_n").alias("n"), F.col("_total").alias("total"))
    sums = times.join(at, [*keys, t]).join(until, [*keys, t]).select(*keys, t, (F.col("n") - F.col("_n")).alias("n"), (F.col("total") - F.col("_total")).alias("total"))
    return left.join(sums, [*keys, t], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n", "total")})


def reconcile(left: DataFrame, right: DataFrame, keys: list[str], tolerance: int, value: str, agree: float = 1e-9) -> DataFrame:
    """One-to-one match of two event tables (id, t, value; whole seconds) within a tolerance; every row of both sides is kept
    with a status: matched, value_mismatch, ambiguous (several candidates), shared (its candidate serves several) or unmatched,
    and unmatched_right. Candidates are counted by second and the only one is the least, so no pairs are made."""
    l = left.select(*keys, F.col("id").alias("left_id"), F.col("t").alias("left_t"), F.col(value).alias("left_value"))  # noqa: E741
    r = right.select(*keys, F.col("id").alias("right_id"), F.col("t").alias("right_t"), F.col(value).alias("right_value"))
    none = F.lit(None)
    rights = r.select(*keys, F.col("right_t").alias("t"), F.struct("right_id", "right_t", "right_value").alias("c"))
    both = rights.unionByName(l.select(*keys, F.col("left_t").alias("t"), none.cast(rights.schema["c"].dataType).alias("c")))
    by_second = both.groupBy(*keys, "t").agg(F.count("c").alias("rights"), F.count_if(F.col("c").isNull()).alias("lefts"), F.min("c").alias("c")).where("t is not null")
    span = (-tolerance, tolerance)
    near = rolling(by_second, keys, {"of_left": (F.sum("rights"), *span), "of_right": (F.sum("lefts"), *span), "c": (F.min("c"), *span)})
    served = near.select(*keys, F.col("t").alias("right_t"), "of_right")
    one = near.select(*keys, F.col("t").alias("left_t"), "of_left", "c.*").join(served, [*keys, "right_t"])
    status = (
        F.when(F.col("of_left").isNull(), "unmatched")
        .when(F.col("of_left") > 1, "ambiguous")
        .when(F.col("of_right") > 1, "shared")
        .when(F.abs(F.col("left_value") - F.col("right_value")) > agree, "value_mismatch")
        .otherwise("matched")
    )
    sure = F.col("status").isin("matched", "value_mismatch")
    main = l.join(one, [*keys, "left_t"], "left").withColumn("status", status)
    main = main.select("left_id", "left_t", F.when(sure, F.col("right_id")).alias("right_id"), F.when(sure, F.col("right_t") - F.col("left_t")).alias("offset"), "status")
    lone = r.join(served.where("of_right > 0"), [*keys, "right_t"], "left_anti")
    return main.unionByName(lone.select(none.cast(main.schema["left_id"].dataType).alias("left_id"), none.cast(main.schema["left_t"].dataType).alias("left_t"), "right_id", none.cast(main.schema["offset"].dataType).alias("offset"), F.lit("unmatched_right").alias("status")))


def first_after(left: DataFrame, right: DataFrame, keys: list[str], within: int, take: list[str], t: str = "t") -> DataFrame:
    """The first right row strictly after each left row's time and at most ``within`` seconds later."""
    return as_of(left, right, keys, within, take, t, forward=True, strict=True)


def _nearest_free(strata: int, reach: int, cooldown: int):
    """Reads (strata..., _island, _at, is_event, t, id) in order of island, _at and kind, where a control comes ``reach`` before its
    time, and yields each event's choice. Kept are the free controls of one window and what was taken there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, done = None, None
        times: list[int] = []  # free controls in order
        ids: list[int | None] = []
        taken: list[int] = []  # sorted
        for batch in batches:
            out: list[tuple] = []
            columns = [c.to_pylist() for c in batch.columns]
            for key, is_event, t, i in zip(zip(*columns[: strata + 1], strict=True), *columns[strata + 2 :], strict=True):
                if key != group:
                    group, done, times, ids, taken = key, None, [], [], []
                if not is_event:
                    k = bisect.bisect_left(taken, t)
                    if all(abs(t - x) >= cooldown for x in taken[max(k - 1, 0) : k + 1]):
                        times.append(t)
                        ids.append(i)
                    continue
                if (t, i) == done:
                    continue
                gone = bisect.bisect_left(times, t - reach)
                if 2 * gone > len(times):  # not at each step, as lists move
                    del times[:gone], ids[:gone]
                    gone = 0
                before, after = bisect.bisect_left(times, t) - 1, bisect.bisect_right(times, t)
                near = [k for k in (before, after) if gone <= k < len(times)]  # all that came are at most reach ahead
                if not near:
                    continue
                k = min(near, key=lambda k: (abs(times[k] - t), k))
                control = times[k]
                out.append((i, t, ids[k], control))
                done = (t, i)
                if cooldown > 0:
                    lo, hi = bisect.bisect_right(times, control - cooldown), bisect.bisect_left(times, control + cooldown)
                    del times[lo:hi], ids[lo:hi]
                del taken[: bisect.bisect_left(taken, t - reach - cooldown)]
                bisect.insort(taken, control)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*out, strict=True)] or [pa.array([], pa.int64())] * 4, names=_CHOICE)

    return run


_CHOICE = ["event_id", "event_t", "control_id", "control_t"]


def matched_controls(events: DataFrame, pool: DataFrame, strata: list[str], reach: int, cooldown: int, t: str = "t") -> DataFrame:
    """For each event the nearest control of its stratum (ties: the earlier, then the smaller id), no control within ``cooldown``
    of one that is taken. Events further apart than both reaches and the cooldown cannot take each other's controls, so strata
    fall into islands there. Events and controls stream through each island in time order; no pairs are made, and a task
    holds the controls of one window, once a second."""
    given = " and ".join(f"`{c}` is not null" for c in [*strata, "_t"])
    e = events.select(*strata, F.col("id"), F.col(t).alias("_t")).where(given)
    times = e.select(*strata, "_t").distinct()  # equal times would have no order
    times = ordered(times, strata, {"_p": ("lag", "_t")}, "_t").withColumn("_new", F.coalesce((F.col("_t") - F.col("_p") > 2 * reach + cooldown).cast("int"), F.lit(1)))
    islands = prefix(times, strata, {"_island": ("sum", "_new")}, "_t").groupBy(*strata, "_island").agg((F.min("_t") - reach).alias("_lo"), (F.max("_t") + reach + 1).alias("_hi"))
    # of controls at one time only the smallest id is ever taken
    p = pool.select(*strata, F.col("id"), F.col(t).alias("_t")).where(given).groupBy(*strata, "_t").agg(F.min("id").alias("id"))
    rows = e.withColumns({"_event": F.lit(True), "_at": F.col("_t")}).unionByName(p.withColumns({"_event": F.lit(False), "_at": F.col("_t") - reach}))
    bucket = max(2 * reach, 1)  # islands and their reaches don't overlap, so that few meet a bucket
    islands = islands.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("_lo") / bucket), F.floor(F.col("_hi") / bucket))))
    near = rows.withColumn("_bucket", F.floor(F.col("_t") / bucket)).join(islands, [*strata, "_bucket"]).where("_t >= _lo and _t < _hi")
    dealt = near.select(*strata, "_island", "_at", "_event", "_t", "id").repartition(*strata, "_island")
    inner = dealt.sortWithinPartitions(*strata, "_island", "_at", "_event", "_t", F.asc_nulls_last("id"))
    return inner.mapInArrow(_nearest_free(len(strata), reach, cooldown), ", ".join(f"{c} long" for c in _CHOICE))


def candidate_rules(events: DataFrame, bars: DataFrame, keys: list[str], bar: int, rules: list[tuple[str, int, str]], t: str = "t") -> DataFrame:
    """For each rule (name, offset in bars, column): how many events (keys, at, value) equal that column of the bar that
    holds them, moved by the offset; how many had such a bar; and all. Offsets are exploded, so one join serves all rules."""
    offsets = sorted({o for _, o, _ in rules})
    numbered = events.withColumn("_id", F.monotonically_increasing_id())
    moved = numbered.withColumn("_o", F.explode(F.array(*map(F.lit, offsets)))).withColumn(t, F.floor(F.col("at") / bar) * bar + F.col("_o") * bar)
    found = moved.join(bars.select(*keys, t, *(F.col(c).alias(f"_{c}") for c in dict.fromkeys(c for _, _, c in rules)), F.lit(True).alias("_has")), [*keys, t], "left")
    tests = F.filter(F.array(*(F.when(F.col("_o") == o, F.struct(F.lit(k).alias("rule"), F.coalesce(F.col("value") == F.col(f"_{c}"), F.lit(False)).alias("exact"))) for k, o, c in rules)), lambda x: x.isNotNull())
    each = found.select(F.explode(tests).alias("x"), F.coalesce("_has", F.lit(False)).alias("has")).select("x.*", "has")
    return each.groupBy("rule").agg(F.count_if("exact").alias("exact"), F.count_if("has").alias("compared"), F.count("*").alias("events"))
