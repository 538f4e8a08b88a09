"""Positions, fills, trades and metrics from a column of targets, and outcomes of price barriers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bars import ordered, prefix
from .joins import interval_join, next_any
from .store import stored

DELAY = 1800


def positions(df: DataFrame, keys: list[str], bar: int, delay: int = DELAY, t: str = "t") -> DataFrame:
    """Adds position: the target of the previous existing bar if this bar follows within the delay, else as before (0 at
    first), and cancelled, whether a fill was too late."""
    lagged = ordered(df, keys, {"_target": ("lag", "target"), "_before": ("lag", t)}, t)
    late = F.col(t) - F.col("_before") - bar > delay
    lagged = lagged.withColumns({"_set": F.when(~late, F.col("_target")), "cancelled": F.coalesce(late & F.col("_target").isNotNull(), F.lit(False))})
    return prefix(lagged, keys, {"position": ("last", "_set")}, t).withColumn("position", F.coalesce("position", F.lit(0)).cast("int")).drop("_target", "_before", "_set")


def fills(df: DataFrame, keys: list[str], t: str = "t", price: str = "open") -> DataFrame:
    """Rows where the position changes: signal_t, fill_t, price, from_position, to_position."""
    out = ordered(df, keys, {"signal_t": ("lag", t), "from_position": ("lag", "position")}, t).withColumn("from_position", F.coalesce("from_position", F.lit(0)))
    return out.where("position <> from_position").select(*keys, "signal_t", F.col(t).alias("fill_t"), F.col(price).alias("price"), "from_position", F.col("position").alias("to_position"))


def trades(fill: DataFrame, keys: list[str]) -> DataFrame:
    """Round trips of each non-zero position; the last may be open (closed = false)."""
    nxt = ordered(fill, keys, {"exit_t": ("lead", "fill_t"), "exit_price": ("lead", "price")}, "fill_t")
    gross = F.when(F.col("price") != 0, F.col("to_position") * (F.col("exit_price") / F.col("price") - 1))
    return nxt.where("to_position <> 0").select(*keys, F.col("fill_t").alias("entry_t"), "exit_t", F.col("to_position").alias("side"), F.col("price").alias("entry_price"), "exit_price", gross.alias("gross"), F.col("exit_t").isNotNull().alias("closed"))


def bar_returns(df: DataFrame, keys: list[str], t: str = "t") -> DataFrame:
    """Adds gross (position times open to next open, 0 on the last bar) and turnover of each bar."""
    out = ordered(df, keys, {"_next": ("lead", "open"), "_was": ("lag", "position")}, t)
    gross = F.when(F.col("_next").isNotNull() & (F.col("open") != 0), F.col("position") * (F.col("_next") / F.col("open") - 1)).otherwise(0.0)
    return out.withColumns({"gross": gross, "turnover": F.abs(F.col("position") - F.coalesce("_was", F.lit(0)))}).drop("_next", "_was")


def net(df: DataFrame, costs: DataFrame) -> DataFrame:
    """Each bar under each cost scenario (scenario, per_side); scenarios are a short list given by the caller."""
    return df.crossJoin(F.broadcast(costs)).withColumn("net", F.col("gross") - F.col("turnover") * F.col("per_side"))


def metrics(by: list[str], r: str = "net") -> list[Column]:
    """Aggregates of bar returns; undefined values are null."""
    x = F.col(r)
    down = F.sqrt(F.avg(F.when(x < 0, x * x).otherwise(0.0)))
    lost = -F.sum(F.when(x < 0, x).otherwise(0.0))
    return [
        F.count("*").alias("bars"),
        F.sum(x).alias("total"),
        F.when(F.stddev_samp(x) > 0, F.avg(x) / F.stddev_samp(x)).alias("sharpe"),
        F.when(down > 0, F.avg(x) / down).alias("sortino"),
        F.sum("turnover").alias("turnover"),
        F.avg((F.col("position") != 0).cast("int")).alias("exposure"),
        F.when(lost > 0, F.sum(F.when(x > 0, x).otherwise(0.0)) / lost).alias("profit_factor"),
        F.when(F.sum("turnover") > 0, F.sum("gross") / F.sum("turnover") * 10_000).alias("break_even_bps"),
    ]


def held_for_at_most(df: DataFrame, keys: list[str], bars: int, t: str = "t") -> DataFrame:
    """Adds position: the target of the row before, with a forced exit after so many bars in a row; a new entry may follow on
    the bar after it. The exit wins over a new target on its bar and so delays it by one.

    Within a run of one target, places cycle through ``bars`` held ones and an exit. Whether a run starts one bar late depends
    on the run before alone: its length either makes the next one late, or leaves things as they are, or turns them
    around. So it is the parity of the turns since the last run that settled it, a running sum over runs."""
    cycle = bars + 1
    x = ordered(df, keys, {"_v": ("lag", "target")}, t).withColumn("_v", F.coalesce("_v", F.lit(0)))
    x = ordered(x, keys, {"_w": ("lag", "_v")}, t).withColumn("_new", F.coalesce((F.col("_v") != F.col("_w")).cast("int"), F.lit(1)))
    x = stored(prefix(x.withColumn("_one", F.lit(1)), keys, {"_run": ("sum", "_new"), "_at": ("count", "_one")}, t))
    runs = x.groupBy(*keys, "_run").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"), F.first("_v").alias("_v"))
    held = F.col("_v") != 0
    turns, keeps = held & (F.col("_n") % cycle == bars), held & (F.col("_n") % cycle == 0)
    runs = prefix(runs.withColumn("_turn", turns.cast("int")), keys, {"_turns": ("sum", "_turn")}, "_first", 1_000_000)
    runs = stored(runs)
    runs = prefix(runs.withColumn("_settled", F.when(~(turns | keeps), F.col("_turns"))), keys, {"_base": ("last", "_settled")}, "_first", 1_000_000)
    runs = runs.withColumn("_late", (F.col("_turns") - F.coalesce("_base", F.lit(0))) % 2)
    runs = ordered(runs, keys, {"_e": ("lag", "_late")}, "_first", 1_000_000).select(*keys, "_run", "_first", F.coalesce("_e", F.lit(0)).alias("_e"))
    place = F.col("_at") - F.col("_first") - F.col("_e")
    position = F.when((place >= 0) & (F.pmod(place, F.lit(cycle)) < bars), F.col("_v")).otherwise(0).cast("long")
    return x.join(runs, [*keys, "_run"]).withColumn("position", position).select(*df.columns, "position")


def cooled(df: DataFrame, keys: list[str], wait: int, t: str = "t", chunk: int | None = None) -> DataFrame:
    """Events at least ``wait`` (above 0) seconds after the last accepted one, greedily in time order; of events of one time the one
    with the smallest other columns. Rows without a time are left out.

    A series is dealt into chunks of at least ``wait`` seconds. The event that a chunk first accepts can only be one of its
    first ``wait`` seconds, or the first after them; from each of these *doors* the chunk leads to one door of a later chunk.
    These pointers are doubled (2, 4, 8 ... chunks ahead) in a logarithmic number of joins, then followed from each series'
    first event, longest first, which gives the door that each chunk is entered by. A task holds the times of one chunk."""
    width = max(chunk or 64 * wait, wait)
    if wait <= 0:
        raise ValueError("wait has to be above 0")
    key = F.struct(F.lit(0).alias("_0"), *keys)  # compares nulls in keys as equal
    rest = F.struct(F.lit(0).alias("_0"), *(c for c in df.columns if c not in (*keys, t)))
    one = df.where(F.col(t).isNotNull()).groupBy(key.alias("_key"), F.col(t).cast("long").alias("_t")).agg(F.min(F.struct(rest.alias("_rest"), F.col(t).alias("_own"))).alias("_row"))
    times = stored(one.select("_key", "_t", F.floor(F.col("_t") / width).alias("_chunk")))

    def ways(rows: pa.Table) -> pa.Table:
        """Each door of a chunk with the last time that is accepted from there."""
        rows = rows.sort_by("_t")
        at, start = rows["_t"].to_numpy(), rows["_chunk"][0].as_py() * width
        after = np.searchsorted(at, at + wait)
        last, step = np.arange(len(at)), np.append(after, len(at))
        while (step[:-1] < len(at)).any():
            live = step[:-1] < len(at)
            last = np.where(live, last[np.minimum(step[:-1], len(at) - 1)], last)
            step = step[step]
        doors = min(int(np.searchsorted(at, start + wait)) + 1, len(at))
        return rows.slice(0, doors).append_column("_last", pa.array(at[last[:doors]]))

    doors = times.groupBy("_key", "_chunk").applyInArrow(ways, times.withColumn("_last", F.lit(None).cast("long")).schema)
    free = doors.select("_key", (F.col("_last") + wait - 1).alias("_free"), F.col("_t").alias("_a"))
    ahead = next_any(free, doors.select("_key", F.col("_t").alias("_free")), ["_key"], [], "_free", width)
    steps = [stored(ahead.where("match_t is not null").select("_key", "_a", F.col("match_t").alias("_b")))]
    most = times.groupBy("_key").agg(F.count_distinct("_chunk").alias("n")).agg(F.max("n")).first()[0] or 0
    while 2 ** len(steps) < most:
        then = steps[-1].select("_key", F.col("_a").alias("_b"), F.col("_b").alias("_c"))
        steps.append(stored(steps[-1].join(then, ["_key", "_b"]).select("_key", "_a", F.col("_c").alias("_b"))))
    reached = times.groupBy("_key").agg(F.min("_t").alias("_a"))
    for step in reversed(steps):
        reached = stored(reached.unionByName(reached.join(step, ["_key", "_a"]).select("_key", F.col("_b").alias("_a"))))

    def follow(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("_t")
        at, door = rows["_t"].to_numpy(), rows["_door"].to_numpy()
        k, taken = int(np.argmax(door)) if door.any() else len(at), []
        while k < len(at):
            taken.append(k)
            k = int(np.searchsorted(at, at[k] + wait))
        return rows.take(pa.array(taken, pa.int64())).drop_columns("_door")

    entered = times.join(reached.select("_key", F.col("_a").alias("_t"), F.lit(True).alias("_door")), ["_key", "_t"], "left").withColumn("_door", F.coalesce("_door", F.lit(False)))
    taken = entered.groupBy("_key", "_chunk").applyInArrow(follow, entered.drop("_door").schema)
    back = {t: F.col("_row._own")} | {k: F.col(f"_key.`{k}`") for k in keys}
    return one.join(taken, ["_key", "_t"], "left_semi").select(*(back.get(c, F.col(f"_row._rest.`{c}`")).alias(c) for c in df.columns))


def first_touch(events: DataFrame, path: DataFrame, keys: list[str], bars: int, bar: int, take: float, stop: float, t: str = "t", ambiguous: str = "stop") -> DataFrame:
    """Short entries at the open of the bar at t: the first bar that gaps over or touches a barrier decides; else the exit is at the
    open after ``bars`` bars. A gap over the stop is filled at the open, one over the take at the barrier, since a resting
    order gets no better price. If one bar touches both, ``ambiguous`` says what counts: stop, take, or exclude (outcome excluded, no
    price). Events without a whole path are left out. Adds entry_price, outcome, exit_t, exit_price, ambiguous, mae and mfe."""
    if ambiguous not in ("stop", "take", "exclude"):
        raise ValueError(f"ambiguous has to be stop, take or exclude, not {ambiguous}")
    e = events.select(*keys, F.col("id"), F.col(t).alias("entry_t"), F.col("open").alias("entry_price")).withColumn("end_t", F.col("entry_t") + bars * bar + 1)
    p = interval_join(e, path.select(*keys, t, "open", "high", "low"), keys, "entry_t", "end_t", t, bars * bar)
    up, down = F.col("entry_price") * (1 + stop), F.col("entry_price") * (1 - take)
    last = F.col(t) == F.col("entry_t") + bars * bar
    as_hit = lambda outcome, price, both=False: F.struct(F.lit(outcome).alias("outcome"), price.alias("price"), F.lit(both).alias("both"))
    either = {"stop": as_hit("stop", up, True), "take": as_hit("take", down, True), "exclude": as_hit("excluded", F.lit(None).cast("double"), True)}[ambiguous]
    hit = (
        F.when(last, as_hit("timeout", F.col("open")))
        .when(F.col("open") >= up, as_hit("stop", F.col("open")))
        .when((F.col("open") <= down) & (F.col(t) > F.col("entry_t")), as_hit("take", down))
        .when((F.col("high") >= up) & (F.col("low") <= down), either)
        .when(F.col("high") >= up, as_hit("stop", up))
        .when(F.col("low") <= down, as_hit("take", down))
    )
    inner = ~last
    return (
        p.withColumn("hit", hit)
        .groupBy(*keys, "id", "entry_t", "entry_price")
        .agg(F.count("*").alias("n"), F.min_by("hit", F.when(F.col("hit").isNotNull(), F.col(t))).alias("h"), F.min(F.when(F.col("hit").isNotNull(), F.col(t))).alias("exit_t"), F.max(F.when(inner, F.col("high"))).alias("top"), F.min(F.when(inner, F.col("low"))).alias("bottom"))
        .where(F.col("n") == bars + 1)
        .select(*keys, "id", "entry_t", "entry_price", F.col("h.outcome").alias("outcome"), "exit_t", F.col("h.price").alias("exit_price"), F.col("h.both").alias("ambiguous"), (F.col("top") / F.col("entry_price") - 1).alias("mae"), (1 - F.col("bottom") / F.col("entry_price")).alias("mfe"))
    )


def hysteresis(df: DataFrame, keys: list[str], value: str, enter: float, leave: float, t: str = "t") -> DataFrame:
    """Adds state: 1 from where the value exceeds ``enter`` until it is at or below ``leave``; null leaves it as it is."""
    x = F.col(value)
    return prefix(df.withColumn("_set", F.when(x > enter, 1).when(x <= leave, 0)), keys, {"state": ("last", "_set")}, t).withColumn("state", F.coalesce("state", F.lit(0))).drop("_set")
