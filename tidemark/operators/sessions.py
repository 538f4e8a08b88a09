"""Sessions of frames: continuity, readiness, book sequences, quality reports, book walks. Session keys partition all
windows; a session's own frames are in order of frame_no."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bars import ordered, prefix


def continuity(frames: DataFrame, session: list[str], order: str = "frame_no") -> DataFrame:
    """Per session: frames, whether the numbers run without a gap, and how often the clock goes back."""
    w = Window.partitionBy(*session).orderBy(order)
    x = frames.withColumns({"_p": F.lag(order).over(w), "_c": F.lag("clock").over(w)})
    return x.groupBy(*session).agg(F.count("*").alias("frames"), F.coalesce(F.bool_and(F.col(order) == F.col("_p") + 1), F.lit(True)).alias("contiguous"), F.count_if(F.col("clock") < F.col("_c")).alias("clock_steps_back"))


def after_ready(frames: DataFrame, session: list[str], ready: Column, order: str = "frame_no") -> DataFrame:
    """Adds post_ready: whether a ready frame came before this one in its session (or is this one)."""
    w = Window.partitionBy(*session).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return frames.withColumn("post_ready", F.coalesce(F.max(ready.cast("int")).over(w) > 0, F.lit(False)))


def ready_once(frames: DataFrame, session: list[str], ready: Column, order: str = "frame_no") -> DataFrame:
    """Per session: how many ready frames it has, the first one's number, and whether it has at most one; a second is invalid."""
    x = frames.groupBy(*session).agg(F.count_if(ready).alias("readies"), F.min(F.when(ready, F.col(order))).alias("first_ready"))
    return x.withColumn("ready_valid", F.col("readies") <= 1)


def book_sequence(messages: DataFrame, keys: list[str], t: str = "frame_no", chunk: int = 100_000) -> DataFrame:
    """Adds status and valid. A snapshot (prev = -1) starts a valid stretch; an update must follow the last seq; a
    heartbeat repeats it and, where messages count their ``levels``, carries none; a smaller seq is a reset. Whatever breaks
    this is a gap, and so is all that follows until the next snapshot. Rows are dealt into chunks once."""
    x = ordered(messages, keys, {"_last": ("lag", "seq")}, t, chunk, dealt=True)
    start = F.col("prev") == -1
    loud = (F.col("seq") == F.col("prev")) & (F.coalesce(F.col("levels"), F.lit(0)) > 0) if "levels" in messages.columns else F.lit(False)
    broken = ~start & (F.col("_last").isNull() | (F.col("prev") != F.col("_last")) | loud)
    x = x.withColumns({"_start": F.when(start, F.col(t)), "_broken": F.when(broken, F.col(t))})
    x = prefix(x, keys, {"_from": ("max", "_start"), "_until": ("max", "_broken")}, t, chunk)
    valid = F.col("_from").isNotNull() & (F.col("_until").isNull() | (F.col("_until") < F.col("_from")))
    status = F.when(start, "snapshot").when(~valid, "gap").when(F.col("seq") == F.col("prev"), "heartbeat").when(F.col("seq") < F.col("prev"), "reset").otherwise("update")
    return x.withColumns({"status": status, "valid": valid}).drop("_last", "_start", "_broken", "_from", "_until")


def quality_report(frames: DataFrame, session: list[str], channel: str, required: list[str]) -> DataFrame:
    """Per session: frames by required channel, channels that are missing or not asked for, reasons, and ok."""
    need = F.array(*map(F.lit, required))
    x = frames.groupBy(*session).agg(F.count("*").alias("frames"), F.collect_set(channel).alias("_seen"), *(F.count_if(F.col(channel) == c).alias(f"n_{c}") for c in required))
    x = x.withColumns({"missing": F.array_sort(F.array_except(need, "_seen")), "extra": F.array_sort(F.array_except("_seen", need))})
    reasons = F.filter(F.array(F.when(F.size("missing") > 0, "channel_missing"), F.when(F.col("frames") < 10, "too_few_frames")), lambda r: r.isNotNull())
    return x.withColumn("reasons", reasons).withColumn("ok", F.size("reasons") == 0).drop("_seen")


def book_walk(levels: DataFrame, book: list[str], notional: float) -> DataFrame:
    """Mean price of buying for a notional through the levels of each book, best first; the last level in part, null if the
    book is too thin."""
    w = Window.partitionBy(*book).orderBy("level").rowsBetween(Window.unboundedPreceding, -1)
    worth = F.col("price") * F.col("size")
    x = levels.withColumn("_before", F.coalesce(F.sum(worth).over(w), F.lit(0.0)))
    take = F.greatest(F.lit(0.0), F.least(worth, F.lit(notional) - F.col("_before")))
    x = x.withColumns({"_take": take, "_units": F.when(F.col("price") > 0, take / F.col("price"))})
    return x.groupBy(*book).agg(F.when(F.sum(worth) >= notional, F.lit(notional) / F.sum("_units")).alias("mean_price"), F.count_if(F.col("_take") > 0).alias("levels"))


def natural_key_dedupe(rows: DataFrame, key: list[str], payload: list[str]) -> DataFrame:
    """One row a key with n copies and conflict, whether copies differ in their payload; keeps the smallest payload."""
    return rows.groupBy(*key).agg(F.count("*").alias("n"), (F.count_distinct(F.struct(*payload)) > 1).alias("conflict"), F.min(F.struct(*payload)).alias("_p")).select(*key, "n", "conflict", "_p.*")


def order_flow(quotes: DataFrame, keys: list[str], seconds: int, t: str = "t") -> DataFrame:
    """Adds ofi: order-flow imbalance of best quotes (bid, bid_size, ask, ask_size) over the last ``seconds``, and how many changes it
    rests on. What a quote adds is told by the one before it; the first of a series adds nothing."""
    from .bars import rolling

    x = ordered(quotes, keys, {f"_{c}": ("lag", c) for c in ("bid", "bid_size", "ask", "ask_size")}, t)
    zero = F.lit(0)
    bid = F.when(F.col("bid") >= F.col("_bid"), F.col("bid_size")).otherwise(zero) - F.when(F.col("bid") <= F.col("_bid"), F.col("_bid_size")).otherwise(zero)
    ask = F.when(F.col("ask") <= F.col("_ask"), F.col("ask_size")).otherwise(zero) - F.when(F.col("ask") >= F.col("_ask"), F.col("_ask_size")).otherwise(zero)
    x = x.withColumn("_e", F.when(F.col("_bid").isNotNull(), bid - ask))
    return rolling(x, keys, {"ofi": (F.sum("_e"), -seconds + 1, 0), "changes": (F.count("_e"), -seconds + 1, 0)}, t).drop("_e", *(f"_{c}" for c in ("bid", "bid_size", "ask", "ask_size")))


def near_depth(levels: DataFrame, book: list[str], bps: float) -> DataFrame:
    """Size within so many basis points of the middle by book: levels (book..., side, price, size); null if a side is empty."""
    best = levels.groupBy(*book).agg(F.max(F.when(F.col("side") == "bid", F.col("price"))).alias("_bid"), F.min(F.when(F.col("side") == "ask", F.col("price"))).alias("_ask"))
    mid = (F.col("_bid") + F.col("_ask")) / 2
    inside = F.abs(F.col("price") - mid) <= mid * (bps / 10_000)
    return levels.join(best, book).groupBy(*book).agg(F.first(mid).alias("mid"), F.when(F.first(mid).isNotNull(), F.sum(F.when(inside, F.col("size")).otherwise(0))).alias("depth"))


def depletion(depths: DataFrame, keys: list[str], seconds: int, least: int, t: str = "t") -> DataFrame:
    """Adds usual (the median depth of the ``seconds`` before) and depleted (the depth's shortfall from it), null with fewer than
    ``least`` points."""
    from .bars import rolling

    x = rolling(depths, keys, {"_m": (F.percentile("depth", F.lit(0.5)), -seconds, -1), "_n": (F.count("depth"), -seconds, -1)}, t)
    usual = F.when(F.col("_n") >= least, F.col("_m"))
    return x.withColumns({"usual": usual, "depleted": F.when(usual > 0, 1 - F.col("depth") / usual)}).drop("_m", "_n")


def absorption(flow: DataFrame, keys: list[str], seconds: int, least_flow: float, most_move: float, t: str = "t") -> DataFrame:
    """Adds flow (signed quantity of the last ``seconds``), move (of the middle over them) and absorbed: a flow at least so large
    with a move at most so large."""
    from .bars import rolling

    x = rolling(flow, keys, {"flow": (F.sum("signed"), -seconds + 1, 0), "_from": (F.max("mid"), -seconds, -seconds)}, t)
    x = x.withColumn("move", F.when(F.col("_from") > 0, F.col("mid") / F.col("_from") - 1))
    return x.withColumn("absorbed", F.coalesce((F.abs("flow") >= least_flow) & (F.abs("move") <= most_move), F.lit(False))).drop("_from")


def clock_gate(samples: DataFrame, by: list[str], cadence: int, share: float = 0.01, p99_ms: float = 20.0, most_ms: float = 100.0) -> DataFrame:
    """Whether a host's clock may be trusted: samples (t in seconds, synced, offset_ms) all synced, gaps beyond the cadence rare,
    offsets small. The quantile is exact, by nearest rank."""
    x = ordered(samples, by, {"_p": ("lag", "t")}, "t")
    late, size = F.col("t") - F.col("_p") > cadence, F.abs("offset_ms")
    out = x.withColumn("_size", size).groupBy(*by).agg(F.count("*").alias("samples"), F.bool_and("synced").alias("all_synced"), F.avg(F.coalesce(late, F.lit(False)).cast("int")).alias("late_share"), F.expr("percentile_disc(0.99) within group (order by _size)").alias("p99_ms"), F.max("_size").alias("max_ms"))
    return out.withColumn("passed", F.col("all_synced") & (F.col("late_share") < share) & (F.col("p99_ms") <= p99_ms) & (F.col("max_ms") <= most_ms))


def rolled_up(report: DataFrame, channels: list[str]) -> DataFrame:
    """One row over all sessions of a quality report: sessions, those that are ok, frames, and frames by channel."""
    return report.agg(F.count("*").alias("sessions"), F.count_if("ok").alias("ok"), F.sum("frames").alias("frames"), *(F.sum(f"n_{c}").alias(f"n_{c}") for c in channels), F.count_if(F.size("missing") > 0).alias("incomplete"))


def envelopes(frames: DataFrame, session: list[str], version: int, order: str = "frame_no") -> DataFrame:
    """Per session: frames, those of another version, whether all belong to one stream and whether their numbers run without a gap."""
    w = Window.partitionBy(*session).orderBy(order)
    x = frames.withColumn("_p", F.lag(order).over(w))
    return x.groupBy(*session).agg(F.count("*").alias("frames"), F.count_if(F.col("version") != version).alias("bad_version"), (F.count_distinct("stream") == 1).alias("one_stream"), F.coalesce(F.bool_and(F.col(order) == F.col("_p") + 1), F.lit(True)).alias("contiguous"))
