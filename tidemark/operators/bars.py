"""Bars on a regular grid, their gaps, and windows that scale over one hot series.

Times are epoch seconds (long). A bar at t covers [t, t + BAR)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BAR = 3600
MONEY = "decimal(18,6)"


def seconds(ts: Column) -> Column:
    """Epoch seconds of a timestamp, rounded down; TIMESTAMP_NTZ counts as UTC."""
    return F.unix_seconds(ts.cast("timestamp"))


def bars(events: DataFrame, bar: int = BAR) -> DataFrame:
    """(symbol, t, open, high, low, close, volume, volume_quote, taker_volume, taker_quote) per event type and bar."""
    money = F.col("value").cast(MONEY)
    even = F.col("user_id") % 2 == 0
    t = seconds(F.col("ts"))
    return (
        events.select("event_type", "ts", "event_id", "value", "user_id", (t - t % bar).alias("t"))
        .groupBy(F.col("event_type").alias("symbol"), "t")
        .agg(
            F.min_by("value", F.struct("ts", "event_id")).alias("open"),
            F.max("value").alias("high"),
            F.min("value").alias("low"),
            F.max_by("value", F.struct("ts", "event_id")).alias("close"),
            F.count("*").alias("volume"),
            F.sum(money).cast("double").alias("volume_quote"),
            F.count_if(even).alias("taker_volume"),
            F.coalesce(F.sum(F.when(even, money)), F.lit(0)).cast("double").alias("taker_quote"),
        )
    )


def with_halo(df: DataFrame, keys: list[str], before: int, after: int, chunk: int, t: str = "t") -> DataFrame:
    """Deals each series into chunks of time. A row is copied to every chunk that it can reach (``before`` is how far
    back windows look, ``after`` how far ahead); ``_core`` marks the one copy that stays."""
    home = F.floor(F.col(t) / chunk)
    reach = F.sequence(F.floor((F.col(t) - after) / chunk), F.floor((F.col(t) + before) / chunk))
    return df.withColumn("_chunk", F.explode(reach)).withColumn("_core", F.col("_chunk") == home)


def rolling(df: DataFrame, keys: list[str], columns: dict[str, tuple[Column, int, int]], t: str = "t", chunk: int | None = None) -> DataFrame:
    """Adds window aggregates over time ranges; columns: name -> (aggregate, from, to), both ends in seconds from the row
    and included. Work spreads over chunks of time, so one hot series is no bottleneck."""
    before = max(0, *(-lo for _, lo, _ in columns.values()))
    after = max(0, *(hi for _, _, hi in columns.values()))
    parts = with_halo(df, keys, before, after, chunk or max(4 * (before + after), 86400), t)
    by = Window.partitionBy(*keys, "_chunk").orderBy(t)
    added = {name: agg.over(by.rangeBetween(lo, hi)) for name, (agg, lo, hi) in columns.items()}
    return parts.withColumns(added).where("_core").drop("_chunk", "_core")


def complete(value: Column, count: Column, wanted: int) -> Column:
    """The value where the window holds as many valid rows as wanted, else null."""
    return F.when(count >= wanted, value)


def at_offset(column: str, offset: int) -> tuple[Column, int, int]:
    """The column's value at exactly t + offset, null if that bar is missing; for rolling()."""
    return F.max(column), offset, offset


def grid(df: DataFrame, keys: list[str], step: int, t: str = "t") -> DataFrame:
    """Every slot of each series from its first to its last bar, with ``present``."""
    span = df.groupBy(*keys).agg(F.min(t).alias("lo"), F.max(t).alias("hi"))
    slots = span.select(*keys, F.explode(F.sequence("lo", "hi", F.lit(step).cast("long"))).alias(t))
    return slots.join(df.withColumn("present", F.lit(True)), [*keys, t], "left").withColumn("present", F.coalesce("present", F.lit(False)))


def ordered(df: DataFrame, keys: list[str], columns: dict[str, tuple[str, str]], t: str = "t", chunk: int = 30 * 86400, dealt: bool = False) -> DataFrame:
    """Adds values of the row before or after in each series, whatever the gap; columns: name -> ("lag" or "lead", column).
    Rows are dealt into chunks of time once; a small table of the chunks' ends serves the rows at their edges. With
    ``dealt`` the chunk stays, as __chunk, for a prefix() that deals no rows anew."""
    own = df.withColumn("__chunk", F.floor(F.col(t) / chunk)).repartition(*keys, "__chunk")
    whole = F.struct(*dict.fromkeys(c for _, c in columns.values()))
    near = Window.partitionBy(*keys).orderBy("__chunk")
    ends = own.groupBy(*keys, "__chunk").agg(F.min_by(whole, t).alias("__first"), F.max_by(whole, t).alias("__last"))
    ends = ends.select(*keys, "__chunk", F.lag("__last").over(near).alias("__before"), F.lead("__first").over(near).alias("__after"))
    by = Window.partitionBy(*keys, "__chunk").orderBy(t)
    inner = {k: (F.lag if kind == "lag" else F.lead)(c).over(by) for k, (kind, c) in columns.items()}
    x = own.withColumns({"__head": F.lag(F.lit(1)).over(by).isNull(), "__tail": F.lead(F.lit(1)).over(by).isNull()} | inner).join(ends, [*keys, "__chunk"])
    edge = {k: F.when(F.col("__head"), F.col(f"__before.{c}")).otherwise(F.col(k)) if kind == "lag" else F.when(F.col("__tail"), F.col(f"__after.{c}")).otherwise(F.col(k)) for k, (kind, c) in columns.items()}
    return x.withColumns(edge).drop("__head", "__tail", "__before", "__after", *([] if dealt else ["__chunk"]))


def prefix(df: DataFrame, keys: list[str], columns: dict[str, tuple[str, str]], t: str = "t", chunk: int = 30 * 86400) -> DataFrame:
    """Adds running aggregates from the start of each series in two phases; columns: name -> (kind, column), kinds sum,
    max, count and last (last value that is not null). Rows are dealt into chunks of time once, or are by ordered(); chunks
    run by themselves, and a small table of their totals is carried over."""
    given = "__chunk" in df.columns
    own = df if given else df.withColumn("__chunk", F.floor(F.col(t) / chunk)).repartition(*keys, "__chunk")
    local = Window.partitionBy(*keys, "__chunk").orderBy(t).rowsBetween(Window.unboundedPreceding, 0)
    past = Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    run = {"sum": F.sum, "max": F.max, "count": F.count}
    totals, carried = [], []
    for name, (kind, c) in columns.items():
        if kind == "last":
            totals.append(F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(t))).alias(f"_{name}"))
            carried.append(F.last(f"_{name}", ignorenulls=True).over(past).alias(f"_{name}"))
        else:
            totals.append(run[kind](c).alias(f"_{name}"))
            carried.append((F.sum if kind == "count" else run[kind])(f"_{name}").over(past).alias(f"_{name}"))
    carry = own.groupBy(*keys, "__chunk").agg(*totals).select(*keys, "__chunk", *carried)
    x = own.withColumns({name: (F.last(c, ignorenulls=True) if kind == "last" else run[kind](c)).over(local) for name, (kind, c) in columns.items()})
    x = x.join(carry, [*keys, "__chunk"])
    merge = {"sum": lambda a, b: F.coalesce(a + b, a, b), "count": lambda a, b: a + F.coalesce(b, F.lit(0)), "max": lambda a, b: F.greatest(a, b), "last": lambda a, b: F.coalesce(a, b)}
    return x.withColumns({name: merge[kind](F.col(name), F.col(f"_{name}")) for name, (kind, _) in columns.items()}).drop("__chunk", *(f"_{n}" for n in columns))


def gaps(df: DataFrame, keys: list[str], step: int, t: str = "t") -> DataFrame:
    """One row per gap: last bar before it, first after it, and bars missing."""
    nxt = ordered(df.select(*keys, t), keys, {"resume": ("lead", t)}, t)
    return nxt.where(F.col("resume") > F.col(t) + step).select(*keys, F.col(t).alias("last_before"), "resume", ((F.col("resume") - F.col(t)).cast("long") / step - 1).cast("long").alias("missing"))
