"""Order books rebuilt from snapshots and updates: the state at each message, depth near the middle, and its depletion.

A price's size holds until the next update of that price or the next snapshot; size 0 deletes it. Messages are dealt into
chunks by their number. What a chunk leaves behind is its last size a price since its last snapshot; each such level is
carried to the chunks up to the one that changes it or has a snapshot, so that a chunk starts from a whole book and all
run at once. A task holds one chunk and one book."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bars import rolling
from .sessions import book_sequence
from .store import stored

LEVELS = "array<struct<price:double,size:double>>"


def _carried(own: DataFrame, keys: list[str], t: str) -> DataFrame:
    """(keys..., _chunk, side, price, size): the book that each chunk but a series' first starts from."""
    by = Window.partitionBy(*keys).orderBy("_chunk")  # a row a chunk
    chunks = own.groupBy(*keys, "_chunk").agg(F.max(F.when(F.col("prev") == -1, F.col(t))).alias("_reset"))
    numbered = chunks.withColumns({"_i": F.row_number().over(by), "_ends": F.count("*").over(Window.partitionBy(*keys)), "_next": F.min(F.when(F.col("_reset").isNotNull(), F.col("_chunk"))).over(by.rowsBetween(1, Window.unboundedFollowing))})
    at = numbered.select(*keys, F.col("_chunk").alias("_next"), F.col("_i").alias("_next_i"))
    numbered = stored(numbered.join(at, [*keys, "_next"], "left").select(*keys, "_chunk", "_i", "_reset", F.coalesce("_next_i", "_ends").alias("_stop")))
    side = lambda name, column: F.transform(column, lambda x, i: F.struct(F.lit(name).alias("side"), x["price"].alias("price"), x["size"].alias("size"), i.alias("k")))
    levels = own.select(*keys, "_chunk", t, F.explode(F.concat(side("ask", "asks"), side("bid", "bids"))).alias("x")).select(*keys, "_chunk", t, "x.*")
    levels = levels.join(numbered, [*keys, "_chunk"]).where(F.col("_reset").isNull() | (F.col(t) >= F.col("_reset")))
    left = levels.groupBy(*keys, "_i", "_stop", "side", "price").agg(F.max_by("size", F.struct(t, "k")).alias("size"))
    changed = F.lead("_i").over(Window.partitionBy(*keys, "side", "price").orderBy("_i"))
    left = left.withColumn("_last", F.least(F.coalesce(changed, F.col("_stop")), F.col("_stop"))).where("size > 0 and _last > _i")
    reach = left.select(*keys, "side", "price", "size", F.explode(F.sequence(F.col("_i") + 1, F.col("_last"))).alias("_i"))
    return reach.join(numbered.select(*keys, "_chunk", "_i"), [*keys, "_i"]).select(*keys, "_chunk", "side", "price", "size").toDF(*keys, "_chunk", "side", "price", "size")


def replayed(messages: pd.DataFrame, start: pd.DataFrame, bps: float, t: str) -> pd.DataFrame:
    """The book after each message of one chunk, in order."""
    book: dict[str, dict[float, float]] = {"ask": {}, "bid": {}}
    for side, price, size in zip(start["side"], start["price"], start["size"], strict=True):
        book[side][price] = size
    out = []
    for m in messages.sort_values(t).itertuples():
        if m.prev == -1:
            book = {"ask": {}, "bid": {}}
        for side, levels in (("ask", m.asks), ("bid", m.bids)):
            for level in levels if levels is not None else ():
                if level["size"]:
                    book[side][level["price"]] = level["size"]
                else:
                    book[side].pop(level["price"], None)
        if not m.valid or not book["ask"] or not book["bid"]:
            out.append((None, None, None, None, len(book["ask"]) + len(book["bid"]) if m.valid else None))
            continue
        bid, ask = max(book["bid"]), min(book["ask"])
        middle = (bid + ask) / 2
        low, high = middle * (1 - bps / 10_000), middle * (1 + bps / 10_000)
        out.append((bid, ask, sum(p * s for p, s in book["bid"].items() if p >= low), sum(p * s for p, s in book["ask"].items() if p <= high), len(book["ask"]) + len(book["bid"])))
    return pd.DataFrame(out, columns=["bid", "ask", "bid_depth", "ask_depth", "levels_held"])


def book_states(messages: DataFrame, keys: list[str], bps: float = 10.0, t: str = "frame_no", chunk: int = 5000) -> DataFrame:
    """For each message (keys..., t, prev, seq, asks, bids; the last two arrays of price and size, null like empty): status and
    valid as book_sequence() has them, best bid and ask, the notional within ``bps`` of the middle on either side, and how
    many levels the book holds. Without a valid book all are null; with an empty side only the levels are given."""
    given = {"asks": F.coalesce(F.col("asks"), F.array().cast(LEVELS)), "bids": F.coalesce(F.col("bids"), F.array().cast(LEVELS))}
    slim = messages.select(*keys, t, "prev", "seq", *(v.cast(LEVELS).alias(k) for k, v in given.items()))
    checked = book_sequence(slim.withColumn("levels", F.size("asks") + F.size("bids")), keys, t)
    own = stored(checked.withColumn("_chunk", F.floor(F.col(t) / chunk)))
    kinds, names = dict(own.dtypes), [*keys, t, "status", "valid"]

    def replay(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values(t).reset_index(drop=True)
        return pd.concat([left[names], replayed(left, right, bps, t)], axis=1)

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in names), "bid double, ask double, bid_depth double, ask_depth double, levels_held long"])
    return own.groupBy(*keys, "_chunk").cogroup(_carried(own, keys, t).groupBy(*keys, "_chunk")).applyInPandas(replay, schema)


def net_depletion(depths: DataFrame, keys: list[str], step: int, far: int = 60, near: int = 5, t: str = "t") -> DataFrame:
    """Adds bid_short and ask_short, how far the depths (bid_depth, ask_depth on a grid of ``step``) fall below their medians from
    ``far`` to ``near`` steps before, and depletion, the ask's less the bid's. Null unless all those points are there."""
    window = lambda agg: (agg, -far * step, -near * step)
    x = rolling(depths, keys, {f"_{k}_{c}": window(f(c)) for c in ("bid_depth", "ask_depth") for k, f in (("m", lambda c: F.percentile(c, F.lit(0.5))), ("n", F.count))}, t)
    short: dict[str, Column] = {}
    for side in ("bid", "ask"):
        usual = F.when((F.col(f"_n_{side}_depth") == far - near + 1) & (F.col(f"_m_{side}_depth") > 0), F.col(f"_m_{side}_depth"))
        short[f"{side}_short"] = 1 - F.col(f"{side}_depth") / usual
    return x.withColumns(short).withColumn("depletion", F.col("ask_short") - F.col("bid_short")).drop(*(f"_{k}_{s}_depth" for k in "mn" for s in ("bid", "ask")))
