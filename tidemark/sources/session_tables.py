"""One route from the lines of session files to typed tables. Whatever is no row of a table is in ``rejected`` with a reason, or in
``controls``; an account shows that nothing is lost, and publishing fails while anything is rejected.

Each payload is parsed once; items of a frame stay text until their channel's schema is known, so one bad item doesn't take
its neighbours along."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import landed
from .sinks import publish_shard

#: Fields of the items of each channel.
FIELDS = {
    "trades": "tradeId string, px string, sz string, side string, ts string",
    "bbo-tbt": "asks array<array<string>>, bids array<array<string>>, ts string",
    "books": "asks array<array<string>>, bids array<array<string>>, ts string, prevSeqId string, seqId string",
    "instruments": "instId string, tickSz string, lotSz string, ctVal string, state string",
}
TABLES = {"trades": "trades", "bbo-tbt": "quotes", "books": "book_messages", "instruments": "instruments"}
_AT = ["session_id", "frame_no", "received_at_ns", "idx", "inst"]


def _number(c: Column) -> Column:
    """A finite number, else null."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def _levels(side: Column) -> Column:
    return F.transform(side, lambda v: F.struct(_number(F.get(v, F.lit(0))).alias("price"), _number(F.get(v, F.lit(1))).alias("size")))


def _broken(levels: Column) -> Column:
    return F.exists(levels, lambda v: v["price"].isNull() | v["size"].isNull() | (v["price"] <= 0) | (v["size"] < 0))


def _first(**tests: Column) -> Column:
    """The first test that holds; a null one doesn't."""
    return F.coalesce(*(F.when(test, F.lit(reason)) for reason, test in tests.items()))


def framed(frames: DataFrame) -> DataFrame:
    """Typed frames with the fields of their payloads and their kind; each payload is read once."""
    p = F.from_json("payload", "event string, arg struct<channel: string, instId: string>, action string, data array<string>")
    x = frames.select("*", F.explode(F.array(p)).alias("p")).select("session_id", "frame_no", "received_at_ns", "payload", F.col("p.event").alias("event"), F.col("p.arg.channel").alias("channel"), F.col("p.arg.instId").alias("inst"), F.col("p.action").alias("action"), F.col("p.data").alias("data"))
    control = F.col("event").isin(*landed.CONTROL_EVENTS)
    pong = F.col("payload").isin("ping", "pong")
    kind = (
        F.when(control | pong, "control").when(F.col("event").isNotNull(), "unknown_event").when(F.col("channel").isNull(), "malformed")
        .when(~F.col("channel").isin(*FIELDS), "unknown_channel").when(F.col("data").isNull() | (F.size("data") == 0), "no_items").otherwise("data")
    )
    return x.withColumn("kind", kind)


def items(frames: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(items, controls, rejected) of typed frames: items of known channels as text, frames that hold none, and data frames
    without an array of items (no_items) or that can't be read (malformed)."""
    x = framed(frames)
    controls = x.where("kind in ('control', 'unknown_event', 'unknown_channel')").select("session_id", "frame_no", "received_at_ns", "kind", "event", "channel")
    rejected = x.where("kind in ('malformed', 'no_items')").select("session_id", "frame_no", F.lit(None).cast("int").alias("idx"), "channel", F.col("kind").alias("reason"))
    each = x.where("kind = 'data'").select("session_id", "frame_no", "received_at_ns", "channel", "inst", "action", F.posexplode("data").alias("idx", "item"))
    return each, controls, rejected


def _read(each: DataFrame, channel: str) -> DataFrame:
    x = each.where(F.col("channel") == channel).withColumn("d", F.from_json("item", FIELDS[channel]))
    return x.withColumn("d", F.when(F.col("item").rlike(r"^\s*\{"), F.col("d")))


def _judged(item: Column, channel: str) -> tuple[dict[str, Column], Column]:
    """The columns of a channel's item (a struct of its FIELDS) and the first reason against it, or null."""
    d = lambda k: item[k]
    if channel == "trades":
        named = {"trade_id": d("tradeId"), "px_raw": d("px"), "px": _number(d("px")), "sz": _number(d("sz")), "side": d("side"), "ts": d("ts").try_cast("long")}
        tests = {"no_trade_id": named["trade_id"].isNull() | (named["trade_id"] == ""), "bad_price": named["px"].isNull() | (named["px"] <= 0), "bad_size": named["sz"].isNull() | (named["sz"] < 0), "bad_side": ~F.coalesce(named["side"].isin("buy", "sell"), F.lit(False)), "bad_time": named["ts"].isNull() | (named["ts"] < 0)}
    elif channel == "bbo-tbt":
        bid, ask = (F.get(_levels(d(k)), 0) for k in ("bids", "asks"))
        named = {"bid": bid["price"], "bid_size": bid["size"], "ask": ask["price"], "ask_size": ask["size"], "ts": d("ts").try_cast("long")}
        tests = {"sides_missing": d("bids").isNull() | d("asks").isNull(), "both_sides_empty": (F.size(d("bids")) == 0) & (F.size(d("asks")) == 0), "bad_level": _broken(_levels(d("bids"))) | _broken(_levels(d("asks"))), "bad_time": named["ts"].isNull() | (named["ts"] < 0)}
    elif channel == "books":
        named = {"action": F.col("action"), "ts": d("ts").try_cast("long"), "prev": d("prevSeqId").try_cast("long"), "seq": d("seqId").try_cast("long"), "asks": _levels(d("asks")), "bids": _levels(d("bids"))}
        tests = {"no_action": ~F.coalesce(F.col("action").isin("snapshot", "update"), F.lit(False)), "sides_missing": d("bids").isNull() | d("asks").isNull(), "bad_sequence": named["prev"].isNull() | named["seq"].isNull() | (named["seq"] < 0), "bad_time": named["ts"].isNull() | (named["ts"] < 0), "bad_level": _broken(named["asks"]) | _broken(named["bids"])}
    else:
        named = {"id": d("instId"), "tick_size": _number(d("tickSz")), "lot_size": _number(d("lotSz")), "contract_value": _number(d("ctVal")), "state": d("state")}
        tests = {"no_instrument": named["id"].isNull() | (named["id"] == "")}
    return named, _first(not_an_object=item.isNull(), **tests)


def judged_items(each: DataFrame, channel: str) -> DataFrame:
    """Items of a channel as columns, with the first reason against each, or null."""
    named, reason = _judged(F.col("d"), channel)
    return _read(each, channel).select(*_AT, *(c.alias(k) for k, c in named.items()), reason.alias("reason"))


def fates(frames: DataFrame) -> DataFrame:
    """(channel, fate, levels) of each item, or of each frame that holds none, in one pass: kept, or the kind of control or reason
    that session_tables() gives it, and how many book levels are kept. Payloads and items are exploded as arrays of one, so
    that nothing reads them again."""
    x = framed(frames).select("channel", "action", "kind", F.posexplode_outer(F.when(F.col("kind") == "data", F.col("data"))).alias("idx", "item"))
    whole = F.col("item").rlike(r"^\s*\{")
    read = F.struct(*(F.when((F.col("kind") == "data") & (F.col("channel") == c) & whole, F.from_json("item", FIELDS[c])).alias(TABLES[c]) for c in FIELDS))
    x = x.select("channel", "action", "kind", F.explode(F.array(read)).alias("d"))
    reason, kept = F.lit(None).cast("string"), F.lit(0)
    for c in FIELDS:
        named, why = _judged(F.col(f"d.{TABLES[c]}"), c)
        reason = F.when(F.col("channel") == c, why).otherwise(reason)
        if c == "books":
            kept = F.when(F.col("channel") == c, F.size(named["asks"]) + F.size(named["bids"])).otherwise(kept)
    fate = F.when(F.col("kind") == "data", F.coalesce(reason, F.lit("kept"))).otherwise(F.col("kind"))
    x = x.select("channel", fate.alias("fate"), kept.alias("levels"))
    return x.withColumn("levels", F.when(F.col("fate") == "kept", F.col("levels")).otherwise(0))


def session_tables(frames: DataFrame) -> dict[str, DataFrame]:
    """trades, quotes, book_messages, book_levels, instruments and controls of typed frames (landed.frames()), and rejected:
    (session_id, frame_no, idx, channel, reason), idx null where a frame as a whole is meant."""
    each, controls, rejected = items(frames)
    out: dict[str, DataFrame] = {}
    for channel, table in TABLES.items():
        x = judged_items(each, channel)
        out[table] = x.where("reason is null").drop("reason")
        rejected = rejected.unionByName(x.where("reason is not null").select("session_id", "frame_no", "idx", F.lit(channel).alias("channel"), "reason"))
    sides = F.array(*(F.struct(F.lit(s).alias("side"), F.col(f"{s}s").alias("levels")) for s in ("ask", "bid")))
    level = out["book_messages"].select(*_AT, "action", F.explode(sides).alias("s")).select(*_AT, "action", "s.side", F.posexplode("s.levels").alias("level", "l"))
    out["book_levels"] = level.select(*_AT, "action", "side", "level", "l.price", "l.size")
    return out | {"controls": controls, "rejected": rejected}


def account(frames: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """(channel, items, kept, rejected) over all frames; items of a channel are those kept and those rejected one by one."""
    each = items(frames)[0].groupBy("channel").agg(F.count("*").alias("items"))
    kept = None
    for channel, table in TABLES.items():
        n = tables[table].agg(F.count("*").alias("kept")).select(F.lit(channel).alias("channel"), "kept")
        kept = n if kept is None else kept.unionByName(n)
    bad = tables["rejected"].where("idx is not null").groupBy("channel").agg(F.count("*").alias("rejected"))
    return kept.join(each, "channel", "left").join(bad, "channel", "left").select("channel", *(F.coalesce(k, F.lit(0)).alias(k) for k in ("items", "kept", "rejected")))


def publish(tables: dict[str, DataFrame], path: str, by: list[str]) -> dict[str, bool]:
    """Writes each table once, partitioned, and tells which were new. Anything rejected raises ValueError before a table is written."""
    worst = tables["rejected"].groupBy("channel", "reason").count().orderBy(F.desc("count")).limit(5).collect()
    if worst:
        raise ValueError("rejected: " + ", ".join(f"{r['count']} x {r.channel} {r.reason}" for r in worst))
    return {name: publish_shard(df, f"{path}/{name}", by) for name, df in tables.items() if name != "rejected"}
