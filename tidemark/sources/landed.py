"""Landed dumps: zipped CSV, JSON responses and session frames, normalised into typed tables with nothing dropped silently."""

from __future__ import annotations

import csv
import io
import zipfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KLINE = ["open_time", "open", "high", "low", "close", "volume", "close_time", "quote_volume", "trades", "taker_base", "taker_quote", "ignore"]


def zipped_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Rows of zip files with one CSV each, as text: (path, row_no, one string a column, problem). A header is told by a first
    cell that is not a number; blanks in quotes are empty, commas in quotes belong to the cell; rows with another
    number of cells have a problem."""

    def open_(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    names = [n for n in z.namelist() if n.endswith(".csv")]
                    lines = list(csv.reader(io.StringIO(z.read(names[0]).decode()))) if len(names) == 1 else []
                rows: list[list] = [[] for _ in range(3 + len(columns))]
                if len(names) != 1:
                    lines = [None]
                for k, line in enumerate(lines):
                    cells = None if line is None else [c.strip() for c in line]
                    if cells and k == 0 and not cells[0].lstrip("-").replace(".", "").isdigit():
                        continue
                    bad = f"{len(names)} csv files" if cells is None else None if len(cells) == len(columns) else f"{len(cells)} cells"
                    values = [None] * len(columns) if bad else [c or None for c in cells]
                    for r, v in zip(rows, [name, k, *values, bad], strict=True):
                        r.append(v)
                kinds = [pa.string(), pa.int64(), *[pa.string()] * (len(columns) + 1)]
                yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, kinds, strict=True)], names=["path", "row_no", *columns, "problem"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path", "content")
    return files.mapInArrow(open_, ", ".join(["path string", "row_no long", *(f"{c} string" for c in columns), "problem string"]))


def epoch_ms(raw: Column) -> Column:
    """Milliseconds of an epoch in milli- or microseconds (the latter only at a whole or last millisecond), else null."""
    x = raw.try_cast("long")
    micro = x > 10**14
    return F.when(~micro, x).when((x % 1000).isin(0, 999), F.floor(x / 1000))


def klines(rows: DataFrame, symbol: str, bar_ms: int = 300_000, close_time: str = "exact") -> tuple[DataFrame, DataFrame]:
    """Typed bars, and the rows that cannot be bars with a reason. ``close_time``: "exact" asks for the last millisecond of the
    bar, "last_trade" for any time within it."""
    number = lambda c: F.col(c).try_cast("double")
    x = rows.withColumns({"ts": epoch_ms(F.col("open_time")), "end": epoch_ms(F.col("close_time"))})
    reason = (
        F.coalesce(
            F.col("problem"),
            F.when(F.col("ts").isNull() | F.col("end").isNull(), "bad_time"),
            F.when(F.col("ts") % bar_ms != 0, "off_grid"),
            F.when(F.col("end") != F.col("ts") + bar_ms - 1 if close_time == "exact" else ~F.col("end").between(F.col("ts"), F.col("ts") + bar_ms - 1), "bad_close_time"),
            F.when(F.greatest(*(number(c).isNull().cast("int") for c in KLINE[1:6])) > 0, "bad_number"),
        )
    )
    x = x.withColumn("reason", reason)
    good = x.where("reason is null").select(F.lit(symbol).alias("symbol"), "ts", *(number(c).alias(c) for c in KLINE[1:6]), number("quote_volume").alias("volume_quote"), F.col("trades").try_cast("long").alias("trades"), number("taker_base").alias("taker_volume"), number("taker_quote").alias("taker_quote"), "path")
    return good, x.where("reason is not null").select("path", "row_no", "reason")


def period_of(path: Column) -> Column:
    """The month or day in a file's name."""
    return F.regexp_extract(path, r"(\d{4}-\d{2}(?:-\d{2})?)\.zip$", 1)


def owned_first(bars: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """One row a key, that of the file whose period has the row's time before others; and an account: rows, distinct rows,
    keys, conflicts (keys with different values)."""
    when = F.timestamp_millis("ts")
    period = period_of(F.col("path"))
    owns = (F.date_format(when, "yyyy-MM") == period) | (F.date_format(when, "yyyy-MM-dd") == period)
    values = [c for c in bars.columns if c not in [*keys, "path"]]
    x = bars.withColumn("_o", (~owns).cast("int"))
    one = x.groupBy(*keys).agg(F.min(F.struct("_o", "path", *values)).alias("_r"), F.count("*").alias("_n"), F.count_distinct(F.struct(*values)).alias("_d"))
    account = one.agg(F.sum("_n").alias("rows"), F.sum("_d").alias("distinct_rows"), F.count("*").alias("keys"), F.count_if(F.col("_d") > 1).alias("conflicts"))
    return one.select(*keys, "_r.path", *(f"_r.{c}" for c in values)), account


def candles(responses: DataFrame, symbol: str) -> DataFrame:
    """Confirmed candles of JSON responses {"data": [[ts, o, h, l, c, vol, .., quote, confirm], ..]}."""
    rows = responses.select(F.explode(F.from_json("body", "struct<data: array<array<string>>>")["data"]).alias("r"))
    at = lambda k: F.get("r", k)
    names = ["open", "high", "low", "close", "volume"]
    return rows.where(at(8) == "1").select(F.lit(symbol).alias("symbol"), at(0).cast("long").alias("ts"), *(at(k + 1).cast("double").alias(c) for k, c in enumerate(names)), at(7).cast("double").alias("volume_quote"))


def frames(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Session frames of JSON lines (column value, path): typed, and those that are malformed with a reason."""
    schema = "struct<schema_version:int, stream:string, session_id:string, frame_no:long, kind:string, received_at_ns:long, payload:string>"
    x = lines.withColumn("f", F.from_json("value", schema)).select("path", "value", "f.*")
    reason = F.when(F.col("frame_no").isNull() | F.col("session_id").isNull(), "bad_envelope").when(F.col("schema_version") != 1, "unknown_version").when(F.col("received_at_ns") <= 0, "bad_clock")
    x = x.withColumn("reason", reason)
    return x.where("reason is null").drop("reason", "value"), x.where("reason is not null").select("path", "value", "reason")


def trades(frame: DataFrame) -> DataFrame:
    """Trades of frames whose payload is {"arg": {"channel": "trades"}, "data": [{..}]}."""
    p = F.from_json("payload", "struct<arg: struct<channel:string, instId:string>, data: array<struct<px:string, sz:string, side:string, ts:string, tradeId:string>>>")
    x = frame.withColumn("p", p).where("p.arg.channel = 'trades'")
    return x.select("session_id", "frame_no", F.col("p.arg.instId").alias("inst"), F.posexplode("p.data").alias("data_idx", "d")).select("session_id", "frame_no", "data_idx", "inst", F.col("d.tradeId").alias("trade_id"), F.col("d.px").alias("px_raw"), F.col("d.px").try_cast("double").alias("px"), F.col("d.sz").try_cast("double").alias("sz"), "d.side", F.col("d.ts").try_cast("long").alias("ts"))


def book_levels(frame: DataFrame) -> DataFrame:
    """Levels of book frames: one row a side and level."""
    p = F.from_json("payload", "struct<arg: struct<channel:string, instId:string>, action:string, data: array<struct<asks: array<array<string>>, bids: array<array<string>>, seqId:long, prevSeqId:long>>>")
    x = frame.withColumn("p", p).where("p.arg.channel like 'books%'").select("session_id", "frame_no", "p.action", F.explode("p.data").alias("d"))
    sides = [x.select("session_id", "frame_no", "action", F.lit(s).alias("side"), F.posexplode(f"d.{s}s").alias("level", "l")) for s in ("ask", "bid")]
    return sides[0].union(sides[1]).select("session_id", "frame_no", "action", "side", "level", F.get("l", 0).try_cast("double").alias("price"), F.get("l", 1).try_cast("double").alias("size"))


def judged_book_messages(frame: DataFrame) -> DataFrame:
    """One row an item of book frames (session_id, frame_no, idx, action, event_ts_ms, prev, seq, ask_levels, bid_levels,
    is_heartbeat, is_reset, asks, bids, reason), or one with idx null where a frame as a whole has a reason. The payload is read
    once: it is exploded as an array of one, so that no filter reads it again."""
    item = "struct<asks: array<array<string>>, bids: array<array<string>>, seqId: string, prevSeqId: string, ts: string>"
    p = F.from_json("payload", f"struct<event: string, arg: struct<channel: string, instId: string>, action: string, data: array<{item}>>")
    x = frame.select("session_id", "frame_no", F.explode(F.array(p)).alias("p")).where("p.arg.channel = 'books' and p.event is null")
    known = F.col("p.action").isin("snapshot", "update")
    whole = F.when(~F.coalesce(known, F.lit(False)), "no_action").when(F.coalesce(F.size("p.data"), F.lit(0)) <= 0, "no_data")
    x = x.select("session_id", "frame_no", whole.alias("whole"), F.col("p.action").alias("action"), F.col("p.data").alias("data"))
    side = lambda c: F.transform(F.col(c), lambda v: F.struct(F.get(v, F.lit(0)).try_cast("double").alias("price"), F.get(v, F.lit(1)).try_cast("double").alias("size")))
    each = x.select("session_id", "frame_no", "action", "whole", F.posexplode_outer(F.when(F.col("whole").isNull(), F.col("data"))).alias("idx", "d"))
    each = each.select("session_id", "frame_no", "idx", "action", "whole", F.col("d.ts").try_cast("long").alias("event_ts_ms"), F.col("d.prevSeqId").try_cast("long").alias("prev"), F.col("d.seqId").try_cast("long").alias("seq"), side("d.asks").alias("asks"), side("d.bids").alias("bids"))
    wrong = lambda c: F.exists(c, lambda v: v["price"].isNull() | v["size"].isNull() | (v["price"] <= 0) | (v["size"] < 0))
    reason = (
        F.when(F.col("whole").isNotNull(), F.col("whole"))
        .when(F.col("asks").isNull() | F.col("bids").isNull(), "sides_missing")
        .when(F.col("prev").isNull() | F.col("seq").isNull() | (F.col("seq") < 0), "bad_sequence")
        .when(F.col("event_ts_ms").isNull(), "bad_time")
        .when(wrong("asks") | wrong("bids"), "bad_level")
    )
    same, empty = (F.col("action") == "update") & (F.col("seq") == F.col("prev")), (F.size("asks") == 0) & (F.size("bids") == 0)
    flags = {"ask_levels": F.size("asks"), "bid_levels": F.size("bids"), "is_heartbeat": same & empty, "is_reset": (F.col("action") == "update") & (F.col("seq") < F.col("prev")), "reason": reason}
    columns = ["session_id", "frame_no", "idx", "action", "event_ts_ms", "prev", "seq", "ask_levels", "bid_levels", "is_heartbeat", "is_reset", "asks", "bids", "reason"]
    return each.withColumns(flags).select(*columns)


def book_messages(frame: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Book frames as (good, bad). good: one row an item (session_id, frame_no, idx, action, event_ts_ms, prev, seq, ask_levels,
    bid_levels, is_heartbeat, is_reset, asks, bids), the last two arrays of price and size for book_states(). bad: (session_id,
    frame_no, idx, reason) of each frame or item that is malformed, with the first of: no_action, no_data, sides_missing,
    bad_sequence, bad_time, bad_level. Control frames with an event and other channels are in neither."""
    x = judged_book_messages(frame)
    return x.where("reason is null").drop("reason"), x.where("reason is not null").select("session_id", "frame_no", "idx", "reason")


def checksums(files: DataFrame, published: DataFrame) -> DataFrame:
    """(name, status) of binary files against published sha256: match, mismatch, absent or unpublished."""
    have = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha"))
    status = F.when(F.col("sha").isNull(), "absent").when(F.col("published").isNull(), "unpublished").when(F.col("sha") == F.col("published"), "match").otherwise("mismatch")
    return have.join(published.select("name", F.col("sha256").alias("published")), "name", "full").select("name", status.alias("status"))


def merge_new(old: DataFrame, new: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """The old rows and those new ones whose key is not there yet (one a key); and how many were added."""
    values = [c for c in old.columns if c not in keys]
    fresh = new.join(old, keys, "left_anti").groupBy(*keys).agg(F.min(F.struct(*values)).alias("_v")).select(*keys, "_v.*")
    return old.unionByName(fresh), fresh.agg(F.count("*").alias("added"))


def with_provenance(df: DataFrame, **constants: str) -> DataFrame:
    """The frame with constant columns that tell where it comes from, ahead of its own."""
    return df.select(*(F.lit(v).alias(k) for k, v in constants.items()), *(F.col(f"`{c}`") for c in df.columns if c not in constants))


def judged(rows: DataFrame, symbol: str, rules: list[tuple[str, Column]], columns: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Typed rows, and those that break a rule (reason, condition that must not hold; the first counts)."""
    reason = F.coalesce(*(F.when(broken, name) for name, broken in rules))
    x = rows.withColumn("reason", reason)
    return x.where("reason is null").select(F.lit(symbol).alias("symbol"), *(c.alias(k) for k, c in columns.items())), x.where("reason is not null")


def _number(c: str) -> Column:
    return F.col(c).try_cast("double")


def _time_rules(bar_ms: int) -> list[tuple[str, Column]]:
    ts = epoch_ms(F.col("open_time"))
    return [("bad_time", ts.isNull()), ("off_grid", ts % bar_ms != 0), ("bad_number", F.greatest(*(_number(c).isNull().cast("int") for c in KLINE[1:5])) > 0)]


def _prices(prefix: str) -> dict[str, Column]:
    return {"ts": epoch_ms(F.col("open_time"))} | {f"{prefix}_{c}": _number(c) for c in KLINE[1:5]} | {f"{prefix}_samples": F.col("trades").try_cast("long")}


def _flows(*names: str) -> Column:
    return F.greatest(*((F.coalesce(_number(c), F.lit(-1.0)) != 0).cast("int") for c in names)) > 0


def mark_price(rows: DataFrame, symbol: str, bar_ms: int = 300_000) -> tuple[DataFrame, DataFrame]:
    """Mark-price bars: columns of flow must be zero; stale bars (no samples) stay and are marked."""
    good, bad = judged(rows, symbol, [*_time_rules(bar_ms), ("flow_not_zero", _flows("volume", "quote_volume", "taker_base", "taker_quote"))], _prices("mark"))
    return good.withColumn("stale", F.coalesce(F.col("mark_samples") == 0, F.lit(False))), bad


def index_price(rows: DataFrame, symbol: str, bar_ms: int = 300_000) -> tuple[DataFrame, DataFrame]:
    """Index-price bars: all other columns must be zero, and prices positive."""
    rules = [*_time_rules(bar_ms), ("flow_not_zero", _flows("volume", "quote_volume", "taker_base", "taker_quote", "ignore")), ("not_positive", F.least(*(_number(c) for c in KLINE[1:5])) <= 0)]
    return judged(rows, symbol, rules, _prices("index"))


def premium_index(rows: DataFrame, symbol: str, bar_ms: int = 300_000) -> tuple[DataFrame, DataFrame]:
    """Premium bars of any sign; columns of flow are left out, samples stay."""
    return judged(rows, symbol, _time_rules(bar_ms), _prices("premium"))


def funding_events(rows: DataFrame, symbol: str) -> tuple[DataFrame, DataFrame]:
    """Settlements (calc_time, funding_interval_hours, last_funding_rate): the declared interval stays apart from any derived one."""
    ts, hours, rate = epoch_ms(F.col("calc_time")), F.col("funding_interval_hours").try_cast("double"), F.col("last_funding_rate").try_cast("double")
    return judged(rows, symbol, [("bad_time", ts.isNull()), ("bad_rate", rate.isNull()), ("bad_interval", hours.isNull() | (hours <= 0))], {"ts": ts, "funding_rate": rate, "declared_hours": hours})


def metrics_rows(rows: DataFrame, symbol: str, ratios: list[str]) -> tuple[DataFrame, DataFrame]:
    """Snapshots: times are naive UTC text, blanks are null, open interest must be there."""
    blank = lambda c: F.when(F.trim(F.col(c)) == "", None).otherwise(F.col(c))
    ts = F.unix_seconds(F.try_to_timestamp(F.col("create_time"), F.lit("yyyy-MM-dd HH:mm:ss"))) * 1000
    open_interest = blank("sum_open_interest").try_cast("double")
    odd = [(f"bad_{c}", blank(c).isNotNull() & blank(c).try_cast("double").isNull()) for c in ratios]
    return judged(rows, symbol, [("bad_time", ts.isNull()), ("other_symbol", F.col("symbol") != symbol), ("no_open_interest", open_interest.isNull()), *odd], {"ts": ts, "open_interest": open_interest} | {c: blank(c).try_cast("double") for c in ratios})


def rest_funding(rows: DataFrame, pages: DataFrame, span: int) -> DataFrame:
    """Settlements of a paged API (id, t, rate, mark_text) with the mark's status and the page (page, first_t, last_t) that
    holds their time; pages are joined by buckets of ``span`` seconds."""
    from ..functions.scalars import decimal_text_class
    from ..operators.joins import interval_join

    numbered = pages.select(F.lit(0).alias("k"), "page", "first_t", (F.col("last_t") + 1).alias("end_t"))
    paged = interval_join(numbered, rows.withColumn("k", F.lit(0)), ["k"], "first_t", "end_t", "t", span)
    held = paged.groupBy("id").agg(F.min("page").alias("page"), F.count("*").alias("pages"))
    status = decimal_text_class(F.col("mark_text"))
    x = rows.withColumns({"mark_status": status, "mark_price": F.when(status == "valid", F.col("mark_text").try_cast("double"))})
    return x.join(held, "id", "left").withColumn("pages", F.coalesce("pages", F.lit(0)))


def pages_audit(rows: DataFrame, by: list[str], first: int, last: int, seal: int, symbol: str) -> DataFrame:
    """What is wrong with landed pages: rows out of range, behind the seal, of other symbols, repeated ids, and pages that don't
    advance (rows: page, id, t, symbol)."""
    from pyspark.sql import Window

    page = rows.groupBy(*by, "page").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    back = page.withColumn("p", F.lag("hi").over(Window.partitionBy(*by).orderBy("page"))).groupBy(*by).agg(F.count_if(F.col("lo") <= F.col("p")).alias("not_advancing"))
    seen = rows.groupBy(*by, "id").agg(F.count("*").alias("n")).groupBy(*by).agg(F.count_if(F.col("n") > 1).alias("repeated_ids"))
    each = rows.groupBy(*by).agg(F.count("*").alias("rows"), F.count_if(~F.col("t").between(first, last)).alias("out_of_range"), F.count_if(F.col("t") >= seal).alias("sealed"), F.count_if(F.col("symbol") != symbol).alias("other_symbol"))
    return each.join(seen, by).join(back, by)


def archive_kind(first_record: Column) -> Column:
    """rest or ws of an archive, by its first record in JSON; null if it is neither."""
    has = lambda k: F.get_json_object(first_record, f"$.{k}").isNotNull()
    return F.when(has("endpoint"), "rest").when(has("frame_no"), "ws")


def flat_record(observation: DataFrame, array: str) -> DataFrame:
    """A nested observation as a flat record: the array's place is taken by its size and a digest of its items in order."""
    rest = [c for c in observation.columns if c != array]
    return observation.select(*rest, F.size(array).alias(f"{array}_count"), F.sha2(F.array_join(array, ","), 256).alias(f"{array}_sha256"))


def funding_objects(responses: DataFrame) -> DataFrame:
    """Settlements of JSON responses {"data": [{instId, fundingTime, fundingRate}, ..]}."""
    items = F.from_json("body", "struct<data: array<struct<instId:string, fundingTime:string, fundingRate:string>>>")["data"]
    return responses.select(F.explode(items).alias("r")).select(F.col("r.instId").alias("symbol"), F.col("r.fundingTime").try_cast("long").alias("ts"), F.col("r.fundingRate").try_cast("double").alias("funding_rate"))


def open_interest_arrays(responses: DataFrame, symbol: str) -> DataFrame:
    """Open interest of JSON responses {"data": [[ts, oi, oi_usd], ..]}."""
    rows = responses.select(F.explode(F.from_json("body", "struct<data: array<array<string>>>")["data"]).alias("r"))
    at = lambda k: F.get("r", k)
    return rows.select(F.lit(symbol).alias("symbol"), at(0).try_cast("long").alias("ts"), at(1).try_cast("double").alias("oi"), at(2).try_cast("double").alias("oi_usd"))


def bbo(frame: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Best quotes of frames whose payload is {"arg": {"channel": "bbo-tbt"}, "data": [{asks, bids, ts}]}; one side may be empty, a
    quote with both empty or an unreadable number is bad."""
    p = F.from_json("payload", "struct<arg: struct<channel:string, instId:string>, data: array<struct<asks: array<array<string>>, bids: array<array<string>>, ts:string>>>")
    x = frame.withColumn("p", p).where("p.arg.channel = 'bbo-tbt'").select("session_id", "frame_no", F.col("p.arg.instId").alias("inst"), F.posexplode("p.data").alias("data_idx", "d"))
    cell = lambda side, k: F.get(F.get(F.col(f"d.{side}"), 0), k)
    named = {"bid": cell("bids", 0), "bid_size": cell("bids", 1), "ask": cell("asks", 0), "ask_size": cell("asks", 1)}
    broken = F.greatest(*((c.isNotNull() & c.try_cast("double").isNull()).cast("int") for c in named.values())) > 0
    reason = F.when(named["bid"].isNull() & named["ask"].isNull(), "both_sides_empty").when(broken, "bad_number")
    x = x.select("session_id", "frame_no", "data_idx", "inst", *(c.try_cast("double").alias(k) for k, c in named.items()), F.col("d.ts").try_cast("long").alias("ts"), reason.alias("reason"))
    return x.where("reason is null").drop("reason"), x.where("reason is not null").select("session_id", "frame_no", "reason")


def instruments(frame: DataFrame) -> DataFrame:
    """Instrument metadata of frames, effective from when they were received."""
    p = F.from_json("payload", "struct<arg: struct<channel:string>, data: array<struct<instId:string, tickSz:string, lotSz:string, ctVal:string, state:string>>>")
    x = frame.withColumn("p", p).where("p.arg.channel = 'instruments'").select("session_id", "frame_no", "received_at_ns", F.explode("p.data").alias("d"))
    return x.select("session_id", "frame_no", F.col("received_at_ns").alias("effective_ns"), F.col("d.instId").alias("inst"), *(F.col(f"d.{a}").try_cast("double").alias(b) for a, b in (("tickSz", "tick_size"), ("lotSz", "lot_size"), ("ctVal", "contract_value"))), F.col("d.state").alias("state"), F.lit("ws").alias("origin"))


def rest_instruments(archives: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same table from REST archives (path, value: one record {endpoint, received_at_ns, body}); an archive that doesn't hold
    exactly one row is bad."""
    r = F.from_json("value", "struct<endpoint:string, received_at_ns:long, body: struct<data: array<struct<instId:string, tickSz:string, lotSz:string, ctVal:string, state:string>>>>")
    x = archives.withColumn("r", r)
    one = F.coalesce(F.size("r.body.data") == 1, F.lit(False))
    d = F.get(F.col("r.body.data"), 0)
    good = x.where(one).select(F.lit(None).cast("string").alias("session_id"), F.lit(None).cast("long").alias("frame_no"), F.col("r.received_at_ns").alias("effective_ns"), d["instId"].alias("inst"), *(d[a].try_cast("double").alias(b) for a, b in (("tickSz", "tick_size"), ("lotSz", "lot_size"), ("ctVal", "contract_value"))), d["state"].alias("state"), F.lit("rest").alias("origin"))
    return good, x.where(~one).select("path", F.coalesce(F.size("r.body.data"), F.lit(0)).alias("rows"))


#: Channels and events that frames may hold.
CHANNELS = ("trades", "bbo-tbt", "books", "books5", "instruments")
CONTROL_EVENTS = ("subscribe", "unsubscribe", "error", "channel-conn-count", "notice", "login")


def controls(frame: DataFrame) -> DataFrame:
    """Frames that hold no rows of a known channel, with what they are: control, unknown_event, unknown_channel or malformed."""
    event, channel = F.get_json_object("payload", "$.event"), F.get_json_object("payload", "$.arg.channel")
    kind = (
        F.when(event.isin(*CONTROL_EVENTS), "control")
        .when(event.isNotNull(), "unknown_event")
        .when(channel.isNull(), "malformed")
        .when(~channel.isin(*CHANNELS), "unknown_channel")
    )
    return frame.select("session_id", "frame_no", kind.alias("kind"), event.alias("event"), channel.alias("channel")).where("kind is not null")


def text_rows(rows: DataFrame, time: str, keys: list[str], columns: dict[str, str], cutoff_ms: int, bar_ms: int) -> DataFrame:
    """Rows by epoch with their cells as the source wrote them (name -> cell), for exact comparison later; rows at or behind the
    cutoff, off the grid or without a time are left out."""
    ts = epoch_ms(F.col(time))
    return rows.withColumn("ts", ts).where((F.col("ts") < cutoff_ms) & (F.col("ts") % bar_ms == 0)).select(*keys, "ts", *(F.col(c).alias(k) for k, c in columns.items()))
