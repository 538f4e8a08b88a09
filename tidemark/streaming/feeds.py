"""Structured Streaming over feeds of events: windowed counts with a watermark and book checks with keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor


def stream(spark: SparkSession, folder: str, pattern: str = "*.parquet", files: int = 100) -> DataFrame:
    """Closed files of a folder as a stream, with the schema of those there now."""
    schema = spark.read.option("pathGlobFilter", pattern).parquet(folder).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files).parquet(folder)


def counts(events: DataFrame, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events and value of each feed and tumbling window. In update and append mode, windows that end before the watermark are let
    go, and rows for them are left out; complete mode keeps all."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    w = timed.groupBy(F.window("ts", every), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,6)")).alias("q"))
    return w.select("event_type", F.unix_seconds("window.start").alias("t"), "n", F.col("q").cast("double").alias("total"))


#: What checked_books() takes: kind is book, ready or end; prev, seq and levels belong to book frames.
MESSAGE = "session long, frame_no long, kind string, prev long, seq long, levels int"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHECKED = "session long, frame_no long, status string, valid boolean"
_STATE = "next long, last long, valid boolean, readies int"


def judged(state: list, n: int, kind: str, prev: int | None, seq: int | None, levels: int | None) -> list[tuple[int, str, bool]]:
    """What one frame gives; state is [next number, last seq, whether the book is valid, ready frames so far]."""
    state[0] = n + 1
    if kind == "ready":
        state[3] += 1
        return [(n, "second_ready", False)] if state[3] > 1 else []
    if kind != "book":
        return []
    if prev == -1:
        status, state[2] = "snapshot", True
    elif not state[2] or prev != state[1] or (seq == prev and (levels or 0) > 0):
        status, state[2] = "gap", False
    else:
        status = "heartbeat" if seq == prev else "reset" if seq < prev else "update"
    state[1] = seq
    return [(n, status, state[2] and state[3] <= 1)]


class BookCheck(StatefulProcessor):
    """Judges a session's frames in order of their numbers. Frames ahead of a missing one wait in a map by number; the rest of
    the state is one row. Both go with an end frame, or once nothing has changed them for their time to live."""

    def __init__(self, first: int, patience_ms: int, ttl_ms: int):
        self.first, self.patience, self.ttl = first, patience_ms, ttl_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.at = handle.getValueState("at", _STATE, self.ttl)
        self.waiting = handle.getMapState("waiting", "frame_no long", "kind string, prev long, seq long, levels int", self.ttl)

    def run(self, key: tuple, fresh: dict[int, tuple], now: int, silent: bool) -> pd.DataFrame:
        """All frames that can be judged; after a silence, numbers that never came are passed over and break the sequence."""
        at = list(self.at.get()) if self.at.exists() else [self.first, None, False, 0]
        before = {int(k[0]): tuple(v) for k, v in self.waiting.iterator()} if self.waiting.exists() else {}
        held, out, ended = {n: v for n, v in (fresh | before).items() if n >= at[0]}, [], False
        for n in sorted(held):
            if n != at[0]:
                if not silent:
                    break
                at[2] = False
            kind, *rest = held.pop(n)
            out += judged(at, n, kind, *rest)
            if kind == "end":
                ended = True
                break
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if ended:
            self.at.clear()
            self.waiting.clear()
        else:
            self.at.update(tuple(at))
            for n in before.keys() - held.keys():
                self.waiting.removeKey((n,))
            for n in held.keys() - before.keys():
                self.waiting.updateValue((n,), held[n])
            if held:
                self.handle.registerTimer(now + self.patience)
        return pd.DataFrame([(key[0], *r) for r in out], columns=["session", "frame_no", "status", "valid"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        none = lambda x: None if pd.isna(x) else int(x)
        fresh = {}
        for pdf in rows:
            for r in pdf.itertuples():
                fresh.setdefault(int(r.frame_no), (r.kind, none(r.prev), none(r.seq), none(r.levels)))
        yield self.run(key, fresh, timerValues.getCurrentProcessingTimeInMs(), False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self.run(key, {}, timerValues.getCurrentProcessingTimeInMs(), True)

    def close(self) -> None:
        pass


def checked_books(messages: DataFrame, first: int = 1, patience_ms: int = 3_600_000, ttl_ms: int = 7 * 86_400_000) -> DataFrame:
    """(session, frame_no, status, valid) of the book frames of MESSAGE rows, as book_sequence() has them, in whatever batches and
    order they come: frames are numbered from ``first`` without a gap, and those ahead of a missing one wait in the session's
    state. After a second ready frame, which has a row of its own, nothing of a session is valid. Numbers that don't come
    within ``patience_ms`` are passed over as a gap. An end frame lets the session's state go, and so does silence for
    ``ttl_ms``. A number that comes again is left out. Needs the RocksDB state store, which run_available() sets."""
    return messages.groupBy("session").transformWithStateInPandas(BookCheck(first, patience_ms, ttl_ms), CHECKED, "Append", "ProcessingTime")


def run_available(result: DataFrame, table: str, checkpoint: str, mode: str = "append", keys: tuple[str, ...] = ()) -> DataFrame:
    """Process what has arrived into Parquet and stop; gives the rows that hold. In update mode each batch is written to a folder of
    its own, ``table``/batch=<n> (the same again if a batch is repeated after a crash), and of each key the last batch's
    row holds; state behind the watermark is let go."""
    spark = result.sparkSession

    def put(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={epoch}")

    writer = result.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    # timers ask for one batch after the other, and would never let it stop; maps of state need RocksDB
    own = {"spark.sql.streaming.noDataMicroBatches.enabled": "false", "spark.sql.streaming.stateStore.providerClass": ROCKS}
    before = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        query = writer.foreachBatch(put).start() if mode == "update" else writer.format("parquet").option("path", table).start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    query.awaitTermination()
    rows = spark.read.parquet(table)
    if mode != "update":
        return rows
    values = [c for c in result.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v")).select(*keys, "v.*")
