"""Structured Streaming forms of the periodic run."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators import dedup
from ..plans import pipeline
from ..schema import SOURCES, Params
from ..sources import history

ACCEPTED = "url string, row_id long, found_us long"
#: Rows of one key that are combined at a time.
CHUNK = 10_000
#: The state of a bucket should fit into a few MB: 4,096 do for 50 million URLs.
BUCKETS = 4_096
NEVER = np.iinfo(np.int64).min


class RollingWindow(StatefulProcessor):
    """Accepts a row of a URL if no accepted row is younger than the window. State: the
    instant (microseconds) of the last accepted row. Rows of one batch are taken in time
    order; a row older than the last accepted one never reopens its window.

    There are many URLs of few rows, so rows come as such, not as a pandas frame for each URL.
    Chunks of a batch are combined as they come: rows inside the last window go, of rows of one
    instant the least stays. With timers, state goes when the watermark has passed its window,
    after which it could refuse no row that is not late itself."""

    def __init__(self, days: int, timers: bool = False):
        self.gap, self.timers = max(1, days) * 86_400_000_000, timers

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "us long")

    def _until(self, us: int) -> int:
        """When the window of an accepted row has surely passed, in milliseconds."""
        return (us + self.gap) // 1000 + 1

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        state = self.last.get()
        old = None if state is None else state[0]
        us, ids = np.zeros(0, np.int64), np.zeros(0, np.int64)
        while chunk := [(r["found_us"], r["row_id"]) for r in islice(rows, CHUNK)]:
            new, new_ids = np.array(chunk, np.int64).T
            late = np.zeros(len(new), bool) if old is None else new < old + self.gap
            us, ids = np.concatenate([us, new[~late]]), np.concatenate([ids, new_ids[~late]])
            order = np.lexsort((ids, us))
            us, ids = us[order], ids[order]
            first = np.ones(len(us), bool)
            first[1:] = us[1:] != us[:-1]
            us, ids = us[first], ids[first]
        kept, at = [], 0
        while at < len(us):  # from one accepted row to the next
            kept.append(at)
            at = int(np.searchsorted(us, us[at] + self.gap))
        if kept:
            newest = int(us[kept[-1]])
            self.last.update((newest,))
            if self.timers:
                if old is not None:
                    self.handle.deleteTimer(self._until(old))
                self.handle.registerTimer(self._until(newest))
        return iter([Row(url=key[0], row_id=int(ids[k]), found_us=int(us[k])) for k in kept])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.last.clear()
        return iter([])

    def close(self) -> None:
        pass


class RollingBuckets(StatefulProcessor):
    """The same rule for many URLs of few rows: URLs are dealt to buckets, and the last accepted
    instants of a bucket are one value, read and written once a batch. All rows of a bucket go
    through one fold, so that no URL costs a frame or a call of its own."""

    def __init__(self, days: int):
        self.gap = max(1, days) * 86_400_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "urls array<string>, us array<long>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = self.last.get()
        old = {} if state is None else dict(zip(*state, strict=True))
        open_, more, waiting = None, [], 0

        def least() -> pd.DataFrame:
            """Of the rows of one URL and instant the least, in order."""
            f = pd.concat(more if open_ is None else [open_, *more], ignore_index=True)
            return f.sort_values(["url", "found_us", "row_id"]).drop_duplicates(["url", "found_us"])

        for f in rows:
            until = np.fromiter((old[u] + self.gap if u in old else NEVER for u in f["url"]), np.int64, len(f))
            more.append(f[f["found_us"].to_numpy(np.int64) >= until][["url", "row_id", "found_us"]])
            waiting += len(more[-1])
            if waiting >= max(CHUNK, 0 if open_ is None else len(open_)):
                open_, more, waiting = least(), [], 0
        open_ = least()
        found = pa.RecordBatch.from_arrays([pa.array(open_["url"], pa.string()), pa.array(open_["found_us"], pa.int64()), pa.array(np.arange(len(open_)))], ["url", "us", "at"])
        kept = [i for b in dedup.accepted(self.gap)(iter([found])) for i in b.column(0).to_pylist()]
        out = open_.iloc[kept]
        old |= zip(out["url"].tolist(), out["found_us"].tolist(), strict=True)  # the last of a URL stays
        if len(out):
            self.last.update((list(old), list(old.values())))
        yield out.reset_index(drop=True)

    def close(self) -> None:
        pass


def _timed(rows: DataFrame, at: str, order: str) -> DataFrame:
    timed = rows.select(F.trim("url").alias("url"), F.col(order).cast("long").alias("row_id"), F.col(at).cast("timestamp").alias("found"))
    return timed.withColumn("found_us", F.unix_micros("found")).where("url <> '' and found is not null")


def rolling_buckets(rows: DataFrame, days: int, at: str = "found_at", order: str = "row_id", buckets: int = BUCKETS) -> DataFrame:
    """Accepted rows of a stream of postings, as of rolling_stream without `late`. A batch reads
    and writes the state of each bucket that it touches whole; where batches are small and the
    state is large, rolling_stream, whose state is by URL, touches less."""
    keyed = _timed(rows, at, order).select(F.pmod(F.xxhash64("url"), F.lit(buckets)).alias("bucket"), "url", "row_id", "found_us")
    return keyed.groupBy("bucket").transformWithStateInPandas(RollingBuckets(days), ACCEPTED, "Append", "None")


def rolling_stream(rows: DataFrame, days: int, at: str = "found_at", order: str = "row_id", late: str | None = None) -> DataFrame:
    """Accepted rows of a stream of postings. Needs the RocksDB state store provider. With `late`
    ('2 days') rows may come that much behind the newest, older ones are dropped, and the state of
    a URL is removed once its window has passed; without it nothing is late and all state stays."""
    timed = _timed(rows, at, order)
    if late is None:
        return timed.drop("found").groupBy("url").transformWithState(RollingWindow(days), ACCEPTED, "Append", "None")
    return timed.withWatermark("found", late).groupBy("url").transformWithState(RollingWindow(days, True), ACCEPTED, "Append", "EventTime")


def progress_counts(events: DataFrame, at: str = "ts", kind: str = "event_type", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by window and type, on a stream (with a watermark) or on a table."""
    timed = events.withColumn("_at", F.col(at).cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("_at", late)
    return timed.groupBy(F.window("_at", window).alias("w"), F.col(kind).alias("event_type")).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def incremental(stream: DataFrame, step, checkpoint: str):
    """Run step(batch DataFrame, batch id) over all new files once, then stop."""
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def incremental_run(stream: DataFrame, path: str, params: Params, as_of: str, checkpoint: str):
    """The whole run over each batch of newly landed rows: filters, merge, rows unseen in the
    history's window, append. A batch that is retried leaves what it has written before out
    of the window and writes in its place, so nothing is stored twice."""
    def step(rows: DataFrame, batch_id: int) -> None:
        spark, batch = rows.sparkSession, f"stream-{batch_id}"
        known = {"": rows.where(F.col("source").isin(*SOURCES))}  # rows name their source, so one scan does
        stored = history.scan_other_batches(spark, path, batch)
        history.append(pipeline.run(known, stored, params, as_of), path, as_of, batch)

    return incremental(stream, step, checkpoint)
