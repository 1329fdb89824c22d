"""Sliding-window admission: batch and streaming forms that agree.

``admission_stream`` decides events as they come and needs them in time order. ``admission_event_time`` takes them
in any order within a delay: a buffer per key holds them until the watermark has passed, an event-time timer per key
releases them in time order, and the same timer drops the state of a key once nothing in it can matter.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.streaming import StatefulProcessor

from docweave.runtime import broadcast_if_small, materialize, ranked

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# Rounds in which chunks settle side by side; after them the rest of a key is walked.
SETTLING_ROUNDS = 2
OUTPUT = "event_id long, key long, at_us long, admitted boolean, retry_after_s double, late boolean"


def admit(times, limit: int, window_us: int, held: deque) -> list[tuple[bool, float]]:
    """Decisions for rising times of one key; ``held`` keeps the admitted times still in the window.

    Rejected events do not count. The state never exceeds ``limit`` entries.
    """
    decisions = []
    for at in times:
        while held and held[0] <= at - window_us:
            held.popleft()
        if len(held) >= limit:
            decisions.append((False, (held[0] + window_us - at) / 1e6))
        else:
            held.append(at)
            decisions.append((True, 0.0))
    return decisions


def segments(events: DataFrame, window_us: int) -> DataFrame:
    """Adds ``segment``: runs of a key that no event-free window separates.

    Events more than one window apart cannot affect each other, so a hot key splits into independent
    segments. Only the distinct (key, window bucket) pairs are ordered, never the events.
    """
    bucket = F.floor(F.col("at_us") / window_us)
    placed = events.withColumn("_bucket", bucket)
    order = Window.partitionBy("key").orderBy("_bucket")
    # A whole empty bucket between two buckets is a gap of at least one window.
    gap = F.col("_bucket") - F.lag("_bucket").over(order) > 1
    runs = placed.select("key", "_bucket").distinct().withColumn("_new", F.coalesce(gap, F.lit(True)).cast("int"))
    runs = runs.withColumn("segment", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return placed.join(runs.select("key", "_bucket", "segment"), ["key", "_bucket"]).drop("_bucket")


def admission_batch(events: DataFrame, limit: int, window_s: int) -> DataFrame:
    """Admission of (event_id, key, at_us) events; equal times are taken in event order.

    Sorted partitions are read as a stream of batches with a state of at most ``limit`` times, so no
    segment is gathered in memory.
    """
    window_us = window_s * 1_000_000
    ordered = (segments(events.select("event_id", "key", "at_us"), window_us)
               .repartition("key", "segment").sortWithinPartitions("key", "segment", "at_us", "event_id"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, held = None, deque()
        for batch in batches:
            if not len(batch):
                continue
            runs = batch[["key", "segment"]].to_numpy()
            heads = np.flatnonzero(np.r_[True, (runs[1:] != runs[:-1]).any(axis=1)])
            times, out = batch["at_us"].tolist(), []
            for start, stop in zip(heads, [*heads[1:], len(runs)]):
                # The first run of a batch may go on from the one before.
                if tuple(runs[start]) != current:
                    current, held = tuple(runs[start]), deque()
                out.extend(admit(times[start:stop], limit, window_us, held))
            yield batch[["event_id", "key", "at_us"]].assign(admitted=[d[0] for d in out], retry_after_s=[d[1] for d in out], late=False)

    return ordered.mapInPandas(run, OUTPUT)


def chunked(events: DataFrame, chunk_rows: int, window_us: int) -> DataFrame:
    """Adds ``chunk``: consecutive events of a key and segment, no more than ``chunk_rows``; events are numbered per quarter of a window."""
    quarter = F.floor(F.col("at_us") / max(1, window_us // 4))
    numbered = ranked(events, ["key", "segment"], quarter, ["at_us", "event_id"])
    return numbered.withColumn("chunk", F.floor((F.col("rank") - 1) / chunk_rows)).drop("rank")


def left_behind(times: np.ndarray, limit: int, window_us: int, held: list[int]) -> list[int]:
    """The admitted times that sorted ``times`` leave behind; rejected events are jumped over, not visited."""
    place = 0
    while place < len(times):
        if len(held) >= limit:
            place = max(place, int(np.searchsorted(times, held[0] + window_us, "left")))
            if place >= len(times):
                break
        at = int(times[place])
        held = [*(h for h in held if h > at - window_us), at]
        place += 1
    return held


def walked(wrong: DataFrame, placed: DataFrame, limit: int, window_us: int) -> DataFrame:
    """(key, segment, chunk, entry) from the first wrong chunk of every segment on, whose entry is the true one.

    Chunks send only their sorted times, an array each. The chunks of a segment are read one after the other as a stream
    with a state of ``limit`` times, because each starts where the one before ended.
    """
    begun = materialize(wrong.groupBy("key", "segment").agg(F.min("chunk").alias("_first"), F.min_by("entry", "chunk").alias("_entry")))
    rest = placed.join(broadcast_if_small(begun), ["key", "segment"]).where(F.col("chunk") >= F.col("_first"))
    times = rest.groupBy("key", "segment", "chunk").agg(
        F.array_sort(F.collect_list("at_us")).alias("times"), F.first(F.when(F.col("chunk") == F.col("_first"), F.col("_entry"))).alias("_entry"))
    ordered = times.repartition("key", "segment").sortWithinPartitions("key", "segment", "chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            entries = []
            for times, entry in zip(batch.column("times"), batch.column("_entry")):
                times = times.values.to_numpy()
                if entry.is_valid:
                    held = entry.as_py()
                entries.append([h for h in held if h > times[0] - window_us])
                held = left_behind(times, limit, window_us, entries[-1])
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("key", "segment", "chunk")), pa.array(entries, pa.list_(pa.int64()))],
                                             names=["key", "segment", "chunk", "entry"])

    return ordered.mapInArrow(run, "key long, segment long, chunk long, entry array<long>")


def admission_dense(events: DataFrame, limit: int, window_s: int, chunk_rows: int = 50_000) -> DataFrame:
    """``admission_batch`` for keys without event-free windows, spread over many tasks.

    A decision depends on those before it, so chunks of a key start from an assumed state: first all run from an
    empty one, then each takes the state in which the chunk before it ended and runs again if that differs from
    what it had assumed. Once no chunk differs every one started from its true state, and a last pass decides. Chunks
    soon forget how they started unless the limit binds without a pause; what two such rounds leave open is
    walked once, over the times alone, so the number of rounds does not grow with the chunks.
    """
    window_us = window_s * 1_000_000
    placed = materialize(chunked(segments(events.select("event_id", "key", "at_us"), window_us), chunk_rows, window_us))
    keys = ["key", "segment", "chunk"]

    def passed(entries: DataFrame, rows: DataFrame, decide: bool) -> DataFrame:
        """One pass of the chunks of ``entries``: their decisions, or the state in which they end."""
        def run(state: pd.DataFrame, batch: pd.DataFrame) -> pd.DataFrame:
            batch = batch.sort_values(["at_us", "event_id"])
            held = deque(int(at) for at in state["entry"].iloc[0]) if len(state) else deque()
            decisions = admit(batch["at_us"].tolist(), limit, window_us, held)
            if decide:
                return batch[["event_id", "key", "at_us"]].assign(admitted=[d[0] for d in decisions], retry_after_s=[d[1] for d in decisions], late=False)
            return batch[keys].iloc[:1].assign(ended=[list(held)])

        schema = OUTPUT if decide else "key long, segment long, chunk long, ended array<long>"
        return entries.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInPandas(run, schema)

    before = Window.partitionBy("key", "segment").orderBy("chunk")
    starts = materialize(placed.groupBy(*keys).agg(F.min("at_us").alias("first_at")))
    entries = starts.withColumn("entry", F.array().cast("array<bigint>"))
    ends = materialize(passed(entries, placed, False))
    for number in count():
        # What the chunk before left behind, as far as it still counts at the first event.
        left = F.coalesce(F.lag("ended").over(before), F.array().cast("array<bigint>"))
        follow = starts.join(ends, keys).withColumn("left", left).select(
            *keys, F.filter("left", lambda at: at > F.col("first_at") - window_us).alias("left"))
        compared = materialize(entries.join(follow, keys))
        wrong = compared.where("left <> entry").select(*keys, F.col("left").alias("entry"))
        if not wrong.limit(1).count():
            return passed(entries, placed, True)
        if number == SETTLING_ROUNDS:
            true = materialize(walked(wrong, placed, limit, window_us))
            return passed(entries.select(*keys, "entry").join(true, keys, "left_anti").unionByName(true), placed, True)
        again = passed(wrong, placed.join(broadcast_if_small(wrong.select(*keys)), keys, "left_semi"), False)
        ends = materialize(ends.join(wrong, keys, "left_anti").unionByName(again))
        entries = materialize(compared.select(*keys, F.col("left").alias("entry")).join(starts, keys))


class AdmissionProcessor(StatefulProcessor):
    """Keeps the admitted times of a key; events behind the last seen time of their key come out as late and are not decided."""

    def __init__(self, limit: int, window_s: int):
        self.limit, self.window_us = limit, window_s * 1_000_000

    def init(self, handle) -> None:
        self.admitted = handle.getListState("admitted", "at_us long")
        self.last = handle.getValueState("last", "at_us long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True).sort_values(["at_us", "event_id"])
        held = deque(value[0] for value in self.admitted.get()) if self.admitted.exists() else deque()
        last = self.last.get()[0] if self.last.exists() else None
        late = batch[batch["at_us"] < last] if last is not None else batch.iloc[:0]
        if len(late):
            yield late[["event_id", "key", "at_us"]].astype("int64").assign(admitted=False, retry_after_s=np.nan, late=True)
        batch = batch.drop(late.index)
        if len(batch):
            decisions = admit(batch["at_us"].tolist(), self.limit, self.window_us, held)
            self.admitted.put([(int(at),) for at in held])
            self.last.update((int(batch["at_us"].iloc[-1]),))
            yield pd.DataFrame({
                "event_id": batch["event_id"].astype("int64"), "key": batch["key"].astype("int64"), "at_us": batch["at_us"].astype("int64"),
                "admitted": [d[0] for d in decisions], "retry_after_s": [d[1] for d in decisions], "late": False})

    def close(self) -> None:
        pass


def admission_stream(events: DataFrame, limit: int, window_s: int) -> DataFrame:
    """Streaming form; the source must deliver each key's events in time order."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return events.select("event_id", "key", "at_us").groupBy("key").transformWithStateInPandas(
        statefulProcessor=AdmissionProcessor(limit, window_s), outputStructType=OUTPUT, outputMode="Append", timeMode="None")


class EventTimeAdmission(StatefulProcessor):
    """Buffer, admitted times and one timer per key.

    The timer stands at the earliest buffered event while there is one, else at the end of the last admitted
    event's window, when the key's state goes. Events behind the watermark broke the promise of the delay: they come
    out as late, undecided, and do not count.
    """

    def __init__(self, limit: int, window_s: int):
        self.limit, self.window_us = limit, window_s * 1_000_000

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at_us long, event_id long")
        self.admitted = handle.getListState("admitted", "at_us long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        passed_us = timerValues.getCurrentWatermarkInMs() * 1000
        early = None
        for batch in rows:
            late = batch["at_us"] < passed_us
            if late.any():
                gone = batch.loc[late, ["event_id", "key", "at_us"]].astype("int64")
                yield gone.assign(admitted=False, retry_after_s=np.nan, late=True)
            kept = batch.loc[~late]
            if len(kept):
                self.waiting.appendList(list(zip(kept["at_us"].astype(int).tolist(), kept["event_id"].astype(int).tolist())))
                first = int(kept["at_us"].min())
                early = first if early is None else min(early, first)
        if early is not None:
            self.wake(early)

    def wake(self, at_us: int) -> None:
        """Fire once the watermark is past this time, unless an earlier timer stands; the later one goes."""
        wanted, standing = at_us // 1000 + 1, list(self.handle.listTimers())
        if standing and min(standing) <= wanted:
            return
        for timer in standing:
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(wanted)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed_us = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted((int(at), int(event)) for at, event in self.waiting.get()) if self.waiting.exists() else []
        ready = [event for event in waiting if event[0] < passed_us]
        rest = waiting[len(ready):]
        held = deque(int(row[0]) for row in self.admitted.get()) if self.admitted.exists() else deque()
        if ready:
            decisions = admit([at for at, _ in ready], self.limit, self.window_us, held)
            yield pd.DataFrame({
                "event_id": [event for _, event in ready], "key": [int(key[0])] * len(ready), "at_us": [at for at, _ in ready],
                "admitted": [d[0] for d in decisions], "retry_after_s": [d[1] for d in decisions], "late": False})
        # Undecided events are not before the watermark, so times a window older can no longer matter.
        while held and held[0] <= passed_us - self.window_us:
            held.popleft()
        for state, rows in ((self.waiting, rest), (self.admitted, [(at,) for at in held])):
            if rows:
                state.put(rows)
            else:
                state.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if rest:
            self.handle.registerTimer(rest[0][0] // 1000 + 1)
        elif held:
            self.handle.registerTimer((held[-1] + self.window_us) // 1000 + 1)

    def close(self) -> None:
        pass


def admission_event_time(events: DataFrame, limit: int, window_s: int, delay_s: int) -> DataFrame:
    """Streaming form for events in any order within ``delay_s``: same decisions as ``admission_batch``.

    Results follow the watermark; what is still within the delay when a source ends stays in the state.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    timed = events.select("event_id", "key", "at_us", F.timestamp_micros("at_us").alias("at")).withWatermark("at", f"{delay_s} seconds")
    # The time column stays behind, so the watermark moves but late rows arrive and can be marked.
    return timed.drop("at").groupBy("key").transformWithStateInPandas(
        statefulProcessor=EventTimeAdmission(limit, window_s), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime")
