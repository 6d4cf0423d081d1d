"""Cumulative counters of sessions as they stream in, in any order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: List states and timers need this store.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: The group of rows without a session.
NO_SESSION = -1


def held_type(counters: tuple[str, ...]):
    """A held row: its place, and of each counter the total and the value given, if they are there."""
    values = [(f"{kind}_{c}", x) for c in counters for kind, x in (("total", "<i8"), ("has_total", "?"), ("last", "<i8"), ("has_last", "?"))]
    return np.dtype([("session_id", "<i8"), ("seq", "<i8"), ("us", "<i8"), *values])


def seen_type(counters: tuple[str, ...]):
    """What the last row given out of a session left behind: its time and the totals."""
    return np.dtype([("session_id", "<i8"), ("ms", "<i8"), *((c, "<i8") for c in counters)])


def heads_of(rows: np.ndarray) -> np.ndarray:
    """Where each session starts in sorted rows."""
    ids = rows["session_id"]
    return np.flatnonzero(np.append(True, ids[1:] != ids[:-1])) if len(ids) else np.zeros(0, "int64")


def split_ready(held: np.ndarray, mark: int) -> tuple[np.ndarray, np.ndarray]:
    """(ready, rest) of held rows, sorted by session and `seq`: ready are those that the watermark has passed, they and all before them in their session."""
    held = held[np.lexsort((held["us"], held["seq"], held["session_id"]))]
    waits = held["us"] // 1000 > mark
    heads, waiting = heads_of(held), np.cumsum(waits)
    before = np.repeat(waiting[heads] - waits[heads], np.diff(np.append(heads, len(held))))
    ready = waiting == before
    return held[ready], held[~ready]


def deltas_of(ready: np.ndarray, seen: np.ndarray, counters: tuple[str, ...], wait: int) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """(values by counter, what was seen after) of sorted rows: a value as given, else the total less the last one before it, 0 after a pause of more than `wait` ms. `seen` is sorted by session."""
    if not len(ready):
        return {c: np.zeros(0, "int64") for c in counters}, seen
    heads, at, ms = heads_of(ready), np.arange(len(ready)), ready["us"] // 1000
    lengths = np.diff(np.append(heads, len(ready)))
    ids, ends, of = ready["session_id"][heads], heads + lengths - 1, np.repeat(np.arange(len(heads)), lengths)
    old = seen[np.minimum(np.searchsorted(seen["session_id"], ids), len(seen) - 1)] if len(seen) else np.zeros(len(heads), seen.dtype)
    known = old["session_id"] == ids if len(seen) else np.zeros(len(heads), bool)
    # The newest time of a session up to each row: ranks of times that rise from session to session, so that one running maximum does for all.
    newest = np.maximum(ms, np.where(known, old["ms"], ms[heads])[of])
    times, rank = np.unique(newest, return_inverse=True)
    newest = times[np.maximum.accumulate(of * len(times) + rank) - of * len(times)]
    paused = np.append(False, ms[1:] > newest[:-1] + wait)
    paused[heads] = known & (ms[heads] > old["ms"] + wait)
    # The row from which on totals count: that after the last pause, else the session's first.
    head = heads[of]
    start = np.maximum(np.maximum.accumulate(np.where(paused, at, 0)), head)
    after = np.zeros(len(heads), seen.dtype)
    after["session_id"], after["ms"] = ids, newest[ends]
    values = {}
    for c in counters:
        total, has = ready[f"total_{c}"], ready[f"has_total_{c}"]
        none = np.where(paused[start], 0, np.where(known, old[c], 0)[of])
        last = np.maximum.accumulate(np.where(has, at, -1))
        prior = np.append(-1, last[:-1])
        before = np.where(prior >= start, total[prior], none)
        values[c] = np.where(ready[f"has_last_{c}"], ready[f"last_{c}"], np.where(has, np.maximum(0, total - before), 0))
        after[c] = np.where(last >= start, total[last], none)[ends]
    after = np.concatenate([seen[~np.isin(seen["session_id"], ids)], after])
    return values, after[np.argsort(after["session_id"])]


class Deltas(StatefulProcessor):
    """Holds the rows of a group of sessions until the watermark has passed them and all before them in their session, then gives them out in order of `seq`.

    State: the rows held, as a block of each batch, and the totals that each session's last row given out left behind. A
    session goes when the watermark is `wait` ms past its last row and none is held. All sessions of a group are worked on at
    once, as a look at the state is a message to the JVM, too dear for each session.
    """

    def __init__(self, counters: tuple[str, ...], wait: int):
        self.counters, self.wait = counters, wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "rows binary")
        self.seen = handle.getValueState("seen", "rows binary")
        self.due = handle.getValueState("due", "ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        # Rows that come are newer than the watermark; those that are due go out with the timer.
        first = None
        for frame in rows:
            block = np.zeros(len(frame), held_type(self.counters))
            block["us"] = frame["ts"].to_numpy("datetime64[us]").astype("int64")
            for name in block.dtype.names:
                if name != "us":
                    block[name] = frame[name].to_numpy()
            if len(block):
                self.held.appendValue((block.tobytes(),))
                low = int(block["us"].min()) // 1000 - 1
                first = low if first is None else min(first, low)
        if first is not None:
            self._wake(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        import pandas as pd

        mark = timerValues.getCurrentWatermarkInMs()
        kind, left = held_type(self.counters), seen_type(self.counters)
        held = np.concatenate([np.zeros(0, kind), *(np.frombuffer(x[0], kind) for x in self.held.get())])
        stored = self.seen.get()
        seen = np.frombuffer(stored[0], left) if stored is not None else np.zeros(0, left)
        ready, rest = split_ready(held, mark)
        values, seen = deltas_of(ready, seen, self.counters, self.wait)
        seen = seen[(seen["ms"] + self.wait > mark) | np.isin(seen["session_id"], rest["session_id"])]
        if len(rest):
            self.held.put([(rest.tobytes(),)])
        else:
            self.held.clear()
        if len(seen):
            self.seen.update((seen.tobytes(),))
        else:
            self.seen.clear()
        self.due.clear()
        if len(rest):
            # The first of a session's rows that the watermark hasn't passed is what it waits for.
            waits = rest["us"] // 1000
            self._wake(int(waits[waits > mark].min()) - 1)
        elif len(seen):
            self._wake(int(seen["ms"].max()) + self.wait)
        if len(ready):
            ids = pd.array(ready["session_id"], "Int64")
            if key[0] == NO_SESSION:
                ids[:] = pd.NA
            yield pd.DataFrame({"session_id": ids, "seq": ready["seq"], "ts": ready["us"].astype("datetime64[us]"), **values})

    def _wake(self, ms: int) -> None:
        """One timer at a time, the earliest asked for. It goes off when the watermark is past it."""
        due = self.due.get()
        if due is not None and due[0] <= ms:
            return
        if due is not None:
            self.handle.deleteTimer(due[0])
        self.handle.registerTimer(ms)
        self.due.update((ms,))

    def close(self) -> None:
        pass


def stream_delta(events: DataFrame, counters: tuple[str, ...] = ("input_tokens",), late: str = "1 hour", idle: str = "1 day", groups: int = 256) -> DataFrame:
    """(session_id, seq, ts, counters) from cumulative logs with total_<c> and last_<c>: as given in `last_<c>`, else the total less the one of the row before by `seq`, 0 at least.

    Rows may come in any order, in any batches, as long as they are no more than `late` behind the newest; later ones are
    dropped. A session's times rise with its `seq`. A row is given out once the watermark has passed it, so at the end of
    a stream the last rows wait for a newer one. A session that goes on more than `idle` after its last row starts from 0
    again. State is kept by `groups` of sessions, dealt by hash; the rows that a group holds must fit a task, so more rows
    need more groups, and a stream keeps their number. Sets the session's state store to RocksDB.
    """
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    wait = int(spark.range(1).select(F.expr(f"unix_millis(timestamp_seconds(0) + interval {idle})")).first()[0])
    # Without nulls, as pandas makes floats of longs with nulls.
    group = F.when(F.col("session_id").isNull(), NO_SESSION).otherwise(F.pmod(F.xxhash64("session_id"), F.lit(groups))).cast("int")
    session = [group.alias("group"), F.coalesce("session_id", F.lit(0)).cast("long").alias("session_id")]
    values = [x for c in counters for kind in ("total", "last") for x in (F.coalesce(f"{kind}_{c}", F.lit(0)).cast("long").alias(f"{kind}_{c}"), F.col(f"{kind}_{c}").isNotNull().alias(f"has_{kind}_{c}"))]
    needed = events.withWatermark("ts", late).select(*session, F.col("seq").cast("long").alias("seq"), "ts", *values)
    made = "session_id long, seq long, ts timestamp, " + ", ".join(f"{c} long" for c in counters)
    return needed.groupBy("group").transformWithStateInPandas(statefulProcessor=Deltas(tuple(counters), wait), outputStructType=made, outputMode="Append", timeMode="EventTime")
