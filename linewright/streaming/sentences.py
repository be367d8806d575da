"""Sentences from a stream of captions, and late tasks that only fill what is missing.

Both run in ``transformWithState`` and need the RocksDB state store
(``spark.sql.streaming.stateStore.providerClass``).  Input is ordered by event time,
not by arrival: rows wait in state until the watermark has passed them, and timers
settle them.  Rows behind the watermark are left out by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.captions import _Sentence

#: The state store that these operators need (a fixed value of Spark).
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Sentences(StatefulProcessor):
    """Pending captions and the open segment of a track; a timer settles captions, a later one the track's end."""

    def __init__(self, idle_ms: int) -> None:
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", "pos long, start_ms long, end_ms long, text string")
        self.open = handle.getValueState("open", "start long, last long, text string, n long, number long, seen long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        latest = None
        for frame in rows:
            for pos, start, end, text in frame[["pos", "start_ms", "end_ms", "text"]].itertuples(index=False):
                self.pending.appendValue((int(pos), int(start), int(end), text))
                latest = int(start) if latest is None else max(latest, int(start))
        if latest is not None:
            self.handle.registerTimer(latest)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        time = expiredTimerInfo.getExpiryTimeInMs()
        held = sorted(self.pending.get(), key=lambda r: (r[1], r[0])) if self.pending.exists() else []
        ready, wait = [r for r in held if r[1] <= time], [r for r in held if r[1] > time]
        machine, number, seen = _Sentence(), 0, -1
        machine.begin(None)
        if self.open.exists():
            machine.start, machine.end, machine.text, machine.n, number, seen = self.open.get()
        out = []
        for _, start, end, text in ready:
            seen = max(seen, start)
            for cue in machine.take(start, end, text):
                number += 1
                out.append((key[0], number, *cue))
        if not ready and not wait and time >= seen + self.idle_ms:
            for cue in machine.finish():
                number += 1
                out.append((key[0], number, *cue))
            self.open.clear()
            self.pending.clear()
        elif ready:
            self.open.update((machine.start, machine.end, machine.text, machine.n, number, seen))
            if wait:
                self.pending.put(wait)
            else:
                self.pending.clear()
            self.handle.registerTimer(seen + self.idle_ms)
        if out:
            yield pd.DataFrame(out, columns=["track_id", "pos", "start_ms", "end_ms", "text"])


def sentence_segments(cues: DataFrame, late: str = "1 minute", idle_ms: int = 600_000) -> DataFrame:
    """(track_id, pos, start_ms, end_ms, text): the segments of the batch operator, in any order of arrival.

    ``cues`` has track_id, pos (which orders captions of one start), start_ms and
    end_ms (since 1970) and text.  A caption may come up to ``late`` after later
    ones.  A track that has been silent for ``idle_ms`` of event time gives its last
    segment and its state goes; what comes after that begins anew.
    """
    timed = cues.select("track_id", "pos", "start_ms", "end_ms", "text", F.timestamp_millis("start_ms").alias("at")).withWatermark("at", late)
    out = "track_id string, pos long, start_ms long, end_ms long, text string"
    return timed.groupBy("track_id").transformWithStateInPandas(statefulProcessor=_Sentences(idle_ms), outputStructType=out, outputMode="Append", timeMode="EventTime")


class _Filled(StatefulProcessor):
    """The value of a key and the task it came from, until a timer expires it."""

    def __init__(self, keep_ms: int) -> None:
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.given = handle.getValueState("given", "task long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        best = None
        for frame in rows:
            for task, text, at in frame[["task", "text", "at"]].itertuples(index=False):
                if text is not None and (best is None or (task, text) < best[:2]):
                    best = (int(task), text, at)
        if best is None or self.given.exists():
            return
        self.given.update((best[0],))
        stamp = best[2].tz_localize(UTC) if best[2].tzinfo is None else best[2]
        self.handle.registerTimer(int((stamp - datetime(1970, 1, 1, tzinfo=UTC)).total_seconds() * 1000) + self.keep_ms)
        yield pd.DataFrame([(*key, best[0], best[1])], columns=["job", "batch_num", "task", "text"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        self.given.clear()
        return iter(())


def fill_missing(results: DataFrame, late: str = "1 hour", keep_ms: int = 86_400_000) -> DataFrame:
    """(job, batch_num, task, text): the first result that arrives for each key; later tasks fill only absent keys.

    ``results`` has job, batch_num, task, text and the time ``at``.  Within a
    micro-batch the earliest task counts; null texts fill nothing.  A key is
    forgotten ``keep_ms`` of event time after its result.
    """
    timed = results.select("job", "batch_num", "task", "text", F.col("at").cast("timestamp").alias("at")).withWatermark("at", late)
    return timed.groupBy("job", "batch_num").transformWithStateInPandas(statefulProcessor=_Filled(keep_ms), outputStructType="job string, batch_num long, task long, text string", outputMode="Append", timeMode="EventTime")
