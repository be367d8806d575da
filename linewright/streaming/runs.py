"""Streaming twins (an extension): counts by event time, and runs that collapse as records arrive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def density(events: DataFrame, by: list[str], time: str = "ts", every: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Records of each key and window of event time; what comes later than ``late`` is left out."""
    stamped = events.withColumn(time, F.col(time).cast("timestamp"))
    return stamped.withWatermark(time, late).groupBy(F.window(time, every), *by).agg(F.count("*").alias("n")).select(*by, F.col("window.start").alias("win_start"), "n")


def _collapse(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    value, length = state.get if state.exists else (None, 0)
    least = 3
    for frame in frames:
        kept = []
        for pos, text in frame.sort_values("pos")[["pos", "text"]].itertuples(index=False):
            length = length + 1 if text == value else 1
            value = text
            if length < least:
                kept.append((key[0], pos, text))
        yield pd.DataFrame(kept, columns=["track_id", "pos", "text"])
    state.update((value, length))


def collapse_runs(lines: DataFrame) -> DataFrame:
    """(track_id, pos, text): of a run of equal texts no more than the first two records pass.

    The batch operator drops the second record too once a third arrives; a
    stream that has already emitted it can't.
    """
    return lines.groupBy("track_id").applyInPandasWithState(_collapse, "track_id string, pos long, text string", "value string, length long", "append", GroupStateTimeout.NoTimeout)
