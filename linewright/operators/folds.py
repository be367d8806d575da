"""Folds over a track's records in pieces: each piece is folded by itself, a record at a time.

A fold's next step depends on what it held before.  Where a record's step can't
depend on that, whatever it was, the track may be cut: such safe breaks are found
by column expressions.  Pieces between them are dealt to tasks by track and piece
and sorted, and a state machine runs over the sorted rows of a task, so its memory
is that of one state and one batch, even where a track has no safe break at all; a
track with breaks is spread.  Seams need no settling, since a piece begins in a
state that is known: the machine's own start, with what the record before carries.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scans import numbered, scanned

Cue = tuple[int | None, int | None, str | None]
_ROWS = 8192


class Machine(Protocol):
    """A fold's state: begins anew with each piece, takes records, and gives cues as they are settled."""

    def begin(self, carry: int | None) -> None: ...

    def take(self, start: int | None, end: int | None, text: str | None) -> Iterable[Cue]: ...

    def finish(self) -> Iterable[Cue]: ...


def pieces(df: DataFrame, by: list[str], order: list[str], safe: Column, chunk: Column | None = None) -> DataFrame:
    """``df`` with ``_piece``: how many records up to and with each one are safe to begin with."""
    flag = F.coalesce(safe.cast("int"), F.lit(0))
    if chunk is not None:
        return scanned(df, by, order, chunk, sums={"_piece": flag})
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_piece", F.sum(flag).over(w))


def fold(df: DataFrame, by: list[str], order: list[str], machine: Callable[[], Machine], carry: str | None = None, chunk: Column | None = None) -> DataFrame:
    """(by, pos from 1, start_ms, end_ms, text) of the cues that the machine makes of each track of ``df``, which has pieces."""
    width = len(by)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, key, place = machine(), None, 0
        types: list[pa.DataType] = []
        out: list[tuple] = []

        def packed() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            kinds = [*types, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            made = pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[*(f"_by{i}" for i in range(width)), "_piece", "_place", "start_ms", "end_ms", "text"])
            out.clear()
            return made

        for batch in batches:
            types = [batch.schema.field(i).type for i in range(width)]
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[: width + 1] != key:
                    if key is not None:
                        for cue in own.finish():
                            out.append((*key, place, *cue))
                            place += 1
                    key, place = row[: width + 1], 0
                    own.begin(row[width + 1])
                for cue in own.take(*row[width + 2 :]):
                    out.append((*key, place, *cue))
                    place += 1
                if len(out) >= _ROWS:
                    yield packed()
        if key is not None:
            for cue in own.finish():
                out.append((*key, place, *cue))
                place += 1
        if out:
            yield packed()

    sorted_rows = df.repartition(*by, "_piece").sortWithinPartitions(*by, "_piece", *order)
    carried = F.col(carry).cast("long") if carry else F.lit(None).cast("long")
    rows = sorted_rows.select(*(F.col(c).alias(f"_by{i}") for i, c in enumerate(by)), F.col("_piece").cast("long").alias("_piece"), carried.alias("_carry"), F.col("start_ms").cast("long"), F.col("end_ms").cast("long"), "text")
    kinds = ", ".join(f"_by{i} {df.schema[c].dataType.simpleString()}" for i, c in enumerate(by))
    found = rows.mapInArrow(run, f"{kinds}{', ' if by else ''}_piece long, _place long, start_ms long, end_ms long, text string")
    out = found.select(*(F.col(f"_by{i}").alias(c) for i, c in enumerate(by)), "_piece", "_place", "start_ms", "end_ms", "text")
    out = numbered(out, by, ["_piece", "_place"], F.floor(F.col("_piece") / 10_000) if chunk is not None else None, "pos")
    return out.select(*by, "pos", "start_ms", "end_ms", "text")
