"""``spark.read.format("wave")``: loudness of uncompressed sound files, a row for each second.

    spark.dataSource.register(WaveFiles)
    spark.read.format("wave").load("/sound")

A task walks the chunks of a file's RIFF header (ids, sizes, a pad byte after odd
sizes, unknown chunks skipped) by seeking, then reads the samples of its own seconds
alone, a few at a time, so a recording of any length is spread over tasks by
``partitionBytes`` (32 MB) and takes bounded memory.  Samples are whole numbers of
8 (unsigned), 16, 24 or 32 bits, or floats of 32; all are scaled to 16 bits.  Channels
count together.

``whole`` is false for a last second that the samples don't fill.  A file that isn't
RIFF/WAVE, has no format or no samples, or another encoding gives one row with its
``error``; one whose samples end before their stated size gives its whole frames'
seconds, and a row with ``second`` null and the error ``truncated``.
"""

from __future__ import annotations

import posixpath
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .storage import file_system, files_below

_SCHEMA = pa.schema([("file", pa.string()), ("second", pa.int64()), ("n_samples", pa.int64()), ("rms", pa.float64()), ("peak", pa.float64()), ("whole", pa.bool_()), ("error", pa.string())])
DDL = "file string, second long, n_samples long, rms double, peak double, whole boolean, error string"
#: Encodings by their tags (fixed values of the format): whole numbers, floats, and the tag that names one of them further on.
_WHOLE, _FLOAT, _EXTENSIBLE = 1, 3, 0xFFFE
_SECONDS = 16  # read at a time


class Malformed(ValueError):
    """A file that can't be read as sound."""


@dataclass
class Sound:
    """Where a file's samples are and how they are written."""

    at: int
    size: int
    rate: int
    channels: int
    bits: int
    floats: bool
    truncated: bool

    @property
    def frame(self) -> int:
        return self.channels * self.bits // 8

    @property
    def frames(self) -> int:
        return self.size // self.frame


def header(stream: pa.NativeFile, size: int) -> Sound:
    """The format and the place of the samples, from the chunks before and at them."""
    stream.seek(0)
    head = stream.read(12)
    if len(head) < 12 or head[:4] != b"RIFF" or head[8:] != b"WAVE":
        raise Malformed("not RIFF/WAVE")
    at, found = 12, None
    while at + 8 <= size:
        stream.seek(at)
        name, length = struct.unpack("<4sI", stream.read(8))
        at += 8
        if name == b"fmt ":
            data = stream.read(min(length, 40))
            if len(data) < 16:
                raise Malformed("short format")
            tag, channels, rate, _, _, bits = struct.unpack("<HHIIHH", data[:16])
            if tag == _EXTENSIBLE and len(data) >= 26:
                tag = struct.unpack("<H", data[24:26])[0]
            if not channels or not rate:
                raise Malformed("no channels or rate")
            if (tag, bits) not in {(_WHOLE, 8), (_WHOLE, 16), (_WHOLE, 24), (_WHOLE, 32), (_FLOAT, 32)}:
                raise Malformed(f"encoding {tag} of {bits} bits")
            found = rate, channels, bits, tag == _FLOAT
        elif name == b"data":
            if found is None:
                raise Malformed("samples before their format")
            there = min(length, size - at)
            return Sound(at, there, *found, there < length)
        at += length + length % 2
    raise Malformed("no samples" if found else "no format")


def scaled(data: bytes, bits: int, floats: bool) -> np.ndarray:
    """Samples on the scale of 16 bits."""
    if floats:
        return np.frombuffer(data, "<f4").astype(np.float64) * 32768
    if bits == 8:
        return (np.frombuffer(data, np.uint8).astype(np.float64) - 128) * 256
    if bits == 24:
        three = np.frombuffer(data, np.uint8).reshape(-1, 3)
        wide = np.zeros((len(three), 4), np.uint8)
        wide[:, 1:] = three
        return wide.view("<i4").ravel().astype(np.float64) / 65536
    return np.frombuffer(data, f"<i{bits // 8}").astype(np.float64) / (1 << bits - 16)


def seconds_of(stream: pa.NativeFile, sound: Sound, first: int, last: int) -> Iterator[tuple[int, int, float, float, bool]]:
    """(second, samples, root mean square, peak, whole) of the seconds in [first, last)."""
    step = sound.rate * sound.frame
    for begin in range(first, last, _SECONDS):
        end = min(begin + _SECONDS, last)
        stream.seek(sound.at + begin * step)
        most = min(end * step, sound.frames * sound.frame) - begin * step
        samples = scaled(stream.read(most), sound.bits, sound.floats)
        width = sound.rate * sound.channels
        for k in range(end - begin):
            own = samples[k * width : (k + 1) * width]
            if len(own):
                yield begin + k, len(own), float(np.sqrt(np.mean(own * own))), float(np.abs(own).max()), len(own) == width


@dataclass
class Share(InputPartition):
    """Files of a task, each with the share ``part`` of ``of`` that it reads."""

    files: list[tuple[str, int, int, int]]

    def __init__(self, files: list[tuple[str, int, int, int]]) -> None:
        super().__init__(None)
        self.files = files


class WaveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.suffixes = tuple(x for x in options.get("suffixes", "").split(",") if x)
        self.limit = int(options.get("partitionBytes", 32 << 20))

    def partitions(self) -> list[Share]:
        out: list[Share] = []
        some: list[tuple[str, int, int, int]] = []
        held = 0
        for path, size in files_below(self.path, self.suffixes):
            if size > self.limit:
                n = -(-size // self.limit)
                out += [Share([(path, size, i, n)]) for i in range(n)]
                continue
            if some and held + size > self.limit:
                out.append(Share(some))
                some, held = [], 0
            some.append((path, size, 0, 1))
            held += size
        return [*out, Share(some)] if some or not out else out

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        system, _ = file_system(self.path)
        for path, size, part, of in partition.files:
            name = posixpath.basename(path)
            rows: list[tuple] = []
            try:
                with system.open_input_file(path) as stream:
                    sound = header(stream, size)
                    total = -(-sound.frames // sound.rate)
                    for row in seconds_of(stream, sound, total * part // of, total * (part + 1) // of):
                        rows.append((name, *row, None))
                        if len(rows) == 4096:
                            yield self._batch(rows)
                            rows = []
                if sound.truncated and not part:
                    rows.append((name, None, None, None, None, None, "truncated"))
            except (OSError, Malformed) as e:
                if not part:
                    rows.append((name, None, None, None, None, None, str(e) if isinstance(e, Malformed) else f"unreadable: {type(e).__name__}"))
            if rows:
                yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)


class WaveFiles(DataSource):
    """Loudness of sound files by the second."""

    @classmethod
    def name(cls) -> str:
        return "wave"

    def schema(self) -> str:
        return DDL

    def reader(self, schema) -> WaveReader:
        return WaveReader(dict(self.options))


def read_waves(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """file, second, n_samples, rms, peak, whole and error of the sound files below a path."""
    spark.dataSource.register(WaveFiles)
    return spark.read.format("wave").options(**options).load(path)


def silence(seconds: DataFrame, by: list[str], level: float = 500.0, whole: Column | None = None) -> DataFrame:
    """n_seconds, n_silent, the share of silent seconds and the threshold that follows from it; only whole seconds count."""
    kept = seconds.where(F.col("whole") if whole is None else whole)
    counted = kept.groupBy(*by).agg(F.count("*").alias("n_seconds"), F.count_if(F.col("rms") < level).alias("n_silent"))
    share = F.col("n_silent") / F.col("n_seconds")
    return counted.withColumns({"silent": share, "threshold": F.when(share > 0.3, 2.0).otherwise(1.0)})
