"""``spark.read.format("subtitles")``: subtitle files as rows of cues.

    spark.dataSource.register(SubtitleFiles)
    spark.read.format("subtitles").option("dialect", "patch").load("/tracks")

Options: ``dialect`` names one of ``subtitles.DIALECTS``, and each field of
``Dialect`` may be set by its own name; ``suffixes`` (``.srt,.vtt``) chooses files;
``partitionBytes`` (32 MB) bounds what a task reads: small files share a task, and
longer ones are cut where a block begins; ``mode`` is that of Spark's readers.
With ``PERMISSIVE`` a file that can't be opened or has no stamp line, and a block
that isn't UTF-8, is a row with its ``error``; ``DROPMALFORMED`` leaves such rows out;
``FAILFAST`` raises.  Blocks that the dialect doesn't keep give no row in any mode, as
with its parser.

A block is a run of lines between blank ones and belongs to the part of the file
where its first line begins; ``at`` is that place in bytes, so the cues of a file
are in the order of ``at`` however it was cut.  ``read_subtitles`` numbers them.
Whether a cut file has any cue is not known to a task, so only whole ones are
reported for that.  With ``pushdown`` "true", and Spark's setting
``spark.sql.python.filterPushdown.enabled``, a filter on ``file`` (equal or among
values) prunes files before tasks are planned.
"""

from __future__ import annotations

import html
import posixpath
import re
from collections.abc import Iterator
from dataclasses import dataclass, fields, replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from .storage import file_system, files_below
from .subtitles import DIALECTS, Dialect

_SCHEMA = pa.schema([("file", pa.string()), ("at", pa.int64()), ("idx", pa.int32()), ("start_ms", pa.int64()), ("end_ms", pa.int64()), ("text", pa.string()), ("lines", pa.list_(pa.string())), ("error", pa.string())])
DDL = "file string, at long, idx int, start_ms long, end_ms long, text string, lines array<string>, error string"
#: Rows of a batch, and bytes that are read at a time.
_ROWS, _READ = 4096, 1 << 20

_STAMP = re.compile(r"(?:(\d+):)?(\d{1,2}):(\d{2})[,.](\d{3})", re.ASCII)
_DIGITS = re.compile(r"\d+", re.ASCII)
_MARKS = re.compile(r">>+|(?<!\S)>(?!\S)", re.ASCII)
#: White space of Unicode.
_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def milliseconds(stamp: str) -> int | None:
    found = _STAMP.search(stamp)
    if not found:
        return None
    hour, minute, second, ms = (int(x) if x and len(x) <= 7 else 0 for x in found.groups())
    return ((hour * 60 + minute) * 60 + second) * 1000 + ms


def cue_of(block: str, d: Dialect) -> tuple[int | None, int, int, str, list[str]] | None:
    """(idx, start_ms, end_ms, text, lines) of a block, None if the dialect doesn't keep it."""
    lines = [x.replace("\r", "").strip(" ") for x in block.split("\n")]
    at = next((i for i, x in enumerate(lines) if "-->" in x), None)
    if at is None:
        return None
    begin, end = lines[at].split("-->")[:2]
    start_ms, end_ms = milliseconds(begin), milliseconds(end)
    if start_ms is None or end_ms is None or not d.point_stamps and not ("," in begin and "," in end):
        return None
    idx = int(lines[at - 1]) if at and _DIGITS.fullmatch(lines[at - 1]) and len(lines[at - 1]) < 10 else None
    if d.needs_index and idx is None or d.least_lines > sum(x != "" for x in lines):
        return None
    kept = [x for x in lines[at + 1 :] if x and not (d.drop_numeric_lines and _DIGITS.fullmatch(x))]
    if d.clean_markup:
        # tags go before entities are decoded, so that decoded signs stay
        decoded = html.unescape("\n".join(re.sub("<[^>]+>", "", x) for x in kept))
        kept = [_SPACE.sub(" ", _MARKS.sub(" ", x)).strip(" ") for x in decoded.split("\n")]
        kept = [x for x in kept if x and not x.startswith(("Kind:", "Language:"))]
    text = d.joiner.join(kept)
    return (idx, start_ms, end_ms, text, kept) if text or d.keep_empty else None


@dataclass
class Part(InputPartition):
    """Ranges (path, first byte, byte after the last, size of the file) that one task reads."""

    ranges: list[tuple[str, int, int, int]]

    def __init__(self, ranges: list[tuple[str, int, int, int]]) -> None:
        super().__init__(None)
        self.ranges = ranges


def packed(files: list[tuple[str, int]], limit: int) -> list[Part]:
    """Files in order, cut and put together into parts of about ``limit`` bytes."""
    parts: list[Part] = []
    some: list[tuple[str, int, int, int]] = []
    held = 0
    for path, size in files:
        if size > limit:
            n = -(-size // limit)
            parts += [Part([(path, size * i // n, size * (i + 1) // n, size)]) for i in range(n)]
            continue
        if some and held + size > limit:
            parts.append(Part(some))
            some, held = [], 0
        some.append((path, 0, size, size))
        held += size
    return [*parts, Part(some)] if some else parts


def _line_before(stream: pa.NativeFile, at: int) -> bytes:
    """What precedes ``at`` on its line and, where that is nothing, the whole line before."""
    reach = 4096
    while True:
        first = max(0, at - reach)
        stream.seek(first)
        data = stream.read(at - first)
        if first == 0 or b"\n" in data[:-1]:
            return data[:-1].rpartition(b"\n")[2] + data[-1:]
        reach *= 4


def blocks_of(stream: pa.NativeFile, first: int, last: int, blank_separator: bool) -> Iterator[tuple[int, bytes]]:
    """(place, bytes) of the blocks that begin in [first, last); the last one is read to its end."""
    blank = (lambda x: not x.strip(b" \t\r\x0b\x0c")) if blank_separator else (lambda x: x in (b"", b"\r"))
    after_blank, skip = True, False
    if first:
        before = _line_before(stream, first)
        skip = not before.endswith(b"\n")  # the line goes on that began before
        after_blank = not skip and blank(before[:-1])
        if skip:
            partial = before
    stream.seek(first)
    rest, place, begun, held = b"", first, first, []
    while True:
        data = stream.read(_READ)
        lines = (rest + data).split(b"\n")
        rest = lines.pop() if data else b""
        for line in lines:
            size = len(line) + 1
            if skip:
                after_blank, skip = blank(partial + line), False
            elif blank(line):
                if held:
                    yield begun, b"\n".join(held)
                    held = []
                after_blank = True
            elif held:
                held.append(line)
            elif after_blank:
                if place >= last:
                    return
                begun, held, after_blank = place, [line], False
            place += size
            if place >= last and not held:
                return
        if not data:
            break
    if held:
        yield begun, b"\n".join(held)


class SubtitleReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        preset = DIALECTS[options.get("dialect", "captions")]
        own = {f.name: options[f.name] for f in fields(Dialect) if f.name in options}
        kinds = {"bool": lambda x: x.lower() == "true", "int": int, "str": str}
        self.dialect = replace(preset, **{f.name: kinds[str(f.type)](own[f.name]) for f in fields(Dialect) if f.name in own})
        self.path = options["path"]
        self.suffixes = tuple(x for x in options.get("suffixes", "").split(",") if x)
        self.limit = int(options.get("partitionBytes", 32 << 20))
        self.mode = options.get("mode", "PERMISSIVE").upper()
        self.wanted: set[str] | None = None
        if self.mode not in ("PERMISSIVE", "DROPMALFORMED", "FAILFAST"):
            raise ValueError(f"no such mode: {self.mode}")

    def partitions(self) -> list[Part]:
        files = files_below(self.path, self.suffixes)
        if self.wanted is not None:
            files = [x for x in files if posixpath.basename(x[0]) in self.wanted]
        return packed(files, self.limit) or [Part([])]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for row in self._rows(partition):
            if row[7] is None or self.mode == "PERMISSIVE":
                rows.append(row)
            elif self.mode == "FAILFAST":
                raise ValueError(f"{row[0]}, byte {row[1]}: {row[7]}")
            if len(rows) == _ROWS:
                yield self._batch(rows)
                rows = []
        if rows:
            yield self._batch(rows)

    def _rows(self, partition: Part) -> Iterator[tuple]:
        bad = lambda name, at, why: (name, at, None, None, None, None, None, why)
        system, _ = file_system(self.path)
        for path, first, last, size in partition.ranges:
            name, found, at = posixpath.basename(path), False, first
            try:
                with system.open_input_file(path) as stream:
                    for at, raw in blocks_of(stream, first, last, self.dialect.blank_separator):
                        try:
                            block = (raw.removeprefix(b"\xef\xbb\xbf") if at == 0 else raw).decode()
                        except UnicodeDecodeError as e:
                            found = True
                            yield bad(name, at, f"not UTF-8 at byte {at + e.start}")
                            continue
                        found = found or "-->" in block
                        cue = cue_of(block, self.dialect)
                        if cue:
                            yield (name, at, *cue, None)
            except OSError as e:
                yield bad(name, at, f"unreadable: {type(e).__name__}")
                continue
            if not found and (first, last) == (0, size):
                yield bad(name, 0, "no cues")

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)


class PruningReader(SubtitleReader):
    """Takes over filters on ``file``; Spark refuses such a reader where its setting is off."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            names = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if names is not None and f.attribute == ("file",):
                self.wanted = names if self.wanted is None else self.wanted & names
            else:
                yield f


class SubtitleFiles(DataSource):
    """Cues of subtitle files in any of the dialects."""

    @classmethod
    def name(cls) -> str:
        return "subtitles"

    def schema(self) -> str:
        return DDL

    def reader(self, schema) -> SubtitleReader:
        options = dict(self.options)
        return (PruningReader if options.get("pushdown", "false").lower() == "true" else SubtitleReader)(options)


def read_subtitles(spark: SparkSession, path: str, dialect: str = "captions", **options: str) -> DataFrame:
    """file, pos, idx, start_ms, end_ms, text, lines and error; ``pos`` numbers a file's cues from 1 and is null for errors."""
    spark.dataSource.register(SubtitleFiles)
    rows = spark.read.format("subtitles").options(dialect=dialect, **options).load(path)
    good = F.col("error").isNull()
    place = F.row_number().over(Window.partitionBy("file", good).orderBy("at"))
    return rows.withColumn("pos", F.when(good, place)).select("file", "pos", "idx", "start_ms", "end_ms", "text", "lines", "error")
