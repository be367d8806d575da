"""Media columns: content-addressed payloads in tar shards.

``pack`` turns every text into a payload (UTF-8, spaces up to a positive
multiple of 192 bytes) and keeps it losslessly as a binary RGB image, 64 pixels
wide, in tar shards.  A member's name is the SHA-256 of its bytes; a task keeps
each member once, however often it occurs.  The rows carry digest, shard, offset
and length; all rows of equal texts point at the same member, the first of those
that tasks kept.  Shards are rows of a table in the shared folder (one binary
value each), so any store that Spark writes to will do.

Beside a shard's bytes lie its headers: the tar header and the first 48 bytes of
every member.  ``describe`` reads that column alone (some 600 bytes a member,
never the payloads) to fill width, height and sample depth; ``features`` reads
the stored bytes.

Null and empty texts give one row of 192 spaces.  A very long text makes a shard
of its own.  Repeated rows share a member and stay separate rows; a null id
stays null; further columns don't matter; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import io
import tarfile
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import raw_text, spread_join, staged

ROW_BYTES = 192  # 64 pixels of three samples
#: Bytes of a member that are kept beside its tar header.
START = 48
SHARD_BYTES = 8 << 20

_PACKED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("digest", pa.string()), ("shard", pa.string()), ("at", pa.int64()), ("length", pa.int64()), ("headers", pa.binary()), ("data", pa.binary())])
_FEATURES = pa.schema([("shard", pa.string()), ("at", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])
_SHAPES = pa.schema([("shard", pa.string()), ("at", pa.int64()), ("width", pa.int32()), ("height", pa.int32()), ("depth", pa.int32())])
_DDL = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary", pa.int32(): "int"}


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {_DDL[f.type]}" for f in schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def to_media(raw: bytes) -> bytes:
    """The image of a text's bytes."""
    size = max(1, -(-len(raw) // ROW_BYTES)) * ROW_BYTES
    return b"P6\n64 %d\n255\n" % (size // ROW_BYTES) + raw.ljust(size, b" ")


def header(start: bytes) -> tuple[int, int, int, int]:
    """Width, height, sample depth and header length from an image's first bytes."""
    kind, shape, most = start[:START].split(b"\n", 3)[:3]
    if kind != b"P6":
        raise ValueError("not a binary RGB image")
    width, height = map(int, shape.split())
    return width, height, int(most).bit_length(), len(kind) + len(shape) + len(most) + 3


def _feature(samples: np.ndarray) -> str:
    """Mean, deviation and shares of eight equal sample ranges."""
    counts = np.bincount(samples, minlength=256)
    n, value = len(samples), np.arange(256)
    mean = counts @ value / n
    deviation = (max(0.0, counts @ value**2 / n - mean * mean)) ** 0.5
    return f"{mean:.3f},{deviation:.3f}," + ",".join(f"{x:.4f}" for x in counts.reshape(8, 32).sum(1) / n)


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, DataFrame]:
    """References (doc_id, n_bytes, digest, shard, at, length) and shards (shard, headers, data)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        kept: dict[bytes, tuple[str, str, int, int]] = {}
        number, out, size, heads = 0, io.BytesIO(), 0, io.BytesIO()

        def shard() -> tuple:
            out.write(b"\0" * 1024)
            return None, None, None, f"{task:06d}-{number:05d}", None, None, heads.getvalue(), out.getvalue()

        for batch in batches:
            rows = []
            for doc, raw in zip(batch.column(0).cast(pa.int64()).to_pylist(), raw_text(batch.column(1)), strict=True):
                key = hashlib.sha256(raw).digest()
                if (place := kept.get(key)) is None:
                    media = to_media(raw)
                    digest = hashlib.sha256(media).hexdigest()
                    entry = tarfile.TarInfo(f"{digest}.ppm")
                    entry.size = len(media)
                    head = entry.tobuf(tarfile.USTAR_FORMAT)
                    out.write(head)
                    heads.write(head + media[:START])
                    place = kept[key] = (digest, f"{task:06d}-{number:05d}", out.tell(), len(media))
                    out.write(media + b"\0" * (-len(media) % 512))
                    size = out.tell()
                rows.append((doc, len(raw), *place, None, None))
                if size >= shard_bytes:
                    rows.append(shard())
                    number, out, size, heads = number + 1, io.BytesIO(), 0, io.BytesIO()
            yield _batch(rows, _PACKED)
        if size:
            yield _batch([shard()], _PACKED)

    packed = staged(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, _ddl(_PACKED)), "shards")
    # the filters read the short columns alone
    refs = packed.where("digest is not null").drop("headers", "data")
    # where several tasks kept a member, the first place of the corpus stands for all
    first = refs.groupBy("digest").agg(F.min(F.struct("shard", "at")).alias("place"))
    refs = spread_join(refs.select("doc_id", "n_bytes", "length", "digest"), first, ["digest"])
    return refs.select("doc_id", "n_bytes", "digest", "place.shard", "place.at", "length"), packed.where("digest is null").select("shard", "headers", "data")


def _size(head: bytes) -> int:
    """The length of a member, from its tar header."""
    return int(head[124:135], 8)


def members(data: memoryview) -> Iterator[tuple[str, int, int]]:
    """Digest, offset and length of every member of a shard, read from the tar headers."""
    at = 0
    while at + 512 <= len(data) and data[at]:
        head = bytes(data[at : at + 512])
        size = _size(head)
        yield head[:100].split(b"\0", 1)[0].decode().removesuffix(".ppm"), at + 512, size
        at += 512 + size + (-size % 512)


def describe(shards: DataFrame) -> DataFrame:
    """Shape and depth of each member, from the column of headers alone."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, heads in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, at = [], 0
                for i in range(0, len(heads), 512 + START):
                    size = _size(heads[i : i + 512])
                    rows.append((name, at + 512, *header(heads[i + 512 : i + 512 + START])[:3]))
                    at += 512 + size + (-size % 512)
                yield _batch(rows, _SHAPES)

    return shards.select("shard", "headers").mapInArrow(run, _ddl(_SHAPES))


def features(shards: DataFrame) -> DataFrame:
    """Checked digests and features of every stored member."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                view, rows = memoryview(data.as_buffer()), []
                for digest, at, length in members(view):
                    media = view[at : at + length]
                    skip = header(bytes(media[:START]))[3]
                    found = hashlib.sha256(media).hexdigest()
                    if found != digest:
                        raise ValueError(f"member {digest} of shard {name} is damaged")
                    payload = media[skip:]
                    rows.append((name, at, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), length, found, _feature(np.frombuffer(payload, np.uint8))))
                yield _batch(rows, _FEATURES)

    return shards.select("shard", "data").mapInArrow(run, _ddl(_FEATURES))


def media_columns(docs: DataFrame, **options) -> DataFrame:
    """Pack the texts, read the shards back and give each row its media columns; shapes come from the headers."""
    refs, shards = pack(docs, **options)
    refs = staged(refs, "references")
    held = features(shards).join(describe(shards), ["shard", "at"])
    # the rows of a text that occurs often are a hot key
    return spread_join(refs, held, ["shard", "at"], "left").select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "shard", F.col("at").alias("offset"), "width", "height", "depth")
