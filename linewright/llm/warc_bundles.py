"""WARC archives in seekable Zstandard bundles.

Records are grouped into independent Zstandard frames; a bundle begins with a
``warcinfo`` record and ends with a seek table in a skippable frame, as the
public seekable format has it.  The index maps a record's identifier to its
bundle, frame and offset within the frame's plain bytes.  A bundle is kept as
one row for each frame and one for its seek table, in order, in a table of the
shared folder; :func:`assemble` puts one together.  Row groups are small and
follow the bundles' names, so fetching a record reads the row groups of its
bundle and unpacks its frame.

Of the records whose payloads are equal and have at least ``least`` bytes, that
with the largest page id is a response and the others are revisits of it.

A null html is an empty payload; a null url an empty target.  Rows that repeat
the largest page id of their payload are responses all; a row without a page id
is a revisit where another row has one, and its record is named by its place.
Records of rows that repeat a page id share a name.  Very long pages make frames
of their own.  Further columns don't matter; an empty table gives an empty
result.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread_join, staged

LEAST = 1000
FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 8 << 20
#: Bytes of a row group of the table of frames.
GROUP_BYTES = 16 << 20
#: Payloads whose copies take more than ``HOT_BYTES`` together are settled before the shuffle, the ``HOT_MOST`` greatest of them.
HOT_BYTES, HOT_MOST = 4 << 20, 1000
#: Bundles whose names go into the filter of a scan; more are found by a join alone.
NAMED = 1000
ID = "urn:page:"
_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _clean(x: str) -> str:
    return x.replace("\r", "%0D").replace("\n", "%0A")


def record(name: str, url: str | None, payload: bytes, size: int, sha1: bytes, refers_to: int | None, date: str) -> bytes:
    """One WARC record; a revisit, which needs the payload's size alone, if ``refers_to`` is given."""
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{ID}{name}>", f"WARC-Date: {date}", f"WARC-Target-URI: {_clean(url or '')}", f"WARC-Payload-Digest: sha1:{base64.b32encode(sha1).decode()}"]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    if refers_to is None:
        block += payload
    else:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <{ID}{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def info(bundle: str, date: str) -> bytes:
    """The record that begins a bundle."""
    block = b"format: WARC File Format 1.1\r\n"
    lines = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:bundle:{bundle}>", f"WARC-Date: {date}", f"WARC-Filename: {bundle}.warc.zst", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Header fields, block and end of the record at ``at``."""
    stop = data.index(b"\r\n\r\n", at)
    first, *lines = data[at:stop].decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines)
    end = stop + 4 + int(fields["Content-Length"])
    return fields, data[stop + 4 : end], end + 4


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    """The skippable frame that ends a bundle: packed and plain size of each frame."""
    body = b"".join(struct.pack("<II", *x) for x in sizes) + struct.pack("<IBI", len(sizes), 0, _SEEKABLE)
    return struct.pack("<II", _SKIPPABLE, len(body)) + body


def frames(bundle: bytes) -> list[tuple[int, int, int]]:
    """Offset, packed size and plain size of each frame, from the seek table alone."""
    count, flags, magic = struct.unpack("<IBI", bundle[-9:])
    if magic != _SEEKABLE:
        raise ValueError("no seek table")
    width = 12 if flags & 0x80 else 8
    start, out, at = len(bundle) - 9 - count * width, [], 0
    for i in range(count):
        packed, plain = struct.unpack_from("<II", bundle, start + i * width)
        out.append((at, packed, plain))
        at += packed
    return out


def read_frame(bundle: bytes, number: int) -> bytes:
    at, packed, plain = frames(bundle)[number]
    return zstandard.ZstdDecompressor().decompress(bundle[at : at + packed], max_output_size=plain)


_WRITTEN = pa.schema([("page_id", pa.int64()), ("bundle", pa.string()), ("frame", pa.int32()), ("at", pa.int64()), ("length", pa.int64()), ("data", pa.binary())])
_READ = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("bundle", pa.string()), ("frame", pa.int32()), ("at", pa.int64())])
_DDL = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary", pa.int32(): "int"}


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {_DDL[f.type]}" for f in schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _decided(pages: DataFrame, least: int) -> DataFrame:
    """page_id, url, html, size, sha1 and refers_to of every page; html only where it is to be stored if its payload is a hot one."""
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), F.coalesce(pages["html"].cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("sha1", F.unhex(F.sha1(F.col("html").cast("binary")))).withColumn("size", F.octet_length("html").cast("long"))
    # only payloads that several records have: a row for each task and payload goes to this shuffle
    payloads = rows.groupBy("sha1").agg(F.max("page_id").alias("owner"), F.max("size").alias("size"), F.count("*").alias("n")).where("n > 1")
    payloads = staged(payloads.select("sha1", F.when(F.col("size") >= least, F.col("owner")).alias("owner"), (F.col("n") * (F.col("size") + 200)).alias("held")), "payloads")
    hot = payloads.where(F.col("held") > HOT_BYTES).orderBy(F.desc("held"), "sha1").limit(HOT_MOST).select("sha1", F.col("owner").alias("hot_owner"), F.lit(True).alias("settled"))
    other = lambda owner: F.col(owner).isNotNull() & ~F.col("page_id").eqNullSafe(F.col(owner))
    rows = rows.join(F.broadcast(hot), "sha1", "left").withColumn("refers_to", F.when(other("hot_owner"), F.col("hot_owner")))
    # settled rows meet nothing in the join and are dealt by their id and address; revisits leave their html behind
    rows = rows.select("page_id", "url", F.when(F.col("refers_to").isNull(), F.col("html")).alias("html"), "size", "sha1", "refers_to", F.when(F.col("settled"), F.unhex(F.md5(F.concat_ws(" ", "page_id", "url", F.hex("sha1"))))).otherwise(F.col("sha1")).alias("key"))
    rows = rows.join(payloads.where("owner is not null").select(F.col("sha1").alias("key"), "owner"), "key", "left")
    return rows.select("page_id", "url", "html", "size", "sha1", F.coalesce("refers_to", F.when(other("owner"), F.col("owner"))).alias("refers_to"))


def write(pages: DataFrame, *, least: int = LEAST, date: str = "2024-01-01T00:00:00Z", frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> tuple[DataFrame, DataFrame]:
    """Index (page_id, bundle, frame, at, length) and bundles (bundle, frame, data); a seek table has no frame."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        packer = zstandard.ZstdCompressor(level=3)
        plain: list[bytes] = []
        sizes: list[tuple[int, int]] = []
        filled = 0

        def name() -> str:
            return f"{task:06d}-{number:05d}"

        def close_frame() -> tuple:
            nonlocal filled
            data = b"".join(plain)
            packed = packer.compress(data)
            row = None, name(), len(sizes), None, None, packed
            sizes.append((len(packed), len(data)))
            plain.clear()
            filled = 0
            return row

        def close_bundle() -> tuple:
            nonlocal number
            row = None, name(), None, None, None, seek_table(sizes)
            number += 1
            sizes.clear()
            return row

        for batch in batches:
            out, held = [], 0
            for page_id, url, html, size, sha1, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not sizes and not plain:
                    plain.append(info(name(), date))
                    filled = len(plain[0])
                named = f"/{name()}/{len(sizes)}/{filled}" if page_id is None else str(page_id)
                data = record(named, url, (html or "").encode(), size, sha1, refers_to, date)
                out.append((page_id, name(), len(sizes), filled, len(data), None))
                plain.append(data)
                filled += len(data)
                if filled >= frame_bytes:
                    out.append(close_frame())
                    held += len(out[-1][-1])
                    if sum(x for x, _ in sizes) >= bundle_bytes:
                        out.append(close_bundle())
                if held >= bundle_bytes:
                    yield _batch(out, _WRITTEN)
                    out, held = [], 0
            yield _batch(out, _WRITTEN)
        if plain:
            yield _batch([close_frame()], _WRITTEN)
        if sizes:
            yield _batch([close_bundle()], _WRITTEN)

    written = staged(_decided(pages, least).mapInArrow(run, _ddl(_WRITTEN)), "bundles", **{"parquet.block.size": str(GROUP_BYTES)})
    return written.where("data is null").drop("data"), written.where("data is not null").select("bundle", "frame", "data")


def assemble(bundles: DataFrame, bundle: str) -> bytes:
    """The bytes of one bundle, to be kept as a ``.warc.zst`` file."""
    rows = bundles.where(F.col("bundle") == bundle).orderBy(F.col("frame").asc_nulls_last()).collect()
    return b"".join(bytes(r.data) for r in rows)


def read(bundles: DataFrame) -> DataFrame:
    """Every record of the bundles; a revisit's digest is that of its header and its size that of its response."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for name, number, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                frame, at, rows = unpack.decompress(packed.as_buffer()), 0, []
                while at < len(frame):
                    fields, block, end = parse(frame, at)
                    if fields["WARC-Type"] == "warcinfo":
                        at = end
                        continue
                    page = fields["WARC-Record-ID"][1:-1].removeprefix(ID)
                    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                    size = refers_to = None
                    if fields["WARC-Type"] == "response":
                        payload = block.split(b"\r\n\r\n", 1)[1]
                        size = len(payload)
                        if hashlib.sha1(payload).hexdigest() != digest:
                            raise ValueError(f"record {page} in bundle {name} is damaged")
                    else:
                        refers_to = int(fields["WARC-Refers-To"][1:-1].removeprefix(ID))
                    rows.append((None if page.startswith("/") else int(page), size, digest, fields["WARC-Type"], refers_to, name, number, at))
                    at = end
                yield _batch(rows, _READ)

    rows = staged(bundles.where("frame is not null").select("bundle", "frame", "data").mapInArrow(run, _ddl(_READ)), "records")
    # the digest is part of the key: a page id may be repeated with another payload
    full = rows.where("record_type = 'response'").groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.max("payload_bytes").alias("size"))
    # the revisits of one page are a hot key
    revisits = spread_join(rows.where("record_type = 'revisit'"), full, ["refers_to", "payload_digest"], "left").withColumn("payload_bytes", F.col("size"))
    names = [f.name for f in _READ]
    return rows.where("record_type = 'response'").select(names).unionByName(revisits.select(names))


def fetch(index: DataFrame, bundles: DataFrame, page_ids: DataFrame) -> DataFrame:
    """The records of some pages: one frame is read and unpacked for each.

    The names of up to ``NAMED`` bundles become a filter of the scan, which then
    skips the row groups of all others; beyond that the join alone finds frames.
    """
    wanted = index.join(page_ids.select("page_id").distinct(), "page_id", "left_semi")
    places = wanted.groupBy("bundle", "frame").agg(F.collect_list(F.struct("page_id", "at", "length")).alias("places"))
    names = [r.bundle for r in wanted.select("bundle").distinct().limit(NAMED + 1).collect()]
    if len(names) <= NAMED:
        bundles = bundles.where(F.col("bundle").isin(names))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("record", pa.binary())])
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for packed, found in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                plain = unpack.decompress(packed.as_buffer())
                yield _batch([(x["page_id"], plain[x["at"] : x["at"] + x["length"]]) for x in found], schema)

    return bundles.join(places, ["bundle", "frame"]).select("data", "places").mapInArrow(run, "page_id long, record binary")


def archive_pages(pages: DataFrame, **options) -> DataFrame:
    """Write the archives, read them back and return a row for each page."""
    _, bundles = write(pages, **options)
    return read(bundles).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "bundle", "frame", F.col("at").alias("offset"))
