"""Shared helpers: staging tables, word splitting and vectorised hashing."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Odd multiplier of the rolling hashes and its inverse modulo 2**64.
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.default_rng(20240611).integers(1, 1 << 63, 256, dtype=np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_POW = {}
#: Rows of one key that a task of a join can well take.
HOT_ROWS = 50_000
#: Folders of staged tables of this driver.
_STAGED: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    A local run without that setting, as in tests, gets a folder of its own,
    which is then set for the session; on a cluster the setting is required.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="spark-linewright-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def staged(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts the lineage: after the write, a lost executor costs no more than
    its running tasks.  Results read these tables lazily, so they stay until
    :func:`remove_staged`.  ``options`` go to the writer.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/linewright-{uuid.uuid4().hex}"
    df.write.options(compression="zstd", **options).parquet(f"{path}/{name}")
    _STAGED.append(path)
    return spark.read.schema(df.schema).parquet(f"{path}/{name}")


def remove_staged(spark: SparkSession) -> int:
    """Delete the tables that :func:`staged` wrote for this driver; results not yet written are lost. Returns their number."""
    hadoop, n = spark.sparkContext._jsc.hadoopConfiguration(), 0
    while _STAGED:
        path = spark._jvm.org.apache.hadoop.fs.Path(_STAGED.pop())
        n += path.getFileSystem(hadoop).delete(path, True)
    return n


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", ways: int = 64, share: int = 1000, counts: DataFrame | None = None) -> DataFrame:
    """``left`` joined to ``right``, which has one row for each key; frequent keys of ``left`` are dealt into ``ways``.

    A key is frequent if it has more than one of ``share`` rows of ``left`` and
    more than ``HOT_ROWS``, so at most ``share`` hashes are broadcast whatever the
    size of the tables; a table of no more rows than that has no such key.  Rows are dealt by their other columns, alike in every
    attempt of a task.  ``counts`` may give keys with their number ``n``; without
    it ``left`` is read once more.  Stage ``left`` first.
    """
    total = left.count()
    if total <= HOT_ROWS:
        return left.join(right, keys, how)
    least = max(total / share, HOT_ROWS)
    counts = left.groupBy(*keys).agg(F.count("*").alias("n")) if counts is None else counts
    hot = counts.where(F.col("n") > least).select(F.xxhash64(*keys).alias("lw_hash"), F.lit(True).alias("lw_hot"))
    hot = F.broadcast(hot.distinct())
    deal = lambda df, salt: df.withColumn("lw_hash", F.xxhash64(*keys)).join(hot, "lw_hash", "left").withColumn("lw_salt", F.when(F.col("lw_hot"), salt)).drop("lw_hash", "lw_hot")
    others = [c for c in left.columns if c not in keys] or keys
    spread = deal(left, F.pmod(F.xxhash64(*others), F.lit(ways)).cast("int")).withColumn("lw_salt", F.coalesce("lw_salt", F.lit(0)))
    copies = deal(right, F.lit(1)).withColumn("lw_salt", F.explode(F.when(F.col("lw_salt").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(ways - 1)))))
    return spread.join(copies, [*keys, "lw_salt"], how).drop("lw_salt")


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (the murmur3 finaliser)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """``P**0 .. P**(n-1)`` modulo 2**64, or those of the inverse."""
    have = _POW.get(inverse)
    if have is None or len(have) < n:
        size = max(n, 1 << 17)
        have = np.empty(size, np.uint64)
        have[0] = 1
        have[1:] = _P_INV if inverse else _P
        np.multiply.accumulate(have, out=have)
        if size > 1 << 22:  # a text beyond 4 MB: use, don't keep
            return have[:n]
        _POW[inverse] = have
    return have[:n]


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of every word ``[^\\x20\\x09-\\x0D]+`` of a text in UTF-8."""
    b = np.frombuffer(raw, np.uint8)
    n = len(b)
    edge = np.zeros(n + 2, np.int8)
    edge[1:-1] = ~_SPACE[b]
    step = np.diff(edge)
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[b] * powers(n), out=total[1:])
    return mix((total[end] - total[start]) * powers(n + 1, inverse=True)[start]), start, end


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words; empty if there are fewer words."""
    m = len(words) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out = words[:m].copy()
    for i in range(1, n):
        out *= _P
        out += words[i : i + m]
    return mix(out ^ np.uint64(n))


def raw_text(column) -> list[bytes]:
    """The UTF-8 bytes of an Arrow string column, nulls as empty."""
    return [x.encode() if x is not None else b"" for x in column.to_pylist()]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_enough(df: DataFrame, column: str, limit: int) -> bool:
    """Whether the texts in ``column`` have at most ``limit`` bytes together."""
    size = df.agg(F.sum(F.octet_length(column))).first()[0]
    return (size or 0) <= limit
