"""Queries of sound: files rendered from the vectors, in every encoding, with odd chunks and damage."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from ..sources import audio, named_files
from .catalogue import _query
from .tables import read

_RATE = 10


@F.pandas_udf(BinaryType())
def _wave(ids: pd.Series, samples: pd.Series) -> pd.Series:
    """A sound file of eight-bit values in one of five encodings; every eleventh is cut, every thirteenth is none."""

    def made(i: int, values: np.ndarray) -> bytes:
        kind, channels = i % 5, 1 + i % 2
        wide = values.astype(np.int64)
        if kind == 0:
            data, bits, tag = (wide + 128).astype(np.uint8).tobytes(), 8, 1
        elif kind == 1:
            data, bits, tag = (wide * 256).astype("<i2").tobytes(), 16, 1
        elif kind == 2:
            data, bits, tag = (wide << 16).astype("<i4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes(), 24, 1
        elif kind == 3:
            data, bits, tag = (wide << 24).astype("<i4").tobytes(), 32, 0xFFFE
        else:
            data, bits, tag = (wide / 128).astype("<f4").tobytes(), 32, 3
        form = struct.pack("<HHIIHH", tag, channels, _RATE, _RATE * channels * bits // 8, channels * bits // 8, bits)
        if tag == 0xFFFE:
            form += struct.pack("<HHIH14x", 22, bits, 0, 1)
        chunks = struct.pack("<4sI", b"fmt ", len(form)) + form + struct.pack("<4sI3sx", b"LIST", 3, b"odd") + struct.pack("<4sI", b"data", len(data)) + data
        out = struct.pack("<4sI4s", b"RIFF", 4 + len(chunks), b"WAVE") + chunks
        return b"RIFX" + out[4:] if i % 13 == 0 else out[:-1] if i % 11 == 0 else out

    return pd.Series([made(i, np.asarray(v)) for i, v in zip(ids, samples, strict=True)])


_SAMPLES = """v AS (SELECT vec_id, 1 + vec_id % 2 AS ch, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 127) AS BIGINT)) AS s FROM embeddings WHERE vec_id % 13 <> 0),
    w AS (SELECT vec_id, ch, s[1:CASE WHEN vec_id % 11 = 0 THEN (len(s) - 1) // ch * ch ELSE len(s) // ch * ch END] AS s FROM v),
    t AS (SELECT vec_id, k AS second, s[k * 10 * ch + 1:(k + 1) * 10 * ch] AS s, ch FROM (SELECT *, unnest(range(0, CAST(ceil(len(s) / (10.0 * ch)) AS BIGINT))) AS k FROM w))"""


def _seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = F.transform("embedding", lambda x: F.floor(x.cast("double") * 127).cast("int"))
    files = read(spark, sf_dir, "embeddings").select("vec_id", _wave(F.col("vec_id"), values).alias("content"))
    path = named_files.named_in_shared(files, "sound", F.format_string("%d.wav", "vec_id"), "content")
    return audio.read_waves(spark, path, partitionBytes="100").withColumn("vec_id", F.substring_index("file", ".", 1).cast("long"))


@_query(f"""WITH {_SAMPLES}
    SELECT vec_id, second, len(s) AS n_samples, round(sqrt(list_sum(list_transform(s, lambda x: x * x * 65536.0)) / len(s)), 6) AS rms, CAST(list_max(list_transform(s, lambda x: abs(x) * 256)) AS DOUBLE) AS peak, len(s) = 10 * ch AS whole, NULL AS error FROM t
    UNION ALL SELECT vec_id, NULL, NULL, NULL, NULL, NULL, CASE WHEN vec_id % 13 = 0 THEN 'not RIFF/WAVE' ELSE 'truncated' END FROM embeddings WHERE vec_id % 13 = 0 OR vec_id % 11 = 0""")
def sound_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The loudness of each second; files are cut into shares of some hundred bytes."""
    return _seconds(spark, sf_dir).select("vec_id", "second", "n_samples", F.round("rms", 6).alias("rms"), "peak", "whole", "error")


@_query(f"""WITH {_SAMPLES}, q AS (SELECT e.label, sqrt(list_sum(list_transform(s, lambda x: x * x * 65536.0)) / len(s)) < 3500 AS quiet FROM t JOIN embeddings e USING (vec_id) WHERE len(s) = 10 * ch)
    SELECT label, count(*) AS n_seconds, count(*) FILTER (quiet) AS n_silent, avg(CAST(quiet AS INT)) AS silent, CASE WHEN avg(CAST(quiet AS INT)) > 0.3 THEN 2.0 ELSE 1.0 END::DOUBLE AS threshold FROM q GROUP BY label""")
def sound_silence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of silent seconds of all files of a label."""
    labels = read(spark, sf_dir, "embeddings").select("vec_id", "label")
    return audio.silence(_seconds(spark, sf_dir).join(labels, "vec_id"), ["label"], 3500.0)
