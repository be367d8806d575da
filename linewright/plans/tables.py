"""Views of the test tables as tracks of ordered records, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every document: doc_id, pos from 0, line."""
    return read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


LINES = "lines AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos, unnest(string_split(text, chr(10))) AS line FROM documents)"


def cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as cues: a track for each type and day, so that no track grows with the table's time span."""
    events = read(spark, sf_dir, "events")
    start = F.unix_millis(F.col("ts").cast("timestamp"))
    track = F.concat_ws("-", "event_type", F.date_format("ts", "yyyy-MM-dd"))
    return events.select(track.alias("track_id"), "event_id", "user_id", start.alias("start_ms"), (start + F.floor(F.col("value") * 1000)).alias("end_ms"), F.concat(F.col("event_type"), F.lit(" "), F.col("user_id").cast("string")).alias("text"), "event_type", "props")


CUES = "cues AS (SELECT event_type || '-' || strftime(ts, '%Y-%m-%d') AS track_id, event_id, user_id, epoch_us(ts) // 1000 AS start_ms, epoch_us(ts) // 1000 + CAST(floor(value * 1000) AS BIGINT) AS end_ms, event_type || ' ' || user_id AS text, event_type, props FROM events)"
