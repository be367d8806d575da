"""Queries that write files and read them again: subtitle files, named files, logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import logs, named_files, subtitle_files, subtitles
from .catalogue import _CLOCKED, _ORDER, _STAMPS, _clocked, _query
from .rendered import _KEPT, _TRACKS, _tracks
from .tables import CUES, read

_FOUND = " UNION ALL ".join(
    f"SELECT '{d}' AS dialect, track_id || '.vtt' AS file, CAST(row_number() OVER (PARTITION BY track_id ORDER BY no) AS INT) AS pos, CAST(idx AS INT) AS idx, s AS start_ms, e AS end_ms, {t} AS text, NULL AS error FROM r WHERE {w}"
    for d, (t, w) in _KEPT.items()
)
_NONE = " UNION ALL ".join(f"SELECT '{d}', 'bad-' || event_type || '.vtt', NULL, NULL, NULL, NULL, NULL, 'no cues' FROM (SELECT DISTINCT event_type FROM cues)" for d in _KEPT)


@_query(f"WITH {_TRACKS}, f AS ({_FOUND}) SELECT * FROM f UNION ALL {_NONE}")
def subtitle_files_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks written as files, and files without cues, read in every dialect; parts of 2,000 bytes cut the longer ones."""
    tracks = _tracks(spark, sf_dir).select(F.concat("track_id", F.lit(".vtt")).alias("name"), "text")
    bad = read(spark, sf_dir, "events").select(F.concat(F.lit("bad-"), "event_type", F.lit(".vtt")).alias("name"), F.concat(F.lit("1\n"), "event_type").alias("text")).distinct()
    path = named_files.named_in_shared(tracks.unionByName(bad), "tracks", F.col("name"))
    found = [subtitle_files.read_subtitles(spark, path, d, partitionBytes="2000").drop("lines").withColumn("dialect", F.lit(d)) for d in _KEPT]
    return reduce(DataFrame.unionByName, found)


@_query(f"WITH {CUES}, {_CLOCKED} SELECT event_type || '/' || track_id || '.srt' AS file, string_agg(event_id || chr(10) || {_STAMPS} || chr(10) || text, chr(10) || chr(10) ORDER BY event_id) || chr(10) AS text FROM k GROUP BY event_type, track_id")
def named_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each track, in a folder for each type, whose cues keep their own numbers."""
    written = subtitles.format_tracks(_clocked(spark, sf_dir), ["event_type", "track_id"], _ORDER, number="event_id")
    path = named_files.named_in_shared(written, "named", F.format_string("%s/%s.srt", "event_type", "track_id"))
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    return files.select(F.concat_ws("/", F.slice(F.split(F.col("_metadata.file_path"), "/"), -2, 2)).alias("file"), F.col("value").alias("text"))


@_query("""WITH l AS (SELECT *, row_number() OVER (PARTITION BY conv_id // 20 ORDER BY conv_id, turn) AS line_no FROM conversations)
    SELECT 'log-' || conv_id // 20 || '.jsonl' AS file, line_no, CASE WHEN turn % 4 = 3 THEN 'user' ELSE role END AS role,
           CASE WHEN turn % 4 = 3 THEN left('[{"id":' || conv_id || ',"note":"' || repeat('x', 5000) || '"}]', 4000) ELSE text END AS text
    FROM l WHERE turn % 4 <> 2 AND (turn % 4 <> 0 OR role IN ('user', 'assistant')) AND (turn % 4 = 3 OR text IS NOT NULL)""")
def log_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs of twenty conversations a file: texts, blocks, broken lines, and lists without a text."""
    turns = read(spark, sf_dir, "conversations")
    typed = F.to_json(F.struct(F.col("role").alias("type"), F.struct(F.col("text").alias("content")).alias("message")))
    listed = F.to_json(F.struct(F.struct("role", F.array(F.struct(F.lit("text").alias("type"), "text")).alias("content")).alias("message")))
    other = F.to_json(F.struct(F.lit("user").alias("type"), F.struct(F.array(F.struct(F.col("conv_id").alias("id"), F.repeat(F.lit("x"), F.lit(5000)).alias("note"))).alias("content")).alias("message")))
    line = F.when(F.col("turn") % 4 == 0, typed).when(F.col("turn") % 4 == 1, listed).when(F.col("turn") % 4 == 2, "{broken").otherwise(other)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("conv_id", "turn", line.alias("line")))), lambda x: x["line"])
    files = turns.groupBy(F.floor(F.col("conv_id") / 20).alias("part")).agg(F.array_join(ordered, "\n").alias("text"))
    path = named_files.named_in_shared(files, "logs", F.format_string("log-%d.jsonl", "part"))
    return logs.read_logs(spark, path)
