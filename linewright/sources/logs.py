"""Logs as files: lines numbered exactly, however a file is split."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .specs import parse_log


def numbered_lines(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """(file, line_no from 1, line) of every line of the text files below ``path``.

    Spark reads long files in splits, whose lines don't know how many stand before
    them.  A first pass over the same scan counts the lines of each split; sums of
    these counts along a file (a row for each split) give every split the number of
    its first line; a second pass numbers the lines by their places in the split.
    Lines are not shuffled unless the counts outgrow Spark's broadcast threshold.
    The places come from Spark's row ids, which rise within a split; a row that does
    not fit the first pass's count is an error, never a wrong number.
    """
    read = spark.read.text(path, recursiveFileLookup=True, pathGlobFilter=f"*{suffix}")
    rows = read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_split"), F.monotonically_increasing_id().alias("_id"), F.col("value").alias("line"))
    counts = rows.groupBy("file", "_split").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("file").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    place = F.col("_id") - F.col("_first")
    number = F.when((place >= 0) & (place < F.col("_n")), F.col("_before") + place + 1).otherwise(F.raise_error(F.lit("the passes split a file in different ways")).cast("long"))
    return rows.join(starts, ["file", "_split"], "left").select(F.substring_index("file", "/", -1).alias("file"), number.alias("line_no"), "line")


def read_logs(spark: SparkSession, path: str, rule: str = "either", fallback: int | None = 4000, suffix: str = "") -> DataFrame:
    """(file, line_no, role, text) of logs of JSON lines below ``path``; see :func:`~.specs.parse_log`."""
    return parse_log(numbered_lines(spark, path, suffix), ["file"], "line_no", rule=rule, fallback=fallback)
