"""Conversation logs and replies: which of several attempts counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_wins(df: DataFrame, key: list[str], order: list[str], values: list[str]) -> DataFrame:
    """Of the rows of a key the values of the last in ``order`` (made unique by its last column)."""
    best = F.max_by(F.struct(*values), F.struct(*order)).alias("_v")
    return df.groupBy(*key).agg(best).select(*key, *(F.col(f"_v.{v}").alias(v) for v in values))


def fill_missing(df: DataFrame, key: list[str], task_order: list[str], values: list[str]) -> DataFrame:
    """Of the rows of a key those of the earliest task: later tasks only fill what is missing."""
    best = F.min_by(F.struct(*values), F.struct(*task_order)).alias("_v")
    return df.groupBy(*key).agg(best).select(*key, *(F.col(f"_v.{v}").alias(v) for v in values))


def longest_wins(df: DataFrame, key: list[str], order: str, text: str, values: list[str]) -> DataFrame:
    """Of the rows of a key the longest text, the earliest of equals."""
    best = F.max_by(F.struct(*values), F.struct(F.length(text), -F.col(order))).alias("_v")
    return df.groupBy(*key).agg(best).select(*key, *(F.col(f"_v.{v}").alias(v) for v in values))


def first_and_last(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """First user text and last assistant text of every conversation."""
    mine = lambda who: F.when(F.col(role) == who, F.struct(turn, text))
    return df.groupBy(conv).agg(F.min(mine("user"))[text].alias("first_user"), F.max(mine("assistant"))[text].alias("last_assistant"), F.count_if(F.col(role) == "assistant").alias("n_assistant"))


def rekey(df: DataFrame, index: str) -> DataFrame:
    """The index from zero over the whole set."""
    return df.withColumn(index, F.col(index) - df.agg(F.min(index)).scalar())


def task_filter(df: DataFrame, prompt: str, wanted: str, text: str, least_chars: int = 500) -> DataFrame:
    """Why a task's log is skipped, null if it counts, and its batch number."""
    number = F.regexp_extract(prompt, r"(?:batch|gap)_(\d+)\.", 1)
    reason = F.when(~F.col(prompt).contains(wanted), "other job").when(number == "", "no batch number").when(F.length(F.coalesce(text, F.lit(""))) < least_chars, "too short")
    return df.withColumns({"batch_num": F.when(number != "", number.cast("int")), "skip_reason": reason})


def split_sections(df: DataFrame, text: str, words: tuple[str, ...] = ("Ch", "Seg"), shift: int = 10_000) -> DataFrame:
    """One row for each numbered first-level heading in a reply; numbers of the second kind lie ``shift`` higher."""
    heading = rf"(?m)(?=^#\s+(?:{'|'.join(words)})\s*\d+\s*[:：])"
    parts = df.select("*", F.posexplode(F.split(F.col(text), heading)).alias("part", "section"))
    kind = F.regexp_extract("section", rf"^#\s+({'|'.join(words)})\s*(\d+)\s*[:：]", 1)
    number = F.regexp_extract("section", rf"^#\s+({'|'.join(words)})\s*(\d+)\s*[:：]", 2)
    return parts.where(number != "").withColumn("number", number.cast("int") + F.when(kind == words[-1], shift).otherwise(0)).drop("part")


def keyed_captions(df: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """Captions inside replies: number, stamp line and text of every block that has all three."""
    body = F.regexp_replace(F.col(text), r"(?m)^\s*```[a-z]*\s*$", "")
    blocks = df.select(*key, F.posexplode(F.split(body, r"\n\s*\n")).alias("block_no", "block"))
    pattern = r"(?s)^\s*(\d+)\s*\n([^\n]*-->[^\n]*)\n(.*\S)\s*$"
    part = lambda i: F.regexp_extract("block", pattern, i)
    return blocks.where(F.col("block").rlike(pattern)).select(*key, "block_no", part(1).cast("int").alias("number"), F.trim(part(2)).alias("stamps"), part(3).alias("caption"))


def json_field(document: Column, path: str) -> Column:
    """A field of an open-schema JSON text; null if it is absent or the text isn't JSON."""
    return F.try_variant_get(F.try_parse_json(document), path, "string")
