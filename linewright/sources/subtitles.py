"""Subtitle tracks: one parser whose options stand for the dialects, and writers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import ms_to_stamp, stamp_to_ms, without_speaker_marks, without_tags
from ..functions.unescape import unescape_html


@dataclass(frozen=True)
class Dialect:
    """What a parser accepts and keeps."""

    blank_separator: bool = True  # blocks are separated by lines of white space, not only empty ones
    point_stamps: bool = True
    needs_index: bool = False
    least_lines: int = 0
    keep_empty: bool = False
    drop_numeric_lines: bool = False
    clean_markup: bool = False
    joiner: str = "\n"


#: The dialects by what they are used for.
DIALECTS = {
    "captions": Dialect(clean_markup=True, joiner=" "),
    "merge": Dialect(point_stamps=False, drop_numeric_lines=True, joiner=" "),
    "lines": Dialect(needs_index=True, keep_empty=True),
    "gaps": Dialect(needs_index=True, keep_empty=True, joiner=" "),
    "patch": Dialect(needs_index=True, least_lines=3),
    "segments": Dialect(joiner=" "),
    "texts": Dialect(point_stamps=False, least_lines=3, joiner=" "),
}


def _lines(block: Column) -> Column:
    return F.transform(F.split(block, "\n"), lambda x: F.trim(F.replace(x, F.lit("\r"), F.lit(""))))


def blocks(text: Column, blank: bool = True) -> Column:
    """The blocks of a track that hold a stamp line."""
    return F.filter(F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), r"\n\s*\n" if blank else r"\n\n+"), lambda b: F.contains(b, F.lit("-->")))


def parse(df: DataFrame, by: list[str], text: str = "text", dialect: str | Dialect = "captions") -> DataFrame:
    """track columns, pos, idx, start_ms, end_ms, text and lines of every cue."""
    d = DIALECTS[dialect] if isinstance(dialect, str) else dialect
    cut = df.select(*by, F.posexplode(blocks(F.col(text), d.blank_separator)).alias("block_no", "block"))
    # each step's values are bound in an array of one and filtered there: filters on columns would be
    # pushed below the steps and do all of their work again, for each use of a value
    step = F.transform(F.array("block"), _lines)
    step = F.transform(step, lambda x: F.struct(x.alias("lines"), F.array_position(F.transform(x, lambda y: F.contains(y, F.lit("-->"))), True).cast("int").alias("at")))
    step = F.transform(step, lambda x: F.struct(
        F.size(F.filter(x["lines"], lambda y: y != "")).alias("n"),
        F.when(x["at"] > 1, F.get(x["lines"], x["at"] - 2)).alias("index"),
        F.split(F.get(x["lines"], x["at"] - 1), "-->").alias("stamps"),
        F.filter(F.slice(x["lines"], x["at"] + 1, F.size(x["lines"])), lambda y: (y != "") & ~y.rlike(r"^\d+$") if d.drop_numeric_lines else y != "").alias("lines"),
    ))
    step = F.transform(step, lambda x: F.struct(
        F.when(x["index"].rlike(r"^\d+$"), x["index"].cast("int")).alias("idx"),
        stamp_to_ms(F.get(x["stamps"], F.lit(0))).alias("start_ms"),
        stamp_to_ms(F.get(x["stamps"], F.lit(1))).alias("end_ms"),
        # of captions tags go before entities are decoded, so that decoded signs stay
        F.array_join(F.transform(x["lines"], without_tags), "\n").alias("text") if d.clean_markup else F.array_join(x["lines"], d.joiner).alias("text"),
        *([] if d.clean_markup else [x["lines"].alias("lines")]),
        x["n"].alias("n"),
        F.slice(x["stamps"], 1, 2).alias("stamps"),
    ))

    def kept(x: Column) -> Column:
        found = x["start_ms"].isNotNull() & x["end_ms"].isNotNull()
        if not d.point_stamps:
            found &= F.forall(x["stamps"], lambda y: F.contains(y, F.lit(",")))
        if d.needs_index:
            found &= x["idx"].isNotNull()
        if d.least_lines:
            found &= x["n"] >= d.least_lines
        return found if d.keep_empty else found & (x["text"] != "")

    cues = cut.select(*by, "block_no", F.inline(F.filter(step, kept)))
    if d.clean_markup:
        cues = cues.withColumn("_decoded", unescape_html("text"))
        step = F.transform(F.array("_decoded"), lambda x: F.filter(F.transform(F.split(x, "\n"), without_speaker_marks), lambda y: ~y.rlike(r"^(?:Kind|Language):") & (y != "")))
        step = F.transform(step, lambda x: F.struct(F.array_join(x, d.joiner).alias("text"), x.alias("lines")))
        cues = cues.select(*by, "block_no", "idx", "start_ms", "end_ms", F.inline(step if d.keep_empty else F.filter(step, lambda x: x["text"] != "")))
    return cues.withColumn("pos", F.row_number().over(Window.partitionBy(*by).orderBy("block_no"))).select(*by, "pos", "idx", "start_ms", "end_ms", "text", "lines")


def read_tracks(spark: SparkSession, path: str, dialect: str | Dialect = "captions") -> DataFrame:
    """Cues of all subtitle files below a path; a track is a file's path."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("track_id"), F.col("value").alias("text"))
    return parse(files, ["track_id"], dialect=dialect)


def plain_text(df: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    """A track without numbers and stamps, a line for each cue."""
    return parse(df, by, text, Dialect(drop_numeric_lines=True, joiner=" ")).groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n").alias("text"))


def format_tracks(cues: DataFrame, by: list[str], order: list[str], second: str | None = None, number: str | None = None) -> DataFrame:
    """The text of each track in subtitle format; ``second`` adds a line below each text.

    Cues are numbered from 1, or keep the numbers of the column ``number``, by
    which they are then ordered first.
    """
    w = Window.partitionBy(*by).orderBy(*([number] if number else []), *order)
    parts = [F.col(number or "_no").cast("string"), F.concat(ms_to_stamp(F.col("start_ms")), F.lit(" --> "), ms_to_stamp(F.col("end_ms"))), F.coalesce("text", F.lit(""))]
    if second:
        parts.append(F.coalesce(second, F.lit("")))
    block = cues.withColumn("_no", F.row_number().over(w)).withColumn("_block", F.concat_ws("\n", *parts))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_no", "_block"))), lambda x: x["_block"]), "\n\n")
    return block.groupBy(*by).agg(F.concat(joined, F.lit("\n")).alias("text"), F.count("*").alias("n_cues"))


def write_tracks(cues: DataFrame, by: list[str], order: list[str], path: str, second: str | None = None) -> None:
    """One folder of subtitle text for each track, named by the track's columns."""
    format_tracks(cues, by, order, second).drop("n_cues").write.partitionBy(*by).mode("overwrite").text(path)
