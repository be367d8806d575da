"""Texts and tables that are written: job configurations, notes, an index, transcripts, status lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import slug


def job_config(batches: DataFrame, by: list[str]) -> DataFrame:
    """A JSON text for each track with its batches in order."""
    rest = [c for c in batches.columns if c not in by]
    jobs = F.array_sort(F.collect_list(F.struct(*rest)))
    return batches.groupBy(*by).agg(F.to_json(F.struct(F.count("*").alias("n_batches"), jobs.alias("batches"))).alias("config"))


def prompt(template: str, **values: Column) -> Column:
    """A template with ``{name}`` places filled from columns."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def note_name(prefix: str, number: Column, title: Column) -> Column:
    """File name of a note: prefix, two-digit number and slug."""
    return F.concat_ws("-", F.lit(prefix), F.format_string("%02d", number), slug(title))


def index_table(notes: DataFrame, by: list[str], number: str = "number", title: str = "title", file: str = "file") -> DataFrame:
    """A Markdown table of notes by number; files of several prefixes are an error."""
    kept = notes.withColumn("_prefix", F.regexp_extract(file, r"^(.*?)-\d+", 1))
    row = F.format_string("| %d | [%s](%s) |", number, title, file)
    rows = F.transform(F.array_sort(F.collect_list(F.struct(number, row.alias("row")))), lambda x: x["row"])
    out = kept.groupBy(*by).agg(F.count_distinct("_prefix").alias("_n"), rows.alias("_rows"))
    checked = F.when(F.col("_n") <= 1, F.concat(F.lit("| # | Chapter |\n|---|---|\n"), F.array_join("_rows", "\n"))).otherwise(F.raise_error(F.lit("notes of several prefixes")).cast("string"))
    return out.select(*by, checked.alias("text"))


def transcript(lessons: DataFrame, by: list[str], order: str, title: str = "title", text: str = "text", placeholder: str = "(no captions)") -> DataFrame:
    """Sections in order, a placeholder where a text is missing."""
    part = F.concat(F.lit("## "), F.coalesce(title, F.lit("")), F.lit("\n\n"), F.coalesce(F.nullif(F.trim(text), F.lit("")), F.lit(placeholder)))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, part.alias("p")))), lambda x: x["p"]), "\n\n")
    return lessons.groupBy(*by).agg(joined.alias("text"), F.count_if(F.trim(F.coalesce(text, F.lit(""))) != "").alias("n_filled"), F.sum(F.length(F.coalesce(text, F.lit("")))).alias("n_chars"))


def status_lines(df: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    """``KEY=value`` lines for each row."""
    return df.select(*by, F.concat_ws("\n", *(F.concat(F.lit(f"{n.upper()}="), F.coalesce(F.col(n).cast("string"), F.lit(""))) for n in names)).alias("text"))


def write_parts(df: DataFrame, keys: list[str], path: str) -> None:
    """Texts in folders named by their keys."""
    df.select(*keys, "text").write.partitionBy(*keys).mode("overwrite").text(path)
