"""Small inputs given as text: correction pairs, patch lists, selections; logs of conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_corrections(spark: SparkSession, path: str) -> DataFrame:
    """(ord, wrong, correct, context) of a JSON dictionary with ``replacements``."""
    schema = "replacements array<struct<wrong:string,correct:string,context:string>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    return rows.select(F.posexplode("replacements").alias("ord", "r")).select("ord", "r.*")


def parse_pairs(df: DataFrame, spec: str = "spec", separators: str = r"[,|;\n]", empty_correct: bool = False, strict: bool = False, by: list[str] | None = None) -> DataFrame:
    """(ord, wrong, correct) of pair lists such as ``a=b;c=d``, after the columns ``by``; a colon stands in where no ``=`` is.

    Pairs without both sides go, unless ``empty_correct`` lets the right side be
    empty; with ``strict`` a malformed pair is an error.
    """
    by = by or []
    each = df.select(*by, F.posexplode(F.split(F.col(spec), separators)).alias("ord", "pair")).withColumn("pair", F.trim("pair")).where("pair <> '' and pair not like '#%'")
    sign = F.when(F.col("pair").contains("="), "=").otherwise(":")
    at = F.locate("=", F.col("pair"))
    at = F.when(at > 0, at).otherwise(F.locate(":", F.col("pair")))
    parts = each.withColumns({"_at": at, "_sign": sign}).withColumns({"wrong": F.when(F.col("_at") > 0, F.trim(F.substr("pair", F.lit(1), F.col("_at") - 1))), "correct": F.when(F.col("_at") > 0, F.trim(F.substr("pair", F.col("_at") + 1)))})
    good = F.coalesce((F.col("wrong") != "") & (F.lit(empty_correct) | (F.col("correct") != "")), F.lit(False))
    if strict:
        good = F.when(good, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("malformed pair: "), "pair")).cast("boolean"))
    return parts.where(good).select(*by, "ord", "wrong", "correct")


def checked_pairs(df: DataFrame, spec: str = "spec", separators: str = r"[,|;\n]", by: list[str] | None = None, most: int = 30) -> DataFrame:
    """:func:`parse_pairs` for lists that are to be applied, where silence would hide a mistake.

    A list that has text but no pair is an error, and so is a right side of over
    ``most`` characters that holds ``;`` or ``|``, as a list cut at the wrong signs has.
    """
    by = by or []
    sign = lambda x: F.when(F.contains(x, F.lit("=")), F.lit("=")).otherwise(F.lit(":"))
    at = lambda x: F.call_function("locate", sign(x), x)
    side = lambda x, i: F.trim(F.substr(x, F.lit(1), at(x) - 1)) if i == 0 else F.trim(F.substr(x, at(x) + 1))
    cut = F.transform(F.split(F.col(spec), separators), lambda x, i: F.struct(i.alias("ord"), F.when(at(x) > 0, side(x, 0)).alias("wrong"), F.when(at(x) > 0, side(x, 1)).alias("correct")))
    kept = F.filter(cut, lambda p: F.coalesce((p["wrong"] != "") & (p["correct"] != ""), F.lit(False)))
    polluted = F.exists(kept, lambda p: p["correct"].rlike("[;|]") & (F.length(p["correct"]) > most))
    none = F.col(spec).rlike(r"\S") & (F.size(kept) == 0)
    fail = lambda why: F.raise_error(F.concat(F.lit(why), F.left(F.col(spec), F.lit(120)))).cast(kept_type)
    kept_type = "array<struct<ord:int,wrong:string,correct:string>>"
    guarded = F.when(none, fail("no pair in: ")).when(polluted, fail("a right side holds separators: ")).otherwise(kept)
    return df.select(*by, F.explode(guarded).alias("_p")).select(*by, "_p.*")


def parse_patches(df: DataFrame, spec: str = "spec") -> DataFrame:
    """(path, offset_ms, skip_ms) of ``PATH:OFFSET[:SKIP]``; offset and skip are seconds."""
    pattern = r"^(.+?):(-?\d+(?:\.\d+)?)(?::(\d+(?:\.\d+)?))?$"
    ms = lambda i: F.round(F.coalesce(F.nullif(F.regexp_extract(spec, pattern, i), F.lit("")), F.lit("0")).cast("double") * 1000).cast("long")
    return df.where(F.col(spec).rlike(pattern)).select(F.regexp_extract(spec, pattern, 1).alias("path"), ms(2).alias("offset_ms"), ms(3).alias("skip_ms"))


def selected_numbers(spec: Column) -> Column:
    """The numbers of ``1,3,7-9``."""
    part = lambda x, i: F.split(x, "-")[i].cast("int")
    return F.array_distinct(F.flatten(F.transform(F.filter(F.split(F.regexp_replace(spec, r"\s", ""), ","), lambda x: x.rlike(r"^\d+(-\d+)?$")), lambda x: F.when(F.contains(x, F.lit("-")), F.when(part(x, 1) >= part(x, 0), F.sequence(part(x, 0), F.greatest(part(x, 0), part(x, 1)))).otherwise(F.array().cast("array<int>"))).otherwise(F.array(x.cast("int"))))))


def select_chapters(chapters: DataFrame, spec: str, label: str = "label") -> DataFrame:
    """Chapters whose number is in the selection; those with letters stay always."""
    wanted = selected_numbers(F.lit(spec))
    return chapters.where(~F.col(label).rlike(r"^\d+$") | F.array_contains(wanted, F.col(label).try_cast("int")))


def parse_log(df: DataFrame, by: list[str], line_no: str, line: str = "line", rule: str = "either", fallback: int | None = None) -> DataFrame:
    """(line_no, role, text) of a log of JSON lines.

    The content is a text or a list of text blocks; lines that aren't JSON go.  A
    user's list without any text block gives its first ``fallback`` characters as
    JSON, where that is set.
    The role is the top-level type (``rule`` "type"), the message's ("message"),
    or the former and, where that is none, the latter ("either").
    """
    rows = df.select(*by, F.col(line_no).alias("line_no"), F.try_parse_json(line).alias("_v")).where("_v is not null")
    kind = F.try_variant_get("_v", "$.type", "string")
    typed, said = F.when(kind.isin("user", "assistant"), kind), F.try_variant_get("_v", "$.message.role", "string")
    role = {"type": typed, "message": said, "either": F.coalesce(typed, said)}[rule]
    listed = F.try_variant_get("_v", "$.message.content", "array<variant>")
    block = lambda x: F.coalesce(F.try_variant_get(x, "$.text", "string"), F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")))
    content = F.try_variant_get("_v", "$.message.content", "variant")
    said_blocks = F.array_compact(F.transform(listed, block))
    text = F.when(F.schema_of_variant(content) == "STRING", F.try_variant_get("_v", "$.message.content", "string"))
    if fallback is not None:
        text = text.when((role == "user") & (F.size(said_blocks) == 0), F.left(F.to_json(content), F.lit(fallback)))
    text = text.otherwise(F.array_join(said_blocks, "\n"))
    return rows.select(*by, "line_no", role.alias("role"), text.alias("text")).where("role is not null and text is not null")


def preferred_files(files: DataFrame, by: list[str], priority: str = "priority") -> DataFrame:
    """Of a key's files those of the first pattern that found any, by name."""
    best = files.groupBy(*by).agg(F.min(F.struct(priority, "path")).alias("b"))
    return best.select(*by, "b.path")


def numbered_files(df: DataFrame, pattern: str, path: str = "path") -> DataFrame:
    """Files whose name matches, with the number that the pattern captures."""
    return df.where(F.col(path).rlike(pattern)).withColumn("number", F.regexp_extract(path, pattern, 1).cast("int"))
