"""Queries of variants: fences, remarks, titles, pair lists, risky patterns, chapter presets, archives without a spine."""

from __future__ import annotations

import io
import zipfile
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from ..functions import text as T
from ..operators import checks
from ..sources import books, named_files, specs
from .catalogue import _query
from .tables import read


@_query("""SELECT doc_id, 'a' || replace(replace(text, '`', ''), chr(10), chr(10) || '  ') || 'z' AS marks, 'before' || chr(10) || lang || ' ' || source || chr(10) || '```' || chr(10) || 'after' AS wrapped,
           replace(text, '`', '') || 'kept' AS remarks FROM documents""")
def reply_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as replies: marks everywhere, a wrapper with a second closing fence, and remarks before and after."""
    plain = F.replace("text", F.lit("`"), F.lit(""))
    marks = F.concat(F.lit("```srt   a"), F.replace(plain, F.lit("\n"), F.lit("\n  ```  \n  ")), F.lit("z  ```"))
    # a line of marks alone leaves an empty line, which goes with it here
    cleaned = F.replace(T.without_fence_marks(marks), F.lit("\n\n  "), F.lit("\n  "))
    wrapped = T.without_wrapper(F.concat(F.lit(" before\n```markdown  \n"), "lang", F.lit(" "), "source", F.lit("\n``` \n\n```\nafter \n")))
    remarks = T.without_meta_remarks(F.concat(F.lit("Wait, that is wrong.\nI NOTICE an error: let me redo it\n以下是修正後的版本\n"), plain, F.lit("翻譯完成。\nkept")))
    return read(spark, sf_dir, "documents").select("doc_id", cleaned.alias("marks"), wrapped.alias("wrapped"), remarks.alias("remarks"))


@_query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN lang || ' 標題' WHEN 1 THEN source WHEN 2 THEN 'note of ' || lang ELSE 'x' END AS title FROM documents""")
def note_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles after a dash, from the first heading, from the file's name, and a dash without anything after it."""
    kind = F.col("doc_id") % 4
    text = F.when(kind == 0, F.concat(F.lit("# Ch1: no\n## plain\n  ## — \n ## A — "), "lang", F.lit(" 標題 \n## B — second")))
    text = text.when(kind == 1, F.concat(F.lit("intro\n## dash —\n# Ch12:  "), "source", F.lit("  \n# Ch13: second"))).when(kind == 2, F.concat(F.repeat(F.lit("line\n"), F.lit(500)), F.lit("# Ch1: too late"))).otherwise("## x")
    name = F.when(kind == 2, F.concat(F.lit("note-of-"), "lang", F.lit("--"))).otherwise("x")
    return read(spark, sf_dir, "documents").select("doc_id", T.chapter_title(text, name).alias("title"))


@_query("""SELECT 'checked' AS kind, n_nationkey, k.ord, k.wrong, n_name AS correct FROM nation, (VALUES (0, 'a'), (3, 'b:c')) k(ord, wrong)
    UNION ALL SELECT 'empty', n_nationkey, k.ord, k.wrong, CASE WHEN k.ord = 1 THEN '' ELSE n_name END FROM nation, (VALUES (0, 'a,x'), (1, 'b')) k(ord, wrong)
    UNION ALL SELECT 'strict', n_nationkey, k.ord, k.wrong, n_name || ';' FROM nation, (VALUES (1, 'a'), (3, 'b')) k(ord, wrong)""")
def pair_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists to be applied, lists that may delete, and files of one pair a line with comments."""
    nation, name = read(spark, sf_dir, "nation"), F.col("n_name")
    rows = nation.select(
        "n_nationkey",
        F.concat(F.lit(" a = "), name, F.lit("|none;=x,b:c="), name, F.lit("\n")).alias("checked"),
        F.concat(F.lit("a,x="), name, F.lit(";b:;=y;nothing\n")).alias("empty"),
        F.concat(F.lit("# comment = x\na="), name, F.lit(";\n\nb="), name, F.lit(";")).alias("strict"),
    )
    checked = specs.checked_pairs(rows, "checked", by=["n_nationkey"])
    empty = specs.parse_pairs(rows, "empty", r"[;\n]", empty_correct=True, by=["n_nationkey"])
    strict = specs.parse_pairs(rows, "strict", r"\n", strict=True, by=["n_nationkey"])
    return reduce(DataFrame.unionByName, (d.select(F.lit(k).alias("kind"), "n_nationkey", "ord", "wrong", "correct") for k, d in (("checked", checked), ("empty", empty), ("strict", strict))))


@_query("""WITH p AS (SELECT * FROM (VALUES (false, 0, 'the', 'THE', NULL), (false, 1, 'qqqq', 'x', NULL), (false, 2, 'der', 'DER', NULL), (true, 0, 'in', 'on', 'short word'), (true, 1, 'zzzz', 'x', 'rare')) t(risky, ord, wrong, correct, note)),
    c AS (SELECT p.*, sum((length(text) - length(replace(text, wrong, ''))) // length(wrong)) AS n FROM p, documents GROUP BY ALL)
    SELECT risky, ord, wrong, correct, CAST(n AS BIGINT) AS n, note, CASE WHEN NOT risky THEN 'the=THE,der=DER' END AS spec FROM c WHERE n > 0""")
def risky_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns to apply and patterns to verify, and the list of the former."""
    pairs = spark.createDataFrame([(0, "the", "THE"), (1, "qqqq", "x"), (2, "der", "DER")], "ord int, wrong string, correct string")
    risky = spark.createDataFrame([(0, "in", "on", "short word"), (1, "zzzz", "x", "rare")], "ord int, wrong string, correct string, note string")
    found = checks.scan_patterns(read(spark, sf_dir, "documents"), pairs, risky)
    return found.join(checks.pair_spec(found, ["risky"]), "risky", "left")


_HEADS = {"english": "'  CHAPTER 12 '", "chinese-numbered": "' 第 3 章 x'", "chinese-section": "'CH4-1 x'", "incerto": "'7    LIMIT DISTRIBUTIONS'"}
_NUMBERS = {"english": 12, "chinese-numbered": 3, "chinese-section": 4, "incerto": 7}


@_query(" UNION ALL ".join(f"SELECT '{p}' AS preset, doc_id, 0 AS section, NULL AS number, NULL AS heading, CAST(len(string_split(text, chr(10))) AS INT) AS n_lines, text FROM documents UNION ALL SELECT '{p}', doc_id, 1, {_NUMBERS[p]}, {h}, 2, {h} || chr(10) || lang FROM documents" for p, h in _HEADS.items()))
def marked_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents before a chapter of each preset's kind; form feeds end no line."""
    docs = read(spark, sf_dir, "documents")
    found = [books.marked_chapters(docs.select("doc_id", F.concat("text", F.lit("\n"), F.expr(h), F.lit("\n\f"), "lang").alias("text")), ["doc_id"], p).select(F.lit(p).alias("preset"), "doc_id", "section", "number", "heading", "n_lines", "text") for p, h in _HEADS.items()]
    return reduce(DataFrame.unionByName, found)


@F.pandas_udf(BinaryType())
def _loose(texts: pd.Series) -> pd.Series:
    """Archives of pages without a package."""

    def made(text: str) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name in ("b.html", "toc.xhtml", "a.xhtml", "nav.html", "x.png"):
                z.writestr(name, f"<p>{name[0]} {text}</p>")
        return out.getvalue()

    return texts.map(made)


@_query("SELECT CAST(page_id AS VARCHAR) AS path, k AS index, f AS file, '(untitled-' || k || ')' AS title, left(f, 1) || ' ' || page_id AS text FROM pages, (VALUES (0, 'a.xhtml'), (1, 'b.html')) t(k, f)")
def book_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of archives without a package, by name, without tables of contents."""
    files = read(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("path"), _loose(F.col("page_id").cast("string")).alias("content"))
    return books.chapters(books.members(files)).drop("size")


@_query("SELECT n_regionkey AS region, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS INT) AS ord, n_name AS wrong, lower(n_name) AS correct, CASE WHEN n_nationkey % 2 = 0 THEN 'c' || n_nationkey END AS context FROM nation")
def correction_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dictionary file for each region, read by itself."""
    entry = F.struct(F.col("n_name").alias("wrong"), F.lower("n_name").alias("correct"), F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("c"), F.col("n_nationkey").cast("string"))).alias("context"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", entry.alias("e")))), lambda x: x["e"])
    rows = read(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.to_json(F.struct(listed.alias("replacements"))).alias("text"))
    path = named_files.named_in_shared(rows, "corrections", F.format_string("%d.json", "n_regionkey"))
    regions = [r["r_regionkey"] for r in read(spark, sf_dir, "region").select("r_regionkey").collect()]
    return reduce(DataFrame.unionByName, (specs.read_corrections(spark, f"{path}/{r}.json").withColumn("region", F.lit(r)) for r in regions))
