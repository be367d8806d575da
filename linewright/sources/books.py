"""Books: archives of XHTML chapters, and plain text with chapter markers."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import url_member
from ..functions.unescape import unescape_html
from ..operators.sequences import section_texts
from .html import text_of

#: Characters of members that leave a worker at once.
_SLICE = 1 << 20
#: Text members of an archive that are read.
TEXT_MEMBERS = (".opf", ".ncx", ".xml", ".xhtml", ".html", ".htm")


def members(files: DataFrame, content: str = "content") -> DataFrame:
    """(path, member, text, status) of every text member of each archive.

    An archive that can't be opened gives one row with the status
    ``unreadable``; a damaged member has no text and the status ``damaged``.
    """

    def texts_of(path: str, data: bytes) -> Iterator[tuple]:
        try:
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                for name in z.namelist():
                    if name.lower().endswith(TEXT_MEMBERS):
                        try:
                            yield path, name, z.read(name).decode("utf-8", "replace"), "ok"
                        except (zipfile.BadZipFile, OSError, ValueError, NotImplementedError, RuntimeError):
                            yield path, name, None, "damaged"
        except (zipfile.BadZipFile, OSError, ValueError):
            yield path, None, None, "unreadable"

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names=["path", "member", "text", "status"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for path, data in zip(*batch.columns, strict=True):
                for row in texts_of(path.as_py(), data.as_py()):
                    rows.append(row)
                    size += len(row[2] or "") + 100
                    if size >= _SLICE:  # so that a worker holds a slice, however many archives a batch has
                        yield packed(rows)
                        rows, size = [], 0
        if rows:
            yield packed(rows)

    return files.select("path", F.col(content).alias("content")).mapInArrow(run, "path string, member string, text string, status string")


def read_books(spark: SparkSession, path: str) -> DataFrame:
    """The text members of all archives below a path."""
    return members(spark.read.format("binaryFile").option("pathGlobFilter", "*.epub").load(path))


def preflight(found: DataFrame) -> DataFrame:
    """(path, status, n_members, damaged): ``ok``, ``damaged`` or ``unreadable``."""
    worst = F.when(F.count_if(F.col("status") == "unreadable") > 0, "unreadable").when(F.count_if(F.col("status") == "damaged") > 0, "damaged").otherwise("ok")
    return found.groupBy("path").agg(worst.alias("status"), F.count_if(F.col("status") == "ok").alias("n_members"), F.array_sort(F.collect_list(F.when(F.col("status") == "damaged", F.col("member")))).alias("damaged"))


METADATA = ("title", "creator", "language", "publisher", "date", "identifier")


def package(found: DataFrame) -> DataFrame:
    """(path, opf, folder, text) of each book's package document, as its container names it."""
    named = found.where(F.col("member").endswith("META-INF/container.xml")).select("path", F.regexp_extract("text", r'full-path="([^"]+)"', 1).alias("member"))
    rows = found.join(named, ["path", "member"])
    return rows.select("path", F.col("member").alias("opf"), F.when(F.col("member").contains("/"), F.regexp_replace("member", "/[^/]*$", "")).otherwise("").alias("folder"), "text")


def metadata(packages: DataFrame) -> DataFrame:
    """A map from each Dublin Core field to its distinct values in order."""
    values = lambda k: F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(rf"(?s)<dc:{k}\b[^>]*>(.*?)</dc:{k}>"), F.lit(1)), lambda x: F.trim(x)))
    plain = packages.withColumn("text", unescape_html("text"))
    return plain.select("path", F.map_filter(F.map_from_arrays(F.array(*map(F.lit, METADATA)), F.array(*map(values, METADATA))), lambda _, v: F.size(v) > 0).alias("metadata"))


def _tags(text, name: str):
    return F.regexp_extract_all(text, F.lit(rf"(?s)<{name}\b[^>]*>"), F.lit(0))


def _attribute(tag, name: str):
    return F.regexp_extract(tag, rf'\b{name}="([^"]*)"', 1)


def spine(packages: DataFrame) -> DataFrame:
    """(path, pos, member) in reading order; references that the manifest lacks go."""
    items = packages.select("path", "folder", F.explode(_tags("text", "item")).alias("tag")).select("path", _attribute("tag", "id").alias("idref"), url_member(_attribute("tag", "href"), F.col("folder")).alias("member"))
    order = packages.select("path", F.posexplode(_tags("text", "itemref")).alias("pos", "tag")).select("path", "pos", _attribute("tag", "idref").alias("idref"))
    return order.join(items, ["path", "idref"]).select("path", "pos", "member")


def contents(found: DataFrame, keep: str = "last") -> DataFrame:
    """(path, member, title) of the table of contents; of a member's entries the last or the first."""
    tables = found.where(F.lower("member").endswith(".ncx")).withColumn("folder", F.when(F.col("member").contains("/"), F.regexp_replace("member", "/[^/]*$", "")).otherwise(""))
    pattern = r"(?s)<text>(.*?)</text>.*?<content\b[^>]*\bsrc=\"([^\"]*)\""
    each = tables.select("path", "folder", F.posexplode(F.arrays_zip(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)).alias("title"), F.regexp_extract_all("text", F.lit(pattern), F.lit(2)).alias("src"))).alias("pos", "e"))
    each = each.select("path", "pos", url_member(F.col("e.src"), F.col("folder")).alias("member"), F.trim(unescape_html(F.col("e.title"))).alias("title"))
    pick = F.max_by if keep == "last" else F.min_by
    return each.groupBy("path", "member").agg(pick("title", "pos").alias("title"))


def chapters(found: DataFrame) -> DataFrame:
    """(path, index, file, title, text, size) in reading order; without a spine all pages but tables of contents by name."""
    packages = package(found)
    ordered = spine(packages)
    pages = found.where(F.col("status") == "ok").where(F.lower("member").rlike(r"\.x?html?$"))
    spare = pages.join(ordered, "path", "left_anti").where(~F.lower("member").rlike("toc|nav"))
    spare = spare.select("path", (F.row_number().over(Window.partitionBy("path").orderBy("member")) - 1).alias("pos"), "member")
    placed = ordered.unionByName(spare).join(pages.select("path", "member", "text"), ["path", "member"])
    titled = placed.join(contents(found), ["path", "member"], "left")
    body = text_of(F.col("text"))
    out = titled.select("path", F.col("pos").alias("index"), F.col("member").alias("file"), F.coalesce("title", F.format_string("(untitled-%d)", "pos")).alias("title"), body.alias("text"))
    return out.withColumn("size", F.octet_length("text").cast("long")).where("size > 0")


#: Chapter markers by preset (fixed values); the group, where there is one, is the chapter's number.
MARKERS = {
    "english": r"^\s*CHAPTER\s+(\d+)\s*$",
    "chinese-numbered": r"^\s*第\s*(\d+)\s*章(?![\p{L}\p{M}\p{N}_])",
    "chinese-section": r"^\s*CH(\d+)-1(?![\p{L}\p{M}\p{N}_])",
    "incerto": r"^\s*(\d+)\s{3,}[A-Z][A-Z\s,'\-\.]{5,}",
}
#: Headings of a book's larger chapters (fixed values).
GROUP_HEADS = r"^第[一二三四五六七八九十百千萬\d]+[章回卷部]|^(?i:Chapter)\s+\d+|^(?i:Part)\s+(?i:[IVXLCDM\d]+)"


def marked_chapters(df: DataFrame, by: list[str], preset: str, text: str = "text") -> DataFrame:
    """(section, number, heading, n_lines, text) of each book's text, cut at the lines that the preset marks; section 0 stands before the first."""
    cut = section_texts(book_lines(df, by, text), by, ["pos"], "line", MARKERS[preset])
    number = F.nullif(F.regexp_extract("heading", MARKERS[preset], 1), F.lit("")).try_cast("int")
    return cut.select(*by, "section", number.alias("number"), "heading", "n_lines", "text")


def book_lines(df: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    """(pos, line): form feeds go, and only line feeds end a line, so that numbers match the file's."""
    return df.select(*by, F.posexplode(F.split(F.replace(F.col(text), F.lit("\f"), F.lit("")), "\n")).alias("pos", "line"))
