"""Queries of parsers and writers: their inputs are rendered from the test tables, so that SQL can say what must come out."""

from __future__ import annotations

import io
import zipfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from ..functions import text as T
from ..functions import unescape
from ..operators import checks, replies
from ..operators import sequences as S
from ..sources import books, html, sinks, specs, subtitles
from .catalogue import _CLOCKED, _ORDER, _STAMPS, _clocked, _query
from .tables import CUES, cues, read

_BODY = "</i> &amp;lt; &eacute;&#8217;"
_TRACKS = f"""{CUES}, {_CLOCKED}, r AS (SELECT track_id, no, s, e, CASE WHEN event_id % 4 <> 0 THEN no END AS idx, event_id % 5 = 0 AS point, text AS t,
    CASE WHEN event_id % 3 <> 0 THEN '<i>' || text || '{_BODY}' END AS body, CASE WHEN event_id % 3 <> 0 THEN text || ' &lt; é’' END AS clean, CASE WHEN event_id % 7 = 0 THEN '42' END AS num FROM k)"""


def _tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks with markup, entities, points in stamps, numeric lines, and cues without index or text."""
    every = {n: F.col("event_id") % n == 0 for n in (3, 4, 5, 7)}
    stamps = F.concat(T.ms_to_stamp(F.col("start_ms")), F.lit(" --> "), T.ms_to_stamp(F.col("end_ms")))
    numbered = _clocked(spark, sf_dir).withColumn("no", F.row_number().over(Window.partitionBy("track_id").orderBy(*_ORDER)))
    block = F.concat_ws("\n", F.when(~every[4], F.col("no").cast("string")), F.when(every[5], F.replace(stamps, F.lit(","), F.lit("."))).otherwise(stamps), F.when(~every[3], F.concat(F.lit("<i>"), "text", F.lit(_BODY))), F.when(every[7], "42"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("no", block.alias("block")))), lambda x: x["block"])
    return numbered.groupBy("track_id").agg(F.concat(F.lit("WEBVTT\nKind: captions\n\n"), F.array_join(ordered, "\n\n")).alias("text"))


#: What each dialect makes of the rendered tracks: its text and which cues it keeps.
_KEPT = {
    "captions": ("concat_ws(' ', clean, num)", "concat_ws(' ', clean, num) <> ''"),
    "merge": ("body", "NOT point AND body IS NOT NULL"),
    "lines": ("concat_ws(chr(10), body, num)", "idx IS NOT NULL"),
    "gaps": ("concat_ws(' ', body, num)", "idx IS NOT NULL"),
    "patch": ("concat_ws(chr(10), body, num)", "idx IS NOT NULL AND concat_ws('', body, num) <> ''"),
    "segments": ("concat_ws(' ', body, num)", "concat_ws('', body, num) <> ''"),
    "texts": ("concat_ws(' ', body, num)", "NOT point AND CASE WHEN idx IS NULL THEN body IS NOT NULL AND num IS NOT NULL ELSE concat_ws('', body, num) <> '' END"),
}


@_query(f"WITH {_TRACKS} " + " UNION ALL ".join(f"SELECT '{d}' AS dialect, track_id, CAST(row_number() OVER (PARTITION BY track_id ORDER BY no) AS INT) AS pos, CAST(idx AS INT) AS idx, s AS start_ms, e AS end_ms, {t} AS text FROM r WHERE {w}" for d, (t, w) in _KEPT.items()))
def parse_dialects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every dialect of the parser on the same tracks."""
    # tracks are rendered once for all dialects; by a number of their own (the same one would be planned away), as
    # adaptive execution reads so small a shuffle in a task or two, and the union does all dialects in those
    tracks, out = _tracks(spark, sf_dir).repartition(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), "track_id"), None
    for dialect in _KEPT:
        found = subtitles.parse(tracks, ["track_id"], dialect=dialect).select(F.lit(dialect).alias("dialect"), "track_id", "pos", "idx", "start_ms", "end_ms", "text")
        out = found if out is None else out.unionByName(found)
    return out


@_query(f"WITH {_TRACKS} SELECT track_id, string_agg(body, chr(10) ORDER BY no) AS text FROM r WHERE body IS NOT NULL GROUP BY track_id")
def plain_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subtitles.plain_text(_tracks(spark, sf_dir), ["track_id"])


@_query(f"WITH {CUES}, {_CLOCKED} SELECT track_id, string_agg(no || chr(10) || {_STAMPS} || chr(10) || text || chr(10) || event_type, chr(10) || chr(10) ORDER BY no) || chr(10) AS text FROM k GROUP BY track_id")
def two_line_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subtitles.format_tracks(_clocked(spark, sf_dir), ["track_id"], _ORDER, second="event_type").drop("n_cues")


@_query(f"WITH {CUES}, {_CLOCKED} SELECT event_id, CAST(no AS INT) AS number, {_STAMPS} AS stamps, text || chr(10) || 'x' AS caption FROM k")
def reply_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reply for each cue: a fence, its block and a block without stamps."""
    numbered = _clocked(spark, sf_dir).withColumn("no", F.row_number().over(Window.partitionBy("track_id").orderBy(*_ORDER)).cast("string"))
    reply = F.concat(F.lit("```srt\n"), "no", F.lit("\n"), T.ms_to_stamp(F.col("start_ms")), F.lit(" --> "), T.ms_to_stamp(F.col("end_ms")), F.lit("\n"), "text", F.lit("\nx\n\n7\nno stamps\n```"))
    return replies.keyed_captions(numbered.withColumn("text", reply), ["event_id"]).drop("block_no")


_RULES = {"either": "turn % 3 = 1 OR turn % 3 = 0 AND role IN ('user', 'assistant')", "type": "turn % 3 = 0 AND role IN ('user', 'assistant')", "message": "turn % 3 = 1"}


@_query(" UNION ALL ".join(f"SELECT '{rule}' AS rule, conv_id, turn AS line_no, role, text FROM conversations WHERE text IS NOT NULL AND ({w})" for rule, w in _RULES.items()))
def log_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines with a type and a text, with a role and blocks, and broken ones, by each rule for the role."""
    turns = read(spark, sf_dir, "conversations")
    typed = F.to_json(F.struct(F.col("role").alias("type"), F.struct(F.col("text").alias("content")).alias("message")))
    listed = F.to_json(F.struct(F.struct("role", F.array(F.struct(F.lit("text").alias("type"), "text")).alias("content")).alias("message")))
    logs = turns.select("conv_id", "turn", F.when(F.col("turn") % 3 == 0, typed).when(F.col("turn") % 3 == 1, listed).otherwise("{broken").alias("line"))
    out = None
    for rule in _RULES:
        found = specs.parse_log(logs, ["conv_id"], "turn", rule=rule).select(F.lit(rule).alias("rule"), "conv_id", "line_no", "role", "text")
        out = found if out is None else out.unionByName(found)
    return out


@_query("SELECT n_regionkey AS region, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS INT) AS ord, n_name AS wrong, CASE WHEN n_nationkey % 7 <> 0 THEN 'N=' || n_nationkey ELSE '' END AS correct FROM nation QUALIFY n_nationkey % 7 <> 0")
def pair_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pair list for each region, with pairs that lack a side."""
    pair = F.concat(F.lit(" "), "n_name", F.when(F.col("n_nationkey") % 5 == 0, " = ").otherwise("="), F.when(F.col("n_nationkey") % 7 != 0, F.concat(F.lit("N="), F.col("n_nationkey").cast("string"))).otherwise(""))
    spec = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", pair.alias("p")))), lambda x: x["p"]), ";")
    lists = read(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(spec.alias("spec"))
    return specs.parse_pairs(lists, by=["region"])


@_query("SELECT 'dir:x/' || o_orderkey || '.srt' AS path, CAST(CAST((o_orderkey % 50 + 1) || '.5' AS DOUBLE) * 1000 AS BIGINT) * CASE WHEN o_orderkey % 2 = 0 THEN -1 ELSE 1 END AS offset_ms, CASE WHEN o_orderkey % 3 = 0 THEN 12250 ELSE 0 END AS skip_ms FROM orders WHERE o_orderkey % 11 <> 0")
def patch_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    spec = F.concat(F.lit("dir:x/"), key.cast("string"), F.lit(".srt:"), F.when(key % 2 == 0, "-").otherwise(""), (key % 50 + 1).cast("string"), F.lit(".5"), F.when(key % 3 == 0, ":12.25").otherwise(""))
    return specs.parse_patches(read(spark, sf_dir, "orders").select(F.when(key % 11 == 0, "dir:x/none.srt:soon").otherwise(spec).alias("spec")))


@_query("SELECT o_custkey, 'part_' || o_orderkey || '.txt' AS path, CAST(o_orderkey AS INT) AS number, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INT) AS place FROM orders WHERE o_orderstatus <> 'F'")
def numbered_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files in the order of the numbers in their names."""
    path = F.concat(F.when(F.col("o_orderstatus") == "F", "other_").otherwise("part_"), F.col("o_orderkey").cast("string"), F.lit(".txt"))
    found = specs.numbered_files(read(spark, sf_dir, "orders").select("o_custkey", path.alias("path")), r"^part_(\d+)\.txt$")
    return found.withColumn("place", F.row_number().over(Window.partitionBy("o_custkey").orderBy("number")))


@_query("""WITH f AS (SELECT o_custkey, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS priority, o_orderstatus || '/' || o_orderkey AS path FROM orders)
    SELECT o_custkey, path FROM f QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY priority, path) = 1""")
def preferred_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.col("o_orderstatus")
    files = read(spark, sf_dir, "orders").select("o_custkey", F.when(status == "F", 0).when(status == "O", 1).otherwise(2).alias("priority"), F.concat_ws("/", status, F.col("o_orderkey").cast("string")).alias("path"))
    return specs.preferred_files(files, ["o_custkey"])


_PACKAGE = """<dc:title>A &amp; &eacute;</dc:title><dc:creator>One</dc:creator><dc:creator id="x"> Two </dc:creator><dc:creator>One</dc:creator>
<item id="a" href="one%20a.xhtml"/><item id="b" href="b.xhtml"/><itemref idref="b"/><itemref idref="none"/><itemref idref="a"/>"""
_CONTENTS = """<navPoint><navLabel><text>First</text></navLabel><content src="one%20a.xhtml#x"/></navPoint>
<navPoint><navLabel><text>Last &amp; &eacute;</text></navLabel><content src="one%20a.xhtml"/></navPoint>"""


@F.arrow_udf(BinaryType())
def _archive(first: pa.Array, second: pa.Array) -> pa.Array:
    """A small archive for each two pages."""

    def made(a: str, b: str) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, text in (("META-INF/container.xml", '<rootfile full-path="OEBPS/c.opf"/>'), ("OEBPS/c.opf", _PACKAGE), ("OEBPS/t.ncx", _CONTENTS), ("OEBPS/one a.xhtml", a), ("OEBPS/b.xhtml", b), ("OEBPS/x.png", "x")):
                z.writestr(name, text)
        return out.getvalue()

    return pa.array((made(a.as_py(), b.as_py()) for a, b in zip(first, second, strict=True)), pa.binary(), size=len(first))


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The members of a book for each document; every fifth archive can't be read."""
    doc = F.col("doc_id")
    first = F.concat(F.lit("<html><head><title>x</title></head><body><p>"), "lang", F.lit(" &eacute;</p><script>y</script><p> "), "source", F.lit("</p></body></html>"))
    second = F.when(doc % 3 == 0, "<p> </p>").otherwise(F.concat(F.lit("<h1>only "), doc.cast("string"), F.lit("</h1>")))
    files = read(spark, sf_dir, "documents").select(doc.cast("string").alias("path"), F.when(doc % 5 == 0, F.lit("no archive").cast("binary")).otherwise(_archive(first, second)).alias("content"))
    return books.members(files)


@_query("SELECT CAST(doc_id AS VARCHAR) AS path, CASE WHEN doc_id % 5 = 0 THEN 'unreadable' ELSE 'ok' END AS status, CASE WHEN doc_id % 5 = 0 THEN 0 ELSE 5 END AS n_members FROM documents")
def book_preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return books.preflight(_members(spark, sf_dir)).select("path", "status", "n_members")


@_query("SELECT CAST(doc_id AS VARCHAR) AS path, 'A & é' AS title, 'One;Two' AS creators, 2 AS fields FROM documents WHERE doc_id % 5 <> 0")
def book_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = books.metadata(books.package(_members(spark, sf_dir)))
    return found.select("path", F.col("metadata")["title"][0].alias("title"), F.array_join(F.col("metadata")["creator"], ";").alias("creators"), F.size("metadata").alias("fields"))


@_query("""WITH b AS (SELECT CAST(doc_id AS VARCHAR) AS path, * FROM documents WHERE doc_id % 5 <> 0),
    c AS (SELECT path, 0 AS index, 'OEBPS/b.xhtml' AS file, '(untitled-0)' AS title, 'only ' || doc_id AS text FROM b WHERE doc_id % 3 <> 0
          UNION ALL SELECT path, 2, 'OEBPS/one a.xhtml', 'Last & é', lang || ' é' || chr(10) || source FROM b)
    SELECT *, octet_length(encode(text)) AS size FROM c""")
def book_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return books.chapters(_members(spark, sf_dir))


@_query("SELECT CAST(doc_id AS VARCHAR) AS path, 'OEBPS/one a.xhtml' AS member, 'First' AS title FROM documents WHERE doc_id % 5 <> 0")
def book_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a member's entries in the table of contents the first."""
    return books.contents(_members(spark, sf_dir), keep="first")


_ARTICLE = """'<html><head>' || CASE WHEN page_id % 3 = 0 THEN '<meta property="og:title" content="T' || page_id || '">' ELSE '' END || '<title>no</title><meta name="author" content="A&B"><meta name="description" content="' || url || '">'
    || CASE WHEN page_id % 2 = 0 THEN '<meta property="article:published_time" content="2024">' ELSE '<script>{"publish_time": "17"}</script>' END || '</head><body><h1> H' || page_id || ' </h1></body></html>'"""


@_query(f"""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'T' ELSE 'H' END || page_id AS title, 'A&B' AS author, CASE WHEN page_id % 2 = 0 THEN '2024' ELSE '17' END AS published, url AS description, left(md5({_ARTICLE}), 10) AS name FROM pages""")
def article_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.col("page_id")
    text = F.concat(
        F.lit("<html><head>"),
        F.when(page % 3 == 0, F.format_string('<meta property="og:title" content="T%d">', page)).otherwise(""),
        F.format_string('<title>no</title><meta name="author" content="A&B"><meta name="description" content="%s">\n    ', "url"),
        F.when(page % 2 == 0, '<meta property="article:published_time" content="2024">').otherwise('<script>{"publish_time": "17"}</script>'),
        F.format_string("</head><body><h1> H%d </h1></body></html>", page),
    )
    found = html.article(read(spark, sf_dir, "pages").withColumn("html", F.replace(text, F.lit("\n    "), F.lit(""))), ["page_id"])
    return found.drop("nickname", "day")


@_query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url ELSE 'F' || page_id END AS title, CASE WHEN page_id % 2 = 0 THEN page_id * 60 END AS duration_sec, CASE WHEN page_id % 2 = 0 THEN 'c \" é' END AS captions, CAST(page_id AS VARCHAR) AS status, '/courses/ml/lesson/' || page_id || ',/courses/ml/lesson/b' AS paths FROM pages")
def lesson_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.col("page_id")
    lesson = F.struct(F.col("url").alias("title"), (page * 60).alias("duration"))
    blob = F.to_json(F.struct(F.struct(F.struct(lesson.alias("lesson"), F.lit('c " é').alias("captions")).alias("pageProps")).alias("props")))
    data = F.when(page % 2 == 0, F.concat(F.lit('<script id="__NEXT_DATA__" type="x">'), blob, F.lit("</script>"))).otherwise("")
    links = F.format_string('<a href="/courses/ml/lesson/%d?x=1">x</a><a href="/courses/ml/lesson/b#y">y</a><a href="/courses/ml/lesson/%d">z</a><a href="/courses/no/lesson/q">q</a>', page, page)
    rows = read(spark, sf_dir, "pages").select("page_id", F.concat(F.format_string("<title> F%d </title>", page), data, links).alias("html"))
    status = html.status_id(F.when(page % 3 == 0, page.cast("string")).otherwise(F.format_string("https://h.example.org/u/status/%d?s=20", page)))
    others = rows.select("page_id", status.alias("status"), F.array_join(html.lesson_paths(F.col("html"), "ml"), ",").alias("paths"))
    return html.lesson(rows, ["page_id"]).join(others, "page_id")


_TABLE = {"ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss", "ñ": "ny", "é": "e"}


@_query("SELECT doc_id, " + "".join("replace(" for _ in _TABLE) + "text" + "".join(f", '{a}', '{b}')" for a, b in _TABLE.items()) + " AS text FROM documents")
def converted_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", unescape.converter(_TABLE)(F.col("text")).alias("text"))


@_query("SELECT doc_id, 'w' || doc_id || ' ' || lang || ' ' || source || ' end' AS text FROM documents")
def inner_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four words of each document, said once, then from the second on, then twice more, are said once."""
    words = F.concat_ws(" ", F.concat(F.lit("w"), F.col("doc_id").cast("string")), "lang", "source", F.lit("end"))
    said = F.concat_ws(" ", words, F.concat_ws(" ", "lang", "source", F.lit("end")), words, words)
    return read(spark, sf_dir, "documents").select("doc_id", unescape.drop_inner_repeats(said).alias("text"))


@_query("""WITH m AS (SELECT o_custkey, o_orderkey AS pos, CASE WHEN o_orderkey % 3 = 0 THEN 'number' ELSE 'letter' END AS kind, chr(CAST(65 + o_orderkey % 4 AS INT)) AS label FROM orders)
    SELECT o_custkey, label, pos, min(CASE WHEN kind = 'number' OR label IN ('A', 'C') THEN pos END) OVER (PARTITION BY o_custkey ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS "end" FROM m QUALIFY kind = 'letter' AND label IN ('A', 'C')""")
def appendix_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    markers = read(spark, sf_dir, "orders").select("o_custkey", key.alias("pos"), F.when(key % 3 == 0, "number").otherwise("letter").alias("kind"), F.char(65 + key % 4).alias("label"))
    return S.appendix_ends(markers, ["o_custkey"], ["A", "C"])


@_query("""WITH c AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'T' ELSE '(untitled-' || o_orderkey || ')' END AS title FROM orders)
    SELECT * FROM c QUALIFY o_orderkey <= max(CASE WHEN title = 'T' THEN o_orderkey END) OVER (PARTITION BY o_custkey)""")
def trailing_untitled(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    chapters = read(spark, sf_dir, "orders").select("o_custkey", key, F.when(key % 3 == 0, "T").otherwise(F.format_string("(untitled-%d)", key)).alias("title"))
    return S.drop_trailing_untitled(chapters, ["o_custkey"], "o_orderkey")


@_query("""WITH s AS (SELECT label, sqrt(list_sum(list_transform(embedding[1:16], lambda x: CAST(x AS DOUBLE) * x)) / 16) < 0.12 AS quiet FROM embeddings)
    SELECT label, avg(CAST(quiet AS INT)) AS silent, CASE WHEN avg(CAST(quiet AS INT)) > 0.3 THEN 2.0 ELSE 1.0 END::DOUBLE AS threshold FROM s GROUP BY label""")
def silent_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 16 numbers of each vector stand for the samples of a second."""
    rows = read(spark, sf_dir, "embeddings").select("label", F.slice("embedding", 1, 16).alias("samples"))
    return checks.silent_share(rows, ["label"], level=0.12)


@_query("""SELECT o_custkey, '{"n_batches":' || count(*) || ',"batches":[' || string_agg('{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}', ',' ORDER BY o_orderkey) || ']}' AS config FROM orders GROUP BY o_custkey""")
def job_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.job_config(read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), ["o_custkey"])


@_query("""WITH f AS (SELECT *, 'notes-' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') || '-' || trim(regexp_replace(lower(n_name), '[^a-z0-9]+', '-', 'g'), '-') AS file FROM nation)
    SELECT n_regionkey, '| # | Chapter |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || n_nationkey || ' | [' || n_name || '](' || file || ') |', chr(10) ORDER BY n_nationkey) AS text FROM f GROUP BY n_regionkey""")
def note_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = read(spark, sf_dir, "nation").withColumn("file", sinks.note_name("notes", F.col("n_nationkey"), F.col("n_name")))
    return sinks.index_table(notes, ["n_regionkey"], "n_nationkey", "n_name")


@_query("SELECT s_suppkey, 'Write to ' || s_name || ' in ' || s_nationkey || ', ' || s_name || '. {rest}' AS prompt, 'S_NAME=' || s_name || chr(10) || 'S_NATIONKEY=' || s_nationkey AS text FROM supplier")
def prompts_and_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "supplier")
    prompt = sinks.prompt("Write to {name} in {nation}, {name}. {rest}", name=F.col("s_name"), nation=F.col("s_nationkey"))
    return sinks.status_lines(rows.withColumn("prompt", prompt), ["s_suppkey", "prompt"], ["s_name", "s_nationkey"])


_MIXED = "CASE WHEN doc_id % 2 = 0 THEN repeat('中', doc_id % 7) || 'abcdefghij' || lang ELSE repeat('a', 3600) || repeat('中', 1000) END"


@_query("SELECT doc_id, doc_id % 2 = 0 AND (doc_id % 7) > 0.15 * (doc_id % 7 + 10 + length(lang)) AS is_han FROM documents")
def han_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short mixed texts, and long ones whose Han characters stand behind the first 4,096 bytes for the most part."""
    return read(spark, sf_dir, "documents").select("doc_id", T.is_han(F.expr(_MIXED)).alias("is_han"))
