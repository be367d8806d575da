"""Parsers, archives, pages, writers and streams."""

from __future__ import annotations

import io
import json
import zipfile

from pyspark.sql import functions as F

from linewright.functions.text import stamp_to_ms
from linewright.sources import books, html, sinks, specs, subtitles
from linewright.streaming import runs

TRACK = "1\n00:00:01,000 --> 00:00:02,000\n<i>Hi</i> &amp; bye\n42\n\n2\n00:00:03.500 --> 00:00:04,000\n\n\nKind: captions\n\n00:00:05,000 --> 00:00:06,000\nno index\n"


def parsed(spark, dialect):
    return [(r.idx, r.start_ms, r.text) for r in subtitles.parse(spark.createDataFrame([("t", TRACK)], "track string, text string"), ["track"], dialect=dialect).orderBy("pos").collect()]


def test_dialects(spark):
    assert parsed(spark, "captions") == [(1, 1000, "Hi & bye 42"), (None, 5000, "no index")]
    assert parsed(spark, "merge") == [(1, 1000, "<i>Hi</i> &amp; bye"), (None, 5000, "no index")]
    assert parsed(spark, "gaps") == [(1, 1000, "<i>Hi</i> &amp; bye 42"), (2, 3500, "")]
    assert parsed(spark, "patch") == [(1, 1000, "<i>Hi</i> &amp; bye\n42")]


def test_parse_does_each_step_once(spark):
    tracks = spark.createDataFrame([("t", TRACK)], "track string, text string")
    for dialect in subtitles.DIALECTS:
        plan = subtitles.parse(tracks, ["track"], dialect=dialect)._jdf.queryExecution().optimizedPlan().toString()
        # blocks, lines, a stamp line, two stamps, decoded lines
        assert plan.count("split(") <= 6
    stamps = ["1:02:03,004 x", "12345678:00:01.000", "02:03,5", " 99:59:59.999", "a 1:2:03:04,005"]
    found = spark.createDataFrame([(i, x) for i, x in enumerate(stamps)], "i int, s string").select("i", stamp_to_ms(F.col("s")).alias("ms")).orderBy("i").collect()
    assert [r.ms for r in found] == [3_723_004, 1000, None, 359_999_999, 7_384_005]


def test_round_trip(spark, tmp_path):
    cues = spark.createDataFrame([("t", 0, 0, 900, "a"), ("t", 1, 1000, 3_600_000, "b")], "track_id string, pos int, start_ms long, end_ms long, text string")
    subtitles.write_tracks(cues, ["track_id"], ["pos"], str(tmp_path / "out"))
    back = subtitles.read_tracks(spark, str(tmp_path / "out"), "gaps").orderBy("pos").collect()
    assert [(r.start_ms, r.end_ms, r.text) for r in back] == [(0, 900, "a"), (1000, 3_600_000, "b")]
    two = subtitles.format_tracks(cues.withColumn("zh", F.lit("z")), ["track_id"], ["pos"], "zh").first()
    assert two.n_cues == 2 and two.text.startswith("1\n00:00:00,000 --> 00:00:00,900\na\nz\n\n2\n")
    assert subtitles.plain_text(spark.createDataFrame([("t", TRACK)], "track string, text string"), ["track"]).first().text == "<i>Hi</i> &amp; bye\nno index"


def test_log(spark):
    lines = [{"type": "user", "message": {"content": "q"}}, {"message": {"role": "assistant", "content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}]}}]
    rows = spark.createDataFrame([("c", i, json.dumps(x)) for i, x in enumerate(lines)] + [("c", 9, "not json")], "conv string, n int, line string")
    assert [(r.role, r.text) for r in specs.parse_log(rows, ["conv"], "n").orderBy("line_no").collect()] == [("user", "q"), ("assistant", "a\nb")]


def test_corrections(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps({"replacements": [{"wrong": "a", "correct": "b", "context": "c"}]}))
    assert tuple(specs.read_corrections(spark, str(tmp_path / "d.json")).first()) == (0, "a", "b", "c")


def book() -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<rootfile full-path="OEBPS/c.opf"/>')
        z.writestr("OEBPS/c.opf", '<dc:title>A &amp; B</dc:title><item id="x" href="b%20c.xhtml"/><item id="y" href="a.xhtml"/><itemref idref="x"/><itemref idref="y"/><itemref idref="none"/>')
        z.writestr("OEBPS/toc.ncx", '<text>One</text></navLabel><content src="b%20c.xhtml#p"/>')
        z.writestr("OEBPS/b c.xhtml", "<p>Hello&nbsp;you</p>")
        z.writestr("OEBPS/a.xhtml", "<p>Two</p>")
    return out.getvalue()


def test_books(spark):
    files = spark.createDataFrame([("a.epub", bytearray(book())), ("b.epub", bytearray(b"junk"))], "path string, content binary")
    found = books.members(files)
    assert {(r.path, r.status) for r in books.preflight(found).collect()} == {("a.epub", "ok"), ("b.epub", "unreadable")}
    assert books.metadata(books.package(found)).first()["metadata"] == {"title": ["A & B"]}
    assert [(r.title, r.file) for r in books.chapters(found).orderBy("index").collect()] == [("One", "OEBPS/b c.xhtml"), ("(untitled-1)", "OEBPS/a.xhtml")]
    lines = spark.createDataFrame([("b", "a\fb\nc")], "book string, text string")
    assert [r.line for r in books.book_lines(lines, ["book"]).orderBy("pos").collect()] == ["ab", "c"]


def test_pages(spark):
    page = '<html><head><title>T</title><meta name="author" content="Me"></head><body><h2>H</h2><p>a &lt; b</p><script>x</script><a href="/courses/c/lesson/1">1</a><a href="/courses/c/lesson/1">1</a></body></html>'
    df = spark.createDataFrame([(1, page)], "id int, html string")
    assert tuple(html.article(df, ["id"]).select("title", "author", "description").first()) == ("T", "Me", None)
    assert [(r.kind, r.text) for r in html.body_blocks(df, ["id"]).orderBy("pos").collect()] == [("heading", "H"), ("text", "a < b")]
    assert df.select(html.text_of(F.col("html"))).first()[0] == "H\na < b\n11"
    assert df.select(html.lesson_paths(F.col("html"), "c")).first()[0] == ["/courses/c/lesson/1"]
    assert [r[0] for r in spark.createDataFrame([("https://x/status/12",), ("34",), ("y",)], "u string").select(html.status_id(F.col("u"))).collect()] == ["12", "34", None]
    lesson = spark.createDataFrame([(1, '<title>F</title><script id="__NEXT_DATA__">{"props":{"pageProps":{"lesson":{"duration":7}}}}</script>')], "id int, html string")
    assert tuple(html.lesson(lesson, ["id"]).first()) == (1, "F", 7, None)


def test_sinks(spark):
    notes = spark.createDataFrame([("b", 2, "Two", "x-02-two.md"), ("b", 1, "One", "x-01-one.md")], "book string, number int, title string, file string")
    assert sinks.index_table(notes, ["book"]).first().text.endswith("| 1 | [One](x-01-one.md) |\n| 2 | [Two](x-02-two.md) |")
    assert json.loads(sinks.job_config(notes.select("book", "number"), ["book"]).first().config)["batches"] == [{"number": 1}, {"number": 2}]
    assert notes.select(sinks.prompt("{n}: {t}", n=F.col("number"), t=F.col("title"))).first()[0] == "2: Two"
    assert notes.select(sinks.note_name("x", F.col("number"), F.col("title"))).first()[0] == "x-02-two"


def test_streams(spark, tmp_path):
    lines = [("t", i, x) for i, x in enumerate("aaaab")]
    spark.createDataFrame(lines, "track_id string, pos long, text string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("track_id string, pos long, text string").parquet(str(tmp_path / "in"))
    query = runs.collapse_runs(stream).writeStream.format("memory").queryName("collapsed").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    query.processAllAvailable()
    query.stop()
    assert [r.text for r in spark.table("collapsed").orderBy("pos").collect()] == ["a", "a", "b"]


def test_texts_leave_in_slices(monkeypatch, spark):
    import pyarrow as pa

    from linewright.functions import unescape

    monkeypatch.setattr(unescape, "_SLICE", 5)
    texts = pa.array(["a", None, "bcdefgh", "", "ij"])
    assert unescape.mapped(texts, str.upper).to_pylist() == ["A", None, "BCDEFGH", "", "IJ"]
    assert unescape.mapped(pa.array([], pa.string()), str.upper).to_pylist() == []
    rows = spark.createDataFrame([("ä ßa",), (None,)], "t string")
    native = rows.select(unescape.converter({"ä": "ae", "ß": "ss"})(F.col("t")).alias("t"))
    assert "Python" not in native._jdf.queryExecution().optimizedPlan().toString()
    assert [r.t for r in native.collect()] == ["ae ssa", None]
    # entries that may meet are still read from left to right
    met = rows.select(unescape.converter({"ä": "ß", "ß": "x", "a": "b"})(F.col("t")).alias("t"))
    assert [r.t for r in met.collect()] == ["ß xb", None]
    assert not unescape._apart({"ab": "x", "bc": "y"}) and not unescape._apart({"aa": "x"}) and unescape._apart({"ab": "x", "cd": "y"})
