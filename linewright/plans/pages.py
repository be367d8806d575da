"""Queries of pages with nested blocks, article fields in all their places, and book members as laid out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import html
from .catalogue import _query
from .tables import read

def _nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a quotation of two paragraphs, a list in a list, paragraphs without end, and text outside the body."""
    page = F.col("page_id").cast("string")
    parts = [
        F.lit("<title>no</title><p>before</p><div class=x id='body'><h2 class=\"a>b\">T"), page, F.lit("</h2><blockquote> <p>"), F.col("url"),
        F.lit("</p><p>q&amp;"), page, F.lit("</p>tail</blockquote><ul><li>a"), page, F.lit("<ul><li>b</li></ul>c <b>&lt;d&gt;</b></li><li>e<li>f</ul><p>x<!-- <p>gone</p> --><p>y<script>'<p>'</script><br/>z"),
        F.when(F.col("page_id") % 2 == 0, "</p>").otherwise(""), F.lit("</div><p>after</p>"),
    ]
    return read(spark, sf_dir, "pages").select("page_id", F.concat(*parts).alias("html"))


_OWN = ["'heading', 'T' || page_id", "'quote', url", "'quote', 'q&' || page_id", "'quote', 'tail'", "'text', 'a' || page_id", "'text', 'b'", "'text', 'c <d>'", "'text', 'e'", "'text', 'f'", "'text', 'x'", "'text', 'y z'"]
_WHOLE = ["'heading', 'T' || page_id", "'quote', url || ' q&' || page_id || ' tail'", "'text', url", "'text', 'q&' || page_id", "'text', 'a' || page_id || ' b c <d>'", "'text', 'b'", "'text', 'e'", "'text', 'f'", "'text', 'x'", "'text', 'y z'"]


@_query(" UNION ALL ".join(f"SELECT '{way}' AS nested, page_id, {i} AS pos, k AS kind, t AS text FROM (SELECT page_id, {x.replace(', ', ' AS k, ', 1)} AS t FROM pages)" for way, rows in (("own", _OWN), ("whole", _WHOLE)) for i, x in enumerate(rows)))
def nested_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks of the body element alone, each text once, and each block whole."""
    pages = _nested(spark, sf_dir)
    own, whole = (html.body_blocks(pages, ["page_id"], nested=way, inside="body").withColumn("nested", F.lit(way)) for way in ("own", "whole"))
    return own.unionByName(whole)


@_query("""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'T' || page_id WHEN page_id % 3 = 1 THEN 'M' || page_id ELSE 'H' || page_id END AS title,
           CASE WHEN page_id % 4 = 0 THEN 'N' || page_id WHEN page_id % 4 = 1 THEN 'n' || page_id END AS nickname,
           CASE WHEN page_id % 5 > 0 THEN strftime(make_timestamp((1700000000 + page_id * 40000) * 1000000), '%Y-%m-%d') END AS day, left(md5(url), 10) AS name FROM pages""")
def article_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles, nicknames and dates in each of their places, and the digest of the address."""
    page = F.col("page_id")
    text = F.concat(
        F.when(page % 3 == 0, F.format_string('<meta property="og:title" content="T%d" />', page)).otherwise(""),
        F.when(page % 3 < 2, F.format_string("<script>var msg_title = 'M%d';</script>", page)).otherwise(""),
        F.when(page % 4 == 0, F.format_string('<script>var nickname = htmlDecode("N%d");</script>', page)).otherwise(""),
        F.when(page % 4 < 2, F.format_string('<script>var nickname = "n%d";</script>', page)).otherwise(""),
        F.when(page % 5 > 0, F.format_string('<script>var ct = "%d";</script>', 1_700_000_000 + page * 40_000)).otherwise('<script>var ct = "soon";</script>'),
        F.format_string("<h1>H%d</h1>", page),
    )
    return html.article(read(spark, sf_dir, "pages").withColumn("html", text), ["page_id"], url="url").select("page_id", "title", "nickname", "day", "name")


@_query("""SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text FROM (
        SELECT doc_id, generate_subscripts(l, 1) AS pos, unnest(l) AS line FROM (
            SELECT doc_id, list_filter(list_transform(string_split(replace(text, chr(13), chr(10)), chr(10)), lambda x: regexp_replace(x, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')), lambda x: x <> '') || ['lang: ' || lang || ' é & <' || source] AS l FROM documents))
    GROUP BY doc_id""".replace("\\\\", "\\"))
def member_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents laid out as a book's member; tags leave no trace, not even a line's end."""
    escaped = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    page = F.concat(F.lit("<html>\n<body class='x'><p>"), escaped, F.lit("</p>\n\n <p>lang"), F.lit("</p>: <i>"), "lang", F.lit("</i> &eacute; &amp; &lt;"), "source", F.lit("\r\n</body></html>"))
    return read(spark, sf_dir, "documents").select("doc_id", html.member_text(page).alias("text"))
