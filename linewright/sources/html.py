"""Web pages: metadata by first match, texts, lesson links and embedded JSON; blocks are found in :mod:`.markup`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import decode_entities_once, without_zero_width
from ..functions.unescape import unescape_html
from .markup import body_blocks, page_text, page_text_ended  # noqa: F401  (blocks are part of this module's interface)


def text_of(page: Column, full_entities: bool = True, ended: bool = False) -> Column:
    """A page's text: no scripts, styles, head or tags; block tags end lines; blank lines go. ``ended``: of entities those that end with a semicolon."""
    if full_entities:
        return page_text_ended(page) if ended else page_text(page)
    bare = F.regexp_replace(page, r"(?is)<(script|style|head)\b.*?</\1\s*>", "")
    lined = F.regexp_replace(bare, r"(?i)<(?:br|/?(?:p|div|h[1-6]|li|tr|blockquote))\b[^>]*>", "\n")
    return _trimmed_lines(decode_entities_once(F.regexp_replace(lined, r"(?s)<[^>]+>", "")))


def _trimmed_lines(text: Column) -> Column:
    return F.array_join(F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != ""), "\n")


def member_text(page: Column) -> Column:
    """The text of a book's member as it is laid out: tags go without a trace, and lines are those of the source."""
    plain = unescape_html(F.regexp_replace(page, r"(?s)<[^>]+>", ""))
    lines = F.transform(F.split(plain, r"\r\n|[\n\x0b\f\r\x1c-\x1e\x85\u2028\u2029]"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def grab(page: Column, *patterns: str) -> Column:
    """The first group of the first pattern that matches with any text in it."""
    return F.coalesce(*(F.nullif(F.trim(F.regexp_extract(page, p, 1)), F.lit("")) for p in patterns))


#: Where articles state their fields, in the order in which they are tried (fixed values).
TITLE = (r"""<meta property="og:title" content="([^"]+)\"""", r"var msg_title = '([^']+)'")
NICKNAME = (r"""var nickname = htmlDecode\("([^"]+)"\)""", r"""var nickname = "([^"]+)\"""")
EPOCH = r"""var ct = "(\d+)\""""


def article(df: DataFrame, by: list[str], html: str = "html", url: str | None = None) -> DataFrame:
    """title, author, nickname, published, day, description and name of an article.

    ``day`` is the date of the page's time in seconds, in the session's time zone.
    ``name`` is a digest of the address in the column ``url``, or of the page where
    there is none.
    """
    page = without_zero_width(F.col(html))
    meta = lambda k: rf'(?is)<meta[^>]*(?:name|property)="{k}"[^>]*content="([^"]*)"'
    title = grab(page, TITLE[0], meta("og:title"), TITLE[1], r"(?is)<h1[^>]*>(.*?)</h1>", r"(?is)<title[^>]*>(.*?)</title>")
    author = grab(page, meta("author"), meta("og:article:author"))
    day = F.date_format(F.timestamp_seconds(grab(page, EPOCH).try_cast("long")), "yyyy-MM-dd")
    fields = {"title": title, "author": author, "nickname": grab(page, *NICKNAME), "published": grab(page, meta("article:published_time"), r'"publish_time"\s*:\s*"?(\d+)'), "day": day, "description": grab(page, meta("description"), meta("og:description"))}
    return df.select(*by, *(c.alias(n) for n, c in fields.items()), F.left(F.md5(F.col(url) if url else page), F.lit(10)).alias("name"))


def status_id(url: Column) -> Column:
    """The number of a status in its address, or the text itself if it is a number."""
    return F.coalesce(F.nullif(F.regexp_extract(url, r"/status/(\d+)", 1), F.lit("")), F.when(url.rlike(r"^\d+$"), url))


def lesson_paths(html: Column, course: str) -> Column:
    """Distinct paths of a course's lessons in order of their first occurrence."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit(rf'href="(/courses/{course}/lesson/[^"#?]+)'), F.lit(1)))


def lesson(df: DataFrame, by: list[str], html: str = "html") -> DataFrame:
    """title, duration and captions from a page's embedded JSON, with fallbacks."""
    blob = F.try_parse_json(F.regexp_extract(F.col(html), r'(?s)<script id="__NEXT_DATA__"[^>]*>(.*?)</script>', 1))
    get = lambda path, kind: F.try_variant_get(blob, path, kind)
    title = F.coalesce(get("$.props.pageProps.lesson.title", "string"), grab(F.col(html), r"(?is)<title[^>]*>(.*?)</title>"))
    return df.select(*by, title.alias("title"), get("$.props.pageProps.lesson.duration", "long").alias("duration_sec"), get("$.props.pageProps.captions", "string").alias("captions"))
