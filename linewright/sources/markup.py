"""Markup read in one scan with a stack of open elements: nested blocks, and a page's text.

The scan follows HTML's rules where pages depend on them: void elements have no
end; a paragraph ends where a block begins; a list item ends where the next one of
its list begins; an end tag closes up to its element, or nothing if that isn't
open; scripts and styles hold no text; comments and declarations go; a tag that
never ends swallows the rest.  Entities are decoded text by text, after tags are
found: all that browsers decode, or with ``ended`` those that end with a semicolon
alone, so that one cut short (``&amp`` at the end of a heading) stays as it stands.
Every character is looked at a bounded number of times, whatever the page.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import partial
from html.entities import html5

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.unescape import mapped

#: Comments, declarations and tags; quoted values may hold any sign.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*+)(?P<rest>(?:=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))|[^>])*+)(?:>|\Z)",
    re.S,
)
_ID = re.compile(r"""(?:^|\s)id\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: Elements by what the rules say of them (fixed values of HTML).
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
ENDS_PARAGRAPH = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
BLOCKS = {"p": "text", "li": "text", "blockquote": "quote", "h1": "heading", "h2": "heading", "h3": "heading", "h4": "heading"}
BREAKS = frozenset("br p div h1 h2 h3 h4 h5 h6 li tr blockquote".split())
#: Entities that end, by number or by name.
_ENTITY = re.compile(r"&(?:#(?:[0-9]+|[xX][0-9A-Fa-f]+)|([A-Za-z][A-Za-z0-9]*));")
_RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in ("script", "style")}


def unescape(text: str, ended: bool = False) -> str:
    """The text with its entities decoded; ``ended``: those alone that end with a semicolon."""
    if not ended:
        return html.unescape(text)
    return _ENTITY.sub(lambda m: html.unescape(m[0]) if m[1] is None or f"{m[1]};" in html5 else m[0], text)


def scan(page: str) -> Iterator[tuple[str, str, str]]:
    """("text", content, ""), ("open", tag, attributes) and ("end", tag, "") as they stand; raw elements without their content."""
    at = 0
    while at < len(page):
        begin = page.find("<", at)
        token = _TOKEN.match(page, begin) if begin >= 0 else None
        while begin >= 0 and token is None:  # a sign of its own
            begin = page.find("<", begin + 1)
            token = _TOKEN.match(page, begin) if begin >= 0 else None
        if token is None:
            yield "text", page[at:], ""
            return
        if begin > at:
            yield "text", page[at:begin], ""
        at = token.end()
        if token["tag"]:
            tag = token["tag"].lower()
            yield ("end" if token["end"] else "open"), tag, token["rest"]
            if tag in _RAW and not token["end"]:
                close = _RAW[tag].search(page, at)
                at = close.start() if close else len(page)


@dataclass
class Block:
    """An element that holds text: its kind, the block around it, and its stretch of text nodes."""

    tag: str
    around: int
    first: int
    last: int = -1


def blocks_of(page: str, inside: str | None = None, ended: bool = False) -> tuple[list[Block], list[str], list[int]]:
    """Blocks in the order of their start tags, text nodes, and the innermost block of each node (-1: none).

    With ``inside`` only the content of the elements with that id counts.
    """
    stack: list[tuple[str, int, bool]] = []  # tag, its block or -1, whether it is the element asked for
    opened: Counter[str] = Counter()
    items = [0]  # open items of each open list
    blocks: list[Block] = []
    nodes: list[str] = []
    owner: list[int] = []
    current, depth = -1, 0 if inside else 1

    def pop() -> str:
        nonlocal current, depth
        tag, block, asked = stack.pop()
        opened[tag] -= 1
        if tag in ("ul", "ol"):
            items.pop()
        elif tag == "li":
            items[-1] -= 1
        if block >= 0:
            blocks[block].last = len(nodes)
            current = blocks[block].around
        depth -= asked
        return tag

    for kind, value, rest in scan(page):
        if kind == "text":
            text = unescape(value, ended).strip() if depth else ""
            if text:
                nodes.append(text)
                owner.append(current)
        elif kind == "end":
            if opened[value] > 0:
                while pop() != value:
                    pass
        else:
            if value in ENDS_PARAGRAPH and opened["p"] > 0:
                while pop() != "p":
                    pass
            elif value == "li" and items[-1]:
                while pop() != "li":
                    pass
            if value in VOID or rest.endswith("/") and value not in BLOCKS:
                continue
            asked = False
            if inside and (found := _ID.search(rest)):
                asked = inside == next(x for x in found.groups() if x is not None)
            block = -1
            if value in BLOCKS and depth:
                block = len(blocks)
                blocks.append(Block(value, current, len(nodes)))
                current = block
            stack.append((value, block, asked))
            opened[value] += 1
            depth += asked
            if value in ("ul", "ol"):
                items.append(0)
            elif value == "li":
                items[-1] += 1
    while stack:
        pop()
    return blocks, nodes, owner


def _squeezed(text: str) -> str:
    return " ".join(text.split())


def listed(page: str, nested: str = "own", inside: str | None = None, ended: bool = False) -> Iterator[tuple[str, str]]:
    """(kind, text) of a page's blocks, those without text left out.

    ``nested`` "whole": every block with all its text, so that what stands in a
    block within a block comes twice, in the order of start tags.  "own": every
    text once, in order; a block goes on after one that it holds, and the kind is
    that of the nearest heading or quotation around it.
    """
    blocks, nodes, owner = blocks_of(page, inside, ended)
    if nested == "whole":
        for b in blocks:
            text = _squeezed(" ".join(nodes[b.first : b.last]))
            if text:
                yield BLOCKS[b.tag], text
        return
    kinds: list[str] = []
    for b in blocks:
        above = kinds[b.around] if b.around >= 0 else "text"
        kinds.append(above if BLOCKS[b.tag] == "text" else BLOCKS[b.tag])
    at = 0
    while at < len(nodes):
        end = at
        while end < len(nodes) and owner[end] == owner[at]:
            end += 1
        if owner[at] >= 0:
            yield kinds[owner[at]], _squeezed(" ".join(nodes[at:end]))
        at = end


def body_blocks(df: DataFrame, by: list[str], html: str = "html", nested: str = "own", inside: str | None = None, ended: bool = False) -> DataFrame:
    """(pos from 0, kind, text) of the headings, quotations, paragraphs and list items of each page; see :func:`listed`.

    Zero-width characters go.  Null and empty pages have no blocks.
    """
    if nested not in ("own", "whole"):
        raise ValueError(f"no such way with nested blocks: {nested}")
    hidden = re.compile("[​‌‍⁠﻿]")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages = batch.column(batch.num_columns - 1)
            rows, source = [], []
            for i, page in enumerate(pages):
                found = [(kind, hidden.sub("", text)) for kind, text in listed(page.as_py() or "", nested, inside, ended)]
                rows += [(p, *x) for p, x in enumerate(x for x in found if x[1])]
                source += [i] * (len(rows) - len(source))
            keys = [c.take(pa.array(source, pa.int64())) for c in batch.columns[:-1]]
            yield pa.record_batch([*keys, pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())], names=[*by, "pos", "kind", "text"])

    kept = df.select(*by, F.col(html).cast("string").alias("_page"))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    return kept.mapInArrow(run, f"{types}{', ' if by else ''}pos int, kind string, text string")


def text_of_page(page: str, ended: bool = False) -> str:
    """A page's text without its head: block tags end lines, lines are trimmed, blank ones go."""
    out: list[str] = []
    head = False
    for kind, value, _ in scan(page):
        if value == "head" and kind != "text":
            head = kind == "open"
        elif head:
            head = value != "body" or kind == "text"
        elif kind == "text":
            out.append(unescape(value, ended))
        elif value in BREAKS:
            out.append("\n")
    return "\n".join(x for line in "".join(out).split("\n") if (x := line.strip(" ")))


@F.arrow_udf(StringType())
def page_text(pages: pa.Array) -> pa.Array:
    """:func:`text_of_page` of each page, null for null."""
    return mapped(pages, text_of_page)


@F.arrow_udf(StringType())
def page_text_ended(pages: pa.Array) -> pa.Array:
    """:func:`text_of_page` of each page with ended entities alone decoded, null for null."""
    return mapped(pages, partial(text_of_page, ended=True))
