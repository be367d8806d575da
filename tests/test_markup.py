"""The markup scan against hand cases and a parser written apart."""

from __future__ import annotations

import random
import time
from html.parser import HTMLParser

import pytest

from linewright.sources import markup


@pytest.mark.parametrize(
    ("page", "own", "whole"),
    [
        ("<li>a<ul><li>b</li></ul>c</li>", ["a", "b", "c"], ["a b c", "b"]),
        ("<ul><li>a<li>b</ul>c", ["a", "b"], ["a", "b"]),
        ("<p>a<p>b<div>c</div>d", ["a", "b"], ["a", "b"]),
        ("<p>a<b>b</p>c<p>d", ["a b", "d"], ["a b", "d"]),
        ("<p>a</blockquote>b</p>", ["a b"], ["a b"]),
        ("<p title='x>y' data=\"<p>\">1 &lt; 2 &amp;amp; 3", ["1 < 2 &amp; 3"], ["1 < 2 &amp; 3"]),
        ("<p>it's <a title=it's>ok</a> 3 < 4 <", ["it's ok 3 < 4 <"], ["it's ok 3 < 4 <"]),
        ("<p>x<script>if (a<b) '</p>'</script>y<style>p{}</style>", ["x y"], ["x y"]),
        ("<p>x<!-- <p> --> y <br> <img src=a> z<![CDATA[no]]>", ["x y z"], ["x y z"]),
        ("", [], []),
        ("<p></p><p> </p>", [], []),
        ("<p>lost in <a href='", ["lost in"], ["lost in"]),
    ],
)
def test_blocks(page, own, whole):
    assert [t for _, t in markup.listed(page)] == own
    assert [t for _, t in markup.listed(page, "whole")] == whole


def test_kinds_and_body():
    page = "<p>no</p><div ID=main><blockquote><p>a</p><p>b</p></blockquote><h2>c</h2><div><li>d</li></div></div><p>no</p>"
    assert list(markup.listed(page, inside="main")) == [("quote", "a"), ("quote", "b"), ("heading", "c"), ("text", "d")]
    assert list(markup.listed(page, "whole", "main")) == [("quote", "a b"), ("text", "a"), ("text", "b"), ("heading", "c"), ("text", "d")]
    assert list(markup.listed(page, inside="other")) == []


class Apart(HTMLParser):
    """Whole blocks of well-formed markup by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.found = [], []

    def handle_starttag(self, tag, attrs):
        if tag != "br":
            self.found.append([tag, []])
            self.open.append(len(self.found) - 1)

    def handle_endtag(self, tag):
        self.open.pop()

    def handle_data(self, data):
        for i in self.open:
            self.found[i][1].append(data.strip())


def made(rng, depth=0):
    out = []
    for _ in range(rng.randrange(1, 4)):
        kind = rng.randrange(5)
        if kind < 2 or depth > 5:
            out.append(rng.choice(["word ", "é &amp; &lt;b&gt; ", " ", "x<br>y", "<!-- <p>c -->"]))
        elif kind == 2:
            out.append("<h3>t <b>v</b></h3>")
        elif kind == 3:
            out.append(f"<blockquote class='a>b'>{made(rng, depth + 1)}</blockquote>")
        else:
            out.append(f"<ul><li>{made(rng, depth + 1)}</li><li>{made(rng, depth + 1)}</li></ul>")
    return "".join(out)


def test_against_a_parser_written_apart():
    rng = random.Random(11)
    for _ in range(300):
        page = made(rng)
        apart = Apart()
        apart.feed(page)
        apart.close()
        wanted = [(markup.BLOCKS[t], " ".join(" ".join(x for x in texts if x).split())) for t, texts in apart.found if t in markup.BLOCKS]
        assert list(markup.listed(page, "whole")) == [x for x in wanted if x[1]], page


@pytest.mark.parametrize("unit", ["<", "<a '", '<p x="', "<!--", "<ul><b>", "</p>", "<li>", "<script>", "<p>&lt;", "<blockquote>"])
def test_time_is_linear(unit):
    page = unit * 40_000
    began = time.process_time()
    blocks, nodes, _ = markup.blocks_of(page)
    markup.text_of_page(page)
    assert time.process_time() - began < 5 and len(blocks) <= 40_000 and len(nodes) <= 40_000


def test_entities_cut_short(spark):
    page = "<h1>a&amp;&amp</h1><p>&lt;b&gt; &amplt; &ampx; &#39; &#x27; &copy; &copy &unknown;</p>"
    texts = ["a&&amp", "<b> &amplt; &ampx; ' ' © &copy &unknown;"]
    assert [t for _, t in markup.listed(page, ended=True)] == texts
    assert [t for _, t in markup.listed(page)] == ["a&&", "<b> &lt; &x; ' ' © © &unknown;"]
    df = spark.createDataFrame([(1, page)], "id long, html string")
    assert [r.text for r in markup.body_blocks(df, ["id"], ended=True).orderBy("pos").collect()] == texts
    assert df.select(markup.page_text_ended("html")).first()[0] == "\n".join(texts)
