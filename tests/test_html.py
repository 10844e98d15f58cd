"""The HTML tokenizer against the standard library's parser, and the states that decide what is text."""

from __future__ import annotations

import random
import re
from html.parser import HTMLParser

from filingflow.functions import html as H
from filingflow.functions.html import tokens
from filingflow.sources import listing as L


class Plain(HTMLParser):
    """A test parser: what the standard library takes for text outside script and style."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.raw = [], 0

    def handle_starttag(self, tag, attrs):
        self.parts.append(" ")
        self.raw += tag in ("script", "style")

    def handle_startendtag(self, tag, attrs):
        self.parts.append(" ")

    def handle_endtag(self, tag):
        self.parts.append(" ")
        self.raw -= tag in ("script", "style") and self.raw > 0

    def handle_data(self, data):
        if not self.raw:
            self.parts.append(data)


def plain_text(html):
    p = Plain()
    p.feed(html)
    p.close()
    return re.sub(r"[ \t\n\r\f]+", " ", "".join(p.parts).replace("\xa0", " ")).strip(" ")


PIECES = [
    "text ", "a &amp; b", "&lt;p&gt;", "&#65;&#x42; ", "<p>", "</p>", "<b class=x>", "</b>", "<br/>", "<a href='x>y' title=\"<i>\">", "</a>",
    "<!-- c > d -->", "<!DOCTYPE html>", "<script>if (a < b) '</p>'</script>", "<style>p > q{}</style>", "<img src=a.png alt='1 > 0'>", " 1 < 2 ", "<td\nclass = 'c'\n>", "é漢😀",
]


def test_matches_the_standard_parser_on_random_pages():
    rng = random.Random(4)
    for _ in range(3000):
        html = "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 14)))
        assert H.page_text(html) == plain_text(html), html


def test_states():
    kinds = lambda h: [(t.kind, t.name, t.data) for t in H.tokens(h)]
    assert kinds('<a title="a > b" x=1>t</A >') == [("open", "a", ' title="a > b" x=1'), ("text", "", "t"), ("close", "a", " ")]
    assert kinds("a<!-- x > <p> -->b<!-->c<!--->d<!--e--!>f") == [("text", "", c) for c in "abcdf"]
    assert kinds("<p>x<!-- open <p>y") == [("open", "p", ""), ("text", "", "x")]
    assert kinds("<script>a</scripty></SCRIPT >b") == [("open", "script", ""), ("raw", "script", "a</scripty>"), ("close", "script", " "), ("text", "", "b")]
    assert kinds("<title>a <b> c</title>") == [("open", "title", ""), ("text", "title", "a <b> c"), ("close", "title", "")]
    assert kinds("x<style>never closed <p>") == [("text", "", "x"), ("open", "style", ""), ("raw", "style", "never closed <p>")]
    assert kinds("1 < 2 <3 </3> <?php x ?>y</>z") == [("text", "", "1 < 2 <3 "), ("text", "", " "), ("text", "", "y"), ("text", "", "z")]
    assert kinds("a<b c='never closed>d") == [("text", "", "a")] and kinds("") == [] and kinds("<") == [("text", "", "<")]
    assert H.attributes(""" A=1 b='2 > 1' c="&amp;" d a=3 e = f/ """) == {"a": "1", "b": "2 > 1", "c": "&", "d": "", "e": "f/"}


def test_time_is_linear():
    for html in ("<" * 400_000, "<a " * 200_000, "<a b='" * 100_000, "<!--" * 200_000, "<a " + "x=y " * 200_000 + ">", "</" * 300_000, "<script>" * 100_000, "&" * 400_000):
        assert len(H.page_text(html)) <= len(html)


ITEM = (
    '<li class="item"><a href="k?id={0}&amp;x">open</a><span class="date">0{0}-03-2021 15:41:53 | Roczny | EBI | 7/2024</span><p>  A&amp;B {0} </p>'
    '<span class="{1} margin-left-30 pull-right">Zmiana 0,3{0}%</span><span class="summary margin-left-30 pull-right">Kurs{0},00</span></li>'
)


def test_items_built_alike_are_not_read_token_by_token(monkeypatch):
    pages = [ITEM.format(1, "profit") + ITEM.format(2, "loss"), "\n<ul>" + ITEM.format(3, "profit") + "</ul> 1 < 2"]
    want = [[(i, *r) for i, r in enumerate(L._item_fields(tokens(p))[0])] for p in pages]
    assert [L.listing_rows(p) for p in pages] == want  # the second has a sign that is no tag
    assert want[0][1] == (1, "k?id=2&x", "02-03-2021 15:41:53 | Roczny | EBI | 7/2024", "  A&B 2 ", "loss", "Zmiana 0,32%", "Kurs2,00")

    def never(html):
        raise AssertionError("read token by token")

    monkeypatch.setattr(L, "tokens", never)
    assert L.listing_rows(ITEM.format(4, "loss") + ITEM.format(5, "profit"))[1][1] == "k?id=5&x"
    monkeypatch.undo()
    odd = [
        "<li><a href='q'>x<p>t<li><ul><li>in</li></ul><p>u</p></li>", "<li><p>a</li><!-- <li> --><li><p>b", "<script><li><p>x</p></li></script>",
        '<li><a href="a>b">x</a><p>y</p></li>', "<li><title><p>z</p></title></li>", "<a><li><p>t</p></li>", "<li><p>t</p></li><", "\0001\0<li><p>\0002\0</p></li>",
        "<LI><P>t</P></LI><li>" + "<b></b>" * 70 + "<p>u</p></li>", "</li></ul><li><ul></li><li><p>v</p></li></ul></li>", "",
    ]
    for page in odd:
        assert L.listing_rows(page) == [(i, *r) for i, r in enumerate(L._item_fields(tokens(page))[0])], page
