"""HTML as a stream of tokens, and text from it.

``tokens`` follows the HTML tokenizer's states as far as they decide what is text and what is markup: quoted attribute
values may hold ``>``, comments end at ``-->``, the contents of script, style and other raw-text elements are not
markup, and whatever is left open at the end of the file (tag, comment, raw text) never becomes text. It reads each
character once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Token(NamedTuple):
    kind: str  # "text" | "open" | "close" | "raw" (contents of a raw-text element)
    name: str  # element name in lower case; of "raw": the element it belongs to
    data: str  # undecoded text, or the attributes as they stand


# Elements whose contents are no markup, those whose contents are text but hold no tags, and those without contents.
RAW_TEXT = frozenset("script style xmp iframe noembed noframes".split())
ESCAPABLE_RAW_TEXT = frozenset(("title", "textarea"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())

_TAG = re.compile(
    r"""(?P<close>/?)(?P<name>[A-Za-z][^\s/>]*+)                       # < and its slash are read by the caller
    (?P<attrs>(?:[\s/]++                                               # between attributes
      |=?[^\s/>=]++                                                    # attribute name
       (?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])[^\s>]++|(?=>))       # its value: quoted, or up to white space
         |(?!\s*+=))                                                   # or none
      |=                                                               # a stray sign
    )*+)>""",
    re.X,
)
_ATTRIBUTE = re.compile(r"""(=?[^\s/>=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|((?!["'])[^\s>]++)))?+""")
_COMMENT_END = re.compile(r"--!?>")
_RAW_END = {n: re.compile(rf"</{n}(?=[\s/>])", re.I) for n in RAW_TEXT | ESCAPABLE_RAW_TEXT}


def tokens(html: str) -> Iterator[Token]:
    """The tokens of a page, in order; comments, declarations and processing instructions are left out."""
    at, end, text = 0, len(html), 0  # ``text``: where the pending text starts
    while True:
        at = html.find("<", at)
        if at < 0:
            break
        after = html[at + 1 : at + 2]
        if after == "!" or after == "?" or (after == "/" and not html[at + 2 : at + 3].isalpha() and at + 2 < end):
            stop = _declaration_end(html, at, end)
        elif after == "/" or (after.isascii() and after.isalpha()):
            tag = _TAG.match(html, at + 1)
            if tag is None:  # open at the end of the file
                if text < at:
                    yield Token("text", "", html[text:at])
                return
            if text < at:
                yield Token("text", "", html[text:at])
            name = tag["name"].lower()
            yield Token("close" if tag["close"] else "open", name, tag["attrs"])
            at = text = tag.end()
            if not tag["close"] and name in _RAW_END:
                close = _RAW_END[name].search(html, at)
                stop = close.start() if close else end
                if stop > at:
                    yield Token("text" if name in ESCAPABLE_RAW_TEXT and close else "raw", name, html[at:stop])
                at = text = stop
            continue
        else:  # a sign by itself is text
            at += 1
            continue
        if text < at:
            yield Token("text", "", html[text:at])
        at = text = stop
    if text < end:
        yield Token("text", "", html[text:])


def _declaration_end(html: str, at: int, end: int) -> int:
    if html.startswith("<!--", at):
        if html.startswith(">", at + 4):
            return at + 5
        if html.startswith("->", at + 4):
            return at + 6
        close = _COMMENT_END.search(html, at + 4)
        return close.end() if close else end
    close = html.find(">", at)
    return close + 1 if close >= 0 else end


def attributes(data: str) -> dict[str, str]:
    """Attributes of an open tag, names in lower case, values decoded; the first of a name counts."""
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(data):
        out.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
    return out


# ----------------------------------------------------------------------------- S3

_SPACE = re.compile(r"[ \t\n\r\f]+")


def page_text(html: str) -> str:
    """The text of a page: markup and raw text apart its parts by a blank, references are decoded, white space collapses."""
    out: list[str] = []
    for t in tokens(html):
        out.append(t.data if t.kind == "text" else " ")
        if t.kind == "text" and t.name:
            out.append(" ")
    return _SPACE.sub(" ", unescape("".join(out)).replace("\xa0", " ")).strip(" ")


ARROW = {"string": pa.string(), "int": pa.int32(), "array<string>": pa.list_(pa.string())}


def scan_pages(pages: DataFrame, keys: list[str], rows_of, out: dict[str, str], source: str = "html", null_row: tuple | None = None) -> DataFrame:
    """``keys`` of every page with the rows that ``rows_of`` reads from its ``source`` (text or bytes; null: ``null_row``, if any).

    One Arrow pass: a page goes to Python once and only the rows come back. ``out`` names the fields of a row with
    their types (those of ``ARROW``), in order.
    """
    narrow = pages.select(*keys, F.col(source).alias("__source"))
    schema = narrow.select(*keys, *[F.lit(None).cast(t).alias(n) for n, t in out.items()]).schema
    kinds = [ARROW[t] for t in out.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, rows = [], []
            for i, page in enumerate(b.column(b.num_columns - 1).to_pylist()):
                found = rows_of(page) if page is not None else [null_row] if null_row else []
                rows += found
                at += [i] * len(found)
            left = pa.RecordBatch.from_arrays(b.columns[:-1], names=b.schema.names[:-1]).take(pa.array(at, pa.int64()))
            fields = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)] if rows else [pa.array([], t) for t in kinds]
            yield pa.RecordBatch.from_arrays([*left.columns, *fields], names=schema.names)

    return narrow.mapInArrow(run, schema)
