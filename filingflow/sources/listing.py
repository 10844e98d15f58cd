"""S1 listing_page_scan, S2 attachment_scan and Job N (normalise_listing).

A landed page goes once through the HTML tokenizer (``functions.html``) in an Arrow pass that returns the fields of its
items; everything after that is native. Tags inside attributes, comments and raw text are never taken for items.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from html import unescape

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filingflow.functions import text as X
from filingflow.functions.html import ESCAPABLE_RAW_TEXT, RAW_TEXT, Token, attributes, scan_pages, tokens
from filingflow.functions.text import _at
from filingflow.sources.tables import ATTACHMENT_BASE, LISTING_BASE

# The classes of an item's spans.
PROFIT, LOSS, PRICE = (f"{kind} margin-left-30 pull-right" for kind in ("profit", "loss", "summary"))
ITEM_FIELDS = ("href", "header_text", "title_text", "change_class", "change_text", "price_text")


def shown(text: str) -> str:
    """References decoded; a no-break space is a plain one."""
    return unescape(text).replace("\xa0", " ")


class _Element:
    """An open element whose parts are looked for: the first of each kind counts."""

    def __init__(self):
        self.found: dict[str, str] = {}
        self.taking: dict[str, list] = {}  # kind -> [element, depth, parts]
        self.lists = 0  # lists open inside it

    def start(self, kind: str, name: str) -> None:
        if kind not in self.found and kind not in self.taking:
            self.taking[kind] = [name, 0, []]

    def opened(self, name: str) -> None:
        for t in self.taking.values():
            t[1] += t[0] == name

    def closed(self, name: str) -> None:
        for kind, t in list(self.taking.items()):
            if t[0] == name:
                t[1] -= 1
                if t[1] <= 0:
                    self.end(kind)

    def end(self, kind: str) -> None:
        if kind in self.taking:
            self.found[kind] = "".join(self.taking.pop(kind)[2])

    def text(self, data: str) -> None:
        for t in self.taking.values():
            t[2].append(data)

    def done(self) -> dict[str, str]:
        for kind in list(self.taking):
            self.end(kind)
        return self.found


def _item_fields(page: Iterable[Token]) -> tuple[list[tuple], bool]:
    """``ITEM_FIELDS`` of every ``<li>`` among these tokens, and whether none of them is left open."""
    items: list[_Element] = []
    inside: list[_Element] = []  # items that are open
    for kind, name, data in page:
        if kind == "text":
            for item in inside:
                item.text(shown(data))
        elif kind == "open":
            if name == "li":
                if inside and not inside[-1].lists:
                    inside.pop().done()
                items.append(_Element())
                inside.append(items[-1])
            elif name in ("ul", "ol") and inside:
                inside[-1].lists += 1
            a = attributes(data) if name in ("a", "span") and inside else {}
            for item in inside:
                if name == "p":
                    item.end("title_text")  # a paragraph ends the one before
                    item.start("title_text", "p")
                elif name == "a" and "href" in a:
                    item.found.setdefault("href", a["href"])
                elif name == "span":
                    css = a.get("class", "")
                    if "date" in css.split():
                        item.start("header_text", "span")
                    for part, of in (("profit", PROFIT), ("loss", LOSS), ("price_text", PRICE)):
                        if css == of:
                            item.start(part, "span")
                item.opened(name)
        elif kind == "close":
            for item in inside:
                item.closed(name)
            if name == "li" and inside:
                inside.pop().done()
            elif name in ("ul", "ol") and inside:
                if inside[-1].lists:
                    inside[-1].lists -= 1
                else:
                    inside.pop().done()
    out = []
    for item in items:
        f = item.done()
        change = "profit" if "profit" in f else "loss" if "loss" in f else ""
        out.append((f.get("href", ""), f.get("header_text", ""), f.get("title_text", ""), change, f.get(change, ""), f.get("price_text", "")))
    return out, not inside


# Items of one page are mostly built alike: which text goes to which field depends on an item's tags only. The reader above
# runs once for each sequence of tags, on the places of the texts instead of the texts, and leaves a plan: for each field
# its places, or the value itself. Pages with any tag but the plain ones are read token by token.
_CUT = re.compile(r"(<[^>]*>)")
_PLAIN = re.compile(r"""<(?P<close>/?)(?P<name>[A-Za-z][A-Za-z0-9]*)(?P<attrs>(?:\s+[A-Za-z-]+="[^"<>\0]*")*\s*)>""")
_LINK = re.compile(r"""<a href="[^"<>\0]*">""")  # the only tag with a place of its own, that of its target
_PLACE = re.compile(r"\0(\d+)\0")
_LINK_AT = len('<a href="')
MOST_TAGS, MOST_KNOWN = 64, 10_000  # of one plan; kept tags and plans
_known: set[str] = set()  # plain tags other than links
_plans: dict[tuple, tuple[list[tuple], bool]] = {}


def _plan(tags: tuple[str, ...]) -> tuple[list[tuple], bool]:
    """Fields of the items between these tags (a link stands as ``<a>``), and whether none is left open."""
    page = [Token("text", "", "\x000\x00")]
    for i, tag in enumerate(tags):
        link = tag == "<a>"
        m = _PLAIN.fullmatch(tag)
        attrs = f' href="\0{2 * i + 1}\0"' if link else m["attrs"]
        page.append(Token("close" if m["close"] else "open", m["name"].lower(), attrs))
        page.append(Token("text", "", f"\0{2 * i + 2}\0"))
    rows, ended = _item_fields(page)
    return [tuple(tuple(int(p) for p in _PLACE.findall(v)) if "\0" in v else v for v in r) for r in rows], ended


def _planned_rows(html: str) -> list[tuple] | None:
    """The rows of a page of plain tags by the plans of its items; None: to be read token by token."""
    parts = _CUT.split(html)  # texts at even places, tags at odd ones
    if "<" in parts[-1]:
        return None
    out: list[tuple] = []
    first, tags, last = 0, [], len(parts) - 2
    for at in range(1, len(parts), 2):
        tag = parts[at]
        if tag not in _known:
            if _LINK.fullmatch(tag):
                tag = "<a>"
            else:
                m = _PLAIN.fullmatch(tag)
                if not m or tag == "<a>" or m["name"].lower() in RAW_TEXT or m["name"].lower() in ESCAPABLE_RAW_TEXT:
                    return None
                if len(_known) >= MOST_KNOWN:
                    _known.clear()
                _known.add(tag)
        tags.append(tag)
        if tag == "</li>" or at == last:  # no item goes over the end of an item, so each has its plan
            if len(tags) > MOST_TAGS:
                return None
            key = tuple(tags)
            plan = _plans.get(key)
            if plan is None:
                if len(_plans) >= MOST_KNOWN:
                    _plans.clear()
                plan = _plans[key] = _plan(key)
            rows, ended = plan
            if not ended and at != last:
                return None
            for row in rows:
                values: list = [len(out)]
                for v in row:
                    if type(v) is tuple:
                        v = _value(parts[first + v[0]], v[0]) if len(v) == 1 else "".join([_value(parts[first + p], p) for p in v])
                    values.append(v)
                out.append(tuple(values))
            first, tags = at + 1, []
    return out


def _value(part: str, place: int) -> str:
    if place % 2:
        return unescape(part[_LINK_AT:-2])
    return shown(part) if "&" in part or "\xa0" in part else part


def listing_rows(html: str) -> list[tuple]:
    """(pos, *ITEM_FIELDS) of every ``<li>`` of a listing page; a part that is missing is empty. The next item and the end
    of its list end an item, an item of a list inside an item is one of its own."""
    rows = _planned_rows(html)
    return [(pos, *r) for pos, r in enumerate(_item_fields(tokens(html))[0])] if rows is None else rows


def listing_page_scan(pages: DataFrame, key_cols=("company_id", "page_no")) -> DataFrame:
    """One row per ``<li>`` with its ordinal and raw field texts."""
    return scan_pages(pages, list(key_cols), listing_rows, {"pos": "int", **dict.fromkeys(ITEM_FIELDS, "string")})


def newest_items(items: DataFrame, key: str, limit: int) -> DataFrame:
    """The newest ``limit`` items of each key, with their order ``ord``: only the header's date is read before the cut."""
    date = F.try_to_date(X.header_date(F.col("header_text")), "dd-MM-yyyy")
    dated = items.withColumn("ord", F.struct(date.alias("d"), "page_no", "pos"))
    w = Window.partitionBy(key).orderBy(F.desc("ord"))
    return dated.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= limit).drop("__n")


def normalise_listing(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Job N: raw item texts -> typed report rows (accepted) and rows that cannot be parsed (rejected).

    The reference aborts the whole scrape on one malformed item (short header, a blank inside the
    loss text); here such an item goes to the rejected frame and the rest continue.

    The finished row is the output of a generator, so the test for bad rows reads finished columns and
    no field is extracted a second time inside the filter.
    """
    raw = ("header_text", "title_text", "change_class", "change_text", "price_text", "href")
    keys = [c for c in items.columns if c not in raw]
    typed = items.select(*keys, *raw[1:], X.split_header(F.col("header_text")).alias("hdr"))
    label = _at("hdr", 2)
    row = F.struct(
        X.parse_date_text(_at("hdr", 1)).alias("date"),
        X.title_or_untitled(F.col("title_text"), label).alias("title"),
        X.report_type_enum(label).alias("report_type"),
        X.report_category_enum(_at("hdr", 3)).alias("report_category"),
        X.change_value(F.col("change_text"), F.col("change_class")).alias("rate_change"),
        X.price_value(F.col("price_text")).alias("exchange_rate"),
        X.absolute_link(LISTING_BASE, F.col("href")).alias("link"),
        F.col("hdr").isNull().alias("bad_header"),
    )
    out = typed.select(*keys, F.explode(F.array(row)).alias("r"))
    bad = F.col("r.bad_header") | F.col("r.rate_change").isNull() | F.col("r.exchange_rate").isNull()
    cols = [*keys, *[f"r.{c}" for c in ("date", "title", "report_type", "report_category", "rate_change", "exchange_rate", "link")]]
    return out.where(~bad).select(*cols), out.where(bad).select(*cols)


def listing_frame(items: DataFrame) -> DataFrame:
    """The seven-column listing frame exactly as the reference builds it, including its swapped
    rate labels (change % under ``exchange rate``, price under ``rate change``; SURVEY X1)."""
    h = F.col("__header")  # a column of its own, so that a header is split once, not once for each use
    label = _at(h, 2)
    return items.withColumn("__header", X.split_header(F.col("header_text"))).select(
        *[c for c in items.columns if c in ("company_id", "company", "page_no", "pos", "id", "ord")],
        _at(h, 1).alias("date"),
        X.title_or_untitled(F.col("title_text"), label).alias("title"),
        label.alias("report type"),
        _at(h, 3).alias("report category"),
        X.change_value(F.col("change_text"), F.col("change_class")).alias("exchange rate"),
        X.price_value(F.col("price_text")).alias("rate change"),
        X.absolute_link(LISTING_BASE, F.col("href")).alias("link"),
    )


def attachment_rows(html: str) -> list[tuple]:
    """One row with two lists: target and text of the first link of each ``<tr class="dane">``."""
    rows: list[_Element] = []
    row: _Element | None = None
    for kind, name, data in tokens(html):
        if kind == "text" and row:
            row.text(shown(data))
        elif kind == "open":
            if name == "tr":
                row = _Element() if "dane" in attributes(data).get("class", "").split() else None
                rows += [row] if row else []
            elif row:
                if name == "a":
                    row.found.setdefault("href", attributes(data).get("href", ""))
                    row.start("name", "a")
                row.opened(name)
        elif kind == "close" and row:
            row.closed(name)
            if name in ("tr", "table"):
                row = None
    found = [r.done() for r in rows]
    return [([f.get("href", "") for f in found], [f.get("name", "") for f in found])]


def attachment_scan(report_pages: DataFrame, wanted: list[str], key_col="link") -> DataFrame:
    """A report page -> two parallel lists (urls, names) of the wanted attachments, like the
    reference's ``get_attachments``; J9 zips them back into rows."""
    read = scan_pages(report_pages, [key_col], attachment_rows, {"hrefs": "array<string>", "names": "array<string>"})
    parsed = F.transform(
        F.arrays_zip("hrefs", "names"),
        lambda r: F.struct(X.absolute_link(ATTACHMENT_BASE, r["hrefs"]).alias("url"), X.ustrip(r["names"]).alias("name")),
    )
    if not wanted:
        kept = F.array().cast("array<struct<url:string,name:string>>")
    else:
        kept = F.filter(parsed, lambda a: X.wanted_attachment(a["name"], wanted))
    return read.select(
        key_col,
        F.transform(kept, lambda a: a["url"]).alias("urls"),
        F.transform(kept, lambda a: a["name"]).alias("names"),
    )


def zip_attachments(scanned: DataFrame, key_col="link") -> DataFrame:
    """Url list zipped with name list, one row per attachment with its 1-based file number."""
    z = scanned.select(key_col, F.posexplode(F.arrays_zip("urls", "names")).alias("pos", "a"))
    return z.select(key_col, (F.col("pos") + 1).alias("file_no"), F.col("a.urls").alias("url"), F.col("a.names").alias("name"))
