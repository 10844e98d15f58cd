"""Operator 11, main text of pages by equivalence-class template deduction.

1. Every page is a sequence of tokens: tags and whole text runs, each told apart by the path of elements around it. Over
   the different pages of a host, a token's occurrence vector says how often each page has it; it is kept as a fold of
   hashes of (page, count), so that a host of any size is one partially aggregated row for each token.
2. Tokens with the same vector are an equivalence class. Classes of several tokens that nearly all pages of the host have
   make the host's template (those of one-page text never get that far).
3. On each page a class is valid if its tokens come in the template's order as often as each other, one instance after
   another; valid classes are nested, the widest first: every instance of the next one lies in one slot of those
   before. What is left between template tokens are the page's slots.
4. Text runs of the template are boilerplate. Of the slots, those inside menus, headers, footers, sidebars, notices,
   adverts, forms and comments (by element, role or name of class) go too; if the page marks its article, the slots
   inside it are the text. Pages of hosts too small for a template have slots everywhere.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filingflow.functions.html import VOID, attributes, tokens
from filingflow.llm.common import fed_once, others, own_names, written

LEAST_PAGES = 5  # different pages that a template class is seen on, at least
LEAST_SHARE = 0.9  # of the host's different pages
LEAST_SIZE = 2  # tokens of a class
ALIKE_MARKED, ALIKE_UNMARKED = 0.5, 0.9  # template text stays if it is more than this share of a marked article, of a page without one

# How elements behave, and what names of regions that are no article look like.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr "
    "script style noscript template iframe button select textarea svg math canvas audio video object".split()
)
CELLS = frozenset(("td", "th"))
ENDED_BY = {  # an element of the first kind is ended by the start of one of its kind, up to the nearest of the second
    "li": (frozenset(("li",)), frozenset(("ul", "ol", "menu"))),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "tr": (frozenset(("tr", "td", "th")), frozenset(("table", "tbody", "thead", "tfoot"))),
    "td": (CELLS, frozenset(("tr", "table"))),
    "th": (CELLS, frozenset(("tr", "table"))),
    "option": (frozenset(("option",)), frozenset(("select", "datalist", "optgroup"))),
}
NO_ARTICLE = frozenset("head nav footer aside form button select datalist textarea fieldset noscript template svg math canvas audio video object dialog menu".split())
NO_ARTICLE_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form".split())
NO_ARTICLE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu submenu breadcrumb "
    "breadcrumbs sidebar sidenav widget widgets footer header masthead topbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe "
    "subscription signup login comment comments disqus reply replies respond share sharing social related recommended recommendations "
    "pagination pager search form toolbar copyright disclaimer skip".split()
)
COMMENT_NAMES = frozenset("comment comments reply replies disqus respond".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass
class Node:
    name: str
    path: int  # hash of the element names from the root, inline elements left out
    out: bool  # inside a region that is no article
    header: bool  # inside a header: only headings count
    article: bool
    main: bool
    heading: bool
    link: bool


@dataclass
class Item:
    """One token of a page as the template sees it (``key``), and where its text belongs."""

    key: int
    text: str | None = None  # decoded, of text runs outside the head
    block: int = -1
    node: Node | None = None


@dataclass
class Page:
    items: list[Item] = field(default_factory=list)
    blocks: int = 0


def _hash(*parts: str | int) -> int:
    return xxhash.xxh64_intdigest("\x00".join(map(str, parts))) - (1 << 63)


class Reader:
    """Pages to tokens; hashes of paths and tags are remembered, as a site has few."""

    MOST = 1 << 16

    def __init__(self):
        self.known: dict[tuple, int] = {}

    def hash(self, *parts: str | int) -> int:
        h = self.known.get(parts)
        if h is None:
            if len(self.known) >= self.MOST:
                self.known.clear()
            h = self.known[parts] = _hash(*parts)
        return h

    def read(self, html: str) -> Page:
        page, stack = Page(), [Node("", 0, False, False, False, False, False, False)]
        block = 0
        for kind, name, data in tokens(html):
            top = stack[-1]
            if kind == "text" or kind == "raw":
                run = " ".join(data.split())
                if run:
                    shown = kind == "text" and not top.out
                    key = _hash("text", top.path, name, run)
                    page.items.append(Item(key, unescape(data) if shown else None, block, top))
                elif kind == "text" and data and not top.out:
                    page.items.append(Item(0, " ", block, top))
            elif kind == "open":
                if name in VOID:
                    if name == "br":
                        page.items.append(Item(0, " ", block, top))
                    elif name == "hr":
                        block += 1
                    page.items.append(Item(self.hash("void", top.path, name)))
                    continue
                if name not in INLINE:
                    self._end_open(stack, name)
                    top = stack[-1]
                    if name in CELLS:
                        page.items.append(Item(0, " ", block, top))
                    else:
                        block += 1
                node = self._node(top, name, data)
                stack.append(node)
                page.items.append(Item(self.hash("open", node.path, name, data.strip() if name != "a" else "")))
            else:
                page.items.append(Item(self.hash("close", top.path, name)))
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].name == name:
                        del stack[i:]
                        break
                    if name in INLINE and name not in NO_ARTICLE and stack[i].name not in INLINE:
                        break  # an inline element ends inside its block or with it
                if name in CELLS:
                    page.items.append(Item(0, " ", block, stack[-1]))
                elif name not in INLINE:
                    block += 1
        page.blocks = block + 1
        return page

    @staticmethod
    def _end_open(stack: list[Node], name: str) -> None:
        """End the paragraph that a block's start ends, and the neighbour that an item's start ends."""
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].name == "p":
                del stack[i:]
                break
            if stack[i].name not in INLINE:
                break
        if name in ENDED_BY:
            kinds, limits = ENDED_BY[name]
            last = None
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name in limits:
                    break
                if stack[i].name in kinds:
                    last = i
            if last is not None:
                del stack[last:]

    def _node(self, top: Node, name: str, data: str) -> Node:
        path = top.path if name in INLINE else self.hash("path", top.path, name)
        out, header, article, main = top.out, top.header, top.article, top.main
        out = out or name in NO_ARTICLE
        header = header or name == "header"
        if data and not data.isspace():
            a = attributes(data)
            role = a.get("role", "").lower()
            words = {w.lower() for w in _NAME.findall(f"{a.get('class', '')} {a.get('id', '')}")}
            if name in ("article", "main", "body", "html"):
                out = out or bool(words & COMMENT_NAMES and name == "article")
            elif "header" in words:
                header = True
                out = out or bool((words - {"header"}) & NO_ARTICLE_NAMES)
            else:
                out = out or bool(words & NO_ARTICLE_NAMES)
            out = out or role in NO_ARTICLE_ROLES or "hidden" in a or a.get("aria-hidden", "").lower() == "true" or bool(_HIDDEN.search(a.get("style", "")))
            main = main or role == "main"
            article = article or role == "article" or a.get("itemprop", "").lower() == "articlebody"
        return Node(name, path, out, header, article or name == "article", main or name == "main", top.heading or name in HEADINGS, top.link or name == "a")


def nest(keys: list[int], template: list[list[int]]) -> set[int]:
    """Places of the tokens that belong to the template's classes, as far as those are valid and nested on this page."""
    places: dict[int, list[int]] = {}
    wanted = {k for c in template for k in c}
    for i, k in enumerate(keys):
        if k in wanted:
            places.setdefault(k, []).append(i)
    taken: list[int] = []  # sorted places of template tokens
    out: set[int] = set()
    for tokens_ in template:
        lists = [places.get(k) for k in tokens_]
        if any(p is None or len(p) != len(lists[0] or ()) for p in lists):
            continue
        instances = list(zip(*lists))
        flat = [i for one in instances for i in one]
        if any(a >= b for a, b in zip(flat, flat[1:])):
            continue  # not in order, or instances that overlap
        slot = _slots(taken, instances)
        if slot is None:
            continue  # an instance crosses the classes around it
        out.update(flat)
        taken = sorted(out)
    return out


def _slots(taken: list[int], instances: list[tuple[int, ...]]) -> list[int] | None:
    """Slot of each instance, None if one lies in several. The widest class, and one as wide, may have tokens in all slots
    of an empty template only."""
    from bisect import bisect_left

    slots = []
    for one in instances:
        first, last = bisect_left(taken, one[0]), bisect_left(taken, one[-1])
        if first != last:
            return None
        slots.append(first)
    return slots


def main_text(page: Page, template: list[list[int]]) -> str:
    """The blocks of the page's article, one to a line."""
    fixed = nest([i.key for i in page.items], template) if template else set()
    blocks: dict[int, list[tuple[str, Node, bool]]] = {}
    for place, item in enumerate(page.items):
        if item.text is not None and (not item.node.header or item.node.heading):
            blocks.setdefault(item.block, []).append((item.text, item.node, place in fixed or item.key == 0))
    rows = []
    for number in sorted(blocks):
        parts = blocks[number]
        text = " ".join("".join(t for t, _, _ in parts).split())
        if text:
            said = [(t, n) for t, n, _ in parts if not t.isspace()]
            links = sum(len(t) for t, n in said if n.link) / max(1, sum(len(t) for t, _ in said))
            rows.append((text, said[0][1] if said else parts[0][1], all(f for _, _, f in parts), links))
    alike = ALIKE_MARKED
    if any(n.article for _, n, _, _ in rows):
        rows = [r for r in rows if r[1].article or (r[1].main and r[1].heading)]
    elif any(n.main for _, n, _, _ in rows):
        rows = [r for r in rows if r[1].main]
    else:
        rows, alike = [r for r in rows if r[3] <= 0.5], ALIKE_UNMARKED
    size = sum(len(r[0]) for r in rows)
    if sum(len(r[0]) for r in rows if r[2]) <= alike * size:  # articles that are mostly alike are copies, not a template
        rows = [r for r in rows if not r[2]]
    return "\n".join(r[0] for r in rows)


# ----------------------------------------------------------------------------- Spark


def host_of(url: Column) -> Column:
    """Host of an absolute address in lower case, without user and port; null if there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    return F.when(host != "", host)


def deduce_templates(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(``host``, ``template``): the classes of each host that has a template, widest first; a class is its tokens' hashes in
    page order, joined by blanks, classes are joined by ``;``.

    Equal pages of a host count once. Pages without a host or without text count nowhere.
    """
    fed = pages.select(F.xxhash64(host_of(F.col(url_col))).alias("host"), F.xxhash64(html_col, F.length(html_col)).alias("page"), F.col(html_col).alias("html"))
    fed = fed.where(host_of(F.col(url_col)).isNotNull() & F.col(html_col).isNotNull())
    token = pa.list_(pa.struct([("token", pa.int64()), ("n", pa.int32()), ("pos", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for b in batches:
            out = []
            for html in b.column(2).to_pylist():
                seen: dict[int, list[int]] = {}
                for place, item in enumerate(reader.read(html).items):
                    if item.key:
                        seen.setdefault(item.key, [0, place])[0] += 1
                out.append([{"token": k, "n": n, "pos": p} for k, (n, p) in seen.items()])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, token)], names=["host", "page", "tokens"])

    read = fed.mapInArrow(run, "host long, page long, tokens array<struct<token:long,n:int,pos:int>>")
    read = written(read.dropDuplicates(["host", "page"]), "page-tokens")
    counted = read.groupBy("host").agg(F.count(F.lit(1)).alias("__pages")).where(F.col("__pages") >= LEAST_PAGES)
    vectors = (
        read.select("host", "page", F.explode("tokens").alias("t"))
        .groupBy("host", F.col("t.token").alias("token"))
        .agg(
            F.count(F.lit(1)).alias("support"),
            F.bit_xor(F.xxhash64("page", "t.n")).alias("vector"),
            F.min(F.struct("page", F.col("t.pos").alias("pos"))).alias("at"),  # the same page for all tokens of a vector
        )
        .where(F.col("support") >= LEAST_PAGES)
    )
    frequent = vectors.join(written(counted, "host-pages"), "host").where(F.col("support") >= LEAST_SHARE * F.col("__pages"))
    classes = frequent.groupBy("host", "support", "vector").agg(F.sort_array(F.collect_list(F.struct("at.pos", "token"))).alias("c")).where(F.size("c") >= LEAST_SIZE)
    line = F.array_join(F.transform("c", lambda x: x["token"].cast("string")), " ")
    classes = classes.select("host", F.struct((-F.col("support")).alias("s"), (-F.size("c")).alias("n"), line.alias("line")).alias("c"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list("c")), lambda c: c["line"]), ";")
    return classes.groupBy("host").agg(joined.alias("template"))


@own_names
def extract_main_text(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``pages`` with ``text``, the blocks of the main text joined by ``\\n``, and ``n_chars``, its code points (columns of these names
    are replaced).

    References are decoded, white space inside a block is one blank, a line break is white space. Null and empty pages, and
    pages without an article, have the empty text. Pages are read whole; markup left open at the end is no text.
    Pages without a host have no template but the same rules. Repeated rows get equal results, an empty table gives
    an empty table.
    """
    new = ["text", "n_chars"]
    rest = others(pages, new)
    templates = written(deduce_templates(pages, url_col, html_col), "page-templates").withColumnsRenamed({"host": "__of", "template": "__template"})
    keyed = pages.withColumn("__host", F.xxhash64(host_of(F.col(url_col)))).join(templates, F.col("__host") == F.col("__of"), "left")
    fed, at = fed_once(keyed, [*rest, "`__template`"], html_col)
    schema = pages.select(*rest, F.lit("").alias(new[0]), F.lit(0).cast("long").alias(new[1])).schema
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, last, template = Reader(), None, []
        for b in batches:
            out = []
            for html, known in zip(b.column(at).to_pylist(), b.column(len(rest)).to_pylist()):
                if known != last:
                    last, template = known, [[int(k) for k in c.split(" ")] for c in known.split(";")] if known else []
                out.append(main_text(reader.read(html), template) if html else "")
            yield pa.RecordBatch.from_arrays([*b.columns[: len(rest)], pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=names)

    return fed.mapInArrow(run, schema)
