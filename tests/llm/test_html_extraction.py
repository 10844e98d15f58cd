"""Main text of pages against a plain reading of the marked article, and template classes against vectors in a dictionary."""

import re
from collections import Counter, defaultdict
from html import unescape

from pyspark.sql import functions as F

from filingflow.llm import html_extraction as H
from filingflow.llm import queries
from tests.llm.conftest import clash

SCHEMA = "page_id long, url string, html string"


def pages_of(spark, rows):
    return spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(rows)], SCHEMA).repartition(3)


def texts(spark, rows):
    got = H.extract_main_text(pages_of(spark, rows)).collect()
    assert all(r["n_chars"] == len(r["text"]) for r in got) and len(got) == len(rows)
    return [r["text"] for r in sorted(got, key=lambda r: r["page_id"])]


def one(html):
    return H.main_text(H.Reader().read(html), [])


def plain(html):
    out = []
    for part in re.split(r"</?(?:p|h1)>", re.search(r"<article>(.*)</article>", html, re.S)[1]):
        text = " ".join(unescape(re.sub(r"</?b>", "", part).replace("<br>", " ")).split())
        out += [text] if text else []
    return "\n".join(out)


def test_query_matches_the_plain_reading_of_all_pages(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["page_id"]: r for r in queries.QUERIES["op11_html_extraction"](spark, sf).collect()}
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        assert got[p["page_id"]]["text"] == plain(p["html"]) and got[p["page_id"]]["url"] == p["url"]


def brute_templates(rows):
    reader, hosts = H.Reader(), defaultdict(dict)
    for url, html in rows:
        host = re.match(r"https?://(?:[^/@]*@)?([^/:?#]+)", url or "")
        if host and html is not None:
            hosts[host[1].lower()][html] = reader.read(html).items
    out = []
    for pages in hosts.values():
        vectors = defaultdict(dict)
        for number, items in enumerate(pages.values()):
            for key, n in Counter(i.key for i in items if i.key).items():
                vectors[key][number] = n
        classes = defaultdict(set)
        for key, v in vectors.items():
            if len(v) >= max(H.LEAST_PAGES, H.LEAST_SHARE * len(pages)):
                classes[tuple(sorted(v.items()))].add(key)
        out.append({frozenset(c) for c in classes.values() if len(c) >= H.LEAST_SIZE})
    return {frozenset(t) for t in out if t}


def site(n, host="http://news.example.org", share=True):
    """Pages without a marked article, with a repeated row of links and boilerplate of their own."""
    out = []
    for i in range(n):
        rows = "".join(f"<div class=row><span>Entry {i * 7 + j}</span> of story {i}</div>" for j in range(i % 4 + 1))
        fixed = "<div>All rights belong to their owners.</div><div>Printed daily in two towns.</div>" if share else ""
        out.append((f"{host}/{i}?x=1", f"<html><body><div>The Daily Example</div><h1>Title {i}</h1>{rows}<div>Body of {i} says {'so ' * i}</div>{fixed}</body></html>"))
    return out


def test_classes_match_occurrence_vectors(spark):
    rows = [*site(12), *site(7, "https://user@Other.example.org:80"), *site(3, "http://small.example.org"), (None, "<p>x</p>"), ("http://a.b/", None)]
    rows += rows[:4]  # copies count once
    got = H.deduce_templates(pages_of(spark, rows)).collect()
    found = {frozenset(frozenset(int(k) for k in c.split(" ")) for c in r["template"].split(";")) for r in got}
    assert found == brute_templates(rows) and len(got) == 2


def test_template_text_goes_and_slots_stay(spark):
    got = texts(spark, site(9))
    assert got[2] == "Title 2\nEntry 14 of story 2\nEntry 15 of story 2\nEntry 16 of story 2\nBody of 2 says so so"
    assert "Daily" not in "".join(got) and "rights" not in "".join(got)
    small = texts(spark, site(4))  # too few pages for a template
    assert small[0].startswith("The Daily Example\nTitle 0")


def test_fixed_line_inside_articles_goes_copies_stay(spark):
    page = "<body><article><h1>T{0}</h1><p>Words of {0} and {1}, quite a few.</p><p>Follow us everywhere.</p></article></body>"
    got = texts(spark, [(f"http://h.org/{i}", page.format(i, i * i)) for i in range(6)])
    assert got[3] == "T3\nWords of 3 and 9, quite a few."
    copies = "<body><article><h1>One story</h1><p>The same long text on all the pages of this host.</p><p>Seen {0} times.</p></article></body>"
    got = texts(spark, [(f"http://h.org/{i}", copies.format(i)) for i in range(6)])
    assert got[5] == "One story\nThe same long text on all the pages of this host.\nSeen 5 times."
    assert texts(spark, [("http://h.org/", copies)] * 8) == [one(copies)] * 8


def test_nesting_and_order():
    a, b, c, d, x = range(1, 6)
    assert H.nest([a, c, x, c, x, b], [[a, b], [c]]) == {0, 5, 1, 3}
    assert H.nest([b, a], [[a, b]]) == set()  # not in order
    assert H.nest([a, b, a], [[a, b]]) == set()  # not as often
    assert H.nest([a, c, b, d], [[a, b], [c, d]]) == {0, 2}  # crosses
    assert H.nest([c, a, b, d], [[c, d], [a, b]]) == {0, 1, 2, 3}


def test_regions_that_are_no_article():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header>Site</header><nav>N</nav>
      <div class="cookieConsent">C</div><main><article class="post"><header><h1>Ti&shy;tle &amp; more</h1><p>by me</p></header>
      <p>First  <b>bo</b>ld &lt;x&gt;&nbsp;y<!-- > --><script>var p = "</p>";</script><br>next</p><div id="ad-12">buy</div><aside>A</aside>
      <form>F<input></form><ul><li>one<li>two</ul><table><tr><td>1<td>2<tr><td>3</table><p hidden>H</p><div role="alert">R</div>
      <a title="a > b" href='x>y'>link text</a><footer>foot</footer></article><section class="user-comments"><article>nice</article></section></main></body>"""
    assert one(page) == "Ti­tle & more\nFirst bold <x> y next\none\ntwo\n1 2\n3\nlink text"
    assert one("<article>a</article><article class='comment'>b</article><p>c</p>") == "a"
    assert one("<div><p>Only text</p><p><a href=x>menu</a></p></div>") == "Only text"
    assert one("") == "" and one("no markup & all") == "no markup & all" and one("a <b <p>x") == "a x"
    assert one("<p>kept</p><!-- open <p>lost</p>") == "kept" and one("<p>kept</p><script>lost") == "kept" and one("<p>kept</p><a href='lost") == "kept"


def test_odd_rows_and_clashing_names(spark):
    rows = [(None, None), (None, ""), ("not an address", "<p>a</p>"), ("http://h.org", "<p>" + "long " * 300_000 + "</p>"), ("http://h.org", "<p>" * 20_000 + "deep"), ("http://h.org", "<div>" * 3000 + "x")]
    got = texts(spark, rows)
    assert got[:3] == ["", "", "a"] and len(got[3]) == 5 * 300_000 - 1 and got[4:] == ["deep", "x"]
    df = clash(pages_of(spark, rows), "n_chars", "host", "__host", "template")
    out = H.extract_main_text(df.withColumn("text", F.lit("own")))
    assert out.columns.count("text") == 1 and {"host", "__host", "template", "html"} <= set(out.columns)
    assert sorted(r["text"] for r in out.collect()) == sorted(got)
    assert H.extract_main_text(pages_of(spark, [])).collect() == []
