"""Files written and committed by the sink, landed files read back."""

from __future__ import annotations

import os
import re

import pytest
from pyspark.sql import functions as F

from filingflow.functions.html import page_text
from filingflow.sources import files as W
from filingflow.sources import landed as R
from filingflow.sources import listing as L
from tests.test_html import plain_text

ROWS = "name string, part int, text string"


def tree(path):
    return sorted(os.path.relpath(os.path.join(d, f), path) for d, _, fs in os.walk(path) for f in fs if not f.endswith(".crc"))


def contents(spark, path, glob="*"):
    return {r["name"]: bytes(r["content"]).decode() for r in W.read_files(spark, path, glob).collect()}


def test_one_file_for_each_name_parts_in_order(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = [(f"c{i % 7}.md", p, f"[{i % 7}:{p}]") for i in range(7) for p in range(30)] + [("ą/../b c%.md", 0, "x"), (".hidden", 0, "h"), ("_u", 1, None), ("_u", 2, "u"), ("none", 0, None), (None, 0, "lost")]
    W.write_text_files(spark.createDataFrame(rows, ROWS).repartition(5), path)
    got = contents(spark, path)
    assert {k: v for k, v in got.items() if k.startswith("c")} == {f"c{i}.md": "".join(f"[{i}:{p}]" for p in range(30)) for i in range(7)}
    assert got["ą/../b c%.md"] == "x" and got[".hidden"] == "h" and got["_u"] == "u" and len(got) == 10
    names = tree(path)
    assert all(re.fullmatch(r"run-[0-9a-f]{12}/(part-\d{6}/[^/]+|_SUCCESS)", n) for n in names) and len(names) == 12  # an empty file is written and read as no row


def test_volumes_split_a_name(spark, tmp_path):
    path = str(tmp_path / "out")
    W.write_text_files(spark.createDataFrame([("a.b.md", p, f"{p},") for p in range(25)], ROWS), path, volume=10)
    assert contents(spark, path) == {"a.b.md": "0,1,2,3,4,5,6,7,8,9,", "a.b.2.md": "10,11,12,13,14,15,16,17,18,19,", "a.b.3.md": "20,21,22,23,24,"}


def test_a_run_that_fails_leaves_nothing_and_appends_join(spark, tmp_path):
    path = str(tmp_path / "out")
    W.write_text_files(spark.createDataFrame([("a.txt", 0, "1")], ROWS), path)
    before = tree(path)
    bad = spark.createDataFrame([(f"{i}.txt", 0, "2") for i in range(20)], ROWS).withColumn("text", F.when(F.col("name") == "13.txt", F.raise_error(F.lit("stop"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="stop"):
        W.write_text_files(bad, path)
    assert tree(path) == before and contents(spark, path) == {"a.txt": "1"}
    W.write_text_files(spark.createDataFrame([("b.txt", 0, "2")], ROWS), path)
    assert contents(spark, path) == {"a.txt": "1", "b.txt": "2"} and contents(spark, path, "b*") == {"b.txt": "2"}


def test_files_are_read_by_the_folders_of_their_tasks(spark, tmp_path):
    """The driver knows one folder for each writing task; before it listed every file, and 40 files made a split."""
    path = str(tmp_path / "out")
    names = spark.range(400).select(F.concat("id", F.lit(".txt")).alias("name"), F.lit(0).alias("part"), F.col("id").cast("string").alias("text"))
    W.write_text_files(names, path)
    folders = W.committed_folders(path)
    read = W.read_files(spark, path)
    assert 1 <= len(folders) <= 8 and read.rdd.getNumPartitions() == len(folders) and read.inputFiles() == []
    assert {r["name"]: bytes(r["content"]).decode() for r in read.collect()} == {f"{i}.txt": str(i) for i in range(400)}
    sizes = W.read_files(spark, path, "1?.txt", content=False).collect()
    assert sorted((r["name"], r["size"], r["content"]) for r in sizes) == [(f"{i}.txt", 2, None) for i in range(10, 20)]
    assert W.read_files(spark, str(tmp_path / "none")).collect() == []


def test_one_csv_file_for_each_company_in_few_folders(spark, tmp_path):
    from filingflow.sources import sinks as S

    path = str(tmp_path / "csv")
    rows = [(f"c {i}", f"0{d}-01-2024", 1, d, f't, "{d}"' if d % 2 else None, "x", "", 1.5, None, "l") for i in range(40) for d in range(1, 8)]
    rows += [(None, "01-01-2024", 1, 1, "none", "x", "y", 0.0, 2.0, "l")]
    kinds = "company string, date string, page_no long, pos int, title string, `report type` string, `report category` string, `exchange rate` double, `rate change` double, link string"
    S.listing_csv_export(spark.createDataFrame(rows, kinds), path)
    files = [n for n in tree(path) if n.endswith(".csv")]
    assert len(files) == 41 and len({os.path.dirname(n) for n in files}) <= 8  # a folder for each company before
    one = next(n for n in files if n.endswith("/c 7.csv"))
    assert (tmp_path / "csv" / one).read_text().splitlines()[:2] == [",date,title,report type,report category,exchange rate,rate change,link", '0,07-01-2024,"t, \\"7\\"",x,"",1.5,,l']
    got = S.read_listing_csv(spark, path)
    assert got.columns == ["_c0", *S.LISTING_COLUMNS, "company"] and got.where("company IS NULL").first()["title"] == "none"
    mine = sorted((r["_c0"], r["date"], r["title"], r["report category"], r["exchange rate"], r["rate change"]) for r in got.where("company = 'c 7'").collect())
    assert mine == [(str(7 - d), f"0{d}-01-2024", f't, "{d}"' if d % 2 else None, None, "1.5", None) for d in (7, 6, 5, 4, 3)]


def test_losing_attempts_are_not_read(tmp_path):
    writer = W.Writer(str(tmp_path), "run")
    for folder in ("attempt-000000-win", "attempt-000000-lost"):
        os.makedirs(tmp_path / "_run-run" / folder)
        (tmp_path / "_run-run" / folder / "f.txt").write_text(folder)
    writer.commit([W.Written(0, str(tmp_path / "_run-run" / "attempt-000000-win"), 1, 3), None])
    assert tree(tmp_path) == ["run-run/_SUCCESS", "run-run/part-000000/f.txt"]
    assert (tmp_path / "run-run/part-000000/f.txt").read_text() == "attempt-000000-win"


PAGE = '<html><head><meta {}></head><body title="a > b"><p>Spółka Łódź &amp; Żory — ąęć</p><!-- <p>no</p> --></body></html>'


def test_charsets():
    said = 'http-equiv="Content-Type" content="text/html; charset={}"'
    for label, codec in (("iso-8859-2", "iso8859-2"), ("windows-1250", "cp1250"), ("UTF-8", "utf-8")):
        page = PAGE.format(said.format(label)).replace("—", "-")
        assert R.decode_file(page.encode(codec)) == (codec, page)
    assert R.decode_file(PAGE.encode("cp1250")) == ("cp1250", PAGE)  # nothing said, not UTF-8
    assert R.decode_file(PAGE.encode()) == ("utf-8", PAGE)
    assert R.decode_file(b"\xff\xfe" + PAGE.encode("utf-16-le")) == ("utf-16-le", PAGE)
    assert R.decode_file(b"\xef\xbb\xbfx") == ("utf-8", "x") and R.decode_file(b"") == ("utf-8", "")
    assert R.charset_of(b'<meta charset="latin1">\x80')[0] == "cp1252" and R.charset_of(b'<meta charset="nope">\xb1')[0] == "cp1250"
    assert R.decode_file(b'<meta charset=utf-8>\xff')[1].endswith("�")


def test_folder_of_files_in_three_charsets(spark, tmp_path):
    want = {}
    for i in range(30):
        codec = ("utf-8", "cp1250", "iso8859-2")[i % 3]
        label = ("utf-8", "windows-1250", "iso-8859-2")[i % 3]
        page = PAGE.format(f'charset="{label}"').replace("—", "-" if i % 3 == 2 else "—") + "x" * i
        folder = tmp_path / f"company {i % 4}"
        folder.mkdir(exist_ok=True)
        name = f"doc {i}.{'htm' if i % 2 else 'html'}"
        (folder / name).write_bytes(page.encode(codec))
        want[f"company {i % 4}", name] = (codec, plain_text(page))
    (tmp_path / "company 0" / "notes.txt").write_text("not html")
    (tmp_path / "company 0" / "_half.html").write_text("not landed")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    try:
        docs = R.landed_documents(spark, str(tmp_path))
        assert 3 <= docs.rdd.getNumPartitions() < 30  # several files to a split, several splits
        assert {(r["company"], r["file_name"]): (r["charset"], r["text"]) for r in docs.collect()} == want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_listing_rows_by_tokens():
    li = '<li{0}><a title="x > y" href="k?a=1&amp;b=2">o</a><span class="x date">01-02-2024 | R&oacute;ż | {1}</span><p>T <b>b</b> &lt;li&gt;</p><p>no</p>'
    change = '<span class="loss margin-left-30 pull-right">Zmiana <i>1,5</i>%</span><span class="summary margin-left-30 pull-right">Kurs<span>2,5</span></span>'
    page = "<ul>" + li.format("", 1) + change + "</li><!-- <li>no</li> --><script>'<li>'</script>" + li.format(" class='a>b'", 2) + "<li>3</ul><li>4"
    got = L.listing_rows(page)
    assert got[0] == (0, "k?a=1&b=2", "01-02-2024 | Róż | 1", "T b <li>", "loss", "Zmiana 1,5%", "Kurs2,5")
    assert got[1] == (1, "k?a=1&b=2", "01-02-2024 | Róż | 2", "T b <li>", "", "", "")
    assert [r[0] for r in got] == [0, 1, 2, 3] and got[2][1:] == ("",) * 6
    nested = L.listing_rows("<li><p>a<ul><li><p>b</li></ul></li><li><span class=date>c</span>")
    assert [r[3] for r in nested] == ["a", "b", ""] and nested[2][2] == "c"
    both = L.listing_rows(f'<li><span class="{L.LOSS}">1</span><span class="{L.PROFIT}">2</span>')
    assert both[0][4:6] == ("profit", "2") and L.listing_rows("") == []


def test_attachment_rows_by_tokens():
    page = '<table><tr class="dane x"><td><a href="d/1">a &amp; b.pdf</a><a href="d/2">no</a><tr><td><a href="d/3">no</a></tr><tr class=dane><td title="<a href=z>">t</table><a href="d/9">no</a>'
    assert L.attachment_rows(page) == [(["d/1", ""], ["a & b.pdf", ""])]
    assert L.attachment_rows("") == [([], [])]


def test_page_text_equals_the_test_parser_on_table_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    assert all(page_text(p["html"]) == plain_text(p["html"]) for p in pages)
