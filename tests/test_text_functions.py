"""Scalar logic goldens (FIXTURES §3) and edge rows (§4)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from filingflow.functions import text as X


def one(spark, expr, *vals, schema="a string"):
    df = spark.createDataFrame([vals], schema)
    return df.select(expr.alias("r")).collect()[0]["r"]


def test_split_header_golden(spark):
    h = "19-09-2024 15:41:53 | Bieżący | ESPI | 22/2024"
    assert one(spark, X.split_header(F.col("a")), h) == ["19-09-2024", "Bieżący", "ESPI"]


def test_split_header_two_segments_and_short(spark):
    assert one(spark, X.split_header(F.col("a")), "19-09-2024 10:00:00 | Roczny | 1/2024") == ["19-09-2024", "Roczny", "unknown"]
    assert one(spark, X.split_header(F.col("a")), "19-09-2024 | 1/2024") is None  # X3: rejected, not a crash


def test_report_type_spellings(spark):
    cases = {
        "Bieżący": "current", "RB": "current", " current ": "current", "KWARTALNY": "quarterly", "q": "quarterly",
        "Półroczny": "semi-annual", "P": "semi-annual", "Śródroczny": "interim", "O": "interim", "Roczny": "annual",
        "annual": "annual", "r": "annual", "weekly": None, "": None,
    }
    for label, want in cases.items():
        assert one(spark, X.report_type_enum(F.col("a")), label) == want, label


def test_category(spark):
    assert one(spark, X.report_category_enum(F.col("a")), " espi ") == "ESPI"
    assert one(spark, X.report_category_enum(F.col("a")), "EBI") == "EBI"
    assert one(spark, X.report_category_enum(F.col("a")), "unknown") is None


def test_change_and_price(spark):
    sch = "a string, b string"
    assert one(spark, X.change_value(F.col("a"), F.col("b")), "Zmiana 0,33%", "profit", schema=sch) == 0.33
    assert one(spark, X.change_value(F.col("a"), F.col("b")), "Zmiana 0,33%", "loss", schema=sch) == -0.33
    # The minus glued to an inner blank fails (NULL, row rejected); the profit side still parses
    assert one(spark, X.change_value(F.col("a"), F.col("b")), "Zmiana  0,33%", "loss", schema=sch) is None
    assert one(spark, X.change_value(F.col("a"), F.col("b")), "Zmiana  0,33%", "profit", schema=sch) == 0.33
    assert one(spark, X.price_value(F.col("a")), "Kurs21,42") == 21.42
    assert one(spark, X.price_value(F.col("a")), "Kurs1 234,50") is None  # thousands blank


def test_title_untitled(spark):
    assert one(spark, X.title_or_untitled(F.col("a"), F.lit("Bieżący")), "   ") == "UNTITLED Bieżący REPORT"
    assert one(spark, X.title_or_untitled(F.col("a"), F.lit("Bieżący")), "  Wyniki ") == "Wyniki"


def test_dates(spark):
    assert one(spark, X.parse_date_text(F.col("a")), "19-09-2024 15:41:53") == dt.date(2024, 9, 19)
    assert one(spark, X.parse_date_text(F.col("a")), "1-1-2024") == dt.date(2024, 1, 1)
    assert one(spark, X.parse_date_text(F.col("a")), "31-02-2024") is None
    err = X.date_request_error(F.col("a"))
    assert one(spark, err, "") is None
    assert one(spark, err, "2024-09-19") == X.DATE_ERROR_SINGLE
    assert one(spark, err, "01-01-2024 - 2024-02-01") == X.DATE_ERROR_RANGE
    assert one(spark, err, "01-01-2024 - 05-01-2024") is None
    a, b = X.range_from_to(F.col("a"))
    assert one(spark, F.array(a, b), "") == ["N/A", "N/A"]
    assert one(spark, F.array(a, b), "01-01-2024") == ["01-01-2024", "01-01-2024"]
    assert one(spark, F.array(a, b), "01-01-2024 - 05-01-2024") == ["01-01-2024", "05-01-2024"]


def test_format_date_input(spark):
    f = X.format_date_input(F.col("a"))
    assert one(spark, f, "") == ""
    assert one(spark, f, "1704067200") == "01-01-2024"
    assert one(spark, f, "2024-01-05T10:00:00Z") == "05-01-2024"
    assert one(spark, f, "05-01-2024") == "05-01-2024"
    assert one(spark, f, "garbage") == ""


def test_human_formats(spark):
    size = X.size_kb_text(F.col("a").cast("bigint"))
    assert one(spark, size, "0") == "N/A"
    assert one(spark, size, "1024") == "1.0 KB"
    assert one(spark, size, "1536") == "1.5 KB"
    s = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    assert one(spark, X.duration_text(s, s + F.expr("INTERVAL 12.3 SECONDS")), "x") == "12.3s"
    assert one(spark, X.duration_text(s, s + F.expr("INTERVAL 90 SECONDS")), "x") == "1.5min"
    assert one(spark, X.duration_text(s, F.lit(None).cast("timestamp_ntz")), "x") == "N/A"
    assert one(spark, X.cut_error(F.col("a")), "e" * 100) == "e" * 100
    assert one(spark, X.cut_error(F.col("a")), "e" * 101) == "e" * 97 + "..."


def test_json_codec(spark):
    arr = F.split(F.col("a"), ",")
    assert one(spark, X.json_list_encode(arr), "current,quarterly") == '["current", "quarterly"]'
    assert one(spark, X.json_list_encode(F.array().cast("array<string>")), "x") is None
    assert one(spark, X.json_list_decode(F.col("a")), '["a", "b"]') == ["a", "b"]
    assert one(spark, X.json_list_decode(F.col("a")), "") is None


def test_attachment_tests_are_case_sensitive(spark):
    w = X.wanted_attachment(F.col("a"), ["PDF", "HTML"])
    assert one(spark, w, "raport.pdf") is True
    assert one(spark, w, "raport.html") is True
    assert one(spark, w, "RAPORT.PDF") is False  # X15
    assert one(spark, w, "raport.htm") is False


def test_standard_file_name(spark):
    name = X.standard_file_name(F.lit("PKO BP"), F.lit(1), F.lit(2), F.col("a"))
    assert one(spark, name, "Raport\t roczny  2024.PDF") == "PKO BP report 1 file 2 Raport roczny 2024.PDF"
    assert one(spark, X.file_extension(F.col("a")), "a.b.PDF") == "pdf"


def test_split_header_long_header_general_path(spark):
    h = "01-02-2024 08:00:00 | Roczny | ESPI | extra | 5/2024"
    assert one(spark, X.split_header(F.col("a")), h) == ["01-02-2024", "Roczny", "ESPI", "extra"]


def test_html_text_fragments():
    from filingflow.sources.listing import listing_rows

    title = lambda fragment: listing_rows(f"<li><p>{fragment}</p>")[0][3]
    assert title("<b>A &amp; B</b> &lt;x&gt;") == "A & B <x>"
    assert title("plain") == "plain"


def test_date_input_keeps_the_text_own_day(spark):
    given = {"2024-01-02T00:30:00+02:00": "02-01-2024", "2024-01-02T23:30:00-05:00": "02-01-2024", "2024-01-02T00:30:00Z": "02-01-2024", "0": "01-01-1970"}
    df = spark.createDataFrame([(k,) for k in given], "c string")
    got = {r["c"]: r["v"] for r in df.select("c", X.format_date_input(F.col("c")).alias("v")).collect()}
    assert got == given


def test_date_of_a_header_by_itself(spark):
    heads = ["02-03-2021 08:00 | Roczny | EBI | 7/2021", " 02-03-2021 | Roczny | 7", "a | b", "a", "", None, " | | |", "1 2 | b | c | d | e", "x||y"]
    df = spark.createDataFrame([(h,) for h in heads], "h string").select(X.header_date(F.col("h")), F.try_element_at(X.split_header(F.col("h")), F.lit(1)))
    assert all(a == b for a, b in df.collect())
    assert [r[0] for r in df.collect()][:4] == ["02-03-2021", "02-03-2021", None, None]
