"""Catalogue entries: listing job — S1, S2, S7, N1-N16, W2, J8, J9."""

from __future__ import annotations

from pyspark.sql import functions as F

from filingflow.functions import text as X
from filingflow.functions.text import _at
from filingflow.operators.common import ordinal
from filingflow.plans.catalog import register
from filingflow.sources import listing as L
from filingflow.sources import tables as T


_PL_LABEL = """CASE report_type WHEN 'current' THEN 'Bieżący' WHEN 'quarterly' THEN 'Kwartalny'
  WHEN 'semi-annual' THEN 'Półroczny' WHEN 'interim' THEN 'Śródroczny' ELSE 'Roczny' END"""
_PAGE = "CAST(floor(id / 100) AS BIGINT)"
_POS = f"CAST(row_number() OVER (PARTITION BY company_id, {_PAGE} ORDER BY id) - 1 AS INTEGER)"


def _scan(spark, sf):
    return L.listing_page_scan(T.listing_pages(spark, sf))


@register(
    "listing_page_scan",
    f"""SELECT company_id, {_PAGE} AS page_no, {_POS} AS pos, href, header_text, title_text, change_class,
  change_text, price_text FROM listing_raw""",
    ("listing_raw",),
)
def q_listing_page_scan(spark, sf):
    return _scan(spark, sf)


@register(
    "normalise_listing",
    f"""SELECT company_id, {_PAGE} AS page_no, {_POS} AS pos, date,
  CASE WHEN title = '' THEN concat('UNTITLED ', {_PL_LABEL}, ' REPORT') ELSE title END AS title,
  report_type, report_category, rate_change, exchange_rate, link FROM reports""",
    ("reports",),
)
def q_normalise_listing(spark, sf):
    accepted, _ = L.normalise_listing(_scan(spark, sf))
    return accepted


def _raw(spark, sf):
    return T.listing_raw(spark, sf)


def _hdr():
    return X.split_header(F.col("header_text"))


@register(
    "split_header",
    f"SELECT id, [strftime(date, '%d-%m-%Y'), {_PL_LABEL}, coalesce(report_category, 'unknown')] AS header_parts FROM reports",
    ("reports",),
)
def q_split_header(spark, sf):
    return _raw(spark, sf).select("id", _hdr().alias("header_parts"))


@register("report_type_enum", "SELECT id, report_type FROM reports", ("reports",))
def q_report_type_enum(spark, sf):
    return _raw(spark, sf).select("id", X.report_type_enum(_at(_hdr(), 2)).alias("report_type"))


@register("report_category_enum", "SELECT id, report_category FROM reports", ("reports",))
def q_report_category_enum(spark, sf):
    return _raw(spark, sf).select("id", X.report_category_enum(_at(_hdr(), 3)).alias("report_category"))


@register("change_value", "SELECT id, rate_change FROM reports", ("reports",))
def q_change_value(spark, sf):
    return _raw(spark, sf).select("id", X.change_value(F.col("change_text"), F.col("change_class")).alias("rate_change"))


@register("price_value", "SELECT id, exchange_rate FROM reports", ("reports",))
def q_price_value(spark, sf):
    return _raw(spark, sf).select("id", X.price_value(F.col("price_text")).alias("exchange_rate"))


@register(
    "title_or_untitled",
    f"SELECT id, CASE WHEN title = '' THEN concat('UNTITLED ', {_PL_LABEL}, ' REPORT') ELSE title END AS title FROM reports",
    ("reports",),
)
def q_title_or_untitled(spark, sf):
    return _raw(spark, sf).select("id", X.title_or_untitled(F.col("title_text"), _at(_hdr(), 2)).alias("title"))


@register("absolute_link", "SELECT id, link FROM reports", ("reports",))
def q_absolute_link(spark, sf):
    return _raw(spark, sf).select("id", X.absolute_link(T.LISTING_BASE, F.col("href")).alias("link"))


@register("parse_date_text", "SELECT id, date FROM reports", ("reports",))
def q_parse_date_text(spark, sf):
    # whole header date segment "dd-MM-yyyy HH:mm:ss": N8 keeps the first token
    seg = X.ustrip(_at(F.split("header_text", r"\|"), 1))
    return _raw(spark, sf).select("id", X.parse_date_text(seg).alias("date"))


# ---------------------------------------------------------------- N9-N11 over request texts

_DATE_INPUT_SQL = """CASE event_id % 4 WHEN 0 THEN CAST(CAST(floor(epoch(ts)) AS BIGINT) AS VARCHAR)
  WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') WHEN 2 THEN strftime(ts, '%d-%m-%Y') ELSE '' END"""


def _date_inputs(spark, sf):
    e = T.read(spark, sf, "events").select("event_id", "ts")
    k = F.col("event_id") % 4
    raw = (
        F.when(k == 0, F.unix_seconds(F.col("ts").cast("timestamp")).cast("string"))
        .when(k == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(k == 2, F.date_format("ts", "dd-MM-yyyy"))
        .otherwise(F.lit(""))
    )
    return e.select("event_id", raw.alias("raw"))


@register(
    "format_date_input",
    f"""SELECT event_id, {_DATE_INPUT_SQL} AS raw,
  CASE WHEN event_id % 4 = 3 THEN '' WHEN event_id % 4 = 0 THEN strftime(CAST(to_timestamp(floor(epoch(ts))) AS TIMESTAMP), '%d-%m-%Y')
    ELSE strftime(ts, '%d-%m-%Y') END AS formatted FROM events""",
)
def q_format_date_input(spark, sf):
    d = _date_inputs(spark, sf)
    return d.select("event_id", "raw", X.format_date_input(F.col("raw")).alias("formatted"))


_REQ_SQL = """CASE id % 5 WHEN 0 THEN '' WHEN 1 THEN strftime(date, '%d-%m-%Y')
  WHEN 2 THEN concat(strftime(date, '%d-%m-%Y'), ' - ', strftime(date + INTERVAL 30 DAY, '%d-%m-%Y'))
  WHEN 3 THEN strftime(date, '%Y-%m-%d')
  ELSE concat(strftime(date, '%Y-%m-%d'), ' - ', strftime(date + INTERVAL 30 DAY, '%Y-%m-%d')) END"""


def _date_requests(spark, sf):
    r = T.reports(spark, sf).select("id", "date")
    k = F.col("id") % 5
    dmy = F.date_format("date", "dd-MM-yyyy")
    iso = F.date_format("date", "yyyy-MM-dd")
    later = F.date_add("date", 30)
    req = (
        F.when(k == 0, F.lit(""))
        .when(k == 1, dmy)
        .when(k == 2, F.concat(dmy, F.lit(" - "), F.date_format(later, "dd-MM-yyyy")))
        .when(k == 3, iso)
        .otherwise(F.concat(iso, F.lit(" - "), F.date_format(later, "yyyy-MM-dd")))
    )
    return r.select("id", req.alias("request"))


@register(
    "date_request_check",
    f"""SELECT id, {_REQ_SQL} AS request,
  CASE id % 5 WHEN 3 THEN 'Wrong date format (expected: DD-MM-YYYY)'
    WHEN 4 THEN 'Wrong date format (expected: DD-MM-YYYY - DD-MM-YYYY)' END AS error FROM reports""",
    ("reports",),
)
def q_date_request_check(spark, sf):
    q = _date_requests(spark, sf)
    return q.select("id", "request", X.date_request_error(F.col("request")).alias("error"))


@register(
    "range_from_to",
    f"""SELECT id, {_REQ_SQL} AS request,
  CASE WHEN id % 5 = 0 THEN 'N/A' WHEN id % 5 IN (1, 3) THEN {_REQ_SQL}
    ELSE split_part({_REQ_SQL}, ' - ', 1) END AS date_from,
  CASE WHEN id % 5 = 0 THEN 'N/A' WHEN id % 5 IN (1, 3) THEN {_REQ_SQL}
    ELSE split_part({_REQ_SQL}, ' - ', 2) END AS date_to FROM reports""",
    ("reports",),
)
def q_range_from_to(spark, sf):
    q = _date_requests(spark, sf)
    a, b = X.range_from_to(F.col("request"))
    return q.select("id", "request", a.alias("date_from"), b.alias("date_to"))


# ---------------------------------------------------------------- N13-N16


@register(
    "wanted_attachment",
    "SELECT id, file_name, contains(right(file_name, 4), 'pdf') AS wanted FROM file_arrivals",
    ("file_arrivals",),
)
def q_wanted_attachment(spark, sf):
    f = T.file_arrivals(spark, sf)
    return f.select("id", "file_name", X.wanted_attachment(F.col("file_name"), ["PDF"]).alias("wanted"))


@register("md5_of_content", "SELECT doc_id, md5(text) AS md5_hash FROM documents")
def q_md5(spark, sf):
    return T.read(spark, sf, "documents").select("doc_id", F.md5("text").alias("md5_hash"))


@register(
    "human_formats",
    """SELECT id, CASE WHEN coalesce(file_size, 0) = 0 THEN 'N/A' ELSE concat(CAST((file_size * 20 + 1024) // 2048 // 10 AS VARCHAR),
  '.', CAST(((file_size * 20 + 1024) // 2048) % 10 AS VARCHAR), ' KB') END AS size_text FROM downloaded_files""",
    ("downloaded_files",),
)
def q_human_formats(spark, sf):
    f = T.downloaded_files(spark, sf)
    return f.select("id", X.size_kb_text(F.col("file_size")).alias("size_text"))


@register(
    "json_list_codec",
    """SELECT id, CAST(CAST(NULLIF(report_types, '') AS JSON) AS VARCHAR[]) AS decoded,
  CASE WHEN report_types IS NULL THEN NULL ELSE '["current", "quarterly"]' END AS encoded FROM scheduled_jobs""",
    ("scheduled_jobs",),
)
def q_json_list_codec(spark, sf):
    j = T.scheduled_jobs(spark, sf).select("id", X.json_list_decode(F.col("report_types")).alias("decoded"))
    return j.select("id", "decoded", X.json_list_encode(F.col("decoded")).alias("encoded"))


# ---------------------------------------------------------------- S2, J8, J9, W2


@register(
    "attachment_scan",
    """SELECT concat('https://www.gpw.pl/komunikat?geru_id=', CAST(report_id AS VARCHAR)) AS link,
  coalesce(list(concat('https://espiebi.pap.pl/espi/pl/reports/view/download/', CAST(id AS VARCHAR)) ORDER BY id)
    FILTER (WHERE contains(right(file_name, 4), 'pdf')), CAST([] AS VARCHAR[])) AS urls,
  coalesce(list(file_name ORDER BY id) FILTER (WHERE contains(right(file_name, 4), 'pdf')), CAST([] AS VARCHAR[])) AS names
FROM file_arrivals GROUP BY report_id""",
    ("file_arrivals",),
)
def q_attachment_scan(spark, sf):
    return L.attachment_scan(T.report_pages(spark, sf), ["PDF"])


_ATT_SQL = """SELECT concat('https://www.gpw.pl/komunikat?geru_id=', CAST(report_id AS VARCHAR)) AS link, report_id,
  row_number() OVER (PARTITION BY report_id ORDER BY id) AS file_no,
  concat('https://espiebi.pap.pl/espi/pl/reports/view/download/', CAST(id AS VARCHAR)) AS url, file_name AS name
FROM file_arrivals WHERE contains(right(file_name, 4), 'pdf') OR contains(right(file_name, 4), 'html')"""


def _attachments(spark, sf):
    return L.zip_attachments(L.attachment_scan(T.report_pages(spark, sf), ["PDF", "HTML"]))


@register(
    "zip_attachments",
    f"SELECT link, CAST(file_no AS INTEGER) AS file_no, url, name FROM ({_ATT_SQL}) a",
    ("file_arrivals",),
)
def q_zip_attachments(spark, sf):
    return _attachments(spark, sf)


def attach_report_id(attachments, reports):
    """An attachment inherits its filing's id through the filing link; NULL when no filing. A filing that was
    appended again is known by its newest id, the run's own row, so attachments never multiply."""
    r = reports.groupBy(F.col("link").alias("r_link")).agg(F.max("id").alias("report_id"))
    return attachments.join(r, attachments["link"] == r["r_link"], "left").drop("r_link")


@register(
    "attach_report_id",
    f"""SELECT a.link, CAST(a.file_no AS INTEGER) AS file_no, a.url, a.name,
  CASE WHEN r.id % 5 = 0 THEN r.id + 10000000 ELSE r.id END AS report_id
FROM ({_ATT_SQL}) a LEFT JOIN reports r ON r.link = a.link""",
    ("file_arrivals", "reports"),
)
def q_attach_report_id(spark, sf):
    reports = T.reports(spark, sf).select("id", "link")
    again = reports.where(F.col("id") % 5 == 0).withColumn("id", F.col("id") + 10000000)  # one filing in five was appended twice
    return attach_report_id(_attachments(spark, sf), reports.unionByName(again))


def filing_and_file_ordinals(reports, companies, attachments):
    """W2 + N12: filing number i in its company's listing (id order), file number j after the type
    filter, the standard file name and its extension."""
    r = ordinal(reports.select("id", "company_id", "link"), ["company_id"], "id", out="report_no")
    c = companies.select(F.col("id").alias("company_id"), F.col("name").alias("company"))
    a = attachments.withColumnRenamed("link", "a_link")
    j = r.join(a, r["link"] == a["a_link"], "inner").join(c, "company_id")
    std = X.standard_file_name(F.col("company"), F.col("report_no"), F.col("file_no"), F.col("name"))
    return j.select(
        F.col("id").alias("report_id"), "report_no", "file_no", std.alias("file_name"), X.file_extension(std).alias("file_type")
    )


@register(
    "filing_and_file_ordinals",
    f"""WITH f AS (SELECT id, company_id, link, CAST(row_number() OVER (PARTITION BY company_id ORDER BY id) AS INTEGER) AS report_no
  FROM reports),
a AS ({_ATT_SQL}),
j AS (SELECT f.id AS report_id, f.report_no, CAST(a.file_no AS INTEGER) AS file_no,
  concat(c.name, ' report ', CAST(f.report_no AS VARCHAR), ' file ', CAST(a.file_no AS VARCHAR), ' ',
    regexp_replace(a.name, '\\s+', ' ', 'g')) AS file_name
  FROM f JOIN a ON a.link = f.link JOIN companies c ON c.id = f.company_id)
SELECT report_id, report_no, file_no, file_name, lower(string_split(file_name, '.')[-1]) AS file_type FROM j""",
    ("reports", "file_arrivals", "companies"),
)
def q_filing_and_file_ordinals(spark, sf):
    return filing_and_file_ordinals(T.reports(spark, sf), T.companies(spark, sf), _attachments(spark, sf))


# ---------------------------------------------------------------- S7 (rows-only: a written artifact)


@register(
    "listing_csv_export",
    f"""WITH r AS (SELECT c.name AS company, r.*, row_number() OVER (PARTITION BY c.name ORDER BY r.date DESC, r.id DESC) - 1 AS idx
  FROM reports r JOIN companies c ON c.id = r.company_id)
SELECT company, CAST(idx AS VARCHAR) AS _c0, strftime(date, '%d-%m-%Y') AS date,
  CASE WHEN title = '' THEN concat('UNTITLED ', {_PL_LABEL}, ' REPORT') ELSE title END AS title,
  {_PL_LABEL} AS "report type", coalesce(report_category, 'unknown') AS "report category",
  CAST(rate_change AS VARCHAR) AS "exchange rate", CAST(exchange_rate AS VARCHAR) AS "rate change", link
FROM r WHERE idx < 5""",
    ("reports", "companies"),
)
def q_listing_csv_export(spark, sf):
    from filingflow.sources.sinks import listing_csv_export, read_listing_csv
    from filingflow.session import scratch_dir

    frame = L.listing_frame(_scan(spark, sf))
    c = T.companies(spark, sf).select(F.col("id").alias("company_id"), F.col("name").alias("company"))
    path = scratch_dir(spark, "listing-csv")
    listing_csv_export(frame.join(c, "company_id"), path, limit=5)
    return read_listing_csv(spark, path)
