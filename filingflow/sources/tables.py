"""S4 registry_scan: the driver tables and the registry tables bound onto them.

The registry (companies, reports, downloaded_files, scheduled_jobs, summary_reports,
job_execution_log, search_history) is derived from the driver parquet by plain projections, so
every job's work grows with the input. Each reader prunes to the columns it needs, letting the
parquet scan carry ``ReadSchema`` / ``PushedFilters``.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DRIVER_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Driver table scan."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _lpad_num(c: Column, n: int = 9) -> Column:
    return F.lpad(c.cast("string"), n, "0")


def seconds_interval(c: Column) -> Column:
    """Exact day-time interval of ``c`` seconds (microsecond precision)."""
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), c.cast("decimal(18,6)"))


# --------------------------------------------------------------------------- registry bindings


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("name"),
        F.concat(F.col("c_name"), F.lit(" S.A.")).alias("full_name"),
        F.col("c_mktsegment").alias("sector"),
    )


REPORT_TYPE_BY_PRIORITY = {
    "1-URGENT": "current",
    "2-HIGH": "quarterly",
    "3-MEDIUM": "semi-annual",
    "4-NOT SPECIFIED": "interim",
}


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    rtype = F.lit("annual")
    for prio, label in reversed(list(REPORT_TYPE_BY_PRIORITY.items())):
        rtype = F.when(F.col("o_orderpriority") == prio, label).otherwise(rtype)
    return o.select(
        k.alias("id"),
        F.col("o_custkey").alias("company_id"),
        F.col("o_orderdate").cast("date").alias("date"),
        F.when(k % 10 == 0, F.lit("")).otherwise(F.concat(F.lit("Report "), k.cast("string"))).alias("title"),
        rtype.alias("report_type"),
        F.when(F.col("o_orderstatus") == "F", "ESPI").when(F.col("o_orderstatus") == "O", "EBI").alias(
            "report_category"
        ),
        (((k % 2001) - 1000).cast("double") / 100).alias("rate_change"),
        ((F.floor("o_totalprice").cast("bigint") % 50000).cast("double") / 100).alias("exchange_rate"),
        F.concat(F.lit(LISTING_BASE + "komunikat?geru_id="), k.cast("string")).alias("link"),
    )


# The exchange's listing site root and the attachment viewer root.
LISTING_BASE = "https://www.gpw.pl/"
ATTACHMENT_BASE = "https://espiebi.pap.pl/espi/pl/reports/view/"

# Polish report-type labels as printed in listing headers.
POLISH_TYPE_LABEL = {
    "current": "Bieżący",
    "quarterly": "Kwartalny",
    "semi-annual": "Półroczny",
    "interim": "Śródroczny",
    "annual": "Roczny",
}


def listing_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Un-normalised feed strings, built from the typed reports (round-trip input for Job N)."""
    r = reports(spark, sf_dir)
    label = F.lit("Roczny")
    for t, pl in POLISH_TYPE_LABEL.items():
        label = F.when(F.col("report_type") == t, pl).otherwise(label)
    header = F.concat(
        _lpad_num(F.dayofmonth("date"), 2), F.lit("-"), _lpad_num(F.month("date"), 2), F.lit("-"),
        F.year("date").cast("string"), F.lit(" 15:41:53 | "), label,
        F.when(F.col("report_category").isNull(), F.lit("")).otherwise(F.concat(F.lit(" | "), F.col("report_category"))),
        F.lit(" | "), (F.col("id") % 99).cast("string"), F.lit("/2024"),
    )
    return r.select(
        "id",
        "company_id",
        header.alias("header_text"),
        F.concat(F.lit("  "), F.col("title"), F.lit(" ")).alias("title_text"),
        F.when(F.col("rate_change") >= 0, "profit").otherwise("loss").alias("change_class"),
        F.concat(
            F.lit("Zmiana "),
            F.replace(F.abs("rate_change").cast("decimal(10,2)").cast("string"), F.lit("."), F.lit(",")),
            F.lit("%"),
        ).alias("change_text"),
        F.concat(
            F.lit("Kurs"), F.replace(F.col("exchange_rate").cast("decimal(12,2)").cast("string"), F.lit("."), F.lit(","))
        ).alias("price_text"),
        F.concat(F.lit("komunikat?geru_id="), F.col("id").cast("string")).alias("href"),
    )


def listing_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = listing_raw(spark, sf_dir)
    li = F.concat(
        F.lit('<li class="item"><a href="'), F.col("href"), F.lit('">open</a><span class="date">'), F.col("header_text"),
        F.lit("</span><p>"), F.col("title_text"), F.lit('</p><span class="'), F.col("change_class"),
        F.lit(' margin-left-30 pull-right">'), F.col("change_text"),
        F.lit('</span><span class="summary margin-left-30 pull-right">'), F.col("price_text"), F.lit("</span></li>"),
    )
    return l.select("id", "company_id", li.alias("li_html"))


# A landed listing page holds at most this many items (the request limit is 1-100), so building
# pages never gathers an unbounded group: page = (company, id div PAGE_ITEMS).
PAGE_ITEMS = 100


def listing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed listing HTML: one blob per (company, page), items in id order."""
    items = listing_items(spark, sf_dir).withColumn("page_no", F.floor(F.col("id") / PAGE_ITEMS).cast("bigint"))
    return items.groupBy("company_id", "page_no").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("id", "li_html"))), lambda x: x["li_html"]), ""
        ).alias("html")
    )


PAGE_CHARS = 500


def file_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    is_html = F.col("doc_id") % 3 == 0
    n_pages = F.when(is_html, F.lit(1)).otherwise(F.greatest(F.lit(1), F.ceil(F.col("n_chars") / F.lit(500.0)).cast("int")))
    # an HTML file loads as one page, any other as pages of 500 characters (the last takes the rest)
    width = F.when(is_html, F.length("text")).otherwise(F.lit(PAGE_CHARS))
    pages = F.transform(
        F.sequence(F.lit(1), n_pages),
        lambda i: F.substring(F.col("text"), (i - 1) * PAGE_CHARS + 1, F.when(i == n_pages, F.length("text")).otherwise(width)),
    )
    return d.select(
        F.col("doc_id").alias("id"),
        F.concat(F.lit("customer#"), _lpad_num(F.col("doc_id") % 97)).alias("company"),
        (F.col("doc_id") * 7).alias("report_id"),
        F.concat(F.lit("doc "), F.col("doc_id").cast("string"), F.when(is_html, F.lit(".html")).otherwise(F.lit(".pdf"))).alias(
            "file_name"
        ),
        F.when(is_html, F.lit("html")).otherwise(F.lit("pdf")).alias("file_type"),
        F.col("n_chars").alias("file_size"),
        F.md5(F.col("text")).alias("md5_hash"),
        "text",
        n_pages.alias("n_pages"),
        pages.alias("pages"),
    )


def first_arrival_per_md5(arrivals: DataFrame) -> DataFrame:
    """Inside a batch the first row (smallest id) of an md5 wins; NULL md5 never registers.

    ``min(id)`` per md5 is partially aggregated map-side (a hot md5 copied a million times is
    combined before the shuffle), then a semi join on the unique id keeps the winners. Only
    ``(md5, id)`` crosses the aggregation shuffle, and the semi join lets Catalyst prune wide
    columns (the document text) that the consumer does not read.
    """
    winners = (
        arrivals.where(F.col("md5_hash").isNotNull())
        .groupBy("md5_hash")
        .agg(F.min("id").alias("__wid"))
        .select("__wid")
    )
    return arrivals.join(winners, arrivals["id"] == winners["__wid"], "left_semi")


def downloaded_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = first_arrival_per_md5(file_arrivals(spark, sf_dir))
    labels = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("l_id")).distinct()
    j = f.join(labels, f["id"] == labels["l_id"], "left")
    summarized = F.col("l_id").isNotNull()
    return j.select(
        "id", "company", "report_id", "file_name", "file_type", "file_size", "md5_hash",
        summarized.alias("is_summarized"),
        F.when(summarized, F.col("text")).alias("summary_text"),
    )


def _customer_name(c: Column) -> Column:
    return F.concat(F.lit("Customer#"), _lpad_num(c % 97))


def scheduled_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("user_id", "ts")
    agg = e.groupBy("user_id").agg(F.max("ts").alias("last_run"), F.count(F.lit(1)).alias("run_count"))
    u = F.col("user_id")
    cron = F.concat(
        (u % 60).cast("string"), F.lit(" "), (u % 24).cast("string"),
        F.when(u % 3 == 0, F.lit(" * * *"))
        .when(u % 3 == 1, F.concat(F.lit(" * * "), (u % 7).cast("string")))
        .otherwise(F.concat(F.lit(" "), (u % 28 + 1).cast("string"), F.lit(" * *"))),
    )
    return agg.select(
        u.alias("id"),
        F.concat(F.lit("job_"), u.cast("string")).alias("job_name"),
        _customer_name(u).alias("company"),
        cron.alias("cron_schedule"),
        (u % 4 != 0).alias("enabled"),
        F.lit("llama3.2:latest").alias("model"),
        F.when(u % 5 == 0, F.lit(None).cast("int")).otherwise((u % 100 + 1).cast("int")).alias("report_limit"),
        F.when(u % 6 == 0, F.lit(None).cast("string")).otherwise(F.lit('["current","quarterly"]')).alias("report_types"),
        "last_run",
        "run_count",
    )


def job_execution_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts", "value")
    et = F.col("event_type")
    status = (
        F.when(et == "error", "failed").when(et == "click", "running").when(et == "signup", "cancelled").otherwise("success")
    )
    return e.select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("job_"), F.col("user_id").cast("string")).alias("job_name"),
        status.alias("status"),
        F.col("ts").alias("started_at"),
        F.when(et == "click", F.lit(None)).otherwise(F.col("ts") + seconds_interval(F.col("value"))).alias("finished_at"),
        F.floor("value").cast("int").alias("reports_found"),
        (F.col("event_id") % 9).cast("int").alias("documents_processed"),
        F.when(
            et == "error",
            F.concat(
                F.lit("n_samples="), (F.col("event_id") % 5).cast("string"), F.lit(" should be >= n_clusters=5. "),
                F.repeat(F.lit("x"), (F.col("event_id") % 120).cast("int")),
            ),
        ).alias("error_message"),
    )


def summary_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    cid = F.col("conv_id")
    dated = cid % 3 != 0
    return c.where(F.col("role") == "assistant").select(
        (cid * 100 + F.col("turn")).alias("id"),
        F.concat(F.lit("job_"), (cid % 101).cast("string")).alias("job_name"),
        _customer_name(cid).alias("company"),
        F.when(dated, F.lit("2024-01-01").cast("date")).alias("date_from"),
        F.when(dated, F.lit("2024-03-31").cast("date")).alias("date_to"),
        F.when(F.col("turn") % 2 == 0, F.lit("md")).otherwise(F.lit("pdf")).alias("file_format"),
        F.length("text").cast("bigint").alias("file_size"),
        F.substring("text", 1, 200).alias("summary_preview"),
        F.concat(F.lit("2024-01-"), _lpad_num(cid % 28 + 1, 2), F.lit(" 00:00:00"))
        .cast("timestamp_ntz")
        .alias("created_at"),
    )


def run_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts", "value")
    return e.where(F.col("event_type").isin("view", "purchase") & (F.col("event_id") % 3 == 0)).select(
        (F.col("event_id") * 10).alias("id"),
        F.concat(F.lit("job_"), F.col("user_id").cast("string")).alias("job_name"),
        (F.col("ts") + seconds_interval(F.floor("value") / 2)).alias("created_at"),
    )


def search_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts", "value")
    u = F.col("user_id")
    return e.where(F.col("event_type") == "click").select(
        F.col("event_id").alias("id"),
        _customer_name(u).alias("company_name"),
        (F.floor("value").cast("int") % 25 + 1).alias("report_amount"),
        F.when(u % 3 == 0, F.lit("")).when(u % 3 == 1, F.lit("PDF")).otherwise(F.lit("PDF HTML")).alias("download_type"),
        F.when(F.col("event_id") % 5 == 0, F.lit(None).cast("string")).otherwise(F.lit("current quarterly")).alias(
            "report_type"
        ),
        F.when(F.col("event_id") % 7 == 0, F.lit(None).cast("string")).otherwise(F.lit("ESPI EBI")).alias(
            "report_category"
        ),
        F.col("ts").alias("created_at"),
    )


REGISTRY = {
    "companies": companies,
    "reports": reports,
    "downloaded_files": downloaded_files,
    "scheduled_jobs": scheduled_jobs,
    "summary_reports": summary_reports,
    "job_execution_log": job_execution_log,
    "search_history": search_history,
}


def registry_scan(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return REGISTRY[table](spark, sf_dir)


def report_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed report pages: one per filing link, its attachments as ``<tr class="dane">`` rows."""
    f = file_arrivals(spark, sf_dir).select("id", "report_id", "file_name")
    row = F.concat(
        F.lit('<tr class="dane"><td>'), F.col("id").cast("string"), F.lit('</td><td><a href="download/'),
        F.col("id").cast("string"), F.lit('">'), F.col("file_name"), F.lit("</a></td></tr>"),
    )
    pages = f.groupBy("report_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", row.alias("tr")))), lambda x: x["tr"]), "").alias("rows")
    )
    return pages.select(
        F.concat(F.lit(LISTING_BASE + "komunikat?geru_id="), F.col("report_id").cast("string")).alias("link"),
        F.concat(F.lit("<html><body><table>"), F.col("rows"), F.lit("</table></body></html>")).alias("html"),
    )
