"""Catalogue entries: search surface F1-F16 and limits T1-T3."""

from __future__ import annotations

from pyspark.sql import functions as F

from filingflow.functions import text as X
from filingflow.operators import search as S
from filingflow.plans.catalog import register
from filingflow.sources import tables as T

_SIZE_KB_SQL = """CASE WHEN coalesce({c}, 0) = 0 THEN 'N/A' ELSE concat(CAST(({c} * 20 + 1024) // 2048 // 10 AS VARCHAR), '.',
  CAST((({c} * 20 + 1024) // 2048) % 10 AS VARCHAR), ' KB') END"""


@register(
    "search_reports",
    """SELECT * FROM reports WHERE date >= DATE '1995-01-01' AND date <= DATE '1996-12-31' AND report_type = 'quarterly'
ORDER BY date DESC, id DESC LIMIT 100""",
    ("reports",),
)
def q_search_reports(spark, sf):
    return S.search_reports(T.reports(spark, sf), date_from="1995-01-01", date_to="1996-12-31", report_type="quarterly")


@register("search_files", "SELECT * FROM downloaded_files WHERE is_summarized = TRUE", ("downloaded_files",))
def q_search_files(spark, sf):
    return S.search_files(T.downloaded_files(spark, sf), is_summarized=True)


@register(
    "file_by_name",
    """SELECT q.company, q.file_name, f.id AS file_id, f.file_size, f.md5_hash
FROM (SELECT DISTINCT company, file_name FROM file_arrivals) q
LEFT JOIN downloaded_files f ON f.company = q.company AND f.file_name = q.file_name
  AND f.id = (SELECT min(id) FROM downloaded_files d WHERE d.company = q.company AND d.file_name = q.file_name)""",
    ("file_arrivals", "downloaded_files"),
)
def q_file_by_name(spark, sf):
    return S.file_by_name(T.file_arrivals(spark, sf), T.downloaded_files(spark, sf))


def _summaries_with_tags(spark, sf):
    s = T.summary_reports(spark, sf)
    return s.withColumn(
        "tags_json", X.json_list_encode(F.array(F.lower("company"), F.replace(F.col("job_name"), F.lit("_"), F.lit("-"))))
    )


@register(
    "search_summary_reports",
    """SELECT *, CAST(CAST(concat('["', lower(company), '", "', replace(job_name, '_', '-'), '"]') AS JSON) AS VARCHAR[]) AS tags
FROM summary_reports WHERE date_from >= DATE '2024-01-01' AND date_to <= DATE '2024-03-31'
ORDER BY created_at DESC, id DESC LIMIT 50""",
    ("summary_reports",),
)
def q_search_summary_reports(spark, sf):
    return S.search_summary_reports(_summaries_with_tags(spark, sf), date_from="2024-01-01", date_to="2024-03-31")


@register(
    "browse_summary_reports",
    f"""SELECT id, job_name, company, coalesce(CAST(date_from AS VARCHAR), 'N/A') AS date_from,
  coalesce(CAST(date_to AS VARCHAR), 'N/A') AS date_to, coalesce(upper(file_format), 'N/A') AS file_format,
  {_SIZE_KB_SQL.format(c="file_size")} AS file_size,
  coalesce(strftime(created_at, '%Y-%m-%d %H:%M:%S'), 'N/A') AS created_at
FROM (SELECT * FROM summary_reports ORDER BY created_at DESC, id DESC LIMIT 50) t
WHERE contains(lower(job_name), 'job_5')""",
    ("summary_reports",),
)
def q_browse_summary_reports(spark, sf):
    return S.browse_summary_reports(T.summary_reports(spark, sf), job_filter="JOB_5")


@register(
    "summary_report_by_id",
    """SELECT q.requested_id, s.job_name, s.company, s.date_from, s.date_to, s.file_format, s.file_size,
  s.summary_preview, s.created_at
FROM (SELECT DISTINCT conv_id * 100 + turn AS requested_id FROM conversations) q
LEFT JOIN summary_reports s ON s.id = q.requested_id""",
    ("summary_reports",),
)
def q_summary_report_by_id(spark, sf):
    req = T.read(spark, sf, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("requested_id"))
    return S.summary_report_by_id(req, T.summary_reports(spark, sf))


@register(
    "search_execution_log",
    "SELECT * FROM job_execution_log ORDER BY started_at DESC, id DESC LIMIT 50",
    ("job_execution_log",),
)
def q_search_execution_log(spark, sf):
    return S.search_execution_log(T.job_execution_log(spark, sf))


_JOB_DECODED = """id, job_name, company, cron_schedule, enabled, model,
  CASE WHEN job_name IS NULL THEN NULL ELSE coalesce(report_limit, 5) END AS report_limit,
  CAST(CAST(NULLIF(report_types, '') AS JSON) AS VARCHAR[]) AS report_types, last_run, run_count"""


@register(
    "list_jobs",
    f"SELECT {_JOB_DECODED} FROM scheduled_jobs WHERE enabled = TRUE ORDER BY job_name",
    ("scheduled_jobs",),
)
def q_list_jobs(spark, sf):
    return S.list_jobs(T.scheduled_jobs(spark, sf), enabled_only=True)


@register(
    "job_by_name",
    f"""SELECT q.requested_job, {_JOB_DECODED}
FROM (SELECT DISTINCT job_name AS requested_job FROM summary_reports) q
LEFT JOIN scheduled_jobs j ON j.job_name = q.requested_job""",
    ("summary_reports", "scheduled_jobs"),
)
def q_job_by_name(spark, sf):
    return S.job_by_name(T.summary_reports(spark, sf).select("job_name"), T.scheduled_jobs(spark, sf))


@register(
    "recent_searches",
    "SELECT * FROM search_history ORDER BY created_at DESC, id DESC LIMIT 50",
    ("search_history",),
)
def q_recent_searches(spark, sf):
    return S.recent_searches(T.search_history(spark, sf))


@register(
    "recent_searches_display",
    """SELECT id, coalesce(nullif(company_name, ''), 'not specified') AS company_name,
  coalesce(nullif(CAST(report_amount AS VARCHAR), ''), 'not specified') AS report_amount,
  coalesce(nullif(download_type, ''), 'not specified') AS download_type,
  'not specified' AS report_date,
  coalesce(nullif(report_type, ''), 'not specified') AS report_type,
  coalesce(nullif(report_category, ''), 'not specified') AS report_category
FROM search_history ORDER BY created_at DESC, id DESC LIMIT 2""",
    ("search_history",),
)
def q_recent_searches_display(spark, sf):
    h = T.search_history(spark, sf).withColumn("report_date", F.lit(None).cast("date"))
    return S.recent_searches_display(h)


@register(
    "company_lookup",
    """SELECT q.pattern, (SELECT min(id) FROM companies c WHERE lower(c.name) LIKE lower(q.pattern)) AS company_id
FROM (SELECT DISTINCT company_name AS pattern FROM search_history
      UNION SELECT DISTINCT concat(substr(company_name, 1, 17), '_') FROM search_history
      UNION SELECT DISTINCT concat(substr(company_name, 1, 16), '%') FROM search_history
      UNION SELECT DISTINCT concat('%', substr(company_name, 15, 4), '_%') FROM search_history
      UNION SELECT unnest(['%', '_', repeat('_', 18), 'Customer#%', '%7', 'C%9', '%#%', '%zz%', '%00_7%'])) q""",
    ("companies", "search_history"),
)
def q_company_lookup(spark, sf):
    h = T.search_history(spark, sf)
    req = h.select(F.col("company_name").alias("name")).unionByName(
        h.select(
            F.explode(
                F.array(
                    F.concat(F.substring("company_name", 1, 17), F.lit("_")),
                    F.concat(F.substring("company_name", 1, 16), F.lit("%")),
                    F.concat(F.lit("%"), F.substring("company_name", 15, 4), F.lit("_%")),
                    *[F.lit(p) for p in ("%", "_", "_" * 18, "Customer#%", "%7", "C%9", "%#%", "%zz%", "%00_7%")],
                )
            ).alias("name")
        )
    )
    return S.company_lookup(req, T.companies(spark, sf))


@register("list_companies", "SELECT id, name, full_name, sector FROM companies ORDER BY name, id", ("companies",))
def q_list_companies(spark, sf):
    return S.list_companies(T.companies(spark, sf))


_JOB_REQ = """jr AS (SELECT job_name, lower(company) AS ckey,
  coalesce(CAST(CAST(NULLIF(report_types, '') AS JSON) AS VARCHAR[]), ['current', 'quarterly', 'semi-annual', 'annual']) AS types,
  coalesce(report_limit, 5) AS lim FROM scheduled_jobs)"""

# A third of the requests ask for days, two fifths for one category; the rest take the defaults.
_DATED_REQ = """jr AS (SELECT job_name, lower(company) AS ckey,
  coalesce(CAST(CAST(NULLIF(report_types, '') AS JSON) AS VARCHAR[]), ['current', 'quarterly', 'semi-annual', 'annual']) AS types,
  CASE id % 5 WHEN 0 THEN ['ESPI'] WHEN 1 THEN ['EBI'] ELSE ['ESPI', 'EBI'] END AS cats,
  CASE id % 6 WHEN 0 THEN DATE '1995-01-01' WHEN 3 THEN DATE '1997-06-17' END AS d1,
  CASE id % 6 WHEN 0 THEN DATE '1996-12-31' WHEN 3 THEN DATE '1997-06-17' END AS d2,
  coalesce(report_limit, 5) * CASE WHEN id % 7 = 0 THEN 50 ELSE 1 END AS lim FROM scheduled_jobs)"""


def _requests(spark, sf):
    j, k = T.scheduled_jobs(spark, sf), F.col("id")
    return j.withColumns(
        {
            "report_categories": F.when(k % 5 == 0, '["ESPI"]').when(k % 5 == 1, '["EBI"]'),
            "date_request": F.when(k % 6 == 0, "01-01-1995 - 31-12-1996").when(k % 6 == 3, "17-06-1997").otherwise(F.lit("")),
            "report_limit": F.coalesce("report_limit", F.lit(5)) * F.when(k % 7 == 0, F.lit(50)).otherwise(F.lit(1)),
        }
    )


@register(
    "listing_filter",
    f"""WITH {_DATED_REQ},
cand AS (SELECT jr.job_name, r.id, r.date, r.report_type, r.report_category, jr.lim,
  row_number() OVER (PARTITION BY jr.job_name ORDER BY r.date DESC, r.id DESC) AS rn
  FROM jr JOIN companies c ON lower(c.name) = jr.ckey JOIN reports r ON r.company_id = c.id
  WHERE list_contains(jr.cats, r.report_category) AND list_contains(jr.types, r.report_type)
    AND (d1 IS NULL OR r.date BETWEEN d1 AND d2))
SELECT job_name, id, date, report_type, report_category, CAST(rn AS INTEGER) AS rn FROM cand WHERE rn <= lim""",
    ("scheduled_jobs", "companies", "reports"),
)
def q_listing_filter(spark, sf):
    return S.listing_filter(_requests(spark, sf), T.companies(spark, sf), T.reports(spark, sf))


@register(
    "per_request_limit",
    f"""WITH {_JOB_REQ},
cand AS (SELECT jr.job_name, r.id, r.date, jr.lim,
  row_number() OVER (PARTITION BY jr.job_name ORDER BY r.date DESC, r.id DESC) AS rn
  FROM jr JOIN companies c ON lower(c.name) = jr.ckey JOIN reports r ON r.company_id = c.id)
SELECT job_name, id, date, CAST(rn AS INTEGER) AS rn FROM cand WHERE rn <= lim""",
    ("scheduled_jobs", "companies", "reports"),
)
def q_per_request_limit(spark, sf):
    return S.report_limit_per_job(T.scheduled_jobs(spark, sf), T.companies(spark, sf), T.reports(spark, sf))


@register(
    "file_type_filter",
    """SELECT id, file_name, (suffix(file_name, '.pdf') OR suffix(file_name, '.html') OR suffix(file_name, '.htm')) AS summarisable
FROM file_arrivals""",
    ("file_arrivals",),
)
def q_file_type_filter(spark, sf):
    return S.file_type_filter(T.file_arrivals(spark, sf))


@register(
    "required_field_check",
    """SELECT id, company, coalesce(length(trim(company)) > 0, FALSE) AS accepted,
  CASE WHEN NOT coalesce(length(trim(company)) > 0, FALSE) THEN 'Error: Company name is required' END AS error
FROM (SELECT id, CASE WHEN download_type = '' THEN ' ' ELSE company_name END AS company FROM search_history) q""",
    ("search_history",),
)
def q_required_field_check(spark, sf):
    h = T.search_history(spark, sf)
    req = h.select("id", F.when(F.col("download_type") == "", F.lit(" ")).otherwise(F.col("company_name")).alias("company"))
    return S.required_field_check(req)


_DUR = "(epoch_us(finished_at) - epoch_us(started_at))"


@register(
    "execution_history",
    f"""SELECT id, job_name,
  CASE status WHEN 'success' THEN '✅ Sukces' WHEN 'failed' THEN '❌ Błąd' WHEN 'running' THEN '⏳ W trakcie'
    WHEN 'no_reports' THEN 'ℹ️ Brak raportów' ELSE '❓ Nieznany' END AS status,
  coalesce(strftime(started_at, '%Y-%m-%d %H:%M:%S'), 'N/A') AS started,
  CASE WHEN started_at IS NULL OR finished_at IS NULL THEN 'N/A'
    WHEN {_DUR} < 60000000 THEN concat(CAST(({_DUR} + 50000) // 100000 // 10 AS VARCHAR), '.',
      CAST((({_DUR} + 50000) // 100000) % 10 AS VARCHAR), 's')
    ELSE concat(CAST(({_DUR} + 3000000) // 6000000 // 10 AS VARCHAR), '.',
      CAST((({_DUR} + 3000000) // 6000000) % 10 AS VARCHAR), 'min') END AS duration,
  reports_found, CASE WHEN id % 3 = 0 THEN '-' WHEN documents_processed > 0 THEN concat('📄 ', documents_processed, ' doc') ELSE '📂 Log' END AS results,
  coalesce(nullif(CASE WHEN length(error_message) > 100 THEN concat(substr(error_message, 1, 97), '...')
    ELSE error_message END, ''), '-') AS error
FROM job_execution_log""",
    ("job_execution_log",),
)
def q_execution_history(spark, sf):
    log = T.job_execution_log(spark, sf)  # two runs of three have a log file
    return S.execution_history(log.withColumn("log_file_path", F.when(F.col("id") % 3 != 0, F.concat(F.lit("logs/"), F.col("id").cast("string")))))
