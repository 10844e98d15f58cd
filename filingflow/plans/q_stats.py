"""Catalogue entries: statistics, views, windows over the registry (A*, W1, J2, J3, J10, J11)."""

from __future__ import annotations

from filingflow.operators import stats
from filingflow.plans.catalog import register
from filingflow.sources import tables as T


def _four(spark, sf):
    return (T.companies(spark, sf), T.reports(spark, sf), T.downloaded_files(spark, sf), T.summary_reports(spark, sf))


# Each side is grouped on its own key before it meets the companies, so nothing has to be counted distinct.
_PER_COMPANY = """
WITH filings AS (SELECT company_id AS cid, count(*) AS n, max(date) AS newest FROM reports GROUP BY 1),
stored AS (SELECT lower(company) AS k, count(*) AS n FROM downloaded_files GROUP BY 1),
digests AS (SELECT lower(company) AS k, count(*) AS n, max(created_at) AS newest FROM summary_reports GROUP BY 1)
SELECT companies.name AS company, companies.sector AS sector,
  ifnull(filings.n, 0) AS total_reports, ifnull(stored.n, 0) AS downloaded_files, ifnull(digests.n, 0) AS summary_reports,
  filings.newest AS latest_report_date, digests.newest AS latest_summary_date
FROM companies
  LEFT JOIN filings ON filings.cid = companies.id
  LEFT JOIN stored ON stored.k = lower(companies.name)
  LEFT JOIN digests ON digests.k = lower(companies.name)
"""
_STATS_TABLES = ("companies", "reports", "downloaded_files", "summary_reports")


@register("company_stats", _PER_COMPANY + " ORDER BY total_reports DESC", _STATS_TABLES)
def q_company_stats(spark, sf):
    return stats.company_stats_ordered(*_four(spark, sf))


@register("company_stats_view", _PER_COMPANY, _STATS_TABLES)
def q_company_stats_view(spark, sf):
    return stats.company_stats(*_four(spark, sf))


@register(
    "company_file_stats",
    """
WITH sizes AS (
  SELECT report_id, count(*) AS files, sum(file_size) AS bytes, count_if(is_summarized) AS done FROM downloaded_files GROUP BY 1),
filings AS (
  SELECT company_id, count(*) AS filings, sum(files) AS files, sum(bytes) AS bytes, sum(done) AS done
  FROM reports LEFT JOIN sizes ON report_id = reports.id GROUP BY 1)
SELECT name, ifnull(filings, 0) AS total_reports, CAST(ifnull(files, 0) AS BIGINT) AS total_files,
  CAST(bytes AS BIGINT) AS total_size_bytes, CAST(ifnull(done, 0) AS BIGINT) AS summarized_count
FROM companies LEFT JOIN filings ON company_id = companies.id
""",
    ("companies", "reports", "downloaded_files"),
)
def q_company_file_stats(spark, sf):
    return stats.company_file_stats(T.companies(spark, sf), T.reports(spark, sf), T.downloaded_files(spark, sf))


_JOB_OVERVIEW = """
WITH newest AS (SELECT job_name, arg_max(status, id) AS last_status FROM job_execution_log GROUP BY 1),
digests AS (SELECT job_name, count(*) AS summary_count FROM summary_reports GROUP BY 1)
SELECT id, job_name, company, model, cron_schedule, enabled, last_run, CAST(NULL AS TIMESTAMP) AS next_run, run_count,
  ifnull(summary_count, 0) AS summary_count, last_status
FROM scheduled_jobs LEFT JOIN digests USING (job_name) LEFT JOIN newest USING (job_name)
"""


@register("active_jobs", _JOB_OVERVIEW, ("scheduled_jobs", "summary_reports", "job_execution_log"))
def q_active_jobs(spark, sf):
    return stats.active_jobs(T.scheduled_jobs(spark, sf), T.summary_reports(spark, sf), T.job_execution_log(spark, sf))


@register(
    "active_jobs_summary_count",
    "SELECT job_name, count(*) AS summary_count FROM summary_reports GROUP BY ALL",
    ("summary_reports",),
)
def q_summary_count(spark, sf):
    return stats.summary_count_per_job(T.summary_reports(spark, sf))


@register(
    "last_status_per_job",
    "SELECT job_name, arg_max(status, id) AS last_status FROM job_execution_log GROUP BY ALL",
    ("job_execution_log",),
)
def q_last_status(spark, sf):
    return stats.last_status_per_job(T.job_execution_log(spark, sf))


@register(
    "next_jobs",
    """
SELECT id, job_name, company, model, cron_schedule, enabled, last_run, CAST(NULL AS TIMESTAMP) AS next_run, run_count
FROM scheduled_jobs WHERE enabled = TRUE ORDER BY next_run ASC NULLS FIRST, id
""",
    ("scheduled_jobs",),
)
def q_next_jobs(spark, sf):
    return stats.next_jobs(T.scheduled_jobs(spark, sf))


@register(
    "file_exists",
    """
SELECT q.md5_hash, (SELECT COUNT(*) FROM downloaded_files d WHERE d.md5_hash = q.md5_hash) > 0 AS file_exists,
  (SELECT min(id) FROM downloaded_files d WHERE d.md5_hash = q.md5_hash) AS file_id
FROM (SELECT DISTINCT md5(text) AS md5_hash FROM benchmark UNION SELECT DISTINCT md5_hash FROM file_arrivals) q
""",
    ("downloaded_files",),
)
def q_file_exists(spark, sf):
    from pyspark.sql import functions as F

    bench = T.read(spark, sf, "benchmark").select(F.md5("text").alias("md5_hash"))
    arrivals = T.file_arrivals(spark, sf).select("md5_hash")
    return stats.file_exists(bench.unionByName(arrivals), T.downloaded_files(spark, sf))


@register(
    "run_counts",
    """
SELECT job_name, COUNT(*) AS runs, CAST(SUM(reports_found) AS BIGINT) AS reports_found,
  CAST(SUM(documents_processed) AS BIGINT) AS documents_processed
FROM job_execution_log GROUP BY job_name
""",
    ("job_execution_log",),
)
def q_run_counts(spark, sf):
    return stats.run_counts(T.job_execution_log(spark, sf))


@register(
    "job_run_stats",
    """
SELECT j.job_name, j.run_count + COALESCE(a.finished_runs, 0) AS run_count,
  COALESCE(a.last_run, j.last_run) AS last_run
FROM scheduled_jobs j LEFT JOIN (
  SELECT job_name, COUNT(*) AS finished_runs, max(finished_at) AS last_run
  FROM job_execution_log WHERE status = 'success' AND finished_at IS NOT NULL GROUP BY job_name) a
ON a.job_name = j.job_name
""",
    ("scheduled_jobs", "job_execution_log"),
)
def q_job_run_stats(spark, sf):
    from pyspark.sql import functions as F

    jobs = T.scheduled_jobs(spark, sf)
    a = stats.job_run_stats(T.job_execution_log(spark, sf)).withColumnRenamed("last_run", "a_last")
    j = jobs.join(a, "job_name", "left")
    return j.select(
        "job_name",
        (F.col("run_count") + F.coalesce("finished_runs", F.lit(0))).alias("run_count"),
        F.coalesce("a_last", "last_run").alias("last_run"),
    )


@register(
    "report_tags",
    "SELECT id, [lower(company), replace(job_name, '_', '-')] AS tags FROM summary_reports",
    ("summary_reports",),
)
def q_report_tags(spark, sf):
    return stats.report_tags(T.summary_reports(spark, sf))
