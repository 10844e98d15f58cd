"""Registry statistics and views: A1-A9, W1, J2, J3, J10.

The reference computes its two views with three fanned-out LEFT JOINs undone by COUNT(DISTINCT)
and a correlated ``ORDER BY id DESC LIMIT 1`` subquery. Here every side is aggregated first
(partial + final hash aggregation, no fan-out) and the scalar subquery is a ``max_by``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filingflow.operators.common import lower_key


def company_stats(companies: DataFrame, reports: DataFrame, files: DataFrame, summaries: DataFrame) -> DataFrame:
    """A1/J2 v_company_stats: per company counts of reports / files / summaries and latest dates."""
    r = reports.groupBy("company_id").agg(
        F.count(F.lit(1)).alias("total_reports"), F.max("date").alias("latest_report_date")
    )
    f = files.groupBy(lower_key("company").alias("ckey")).agg(F.count(F.lit(1)).alias("downloaded_files"))
    s = summaries.groupBy(lower_key("company").alias("ckey")).agg(
        F.count(F.lit(1)).alias("summary_reports"), F.max("created_at").alias("latest_summary_date")
    )
    c = companies.select("id", "name", "sector", lower_key("name").alias("ckey"))
    j = (
        c.join(r, c["id"] == r["company_id"], "left")
        .join(f, "ckey", "left")
        .join(s, "ckey", "left")
    )
    return j.select(
        F.col("name").alias("company"),
        "sector",
        F.coalesce("total_reports", F.lit(0)).alias("total_reports"),
        F.coalesce("downloaded_files", F.lit(0)).alias("downloaded_files"),
        F.coalesce("summary_reports", F.lit(0)).alias("summary_reports"),
        "latest_report_date",
        "latest_summary_date",
    )


def company_stats_ordered(companies, reports, files, summaries) -> DataFrame:
    """A1 as read by the statistics screen: ordered by total_reports descending."""
    return company_stats(companies, reports, files, summaries).orderBy(F.desc("total_reports"), "company")


def company_file_stats(companies: DataFrame, reports: DataFrame, files: DataFrame) -> DataFrame:
    """A2 (documented variant): files reached through reports, bytes, summarised count."""
    per_report = files.groupBy("report_id").agg(
        F.count(F.lit(1)).alias("nf"),
        F.sum("file_size").alias("nbytes"),
        F.count_if(F.col("is_summarized")).alias("nsum"),
    )
    r = reports.select("id", "company_id")
    through = (
        per_report.join(r, per_report["report_id"] == r["id"], "inner")
        .groupBy("company_id")
        .agg(F.sum("nf").alias("total_files"), F.sum("nbytes").alias("total_size_bytes"), F.sum("nsum").alias("summarized_count"))
    )
    rc = r.groupBy("company_id").agg(F.count(F.lit(1)).alias("total_reports"))
    c = companies.select("id", "name")
    j = c.join(rc, c["id"] == rc["company_id"], "left").drop("company_id")
    j = j.join(through, j["id"] == through["company_id"], "left")
    return j.select(
        "name",
        F.coalesce("total_reports", F.lit(0)).alias("total_reports"),
        F.coalesce("total_files", F.lit(0)).alias("total_files"),
        F.col("total_size_bytes").cast("bigint").alias("total_size_bytes"),
        F.coalesce("summarized_count", F.lit(0)).alias("summarized_count"),
    )


def last_status_per_job(log: DataFrame) -> DataFrame:
    """Status of the highest execution id per job (``ORDER BY id DESC LIMIT 1``)."""
    return log.groupBy("job_name").agg(F.max_by("status", "id").alias("last_status"))


def summary_count_per_job(summaries: DataFrame) -> DataFrame:
    """A3: summary reports per job (the id is the table's key, so a plain count is a distinct one)."""
    return summaries.groupBy("job_name").agg(F.count("id").alias("summary_count"))


def active_jobs(jobs: DataFrame, summaries: DataFrame, log: DataFrame) -> DataFrame:
    """J3 v_active_jobs (DDL form: no enabled filter)."""
    j = jobs.join(summary_count_per_job(summaries), "job_name", "left").join(last_status_per_job(log), "job_name", "left")
    return j.select(
        "id", "job_name", "company", "model", "cron_schedule", "enabled", "last_run",
        F.col("next_run") if "next_run" in jobs.columns else F.lit(None).cast("timestamp_ntz").alias("next_run"),
        "run_count",
        F.coalesce("summary_count", F.lit(0)).alias("summary_count"),
        "last_status",
    )


def next_jobs(jobs: DataFrame) -> DataFrame:
    """A4 (documented variant): enabled jobs by next_run ascending (NULLs first, as MySQL)."""
    nr = F.col("next_run") if "next_run" in jobs.columns else F.lit(None).cast("timestamp_ntz")
    return (
        jobs.where(F.col("enabled"))
        .select("id", "job_name", "company", "model", "cron_schedule", "enabled", "last_run", nr.alias("next_run"), "run_count")
        .orderBy(F.asc_nulls_first("next_run"), "id")
    )


def file_exists(requests: DataFrame, files: DataFrame, md5_col: str = "md5_hash") -> DataFrame:
    """A5 check_file_exists for a table of hashes: (md5, exists, smallest id)."""
    per = files.where(F.col("md5_hash").isNotNull()).groupBy("md5_hash").agg(
        F.count(F.lit(1)).alias("n"), F.min("id").alias("file_id")
    )
    q = requests.select(F.col(md5_col).alias("q_md5")).distinct()
    j = q.join(per, q["q_md5"] == per["md5_hash"], "left")
    return j.select(
        F.col("q_md5").alias("md5_hash"),
        (F.coalesce("n", F.lit(0)) > 0).alias("file_exists"),
        "file_id",
    )


def run_counts(log: DataFrame) -> DataFrame:
    """Filings and documents per run, totalled per job."""
    return log.groupBy("job_name").agg(
        F.count(F.lit(1)).alias("runs"),
        F.sum("reports_found").cast("bigint").alias("reports_found"),
        F.sum("documents_processed").cast("bigint").alias("documents_processed"),
    )


def job_run_stats(log: DataFrame, finished_statuses=("success",)) -> DataFrame:
    """Per job, number of finished runs and the latest finish (input to U6)."""
    fin = log.where(F.col("status").isin(*finished_statuses) & F.col("finished_at").isNotNull())
    return fin.groupBy("job_name").agg(
        F.count(F.lit(1)).alias("finished_runs"), F.max("finished_at").alias("last_run")
    )


def report_tags(summaries: DataFrame) -> DataFrame:
    """tags = [lower(company), job name with '_' -> '-']."""
    return summaries.select(
        "id", F.array(F.lower("company"), F.replace(F.col("job_name"), F.lit("_"), F.lit("-"))).alias("tags")
    )

