"""Catalogue entries: registry writes and joins — U1-U15, W3, J1, J4, J6, J10-J12."""

from __future__ import annotations

from pyspark.sql import functions as F

from filingflow.operators import registry as R
from filingflow.plans.catalog import ORACLES, register
from filingflow.session import scratch_dir
from filingflow.sources import listing as L
from filingflow.sources import tables as T
from filingflow.sources.snapshots import SnapshotTable
from filingflow.sources.schemas import REGISTRY_SCHEMAS, conform, domain_check

AS_OF = "2024-02-01 00:00:00"

_FEED_NAMES = "SELECT DISTINCT company AS name FROM file_arrivals UNION SELECT DISTINCT company_name FROM search_history"


@register(
    "insert_company",
    f"""WITH feed AS ({_FEED_NAMES}),
fresh AS (SELECT min(name) AS name FROM feed WHERE lower(name) NOT IN (SELECT lower(name) FROM companies) GROUP BY lower(name))
SELECT id, name, full_name, sector FROM companies
UNION ALL SELECT (SELECT max(id) FROM companies) + row_number() OVER (ORDER BY name), name,
  CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR) FROM fresh""",
    ("companies", "file_arrivals", "search_history"),
)
def q_insert_company(spark, sf):
    feed = T.file_arrivals(spark, sf).select(F.col("company").alias("name")).unionByName(
        T.search_history(spark, sf).select(F.col("company_name").alias("name"))
    )
    return R.insert_companies(T.companies(spark, sf), feed)


@register(
    "resolve_company",
    """SELECT h.id, h.company_name, c.company_id FROM search_history h
LEFT JOIN (SELECT lower(name) AS k, min(id) AS company_id FROM companies GROUP BY 1) c ON c.k = lower(h.company_name)""",
    ("companies", "search_history"),
)
def q_resolve_company(spark, sf):
    feed = T.search_history(spark, sf).select("id", "company_name")
    return R.resolve_company(feed, T.companies(spark, sf), "company_name")


_PL = """CASE report_type WHEN 'current' THEN 'Bieżący' WHEN 'quarterly' THEN 'Kwartalny'
  WHEN 'semi-annual' THEN 'Półroczny' WHEN 'interim' THEN 'Śródroczny' ELSE 'Roczny' END"""


@register(
    "append_reports",
    f"""SELECT id, company_id, date, title, report_type, report_category, rate_change, exchange_rate, link FROM reports
UNION ALL SELECT (SELECT max(id) FROM reports) + row_number() OVER (ORDER BY company_id, id), company_id, date,
  CASE WHEN title = '' THEN concat('UNTITLED ', {_PL}, ' REPORT') ELSE title END,
  report_type, report_category, rate_change, exchange_rate, link FROM reports""",
    ("reports",),
)
def q_append_reports(spark, sf):
    accepted, _ = L.normalise_listing(L.listing_page_scan(T.listing_pages(spark, sf)))
    return R.append_reports(T.reports(spark, sf), accepted, ["company_id", "page_no", "pos"])


_W3 = """SELECT id, company, report_id, file_name, file_type, file_size, md5_hash, text, n_pages FROM file_arrivals
WHERE id IN (SELECT min(id) FROM file_arrivals WHERE md5_hash IS NOT NULL GROUP BY md5_hash)"""


@register("first_arrival_dedup", _W3, ("file_arrivals",))
def q_first_arrival_dedup(spark, sf):
    return R.first_arrival_dedup(T.file_arrivals(spark, sf).drop("pages"))


def _arrivals_lang(spark, sf):
    d = T.read(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang")
    return T.file_arrivals(spark, sf).join(d, "id")


def _registry_before(spark, sf):
    """Registry before the batch: the first arrival per md5 among the English documents."""
    reg = R.first_arrival_dedup(_arrivals_lang(spark, sf).where(F.col("lang") == "en").drop("lang"))
    return reg.select(
        "id", "company", "report_id", "file_name", "file_type", "file_size", "md5_hash",
        F.lit(False).alias("is_summarized"), F.lit(None).cast("string").alias("summary_text"),
    )


_REG_CTES = """a AS (SELECT f.*, d.lang FROM file_arrivals f JOIN documents d ON d.doc_id = f.id),
reg AS (SELECT * FROM a WHERE lang = 'en' AND id IN (SELECT min(id) FROM a WHERE lang = 'en' GROUP BY md5_hash)),
batch AS (SELECT * FROM a WHERE lang <> 'en')"""


@register(
    "new_files_only",
    f"""WITH {_REG_CTES}
SELECT id, md5_hash FROM batch WHERE md5_hash NOT IN (SELECT md5_hash FROM reg)""",
    ("file_arrivals",),
)
def q_new_files_only(spark, sf):
    batch = _arrivals_lang(spark, sf).where(F.col("lang") != "en")
    return R.new_files_only(batch, _registry_before(spark, sf)).select("id", "md5_hash")


@register(
    "register_files",
    f"""WITH {_REG_CTES},
b AS (SELECT * FROM batch WHERE id IN (SELECT min(id) FROM batch GROUP BY md5_hash)
      AND md5_hash NOT IN (SELECT md5_hash FROM reg))
SELECT id, company, report_id, file_name, file_type, file_size, md5_hash, FALSE AS is_summarized,
  CAST(NULL AS VARCHAR) AS summary_text FROM reg
UNION ALL SELECT (SELECT max(id) FROM reg) + row_number() OVER (ORDER BY id), company, report_id, file_name, file_type,
  file_size, md5_hash, FALSE, CAST(NULL AS VARCHAR) FROM b""",
    ("file_arrivals",),
)
def q_register_files(spark, sf):
    batch = _arrivals_lang(spark, sf).where(F.col("lang") != "en").drop("lang")
    return R.register_files(_registry_before(spark, sf), batch)


@register(
    "update_file_summary",
    """SELECT f.id, f.company, f.report_id, f.file_name, f.file_type, f.file_size, f.md5_hash,
  CASE WHEN l.doc_id IS NOT NULL THEN TRUE ELSE f.is_summarized END AS is_summarized,
  CASE WHEN l.doc_id IS NOT NULL THEN concat('quality=', CAST(l.quality AS VARCHAR), ' toxic=', CAST(l.toxic AS VARCHAR))
    ELSE f.summary_text END AS summary_text
FROM downloaded_files f LEFT JOIN labels l ON l.doc_id = f.id""",
    ("downloaded_files",),
)
def q_update_file_summary(spark, sf):
    lab = T.read(spark, sf, "labels")
    changes = lab.select(
        F.col("doc_id").alias("id"),
        F.concat(F.lit("quality="), F.col("quality").cast("string"), F.lit(" toxic="), F.col("toxic").cast("string")).alias(
            "summary_text"
        ),
        F.col("doc_id").alias("change_no"),
    )
    return R.update_file_summary(T.downloaded_files(spark, sf), changes)


_JOB_BATCH = """b AS (SELECT job_name, company, '0 9 * * 1' AS cron_schedule, TRUE AS enabled, 'llama3.2:latest' AS model,
  CAST(NULL AS INTEGER) AS report_limit, CAST(NULL AS VARCHAR) AS report_types, id AS change_no FROM summary_reports),
last AS (SELECT * FROM b WHERE change_no IN (SELECT max(change_no) FROM b GROUP BY job_name))"""


def _job_batch(spark, sf):
    s = T.summary_reports(spark, sf)
    return s.select(
        "job_name", "company", F.lit("0 9 * * 1").alias("cron_schedule"), F.lit(True).alias("enabled"),
        F.lit("llama3.2:latest").alias("model"), F.lit(None).cast("int").alias("report_limit"),
        F.lit(None).cast("string").alias("report_types"), F.col("id").alias("change_no"),
    )


# The job table with all its columns: those the bindings lack are derived from the last run.
_FULL_JOBS = """fj AS (SELECT id, job_name, company, CAST(last_run AS DATE) AS date_from, CAST(NULL AS DATE) AS date_to, model, cron_schedule, enabled,
  report_limit, report_types, CASE WHEN id % 2 = 0 THEN '["ESPI"]' END AS report_categories, last_run, last_run + INTERVAL 1 DAY AS next_run,
  run_count, last_run - INTERVAL 9 DAY AS created_at, last_run AS updated_at FROM scheduled_jobs)"""


def _full_jobs(spark, sf):
    day = F.make_dt_interval(F.lit(1))
    return T.scheduled_jobs(spark, sf).select(
        "id", "job_name", "company", F.col("last_run").cast("date").alias("date_from"), F.lit(None).cast("date").alias("date_to"),
        "model", "cron_schedule", "enabled", "report_limit", "report_types", F.when(F.col("id") % 2 == 0, '["ESPI"]').alias("report_categories"),
        "last_run", (F.col("last_run") + day).alias("next_run"), "run_count", (F.col("last_run") - day * 9).alias("created_at"),
        F.col("last_run").alias("updated_at"),
    )


@register(
    "upsert_jobs",
    f"""WITH {_JOB_BATCH}, {_FULL_JOBS}
SELECT * FROM fj WHERE job_name NOT IN (SELECT job_name FROM last)
UNION ALL BY NAME SELECT fj.id, fj.job_name, l.company, CAST(NULL AS DATE) AS date_from, CAST(NULL AS DATE) AS date_to, l.model, l.cron_schedule,
  l.enabled, l.report_limit, l.report_types, CAST(NULL AS VARCHAR) AS report_categories, fj.last_run, fj.next_run, fj.run_count, fj.created_at,
  TIMESTAMP '{AS_OF}' AS updated_at FROM fj JOIN last l ON l.job_name = fj.job_name
UNION ALL BY NAME SELECT (SELECT max(id) FROM fj) + row_number() OVER (ORDER BY l.job_name) AS id, l.job_name, l.company, l.model,
  l.cron_schedule, l.enabled, l.report_limit, l.report_types, CAST(0 AS BIGINT) AS run_count, TIMESTAMP '{AS_OF}' AS created_at,
  TIMESTAMP '{AS_OF}' AS updated_at FROM last l WHERE l.job_name NOT IN (SELECT job_name FROM fj)""",
    ("summary_reports", "scheduled_jobs"),
)
def q_upsert_jobs(spark, sf):
    return R.upsert_jobs(_full_jobs(spark, sf), _job_batch(spark, sf), AS_OF)


@register("jobs_snapshot")
def q_jobs_snapshot(spark, sf):
    """U5 on a copy-on-write table, written while it is built: the state after an upsert that rewrites the buckets it names."""
    table = SnapshotTable(spark, scratch_dir(spark, "jobs-table"), ["job_name"])
    table.create(_full_jobs(spark, sf))
    table.apply(_job_batch(spark, sf), lambda jobs, batch, last: R.upsert_jobs(jobs, batch, AS_OF, last_id=last))
    return table.read()


ORACLES["jobs_snapshot"] = ORACLES["upsert_jobs"]


@register(
    "update_run_stats",
    """SELECT j.job_name, CASE WHEN a.n IS NULL THEN j.last_run ELSE a.last END AS last_run,
  CAST(NULL AS TIMESTAMP) AS next_run, j.run_count + coalesce(a.n, 0) AS run_count
FROM scheduled_jobs j LEFT JOIN (SELECT job_name, count(*) AS n, max(finished_at) AS last FROM job_execution_log
  WHERE status = 'success' GROUP BY job_name) a ON a.job_name = j.job_name""",
    ("scheduled_jobs", "job_execution_log"),
)
def q_update_run_stats(spark, sf):
    fin = T.job_execution_log(spark, sf).where(F.col("status") == "success").withColumn(
        "next_run", F.lit(None).cast("timestamp_ntz")
    )
    out = R.update_run_stats(T.scheduled_jobs(spark, sf), fin)
    return out.select("job_name", "last_run", "next_run", "run_count")


@register(
    "delete_jobs",
    "SELECT * FROM scheduled_jobs WHERE job_name NOT IN (SELECT job_name FROM summary_reports)",
    ("scheduled_jobs", "summary_reports"),
)
def q_delete_jobs(spark, sf):
    state, _ = R.delete_jobs(T.scheduled_jobs(spark, sf), T.summary_reports(spark, sf))
    return state


@register(
    "delete_jobs_existed",
    """SELECT q.job_name, q.job_name IN (SELECT job_name FROM scheduled_jobs) AS existed
FROM (SELECT DISTINCT job_name FROM summary_reports) q""",
    ("scheduled_jobs", "summary_reports"),
)
def q_delete_jobs_existed(spark, sf):
    _, existed = R.delete_jobs(T.scheduled_jobs(spark, sf), T.summary_reports(spark, sf))
    return existed


@register(
    "set_enabled",
    """SELECT j.job_name, coalesce(r.enabled, j.enabled) AS enabled FROM scheduled_jobs j LEFT JOIN (
  SELECT job_name, file_format = 'md' AS enabled FROM summary_reports
  WHERE id IN (SELECT max(id) FROM summary_reports GROUP BY job_name)) r ON r.job_name = j.job_name""",
    ("scheduled_jobs", "summary_reports"),
)
def q_set_enabled(spark, sf):
    s = T.summary_reports(spark, sf)
    req = s.select("job_name", (F.col("file_format") == "md").alias("enabled"), F.col("id").alias("change_no"))
    return R.set_enabled(T.scheduled_jobs(spark, sf), req).select("job_name", "enabled")


@register(
    "add_report_limit",
    "SELECT job_name, CASE WHEN enabled THEN coalesce(report_limit, 5) ELSE 5 END AS report_limit FROM scheduled_jobs",
    ("scheduled_jobs",),
)
def q_add_report_limit(spark, sf):
    """Old snapshots (disabled jobs here) were written before the column existed; a merged-schema
    read sees NULL there, which reads as the default 5."""
    jobs = T.scheduled_jobs(spark, sf)
    root = scratch_dir(spark, "jobs-schema-versions")
    jobs.where(~F.col("enabled")).drop("report_limit").write.parquet(f"{root}/v=1")
    jobs.where(F.col("enabled")).write.parquet(f"{root}/v=2")
    merged = spark.read.option("mergeSchema", "true").parquet(root)
    return R.add_report_limit(merged).select("job_name", "report_limit")


@register(
    "migrate_v1_names",
    """SELECT 'reports' AS table_name, id, concat_ws('|', company_id, date, title, report_type, report_category) AS v FROM reports
UNION ALL SELECT 'companies', id, concat_ws('|', name, full_name) FROM companies
UNION ALL SELECT 'search_history', id, concat_ws('|', company_name, epoch_us(created_at)) FROM search_history""",
    ("reports", "companies", "search_history"),
)
def q_migrate_v1_names(spark, sf):
    def migrated(v1_table, df):
        back = {v: k for k, v in R.V1_COLUMNS[v1_table].items()}
        return R.migrate_v1(v1_table, df.withColumnsRenamed({c: back[c] for c in df.columns if c in back}))

    cells = {
        "dane": (T.reports(spark, sf).drop("link"), ["company_id", "date", "title", "report_type", "report_category"]),
        "firma": (T.companies(spark, sf).drop("sector"), ["name", "full_name"]),
        "historia": (T.search_history(spark, sf), ["company_name", "created_at"]),
    }
    out = None
    for v1_table, (df, cols) in cells.items():
        name, new = migrated(v1_table, df)
        value = [F.unix_micros(F.col(c).cast("timestamp")) if c == "created_at" else F.col(c) for c in cols]
        rows = new.select(F.lit(name).alias("table_name"), "id", F.concat_ws("|", *[v.cast("string") for v in value]).alias("v"))
        out = rows if out is None else out.unionByName(rows)
    return out


@register(
    "start_execution",
    f"""SELECT (SELECT max(id) FROM job_execution_log) + row_number() OVER (ORDER BY job_name) AS id, job_name,
  'running' AS status, TIMESTAMP '{AS_OF}' AS started_at FROM scheduled_jobs WHERE enabled""",
    ("job_execution_log", "scheduled_jobs"),
)
def q_start_execution(spark, sf):
    due = T.scheduled_jobs(spark, sf).where(F.col("enabled"))
    return R.start_executions(T.job_execution_log(spark, sf), due, AS_OF)


def _end_events(spark, sf):
    e = T.read(spark, sf, "events").where(F.col("event_type") == "click").select("event_id", "ts", "value")
    ok = F.col("value") >= 100
    ends = e.select(
        F.col("event_id").alias("execution_id"),
        F.when(ok, F.lit("success")).otherwise(F.lit("failed")).alias("status"),
        (F.col("ts") + T.seconds_interval(F.col("value"))).alias("finished_at"),
        F.lit(None).cast("int").alias("reports_found"),
        (F.col("event_id") % 9).cast("int").alias("documents_processed"),
        F.lit(None).cast("bigint").alias("summary_report_id"),
        F.when(~ok, F.lit("timeout")).alias("error_message"),
        F.lit(None).cast("string").alias("log_file_path"),
    )
    late = ends.where(F.col("execution_id") % 4 == 0).withColumns(
        {
            "status": F.lit("cancelled"), "finished_at": F.col("finished_at") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(10)),
            "documents_processed": F.lit(0), "error_message": F.lit("late"),
        }
    )
    return ends.unionByName(late)


@register(
    "close_execution",
    """WITH e0 AS (SELECT event_id AS execution_id, CASE WHEN value >= 100 THEN 'success' ELSE 'failed' END AS status,
  ts + to_microseconds(CAST(round(value * 1000000) AS BIGINT)) AS finished_at, CAST(NULL AS INTEGER) AS reports_found,
  CAST(event_id % 9 AS INTEGER) AS documents_processed, CAST(NULL AS BIGINT) AS summary_report_id,
  CASE WHEN value < 100 THEN 'timeout' END AS error_message, CAST(NULL AS VARCHAR) AS log_file_path
  FROM events WHERE event_type = 'click'),
-- every fourth execution also ends a second time, ten minutes later, without documents
e2 AS (SELECT * FROM e0 WHERE execution_id % 4 <> 0 UNION ALL SELECT execution_id, 'cancelled', finished_at + INTERVAL 10 MINUTE, reports_found,
  0, summary_report_id, 'late', log_file_path FROM e0 WHERE execution_id % 4 = 0),
e AS (SELECT * FROM e2)
SELECT s.id, s.job_name, coalesce(e.status, s.status) AS status, s.started_at, e.finished_at,
  CAST((epoch_us(e.finished_at) - epoch_us(s.started_at)) // 1000000 AS INTEGER) AS duration_seconds,
  e.reports_found, e.documents_processed, e.summary_report_id, e.error_message, e.log_file_path
FROM job_execution_log s LEFT JOIN e ON e.execution_id = s.id WHERE s.status = 'running'""",
    ("job_execution_log",),
)
def q_close_execution(spark, sf):
    starts = T.job_execution_log(spark, sf).where(F.col("status") == "running")
    return R.close_executions(starts, _end_events(spark, sf))


@register(
    "log_finished_run",
    f"""SELECT (SELECT max(id) FROM job_execution_log) + row_number() OVER (ORDER BY id) AS id, job_name, status,
  TIMESTAMP '{AS_OF}' - to_seconds(CAST(reports_found AS BIGINT)) AS started_at, TIMESTAMP '{AS_OF}' AS finished_at,
  reports_found AS duration_seconds, reports_found, documents_processed, CAST(NULL AS BIGINT) AS summary_report_id,
  error_message, CAST(NULL AS VARCHAR) AS log_file_path
FROM job_execution_log WHERE status IN ('success', 'failed')""",
    ("job_execution_log",),
)
def q_log_finished_run(spark, sf):
    log = T.job_execution_log(spark, sf)
    runs = log.where(F.col("status").isin("success", "failed")).select(
        F.col("id").alias("run_key"), "job_name", "status", F.col("reports_found").alias("duration"), "reports_found",
        "documents_processed", F.lit(None).cast("bigint").alias("summary_report_id"), "error_message",
        F.lit(None).cast("string").alias("log_file_path"),
    )
    return R.log_finished_runs(log, runs, AS_OF)


_J11 = """SELECT l.id AS execution_id,
  (SELECT s.id FROM run_summaries s WHERE s.job_name = l.job_name AND s.created_at BETWEEN l.started_at AND l.finished_at
   ORDER BY s.created_at, s.id LIMIT 1) AS summary_report_id
FROM job_execution_log l WHERE l.finished_at IS NOT NULL"""


@register(
    "execution_summary_resolve",
    f"SELECT * FROM ({_J11}) x WHERE summary_report_id IS NOT NULL",
    ("job_execution_log", "run_summaries"),
)
def q_execution_summary_resolve(spark, sf):
    return R.resolve_execution_summary(T.job_execution_log(spark, sf), T.run_summaries(spark, sf))


@register(
    "execution_with_summary",
    f"""SELECT l.id, l.job_name, l.status, x.summary_report_id, s.created_at AS summary_created_at
FROM job_execution_log l LEFT JOIN ({_J11}) x ON x.execution_id = l.id LEFT JOIN run_summaries s ON s.id = x.summary_report_id""",
    ("job_execution_log", "run_summaries"),
)
def q_execution_with_summary(spark, sf):
    return R.execution_with_summary(T.job_execution_log(spark, sf), T.run_summaries(spark, sf))


@register(
    "bump_finished_jobs",
    f"""SELECT j.id, j.job_name, CASE WHEN n IS NULL THEN j.last_run ELSE TIMESTAMP '{AS_OF}' END AS last_run, j.run_count + coalesce(n, 0) AS run_count
FROM scheduled_jobs j LEFT JOIN (SELECT job_name, count(*) AS n FROM job_execution_log WHERE status IN ('success', 'failed') AND id % 3 = 0 GROUP BY 1) r
  ON r.job_name = j.job_name""",
    ("scheduled_jobs", "job_execution_log"),
)
def q_bump_finished_jobs(spark, sf):
    runs = T.job_execution_log(spark, sf).where(F.col("status").isin("success", "failed") & (F.col("id") % 3 == 0))
    return R.bump_jobs(T.scheduled_jobs(spark, sf), runs, AS_OF).select("id", "job_name", "last_run", "run_count")


@register(
    "set_null_on_summary_delete",
    """SELECT l.id, CASE WHEN s.id IS NOT NULL THEN l.id * 10 END AS summary_report_id
FROM job_execution_log l LEFT JOIN (SELECT id FROM run_summaries WHERE id % 4 <> 0) s ON s.id = l.id * 10""",
    ("job_execution_log", "run_summaries"),
)
def q_set_null_on_summary_delete(spark, sf):
    log = T.job_execution_log(spark, sf).select("id", (F.col("id") * 10).alias("summary_report_id"))
    return R.set_null_on_summary_delete(log, T.run_summaries(spark, sf).where(F.col("id") % 4 != 0)).select("id", "summary_report_id")


def _drop_request(spark, sf):
    return T.companies(spark, sf).where(F.col("sector") == "AUTOMOBILE").select("id")


@register(
    "referential_delete",
    """WITH gone AS (SELECT id FROM companies WHERE sector = 'AUTOMOBILE'),
alive AS (SELECT id FROM reports WHERE company_id NOT IN (SELECT id FROM gone))
SELECT f.id, CASE WHEN f.report_id IN (SELECT id FROM alive) THEN f.report_id END AS report_id FROM downloaded_files f""",
    ("companies", "reports", "downloaded_files"),
)
def q_referential_delete(spark, sf):
    _, _, files = R.referential_delete(
        T.companies(spark, sf), T.reports(spark, sf), T.downloaded_files(spark, sf), _drop_request(spark, sf)
    )
    return files.select("id", "report_id")


@register(
    "referential_delete_reports",
    "SELECT id, company_id FROM reports WHERE company_id NOT IN (SELECT id FROM companies WHERE sector = 'AUTOMOBILE')",
    ("companies", "reports"),
)
def q_referential_delete_reports(spark, sf):
    _, rep, _ = R.referential_delete(
        T.companies(spark, sf), T.reports(spark, sf), T.downloaded_files(spark, sf), _drop_request(spark, sf)
    )
    return rep.select("id", "company_id")


@register(
    "job_activation",
    """SELECT j.job_name,
  CASE WHEN j.enabled AND i.job_name IS NOT NULL THEN '✅ Aktywny' ELSE '⏸️ Nieaktywny' END AS schedule_status,
  CASE WHEN j.enabled AND i.job_name IS NULL THEN '✅ Aktywne (brak w cron)' WHEN j.enabled THEN '✅ Aktywne'
    ELSE '⏸️ Wyłączone' END AS config_status
FROM scheduled_jobs j LEFT JOIN (SELECT DISTINCT job_name FROM job_execution_log WHERE status <> 'cancelled'
  AND started_at >= TIMESTAMP '2024-01-29 00:00:00') i ON i.job_name = j.job_name""",
    ("scheduled_jobs", "job_execution_log"),
)
def q_job_activation(spark, sf):
    installed = T.job_execution_log(spark, sf).where(
        (F.col("status") != "cancelled") & (F.col("started_at") >= F.lit("2024-01-29 00:00:00").cast("timestamp_ntz"))
    )
    return R.job_activation(T.scheduled_jobs(spark, sf), installed)


@register(
    "append_search",
    """SELECT (SELECT max(id) FROM search_history) + row_number() OVER (ORDER BY r.id) AS id, c.name AS company_name,
  5 AS report_amount, 'PDF HTML' AS download_type, CASE WHEN r.id % 5 = 0 THEN NULL ELSE r.date END AS report_date,
  'current quarterly' AS report_type, 'ESPI EBI' AS report_category, CAST(NULL AS VARCHAR) AS model_used,
  CAST(NULL AS INTEGER) AS execution_time
FROM reports r JOIN companies c ON c.id = r.company_id""",
    ("search_history", "reports", "companies"),
)
def q_append_search(spark, sf):
    from filingflow.plans.q_listing import _date_requests

    req = _date_requests(spark, sf).join(T.reports(spark, sf).select("id", "company_id"), "id")
    c = T.companies(spark, sf).select(F.col("id").alias("company_id"), F.col("name").alias("company_name"))
    req = req.join(c, "company_id").select(
        F.col("id").alias("request_no"), "company_name", F.lit(5).alias("report_amount"), F.lit("PDF HTML").alias("download_type"),
        F.col("request").alias("report_date_text"), F.lit("current quarterly").alias("report_type"),
        F.lit("ESPI EBI").alias("report_category"),
    )
    return R.append_searches(T.search_history(spark, sf), req)


def _scan_sql(table: str) -> str:
    cells = ", ".join(f"CAST({f.name} AS VARCHAR)" for f in REGISTRY_SCHEMAS[table].fields if f.dataType.typeName() not in ("double", "timestamp_ntz"))
    times = ", ".join(f"CAST(epoch_us({f.name}) AS VARCHAR)" for f in REGISTRY_SCHEMAS[table].fields if f.dataType.typeName() == "timestamp_ntz")
    return f"SELECT '{table}' AS table_name, id, md5(concat_ws('|', {cells}{', ' + times if times else ''})) AS row_md5 FROM {table}"


@register("registry_scan", " UNION ALL ".join(_scan_sql(t) for t in REGISTRY_SCHEMAS), tuple(REGISTRY_SCHEMAS))
def q_registry_scan(spark, sf):
    """Every registry table read with its declared schema (column order, types and domains enforced)."""
    out = None
    for table, schema in REGISTRY_SCHEMAS.items():
        df = domain_check(conform(T.registry_scan(spark, sf, table), schema), table)
        cells = [F.col(f.name).cast("string") for f in schema.fields if f.dataType.typeName() not in ("double", "timestamp_ntz")]
        cells += [F.unix_micros(F.col(f.name).cast("timestamp")).cast("string") for f in schema.fields if f.dataType.typeName() == "timestamp_ntz"]
        rows = df.select(F.lit(table).alias("table_name"), "id", F.md5(F.concat_ws("|", *cells)).alias("row_md5"))
        out = rows if out is None else out.unionByName(rows)
    return out
