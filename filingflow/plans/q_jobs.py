"""Catalogue entries: job table checks and legacy configs — K1, K2, K5, S5, J5, U16."""

from __future__ import annotations

from pyspark.sql import functions as F

from filingflow.functions import cron as C
from filingflow.functions import text as X
from filingflow.operators import registry as R
from filingflow.plans.catalog import register
from filingflow.session import scratch_dir
from filingflow.sources import config_files as CF
from filingflow.sources import tables as T

NOW = "2024-02-01 10:30:15"


def _configs(spark, sf):
    j = T.scheduled_jobs(spark, sf)
    k = F.col("id") % 3
    dfrom = F.when(k == 0, F.date_format("last_run", "dd-MM-yyyy")).when(k == 1, F.date_format("last_run", "yyyy-MM-dd")).otherwise(F.lit(""))
    return j.select(
        "job_name", "company",
        F.when(F.col("report_limit").isNull(), F.lit("")).otherwise(F.col("model")).alias("model"),
        "cron_schedule", dfrom.alias("date_from"), F.date_format("last_run", "dd-MM-yyyy").alias("date_to"),
    )


@register(
    "job_row_errors",
    """WITH c AS (SELECT job_name, company, CASE WHEN report_limit IS NULL THEN '' ELSE model END AS model, cron_schedule,
  CASE id % 3 WHEN 0 THEN strftime(last_run, '%d-%m-%Y') WHEN 1 THEN strftime(last_run, '%Y-%m-%d') ELSE '' END AS date_from,
  strftime(last_run, '%d-%m-%Y') AS date_to FROM scheduled_jobs)
SELECT job_name, list_filter([
  CASE WHEN coalesce(job_name, '') = '' THEN 'job_name is required' END,
  CASE WHEN coalesce(company, '') = '' THEN 'company is required' END,
  CASE WHEN coalesce(model, '') = '' THEN 'model is required' END,
  CASE WHEN coalesce(cron_schedule, '') = '' THEN 'cron_schedule is required' END,
  CASE WHEN coalesce(date_from, '') <> '' AND try_strptime(date_from, '%d-%m-%Y') IS NULL THEN 'date_from must be in dd-mm-yyyy format' END,
  CASE WHEN coalesce(date_to, '') <> '' AND try_strptime(date_to, '%d-%m-%Y') IS NULL THEN 'date_to must be in dd-mm-yyyy format' END],
  lambda e: e IS NOT NULL) AS errors FROM c""",
    ("scheduled_jobs",),
)
def q_job_row_errors(spark, sf):
    c = _configs(spark, sf)
    errs = C.job_errors(F.col("job_name"), F.col("company"), F.col("model"), F.col("cron_schedule"), F.col("date_from"), F.col("date_to"))
    return c.select("job_name", errs.alias("errors"))


def _crons(spark, sf):
    j = T.scheduled_jobs(spark, sf)
    u = F.col("id")
    draft = F.concat(
        (u % 70).cast("string"), F.lit(" "), (u % 26).cast("string"),
        F.when(u % 4 == 0, F.lit(" * *")).otherwise(F.lit(" */2 * *")),
    )
    return j.select("id", F.lit("job").alias("source"), F.col("cron_schedule").alias("cron")).unionByName(
        j.select("id", F.lit("draft").alias("source"), draft.alias("cron"))
    )


def _cron_sql() -> str:
    cases = []
    for i, (lo, hi, name) in enumerate(C.CRON_FIELDS, start=1):
        cases.append(
            f"WHEN regexp_full_match(p[{i}], '[0-9]+') AND (CAST(p[{i}] AS BIGINT) < {lo} OR CAST(p[{i}] AS BIGINT) > {hi}) "
            f"THEN '{name} musi być między {lo} a {hi}'"
        )
    msg = f"CASE WHEN len(p) <> 5 THEN '{C.CRON_FIELD_COUNT_ERROR}' {' '.join(cases)} ELSE '{C.CRON_OK}' END"
    return f"""WITH s AS (SELECT id, 'job' AS source, cron_schedule AS cron FROM scheduled_jobs
  UNION ALL SELECT id, 'draft', concat(CAST(id % 70 AS VARCHAR), ' ', CAST(id % 26 AS VARCHAR),
    CASE WHEN id % 4 = 0 THEN ' * *' ELSE ' */2 * *' END) FROM scheduled_jobs),
q AS (SELECT *, CASE WHEN trim(cron) = '' THEN CAST([] AS VARCHAR[]) ELSE string_split_regex(trim(cron), '\\s+') END AS p FROM s),
m AS (SELECT id, source, cron, {msg} AS message FROM q)
SELECT id, source, cron, message = '{C.CRON_OK}' AS valid, message FROM m"""


@register("cron_check", _cron_sql(), ("scheduled_jobs",))
def q_cron_check(spark, sf):
    c = _crons(spark, sf).withColumn("chk", C.cron_check(F.col("cron")))
    return c.select("id", "source", "cron", F.col("chk.valid").alias("valid"), F.col("chk.message").alias("message"))


@register(
    "next_fire_time",
    f"""WITH j AS (SELECT job_name, TRY_CAST(split_part(cron_schedule, ' ', 1) AS INTEGER) AS m,
  TRY_CAST(split_part(cron_schedule, ' ', 2) AS INTEGER) AS h, split_part(cron_schedule, ' ', 3) AS dom,
  split_part(cron_schedule, ' ', 4) AS mon, split_part(cron_schedule, ' ', 5) AS dow FROM scheduled_jobs WHERE enabled),
c AS (SELECT j.*, CAST(g.d AS DATE) AS d FROM j, generate_series(TIMESTAMP '{NOW[:10]} 00:00:00',
  TIMESTAMP '{NOW[:10]} 00:00:00' + INTERVAL 400 DAY, INTERVAL 1 DAY) g(d)),
t AS (SELECT job_name, CAST(d AS TIMESTAMP) + to_hours(h) + to_minutes(m) AS ts, d, dom, mon, dow FROM c)
SELECT job_name, min(ts) AS next_run FROM t
WHERE ts > TIMESTAMP '{NOW}' AND (mon = '*' OR month(d) = TRY_CAST(mon AS INTEGER))
  AND CASE WHEN dom = '*' AND dow = '*' THEN TRUE
    WHEN dom = '*' THEN dayofweek(d) = TRY_CAST(dow AS INTEGER) % 7
    WHEN dow = '*' THEN day(d) = TRY_CAST(dom AS INTEGER)
    ELSE day(d) = TRY_CAST(dom AS INTEGER) OR dayofweek(d) = TRY_CAST(dow AS INTEGER) % 7 END
GROUP BY job_name""",
    ("scheduled_jobs",),
)
def q_next_fire_time(spark, sf):
    j = T.scheduled_jobs(spark, sf).where(F.col("enabled"))
    now = F.lit(NOW).cast("timestamp_ntz")
    return j.select("job_name", C.next_fire_time(F.col("cron_schedule"), now).alias("next_run"))


def _legacy_dir(spark, sf):
    """Legacy config documents landed from the registry's summary jobs (one per job, last wins),
    with an extra key the current schema does not know."""
    s = T.summary_reports(spark, sf).withColumn(
        "job_name",
        F.concat(
            F.when(F.floor(F.col("id") / 100) % 2 == 0, F.lit("job_")).otherwise(F.lit("weekly_")),
            F.floor(F.col("id") / 100).cast("string"),
        ),
    )
    last = s.groupBy("job_name").agg(F.max_by(F.struct("company", "date_from", "date_to", "file_format"), "id").alias("c"))
    cfg = last.select(
        "job_name", F.col("c.company").alias("company"),
        F.date_format("c.date_from", "dd-MM-yyyy").alias("date_from"), F.date_format("c.date_to", "dd-MM-yyyy").alias("date_to"),
        F.lit("llama3.2:latest").alias("model"), F.lit("0 9 * * 1").alias("cron_schedule"),
        (F.col("c.file_format") == "md").alias("enabled"), F.concat(F.lit("legacy "), F.col("job_name")).alias("description"),
        F.lit(1).alias("legacy_version"),
    )
    path = scratch_dir(spark, "legacy-configs")
    CF.write_legacy_configs(cfg, path)
    return CF.legacy_config_scan(spark, path)


_LEGACY_NAME = "concat(CASE WHEN (id // 100) % 2 = 0 THEN 'job_' ELSE 'weekly_' END, CAST(id // 100 AS VARCHAR))"


@register(
    "legacy_config_scan",
    f"""WITH s AS (SELECT {_LEGACY_NAME} AS job_name, * EXCLUDE (job_name) FROM summary_reports),
last AS (SELECT * FROM s WHERE id IN (SELECT max(id) FROM s GROUP BY job_name))
SELECT job_name, company, strftime(date_from, '%d-%m-%Y') AS date_from, strftime(date_to, '%d-%m-%Y') AS date_to,
  'llama3.2:latest' AS model, '0 9 * * 1' AS cron_schedule, file_format = 'md' AS enabled, 5 AS report_limit,
  CAST(NULL AS VARCHAR[]) AS report_types, CAST(NULL AS VARCHAR[]) AS report_categories, CAST(NULL AS VARCHAR) AS email_notify,
  concat('legacy ', job_name) AS description FROM last""",
    ("summary_reports",),
)
def q_legacy_config_scan(spark, sf):
    return _legacy_dir(spark, sf)


@register(
    "unmigrated_configs",
    """SELECT DISTINCT concat(CASE WHEN (id // 100) % 2 = 0 THEN 'job_' ELSE 'weekly_' END, CAST(id // 100 AS VARCHAR)) AS job_name FROM summary_reports
WHERE concat(CASE WHEN (id // 100) % 2 = 0 THEN 'job_' ELSE 'weekly_' END, CAST(id // 100 AS VARCHAR)) NOT IN (SELECT job_name FROM scheduled_jobs)""",
    ("summary_reports", "scheduled_jobs"),
)
def q_unmigrated_configs(spark, sf):
    return R.unmigrated_configs(_legacy_dir(spark, sf), T.scheduled_jobs(spark, sf)).select("job_name")


def migrate_legacy_configs(legacy, jobs, as_of: str):
    """U16: S5 -> J5 -> U5, every field the job table has; returns (new job state, number migrated)."""
    todo = R.unmigrated_configs(legacy, jobs)
    batch = todo.select(
        "job_name", "company", "cron_schedule", "enabled", "model", F.col("report_limit").cast("int").alias("report_limit"),
        X.parse_date_text(F.col("date_from")).alias("date_from"), X.parse_date_text(F.col("date_to")).alias("date_to"),
        X.json_list_encode(F.col("report_types")).alias("report_types"), X.json_list_encode(F.col("report_categories")).alias("report_categories"),
        F.lit(0).alias("change_no"),
    )
    state = R.upsert_jobs(jobs, batch, as_of)
    return state, todo.agg(F.count(F.lit(1)).alias("migrated"))


_MIGRATED = f"""s AS (SELECT {_LEGACY_NAME} AS job_name, * EXCLUDE (job_name) FROM summary_reports),
last AS (SELECT * FROM s WHERE id IN (SELECT max(id) FROM s GROUP BY job_name) AND job_name NOT IN (SELECT job_name FROM scheduled_jobs))"""


@register("migrate_legacy_configs", f"WITH {_MIGRATED} SELECT count(*) AS migrated FROM last", ("summary_reports", "scheduled_jobs"))
def q_migrate_legacy_configs(spark, sf):
    return migrate_legacy_configs(_legacy_dir(spark, sf), T.scheduled_jobs(spark, sf), "2024-02-01 00:00:00")[1]


@register(
    "migrated_job_state",
    f"""WITH {_MIGRATED}
SELECT id, job_name, company, CAST(NULL AS DATE) AS date_from, CAST(NULL AS DATE) AS date_to, cron_schedule, enabled, report_limit,
  CAST(NULL AS VARCHAR) AS report_categories, run_count FROM scheduled_jobs
UNION ALL SELECT (SELECT max(id) FROM scheduled_jobs) + row_number() OVER (ORDER BY job_name), job_name, company, date_from, date_to, '0 9 * * 1',
  file_format = 'md', 5, '["ESPI"]', 0 FROM last""",
    ("summary_reports", "scheduled_jobs"),
)
def q_migrated_job_state(spark, sf):
    jobs = T.scheduled_jobs(spark, sf).withColumns(
        {"date_from": F.lit(None).cast("date"), "date_to": F.lit(None).cast("date"), "report_categories": F.lit(None).cast("string")}
    )
    legacy = _legacy_dir(spark, sf).withColumn("report_categories", F.array(F.lit("ESPI")))
    state, _ = migrate_legacy_configs(legacy, jobs, "2024-02-01 00:00:00")
    return state.select("id", "job_name", "company", "date_from", "date_to", "cron_schedule", "enabled", "report_limit", "report_categories", "run_count")
