"""Registry writes as pure functions ``(state, changes) -> new state``: U1-U16, W3, J1, J4-J7, J11, J12.

Parquet has no MERGE, so an upsert is a join of the current snapshot with the change set and a
per-column choice; the caller writes the result to a fresh folder and never overwrites a path that
is being read. New AUTO_INCREMENT ids are ``max(id)`` plus a
distributed dense numbering of the new rows (``dense_ids``), never a global window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filingflow.functions import text as X
from filingflow.operators.common import cut_lineage, dense_ids, lower_key
from filingflow.sources.tables import first_arrival_per_md5


def _max_id(state: DataFrame, col: str = "id") -> DataFrame:
    return state.agg(F.coalesce(F.max(col), F.lit(0)).cast("bigint").alias("__max_id"))


def append_with_ids(state: DataFrame, new_rows: DataFrame, order_cols: list[str], id_col: str = "id", last_id: int | None = None) -> DataFrame:
    """New rows numbered after ``last_id``, or after the current maximum id (a one-row scalar, broadcast)."""
    numbered = dense_ids(new_rows, order_cols, out="__rank")
    if last_id is not None:
        return numbered.withColumn(id_col, (F.lit(last_id) + F.col("__rank")).cast("bigint")).drop("__rank")
    j = numbered.join(F.broadcast(_max_id(state, id_col)))
    return j.withColumn(id_col, (F.col("__max_id") + F.col("__rank")).cast("bigint")).drop("__max_id", "__rank")


# --------------------------------------------------------------------------- companies


def insert_companies(companies: DataFrame, feed_names: DataFrame, name_col: str = "name") -> DataFrame:
    """Names not yet registered (case-insensitively) are appended; re-running adds nothing."""
    names = feed_names.select(F.col(name_col).alias("name")).where(F.col("name").isNotNull()).dropDuplicates(["name"])
    known = companies.select(lower_key("name").alias("k"))
    fresh = names.join(known, lower_key("name") == F.col("k"), "left_anti")
    fresh = fresh.groupBy(lower_key("name").alias("k")).agg(F.min("name").alias("name"))
    added = append_with_ids(companies, fresh.select("name"), ["name"]).select(
        "id", "name", F.lit(None).cast("string").alias("full_name"), F.lit(None).cast("string").alias("sector")
    )
    return companies.select("id", "name", "full_name", "sector").unionByName(added)


def resolve_company(feed: DataFrame, companies: DataFrame, name_col: str = "company") -> DataFrame:
    """Feed company (lower-cased) -> company id (smallest id per case-insensitive name)."""
    ids = companies.groupBy(lower_key("name").alias("__k")).agg(F.min("id").alias("company_id"))
    return feed.join(ids, lower_key(name_col) == F.col("__k"), "left").drop("__k")


# --------------------------------------------------------------------------- reports


def append_reports(reports: DataFrame, normalised: DataFrame, order_cols: list[str]) -> DataFrame:
    """Normalised feed rows appended with new ids; no de-duplication."""
    cols = ["company_id", "date", "title", "report_type", "report_category", "rate_change", "exchange_rate", "link"]
    # the numbering reads the rows several times: the pages behind them are scanned once
    rows = cut_lineage(normalised.select(*cols, *[c for c in order_cols if c not in cols]), "normalised")
    added = append_with_ids(reports, rows, order_cols)
    return reports.select("id", *cols).unionByName(added.select("id", *cols))


# --------------------------------------------------------------------------- files


def first_arrival_dedup(arrivals: DataFrame) -> DataFrame:
    """The first arrival of each md5 in a batch; NULL md5 is never registered."""
    return first_arrival_per_md5(arrivals)


def new_files_only(arrivals: DataFrame, registry: DataFrame) -> DataFrame:
    """Arrivals whose md5 is not registered yet."""
    known = registry.select(F.col("md5_hash").alias("__m")).where(F.col("__m").isNotNull())
    return arrivals.join(known, arrivals["md5_hash"] == known["__m"], "left_anti")


FILE_COLS = ["id", "company", "report_id", "file_name", "file_type", "file_size", "md5_hash", "is_summarized", "summary_text"]


def register_files(registry: DataFrame, arrivals: DataFrame) -> DataFrame:
    """W3 then J4 then append (new ids in arrival order). Idempotent."""
    fresh = new_files_only(first_arrival_dedup(arrivals), registry)
    # the arrivals are read once for the numbering and the rows
    fresh = cut_lineage(fresh.withColumnRenamed("id", "arrival_id"), "fresh-files")
    added = append_with_ids(registry, fresh, ["arrival_id"]).select(
        "id", "company", "report_id", "file_name", "file_type", F.col("file_size").cast("bigint").alias("file_size"),
        "md5_hash", F.lit(False).alias("is_summarized"), F.lit(None).cast("string").alias("summary_text"),
    )
    return registry.select(*FILE_COLS).unionByName(added)


def update_file_summary(registry: DataFrame, changes: DataFrame) -> DataFrame:
    """U4: set is_summarized and summary_text by id (last change per id wins)."""
    ch = changes.groupBy(F.col("id").alias("__id")).agg(F.max_by("summary_text", "change_no").alias("__txt"))
    j = registry.join(ch, registry["id"] == ch["__id"], "left")
    hit = F.col("__id").isNotNull()
    return j.select(
        *[c for c in registry.columns if c not in ("is_summarized", "summary_text")],
        F.when(hit, F.lit(True)).otherwise(F.col("is_summarized")).alias("is_summarized"),
        F.when(hit, F.col("__txt")).otherwise(F.col("summary_text")).alias("summary_text"),
    )


# --------------------------------------------------------------------------- jobs

JOB_CONFIG_COLS = [
    "company", "date_from", "date_to", "model", "cron_schedule", "enabled", "report_limit", "report_types", "report_categories",
]


def upsert_jobs(jobs: DataFrame, batch: DataFrame, as_of: str, last_id: int | None = None) -> DataFrame:
    """U5 insert-or-update by job_name; the result has every column of ``jobs``, and ``updated_at``.

    Rows the batch does not name stay as they are, whatever columns they have. For the others the
    config columns and updated_at come from the batch (the last writer inside a batch wins, by
    ``change_no``; a config column the batch lacks is NULL) and the rest is kept. New jobs get new ids, no
    runs, and ``created_at`` = now; ``last_id`` is the highest id given so far where ``jobs`` is a part of the table.
    """
    now = F.lit(as_of).cast("timestamp_ntz")
    if "updated_at" not in jobs.columns:
        jobs = jobs.withColumn("updated_at", F.lit(None).cast("timestamp_ntz"))
    cfg = [c for c in JOB_CONFIG_COLS if c in jobs.columns]
    types = dict(jobs.dtypes)
    given = [(F.col(c) if c in batch.columns else F.lit(None)).cast(types[c]).alias(c) for c in cfg]
    last = batch.groupBy("job_name").agg(F.max_by(F.struct(*given), F.col("change_no")).alias("__c"))
    named = last.select(F.col("job_name").alias("__job"), "__c")
    hit = F.col("__job").isNotNull()
    kept = jobs.join(named, jobs["job_name"] == named["__job"], "left")
    value = {c: F.when(hit, F.col("__c")[c]).otherwise(F.col(c)) for c in cfg} | {"updated_at": F.when(hit, now).otherwise(F.col("updated_at"))}
    kept = kept.select(*[value.get(c, F.col(c)).alias(c) for c in jobs.columns])
    new = last.join(jobs.select("job_name"), "job_name", "left_anti").select("job_name", *[F.col("__c")[c].alias(c) for c in cfg])
    new = append_with_ids(jobs, new, ["job_name"], last_id=last_id)
    start = {"run_count": F.lit(0), "updated_at": now, "created_at": now}
    rest = [c for c in jobs.columns if c not in ("id", "job_name", *cfg)]
    new = new.withColumns({c: start.get(c, F.lit(None)).cast(types[c]) for c in rest})
    return kept.unionByName(new.select(*jobs.columns))


def update_run_stats(jobs: DataFrame, finished: DataFrame) -> DataFrame:
    """Per job with finished runs: last_run = latest finish, next_run = given or NULL (X11),
    run_count + number of runs."""
    a = finished.groupBy("job_name").agg(
        F.count(F.lit(1)).alias("__n"), F.max("finished_at").alias("__last"), F.max_by("next_run", "finished_at").alias("__next")
    )
    j = jobs.join(a, "job_name", "left")
    hit = F.col("__n").isNotNull()
    nr = F.col("next_run") if "next_run" in jobs.columns else F.lit(None).cast("timestamp_ntz")
    return j.select(
        *[c for c in jobs.columns if c not in ("last_run", "next_run", "run_count")],
        F.when(hit, F.col("__last")).otherwise(F.col("last_run")).alias("last_run"),
        F.when(hit, F.col("__next")).otherwise(nr).alias("next_run"),
        (F.col("run_count") + F.coalesce(F.col("__n"), F.lit(0))).alias("run_count"),
    )


def delete_jobs(jobs: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new state, per request whether the job existed)."""
    req = names.select("job_name").distinct()
    state = jobs.join(req, "job_name", "left_anti")
    existed = req.join(jobs.select("job_name", F.lit(True).alias("existed")), "job_name", "left").select(
        "job_name", F.coalesce("existed", F.lit(False)).alias("existed")
    )
    return state, existed


def set_enabled(jobs: DataFrame, requests: DataFrame) -> DataFrame:
    """Enable / disable a table of job names (the last request per job wins)."""
    r = requests.groupBy("job_name").agg(F.max_by("enabled", "change_no").alias("__en"))
    j = jobs.join(r, "job_name", "left")
    return j.select(*[c for c in jobs.columns if c != "enabled"], F.coalesce("__en", "enabled").alias("enabled"))


def add_report_limit(jobs: DataFrame) -> DataFrame:
    """A schema without report_limit reads as 5 (the column default)."""
    if "report_limit" not in jobs.columns:
        return jobs.withColumn("report_limit", F.lit(5))
    return jobs.withColumn("report_limit", F.coalesce(F.col("report_limit"), F.lit(5)))


# v1 -> v2 table and column renames of the registry migration.
V1_TABLES = {"firma": "companies", "dane": "reports", "historia": "search_history"}
V1_COLUMNS = {
    "firma": {"id_firmy": "id", "nazwa": "name", "pelna_nazwa": "full_name", "data_dodania": "created_at"},
    "dane": {
        "id_raportu": "id",
        "Id_firmy": "company_id",
        "data": "date",
        "tytul_raportu": "title",
        "typ_raportu": "report_type",
        "kategoria_raportu": "report_category",
        "zmiana": "rate_change",
        "kurs": "exchange_rate",
        "data_pobrania": "created_at",
    },
    "historia": {"data_wyszukiwania": "created_at"},
}


def migrate_v1(table_v1: str, df: DataFrame) -> tuple[str, DataFrame]:
    """A v1 table -> (v2 name, frame with v2 column names)."""
    renames = {k: v for k, v in V1_COLUMNS[table_v1].items() if k in df.columns}
    return V1_TABLES[table_v1], df.withColumnsRenamed(renames)


# --------------------------------------------------------------------------- executions


def start_executions(log: DataFrame, jobs_to_start: DataFrame, as_of: str) -> DataFrame:
    """U8: one 'running' row per started job, started_at = as_of, new ids."""
    new = jobs_to_start.select("job_name").distinct()
    added = append_with_ids(log, new, ["job_name"])
    return added.select(
        "id", "job_name", F.lit("running").alias("status"), F.lit(as_of).cast("timestamp_ntz").alias("started_at")
    )


def close_executions(starts: DataFrame, ends: DataFrame) -> DataFrame:
    """Pair each start with its end event by execution id; status, finish, whole-second
    duration (truncated), and *every* optional column overwritten — also with NULL. Of several end
    events of one execution the latest counts (by finish, then status)."""
    cols = ["finished_at", "status", "reports_found", "documents_processed", "summary_report_id", "error_message", "log_file_path"]
    e = ends.groupBy("execution_id").agg(F.max(F.struct(*cols)).alias("e")).select("execution_id", "e.*").withColumnRenamed("status", "__status")
    s = starts.select("id", "job_name", "status", "started_at")
    j = s.join(e, s["id"] == e["execution_id"], "left")
    closed = F.col("execution_id").isNotNull()
    secs = F.floor(X.micros_between(F.col("started_at"), F.col("finished_at")) / F.lit(1000000)).cast("int")
    return j.select(
        "id", "job_name",
        F.when(closed, F.col("__status")).otherwise(F.col("status")).alias("status"),
        "started_at", "finished_at",
        F.when(closed, secs).alias("duration_seconds"),
        "reports_found", "documents_processed", "summary_report_id", "error_message", "log_file_path",
    )


def bump_jobs(jobs: DataFrame, runs: DataFrame, as_of: str) -> DataFrame:
    """U13, second half: a job with runs to log has last_run = now and run_count + their number."""
    n = runs.groupBy("job_name").agg(F.count(F.lit(1)).alias("__n"))
    j = jobs.join(n, "job_name", "left")
    last = F.when(F.col("__n").isNotNull(), F.lit(as_of).cast("timestamp_ntz")).otherwise(F.col("last_run"))
    value = {"last_run": last, "run_count": F.col("run_count") + F.coalesce("__n", F.lit(0))}
    return j.select(*[value.get(c, F.col(c)).alias(c) for c in jobs.columns])


def log_finished_runs(log: DataFrame, runs: DataFrame, as_of: str) -> DataFrame:
    """U13, first half: started = now - duration, finished = now, appended to the log (the new rows)."""
    now = F.lit(as_of).cast("timestamp_ntz")
    added = append_with_ids(log, runs, ["run_key"])
    return added.select(
        "id", "job_name", "status",
        (now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("duration").cast("decimal(18,6)"))).alias("started_at"),
        now.alias("finished_at"),
        F.col("duration").cast("int").alias("duration_seconds"),
        "reports_found", "documents_processed", "summary_report_id", "error_message", "log_file_path",
    )


RANGE_BUCKET_SECONDS = 3600


def resolve_execution_summary(log: DataFrame, summaries: DataFrame, bucket_seconds: int = RANGE_BUCKET_SECONDS) -> DataFrame:
    """The FK the reference leaves unset — the earliest summary of the same job created inside
    [started_at, finished_at].

    A bucketed range join: every execution is exploded over the time buckets its run spans and
    each summary falls in exactly one bucket, so candidate pairs only meet on (job, bucket) —
    never all executions x all summaries of a busy job — and each qualifying pair meets once.
    A partially aggregated ``min_by`` per execution picks the earliest (ties: smaller id).
    """
    def bucket(ts):
        return F.floor(F.unix_micros(ts.cast("timestamp")) / F.lit(bucket_seconds * 1_000_000)).cast("bigint")

    l = log.where(F.col("finished_at").isNotNull() & (F.col("finished_at") >= F.col("started_at"))).select(
        F.col("id").alias("execution_id"), "job_name", "started_at", "finished_at",
        F.explode(F.sequence(bucket(F.col("started_at")), bucket(F.col("finished_at")))).alias("bucket"),
    )
    s = summaries.select(
        F.col("id").alias("summary_id"), F.col("job_name").alias("s_job"), "created_at", bucket(F.col("created_at")).alias("s_bucket")
    )
    cond = (
        (l["job_name"] == s["s_job"]) & (l["bucket"] == s["s_bucket"])
        & (s["created_at"] >= l["started_at"]) & (s["created_at"] <= l["finished_at"])
    )
    pairs = l.join(s, cond, "inner")
    return pairs.groupBy("execution_id").agg(
        F.min_by("summary_id", F.struct("created_at", "summary_id")).alias("summary_report_id")
    )


def execution_with_summary(log: DataFrame, summaries: DataFrame) -> DataFrame:
    """The log with its resolved summary (FK left join).

    The found summaries meet their times before they meet the log: most runs have none, and a join of the whole log on the
    summary's id would put all of those into the one task of the null key.
    """
    fk = resolve_execution_summary(log, summaries)
    s = summaries.select(F.col("id").alias("__sid"), F.col("created_at").alias("summary_created_at"))
    dated = fk.join(s, fk["summary_report_id"] == s["__sid"], "left").drop("__sid")
    return log.select("id", "job_name", "status").join(dated, F.col("id") == F.col("execution_id"), "left").drop("execution_id")


def referential_delete(companies: DataFrame, reports: DataFrame, files: DataFrame, drop_companies: DataFrame):
    """Drop companies -> cascade their reports (anti join) -> files keep rows with report_id
    set NULL where the report is gone (left join + when)."""
    gone = drop_companies.select(F.col("id").alias("__cid")).distinct()
    comp = companies.join(gone, companies["id"] == gone["__cid"], "left_anti")
    rep = reports.join(gone, reports["company_id"] == gone["__cid"], "left_anti")
    alive = rep.select(F.col("id").alias("__rid"))
    f = files.join(alive, files["report_id"] == alive["__rid"], "left")
    f = f.withColumn("report_id", F.when(F.col("__rid").isNotNull(), F.col("report_id"))).drop("__rid")
    return comp, rep, f


def set_null_on_summary_delete(log: DataFrame, summaries: DataFrame) -> DataFrame:
    """J12 second rule: a log row whose summary no longer exists gets summary_report_id NULL."""
    s = summaries.select(F.col("id").alias("__sid"))
    j = log.join(s, log["summary_report_id"] == s["__sid"], "left")
    return j.withColumn("summary_report_id", F.when(F.col("__sid").isNotNull(), F.col("summary_report_id"))).drop("__sid")


def attach_summaries(files: DataFrame, summaries: DataFrame) -> DataFrame:
    """Per-file summaries matched to registered files by (lower(company), file_name). Of several summaries of one file the
    last counts: the largest ``id`` if there is one, then the greatest text; so files never multiply."""
    last = F.struct(F.col("id") if "id" in summaries.columns else F.lit(0).alias("id"), F.col("summary").alias("summary"))
    s = summaries.groupBy(lower_key("company").alias("__c"), F.col("file_name").alias("__f")).agg(F.max(last)["summary"].alias("new_summary"))
    cond = (lower_key(files["company"]) == s["__c"]) & (files["file_name"] == s["__f"])
    return files.join(s, cond, "left").drop("__c", "__f")


def job_activation(jobs: DataFrame, installed: DataFrame) -> DataFrame:
    """Status labels of the two schedule screens from the enabled flag and the installed set."""
    inst = installed.select(F.col("job_name").alias("__n")).distinct()
    j = jobs.join(inst, jobs["job_name"] == inst["__n"], "left")
    is_inst = F.col("__n").isNotNull()
    en = F.coalesce(F.col("enabled"), F.lit(False))
    active = F.when(en & is_inst, F.lit("✅ Aktywny")).otherwise(F.lit("⏸️ Nieaktywny"))
    cfg = F.when(en, F.lit("✅ Aktywne")).otherwise(F.lit("⏸️ Wyłączone"))
    cfg = F.when(en & ~is_inst, F.concat(cfg, F.lit(" (brak w cron)"))).otherwise(cfg)
    return j.select("job_name", active.alias("schedule_status"), cfg.alias("config_status"))


def unmigrated_configs(legacy: DataFrame, jobs: DataFrame) -> DataFrame:
    """Legacy job configs whose name is not in the registry yet."""
    return legacy.join(jobs.select("job_name"), "job_name", "left_anti")


def tags_json(company: Column, job_name: Column) -> Column:
    """A9 + N16: the summary tags as stored."""
    return X.json_list_encode(F.array(F.lower(company), F.replace(job_name, F.lit("_"), F.lit("-"))))


def append_searches(history: DataFrame, requests: DataFrame) -> DataFrame:
    """Searches appended with new ids; '' date -> NULL, only the first token of a range is
    kept, dd-MM-yyyy becomes a DATE (ISO text parses as well); model and time are never passed
    by the run (X18) and stay NULL."""
    d = F.when(F.coalesce(X.ustrip(F.col("report_date_text")), F.lit("")) == "", F.lit(None).cast("date")).otherwise(
        X.parse_date_text(F.col("report_date_text"))
    )
    rows = requests.select(
        "request_no", "company_name", F.col("report_amount").cast("int").alias("report_amount"), "download_type",
        d.alias("report_date"), "report_type", "report_category",
        F.lit(None).cast("string").alias("model_used"), F.lit(None).cast("int").alias("execution_time"),
    )
    return append_with_ids(history, rows, ["request_no"]).drop("request_no")
