"""Registry writes: idempotence, edge rows, join semantics, plan shape."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from filingflow.operators import registry as R
from filingflow.operators import search as S
from filingflow.operators import stats
from filingflow.sources import tables as T
from tests.conftest import SF_SMALL, rows


def _sorted(df, *cols):
    return sorted(rows(df, *cols), key=lambda r: tuple((x is None, str(x)) for x in r))


def test_insert_companies_idempotent(spark):
    comp = T.companies(spark, SF_SMALL)
    feed = spark.createDataFrame([("kęty",), ("KĘTY",), ("nowa spółka",), ("Customer#000000001",)], "name string")
    once = R.insert_companies(comp, feed)
    twice = R.insert_companies(once, feed)
    assert once.count() == comp.count() + 2  # case-insensitive: kęty once, Customer#..1 already known
    assert _sorted(once) == _sorted(twice)


def test_first_arrival_and_null_md5(spark):
    arr = spark.createDataFrame(
        [(1, "a", None), (2, "b", None), (3, "c", "h1"), (4, "d", "h1"), (5, "e", "h2")],
        "id long, file_name string, md5_hash string",
    )
    won = R.first_arrival_dedup(arr)
    assert _sorted(won, "id") == [(3,), (5,)]  # NULL md5 never registered; first of h1 wins


def test_register_files_idempotent(spark):
    reg = T.downloaded_files(spark, SF_SMALL).limit(0)
    arr = T.file_arrivals(spark, SF_SMALL).drop("text", "n_pages", "pages")
    once = R.register_files(reg, arr)
    twice = R.register_files(once, arr)
    assert once.count() == arr.select("md5_hash").distinct().count()
    assert _sorted(once) == _sorted(twice)


def test_upsert_jobs_last_writer_and_idempotent(spark):
    jobs = spark.createDataFrame(
        [(1, "a", "X", "0 9 * * 1", True, "m", 5, None, None, 3)],
        "id long, job_name string, company string, cron_schedule string, enabled boolean, model string, report_limit int, "
        "report_types string, last_run timestamp_ntz, run_count long",
    )
    batch = spark.createDataFrame(
        [("a", "Y1", "1 1 * * *", False, "m2", None, None, 1), ("a", "Y2", "2 2 * * *", True, "m3", 7, None, 2),
         ("b", "Z", "3 3 * * *", True, "m", None, None, 3)],
        "job_name string, company string, cron_schedule string, enabled boolean, model string, report_limit int, "
        "report_types string, change_no long",
    )
    once = R.upsert_jobs(jobs, batch, "2024-02-01 00:00:00")
    got = {r["job_name"]: r for r in once.collect()}
    assert got["a"]["id"] == 1 and got["a"]["company"] == "Y2" and got["a"]["run_count"] == 3 and got["a"]["report_limit"] == 7
    assert got["b"]["id"] == 2 and got["b"]["run_count"] == 0
    twice = R.upsert_jobs(once.drop("updated_at"), batch, "2024-02-01 00:00:00")
    assert _sorted(once) == _sorted(twice)


def test_delete_jobs_idempotent_and_existed(spark):
    jobs = T.scheduled_jobs(spark, SF_SMALL)
    names = spark.createDataFrame([("job_1",), ("no_such_job",)], "job_name string")
    state, existed = R.delete_jobs(jobs, names)
    state2, _ = R.delete_jobs(state, names)
    assert _sorted(state) == _sorted(state2)
    assert dict(rows(existed)) == {"job_1": True, "no_such_job": False}


def test_close_execution_overwrites_with_null(spark):
    starts = spark.createDataFrame(
        [(1, "j", "running", dt.datetime(2024, 1, 1, 0, 0, 0)), (2, "j", "running", dt.datetime(2024, 1, 1, 0, 0, 0))],
        "id long, job_name string, status string, started_at timestamp_ntz",
    )
    ends = spark.createDataFrame(
        [(1, "failed", dt.datetime(2024, 1, 1, 0, 0, 1, 900000), None, 3, None, "boom", None)],
        "execution_id long, status string, finished_at timestamp_ntz, reports_found int, documents_processed int, "
        "summary_report_id long, error_message string, log_file_path string",
    )
    out = {r["id"]: r for r in R.close_executions(starts, ends).collect()}
    assert out[1]["status"] == "failed" and out[1]["duration_seconds"] == 1 and out[1]["reports_found"] is None
    assert out[2]["status"] == "running" and out[2]["finished_at"] is None  # running job with NULL finish


def test_company_lookup_like_semantics(spark):
    comp = spark.createDataFrame([(1, "PKO_BP"), (2, "PKOXBP"), (3, "Orlen"), (4, "orlen")], "id long, name string")
    req = spark.createDataFrame([("PKO_BP",), ("orl%",), ("ORLEN",), ("none",)], "name string")
    got = dict(rows(S.company_lookup(req, comp)))
    assert got == {"PKO_BP": 1, "orl%": 3, "ORLEN": 3, "none": None}  # '_' is a wildcard (X5)


def test_browse_keeps_limit_below_filter(spark):
    df = S.browse_summary_reports(T.summary_reports(spark, SF_SMALL), job_filter="job_1")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Filter") < plan.index("Limit")  # Filter above the (Global)Limit in the tree


def test_company_stats_no_fanout(spark):
    c = T.companies(spark, SF_SMALL)
    out = stats.company_stats(c, T.reports(spark, SF_SMALL), T.downloaded_files(spark, SF_SMALL), T.summary_reports(spark, SF_SMALL))
    assert out.count() == c.count()
    no_reports = out.where(F.col("total_reports") == 0).limit(1).collect()
    for r in no_reports:  # company with no reports: zero counts, NULL dates
        assert r["latest_report_date"] is None


def test_report_limit_default(spark):
    jobs = T.scheduled_jobs(spark, SF_SMALL)
    got = S.list_jobs(jobs).where(F.col("id") % 5 == 0).select("report_limit").distinct().collect()
    assert [r[0] for r in got] == [5]  # NULL report_limit reads as 5


def test_bucketed_range_join_spans_buckets(spark):
    log = spark.createDataFrame(
        [(1, "j", dt.datetime(2024, 1, 1, 0, 50), dt.datetime(2024, 1, 1, 2, 10)), (2, "j", dt.datetime(2024, 1, 1, 5, 0), None)],
        "id long, job_name string, started_at timestamp_ntz, finished_at timestamp_ntz",
    )
    summ = spark.createDataFrame(
        [(10, "j", dt.datetime(2024, 1, 1, 1, 30)), (11, "j", dt.datetime(2024, 1, 1, 0, 55)), (12, "k", dt.datetime(2024, 1, 1, 0, 51)),
         (13, "j", dt.datetime(2024, 1, 1, 2, 11))],
        "id long, job_name string, created_at timestamp_ntz",
    )
    # a 2h20m run spans three hour buckets; the earliest summary of the same job inside wins
    assert rows(R.resolve_execution_summary(log, summ)) == [(1, 11)]
    assert rows(R.resolve_execution_summary(log, summ, bucket_seconds=60)) == [(1, 11)]


def test_company_lookup_prefix_path(spark):
    comp = spark.createDataFrame([(5, "Customer#000000001"), (3, "Customer#000000002"), (9, "Other")], "id long, name string")
    req = spark.createDataFrame([("customer#00000000_",), ("CUSTOMER#00000009_",), ("Custom%",), ("%ther",)], "name string")
    got = dict(rows(S.company_lookup(req, comp)))
    assert got == {"customer#00000000_": 3, "CUSTOMER#00000009_": None, "Custom%": 3, "%ther": 9}


def test_upsert_keeps_untouched_jobs_and_all_columns(spark):
    t = dt.datetime(2024, 1, 1)
    jobs = spark.createDataFrame(
        [(1, "a", "c1", "0 9 * * 1", 5, t, t, 3, t, "keep"), (2, "b", None, None, 7, t, t, 4, None, "x")],
        "id long, job_name string, company string, cron_schedule string, report_limit int, next_run timestamp_ntz, created_at timestamp_ntz, run_count long, updated_at timestamp_ntz, note string",
    )
    batch = spark.createDataFrame([("a", "new", "* * * * *", 1), ("a", "newest", "1 * * * *", 2), ("z", None, None, 1)], "job_name string, company string, cron_schedule string, change_no int")
    got = {r["job_name"]: r for r in R.upsert_jobs(jobs, batch, "2024-02-01 00:00:00").collect()}
    now = dt.datetime(2024, 2, 1)
    assert tuple(got["b"]) == (2, "b", None, None, 7, t, t, 4, None, "x")
    assert tuple(got["a"]) == (1, "a", "newest", "1 * * * *", None, t, t, 3, now, "keep")
    assert tuple(got["z"]) == (3, "z", None, None, None, None, now, 0, now, None)


def test_appended_rows_and_new_files_are_computed_once(spark):
    feed = spark.createDataFrame([(1, 0, i) for i in range(5)], "company_id long, page_no long, pos int")
    feed = feed.mapInArrow(lambda batches: batches, feed.schema)
    cols = {"date": "date", "title": "string", "report_type": "string", "report_category": "string", "rate_change": "double", "exchange_rate": "double", "link": "string"}
    feed = feed.withColumns({c: F.lit(None).cast(t) for c, t in cols.items()})
    state = feed.select(F.lit(7).cast("bigint").alias("id"), "company_id", *cols).limit(1)
    state = spark.createDataFrame(state.collect(), state.schema)
    out = R.append_reports(state, feed, ["company_id", "page_no", "pos"])
    assert "MapInArrow" not in out._jdf.queryExecution().toString()  # the pages were scanned for each reader before
    assert sorted(r["id"] for r in out.collect()) == [7, 8, 9, 10, 11, 12]
    arr = T.file_arrivals(spark, SF_SMALL).drop("text", "n_pages", "pages")
    out = R.register_files(T.downloaded_files(spark, SF_SMALL).limit(0), arr)
    assert "md5(" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_runs_without_a_summary_do_not_meet_in_one_task(spark):
    start = dt.datetime(2024, 1, 1)
    log = spark.range(4000).select(
        "id", F.lit("j").alias("job_name"), F.lit("success").alias("status"), F.lit(start).cast("timestamp_ntz").alias("started_at"),
        F.when(F.col("id") < 2, F.lit(start + dt.timedelta(minutes=5)).cast("timestamp_ntz")).alias("finished_at"),
    )
    made = start + dt.timedelta(minutes=1)
    summ = spark.createDataFrame([(10, "j", made), (10, "j", made), (11, "k", made)], "id long, job_name string, created_at timestamp_ntz")
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = R.execution_with_summary(log, summ).withColumn("task", F.spark_partition_id()).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    # a summary's id that occurs twice gives its run two rows, as the join on it always did
    assert sorted(r["id"] for r in out) == [0, 0, 1, 1, *range(2, 4000)]
    assert {(r["id"], r["summary_report_id"], r["summary_created_at"]) for r in out if r["id"] < 3} == {(0, 10, made), (1, 10, made), (2, None, None)}
    tasks = [r["task"] for r in out]
    assert max(tasks.count(t) for t in set(tasks)) < 1000  # all 3,998 were in one task before
