"""Driver contract, oracle agreement on the smallest scale, and drained streams."""

from __future__ import annotations

import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from filingflow.sources.tables import DRIVER_TABLES
from tests.conftest import SF_SMALL

FAST_ORACLE_SET = [
    "company_stats", "active_jobs", "search_reports", "listing_filter", "normalise_listing", "register_files",
    "upsert_jobs", "close_execution", "execution_summary_resolve", "concat_summaries", "cron_check", "next_fire_time",
    "select_representatives", "summarise_batch", "document_scan",
]


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns == [
        "company", "sector", "total_reports", "downloaded_files", "summary_reports", "latest_report_date", "latest_summary_date",
    ]


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in DRIVER_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def _canon(rows):
    def norm(v):
        if isinstance(v, float):
            return f"{v:.9g}"
        if isinstance(v, (list, tuple)):
            return tuple(norm(x) for x in v)
        return v

    return sorted((tuple(norm(v) for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", FAST_ORACLE_SET)
def test_query_matches_oracle(spark, duck, name):
    df = entry.queries()[name](spark, SF_SMALL)
    cols = sorted(df.columns)
    got = _canon(tuple(r[c] for c in cols) for r in df.collect())
    rel = duck.sql(entry.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    idx = [rel.columns.index(c) for c in cols]
    want = _canon(tuple(r[i] for i in idx) for r in rel.fetchall())
    assert got == want


def test_feed_stream_equals_batch_and_resumes(spark):
    from filingflow.plans import q_streams
    from filingflow.session import scratch_dir
    from filingflow.sources import listing as L
    from filingflow.sources import tables as T
    from filingflow.streaming import feeds

    landing, schema = q_streams._land(T.listing_pages(spark, SF_SMALL), "t-listing", 3, "page_no")
    sink, ckpt = scratch_dir(spark, "t-sink"), scratch_dir(spark, "t-ckpt")
    first = feeds.incremental_feed(spark, landing, schema, sink, ckpt).count()
    again = feeds.incremental_feed(spark, landing, schema, sink, ckpt).count()  # resumes: nothing new
    batch, _ = L.normalise_listing(L.listing_page_scan(T.listing_pages(spark, SF_SMALL)))
    assert first == again == batch.count()


def test_registry_stream_stores_each_md5_once(spark):
    from filingflow.plans import q_streams
    from filingflow.session import scratch_dir
    from filingflow.sources import tables as T
    from filingflow.streaming import feeds

    arr = T.file_arrivals(spark, SF_SMALL).drop("text", "n_pages", "pages")
    landing, schema = q_streams._land(arr, "t-arrivals", 3, "id")
    reg = feeds.streaming_registry(spark, landing, schema, scratch_dir(spark, "t-reg"), scratch_dir(spark, "t-reg-ckpt"))
    assert reg.count() == reg.select("md5_hash").distinct().count() == arr.select("md5_hash").distinct().count()
    assert reg.select("id").distinct().count() == reg.count()
    assert reg.agg(F.max("id")).collect()[0][0] == reg.count()


def test_every_inventory_id_has_queries():
    from filingflow.plans.inventory import INVENTORY

    from filingflow.plans.catalog import QUERIES as qs, load_all

    load_all()
    missing = {i: [k for k in keys if k not in qs] for i, keys in INVENTORY.items() if any(k not in qs for k in keys)}
    assert missing == {}
    covered = {k for keys in INVENTORY.values() for k in keys}
    assert set(qs) - covered == set()  # every catalogue key is accounted for by an inventory id


def test_pipeline_outputs_are_consistent(spark):
    from filingflow.operators.pipeline import Pipeline
    from filingflow.sources import tables as T

    out = Pipeline(spark, SF_SMALL)
    docs = T.file_arrivals(spark, SF_SMALL)
    n_docs = docs.select("md5_hash").distinct().count()
    summ = out.condensed
    # every downloaded document gets exactly one outcome: a summary or an error
    assert summ.count() == summ.select("id").distinct().count() == docs.count()
    assert summ.where(F.col("summary").isNull() & F.col("error").isNull()).count() == 0
    assert summ.where(F.col("error").isNotNull() & ~F.col("error").startswith("n_samples=")).count() == 0
    files = out.files()
    assert files.count() == n_docs  # one registry row per md5
    stored = summ.where(F.col("summary").isNotNull()).join(files.select("company", "file_name"), ["company", "file_name"], "left_semi")
    assert files.where(F.col("is_summarized")).count() == stored.count()
    rep = out.report()
    heads = rep.where(F.col("part") == 0)
    assert heads.where(~F.col("text").startswith("# Zbiorczy Raport GPW - ")).count() == 0
    tails = rep.groupBy("company").agg(F.max("part").alias("p")).join(rep, "company").where(F.col("part") == F.col("p"))
    assert tails.where(~F.col("text").contains("---")).count() == 0


def test_legacy_config_json_golden(spark, tmp_path):
    """FIXTURES §3: the documented job JSON reads as one job row (multi-line layout, unknown key
    dropped, defaults filled)."""
    from filingflow.sources.config_files import legacy_config_scan

    (tmp_path / "weekly.json").write_text(
        '{\n  "job_name": "weekly_report",\n  "company": "Asseco",\n  "date_from": "18-10-2025",\n'
        '  "date_to": "25-10-2025",\n  "model": "llama3.2:latest",\n  "cron_schedule": "0 9 * * 1",\n'
        '  "enabled": true,\n  "email_notify": null,\n  "description": "weekly",\n  "extra_key": 1\n}\n'
    )
    got = legacy_config_scan(spark, str(tmp_path), multi_line=True).collect()
    assert len(got) == 1
    r = got[0]
    assert (r["job_name"], r["company"], r["cron_schedule"], r["enabled"], r["report_limit"]) == (
        "weekly_report", "Asseco", "0 9 * * 1", True, 5,
    )
    assert "extra_key" not in r.asDict()


def test_streams_restart_on_unchanged_input(spark):
    from filingflow.plans import q_streams
    from filingflow.session import scratch_dir
    from filingflow.sources import tables as T
    from filingflow.streaming import feeds

    arr = T.file_arrivals(spark, SF_SMALL).drop("text", "n_pages", "pages")
    landing, schema = q_streams._land(arr, "t-again", 3, "id")
    where = scratch_dir(spark, "t-again-reg"), scratch_dir(spark, "t-again-ckpt")
    first = sorted(map(tuple, feeds.streaming_registry(spark, landing, schema, *where).collect()))
    again = sorted(map(tuple, feeds.streaming_registry(spark, landing, schema, *where).collect()))
    replay = sorted(map(tuple, feeds.streaming_registry(spark, landing, schema, where[0], scratch_dir(spark, "t-replay")).collect()))
    assert first == again == replay and len(first) == arr.select("md5_hash").distinct().count()

    kinds = "execution_id long, job_name string, started_at timestamp_ntz, start_status string, end_status string, finished_at timestamp_ntz, reports_found int, documents_processed int, summary_report_id long, error_message string, log_file_path string, is_end boolean"
    t = dt.datetime(2024, 1, 1)
    late = t + dt.timedelta(minutes=5)
    events = spark.createDataFrame(
        [
            (1, "a", t, "running", None, None, None, None, None, None, None, False),
            (1, None, None, None, "success", late, 3, None, 7, None, None, True),
            (1, None, None, None, "failed", t, 9, 9, None, "early", "log", True),
            (2, "b", t, "running", None, None, None, None, None, None, None, False),
        ],
        kinds,
    )
    landing, schema = q_streams._land(events, "t-exec", 2)
    where = scratch_dir(spark, "t-exec-state"), scratch_dir(spark, "t-exec-ckpt")
    for _ in range(2):
        got = {r["execution_id"]: r for r in feeds.execution_pairing(spark, landing, schema, *where).collect()}
        assert tuple(got[1])[1:] == ("a", t, "running", "success", late, 3, None, 7, None, None, True)
        assert got[2]["is_end"] is False and got[2]["end_status"] is None
    empty = scratch_dir(spark, "t-none")
    events.limit(0).write.parquet(empty)
    assert feeds.execution_pairing(spark, empty, schema, scratch_dir(spark, "t-none-s"), scratch_dir(spark, "t-none-c")).collect() == []


def test_an_increment_is_landed_by_several_tasks_and_drained_as_one_batch(spark):
    from filingflow.plans import q_streams
    from filingflow.session import scratch_dir
    from filingflow.streaming import feeds

    kinds = "id long, company string, file_name string, file_type string, file_size long, md5_hash string"
    rows = spark.createDataFrame([(i, "c", f"f{i}", "pdf", 1, f"m{i % 70}" if i % 5 else None) for i in range(400)], kinds).repartition(6)
    reg, ckpt, landed, batches = scratch_dir(spark, "t-inc"), scratch_dir(spark, "t-inc-ckpt"), [0], set()
    for landing, schema, files in q_streams._increments(rows, "t-inc", 4, "id"):
        landed.append(files)
        got = feeds.streaming_registry(spark, landing, schema, reg, ckpt, files).collect()
        batches |= {r["batch_id"] for r in got}
    assert min(b - a for a, b in zip(landed, landed[1:])) > 1  # one file, so one task, for each increment before
    assert spark.read.parquet(landing).count() == 400 and batches == {0}
    want = sorted(next(i for i in range(400) if i % 5 and i % 70 == m) for m in range(70) if m % 5)
    assert [r["arrival_id"] for r in sorted(got, key=lambda r: r["id"])] == want


def test_python_workers_find_the_package_from_another_folder(tmp_path):
    import os
    import subprocess
    import sys

    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (
        f"import sys; sys.path.insert(0, {repo!r})\n"
        "from filingflow.session import build_session\n"
        "spark = build_session('local[2]')\n"
        "from filingflow.operators import documents as D\n"
        "from pyspark.sql import functions as F\n"
        "df = spark.createDataFrame([(1, 'a b')], 'doc_id long, text string')\n"
        "print(D.chunk_documents(df).collect())\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert out.returncode == 0 and "chunk='a b'" in out.stdout, out.stderr[-500:]


def test_queries_are_listed_without_a_session(tmp_path):
    import os
    import subprocess
    import sys

    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"import sys; sys.path.insert(0, {repo!r}); import __spark_entry__ as e; print(len(e.queries()) >= len(e.oracle_sql()) > 100)"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert out.stdout.strip() == "True", out.stderr[-500:]


def test_a_malformed_page_goes_to_the_feeds_rejects(spark):
    from filingflow.session import scratch_dir
    from filingflow.streaming import feeds

    li = '<li><a href="k?{0}">o</a><span class="date">0{0}-01-2024 12:00:00 | Bieżący | ESPI | 1/2024</span><p>t</p><span class="profit margin-left-30 pull-right">Zmiana 1,0%</span><span class="summary margin-left-30 pull-right">Kurs2,0</span></li>'
    bad = li.format(3).replace("Zmiana 1,0%", "no number")
    landing, sink = scratch_dir(spark, "t-bad"), scratch_dir(spark, "t-bad-sink")
    pages = spark.createDataFrame([(1, 0, li.format(1) + bad), (2, 0, "<li>broken"), (3, 0, None)], "company_id long, page_no long, html string")
    pages.repartition(3).write.parquet(landing)
    for ckpt in ("a", "a", "b"):  # a restart, and a replay from the start
        got = feeds.incremental_feed(spark, landing, pages.schema, sink, f"{sink}-{ckpt}")
        assert [(r["company_id"], r["pos"]) for r in got.collect()] == [(1, 0)]
        rejected = feeds.read_batches(spark, f"{sink}-rejects").collect()
        assert sorted((r["company_id"], r["pos"]) for r in rejected) == [(1, 1), (2, 0)]


def test_summaries_of_one_file_do_not_multiply_it(spark):
    from filingflow.operators import registry as R

    files = spark.createDataFrame([(1, "A", "x.pdf"), (2, "b", "y.pdf")], "id long, company string, file_name string")
    found = spark.createDataFrame([(7, "a", "x.pdf", "old"), (9, "A", "x.pdf", "new"), (8, "a", "x.pdf", "zzz")], "id long, company string, file_name string, summary string")
    assert sorted((r["id"], r["new_summary"]) for r in R.attach_summaries(files, found).collect()) == [(1, "new"), (2, None)]
    assert R.attach_summaries(files, found.drop("id")).where("id = 1").first()["new_summary"] == "zzz"


def test_filters_keep_new_files_from_reading_the_registry(spark):
    from filingflow.streaming import feeds

    md5s = lambda a, b: spark.range(a, b).select(F.md5(F.col("id").cast("string").cast("binary")).alias("md5_hash"))
    filters = feeds.membership_filters(md5s(0, 3000)).unionByName(feeds.membership_filters(md5s(3000, 3100)))
    assert filters.groupBy("bucket").count().agg(F.max("count")).first()[0] <= 2
    assert filters.agg(F.sum(F.length("bits"))).first()[0] < 3100 * 32 * 0.2  # bytes of filters against bytes of md5s
    old = feeds.maybe_registered(md5s(0, 3100), filters)
    assert old.count() == 3100  # none is missed
    new = feeds.maybe_registered(md5s(10_000, 14_000), filters)
    assert new.count() < 60


def test_a_batch_that_died_after_its_filters_is_registered_once(spark, monkeypatch):
    from filingflow.operators import registry as R
    from filingflow.session import scratch_dir
    from filingflow.streaming import feeds

    kinds = "id long, company string, file_name string, file_type string, file_size long, md5_hash string"
    rows = spark.createDataFrame([(i, "c", f"f{i}", "pdf", 1, f"m{i % 7}" if i % 5 else None) for i in range(20)], kinds)
    landing, reg, ckpt = scratch_dir(spark, "t-die"), scratch_dir(spark, "t-die-reg"), scratch_dir(spark, "t-die-ckpt")
    rows.coalesce(1).write.parquet(landing)
    real = R.append_with_ids
    monkeypatch.setattr(R, "append_with_ids", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("died")))
    with pytest.raises(Exception, match="died"):
        feeds.streaming_registry(spark, landing, rows.schema, reg, ckpt)
    monkeypatch.setattr(R, "append_with_ids", real)
    got = feeds.streaming_registry(spark, landing, rows.schema, reg, ckpt).collect()
    assert sorted(r["md5_hash"] for r in got) == [f"m{i}" for i in range(7)] and sorted(r["id"] for r in got) == list(range(1, 8))
    again = feeds.streaming_registry(spark, landing, rows.schema, reg, scratch_dir(spark, "t-die-again")).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))


EXECUTION_EVENTS = (
    "execution_id long, job_name string, started_at timestamp_ntz, start_status string, end_status string, finished_at timestamp_ntz, "
    "reports_found int, documents_processed int, summary_report_id long, error_message string, log_file_path string, is_end boolean"
)


def _events(spark, landing, *events):
    """Lands one file of start events (id, minute) and end events (id, minute, status)."""
    t0 = dt.datetime(2024, 1, 1)
    rows = [
        (e[0], None, None, None, e[2], t0 + dt.timedelta(minutes=e[1]), 1, 2, None, None, None, True)
        if len(e) == 3
        else (e[0], f"job {e[0]}", t0 + dt.timedelta(minutes=e[1]), "running", None, None, None, None, None, None, None, False)
        for e in events
    ]
    spark.createDataFrame(rows, EXECUTION_EVENTS).coalesce(1).write.mode("append").parquet(landing)


def test_the_state_of_executions_holds_open_runs_only(spark):
    from filingflow.session import scratch_dir
    from filingflow.streaming import feeds

    landing, sink, ckpt = scratch_dir(spark, "t-open"), scratch_dir(spark, "t-open-sink"), scratch_dir(spark, "t-open-ckpt")
    schema = spark.createDataFrame([], EXECUTION_EVENTS).schema

    def drain(checkpoint=ckpt, patience=3_600_000):
        got = feeds.execution_pairing(spark, landing, schema, sink, checkpoint, patience_ms=patience).collect()
        held = feeds.open_executions(spark, checkpoint).collect()
        minute = lambda x: x and x.minute
        return {r["execution_id"]: (minute(r["started_at"]), r["end_status"], minute(r["finished_at"])) for r in got}, sorted(r["execution_id"] for r in held)

    _events(spark, landing, *[(i, i % 7) for i in range(40)])
    rows, held = drain()
    assert held == list(range(40)) and rows[3] == (3, None, None)
    _events(spark, landing, *[(i, 10, "success") for i in range(38)], (50, 11, "early"))
    rows, held = drain()
    assert held == [38, 39, 50] and rows[5] == (5, "success", 10) and rows[50] == (None, "early", 11)
    assert drain() == (rows, held)  # a restart without new input
    _events(spark, landing, (50, 9), (7, 30, "failed"), (8, 1, "stale"))  # a late start, a second end later and one earlier
    rows, held = drain()
    assert held == [7, 8, 38, 39] and rows[50] == (9, "early", 11) and rows[7] == (0, "failed", 30) and rows[8] == (1, "success", 10)
    full = rows
    rows, held = drain(scratch_dir(spark, "t-open-replay"))  # all events again, with no state, into the same sink
    assert rows == full
    _events(spark, landing, (60, 1))
    quick = scratch_dir(spark, "t-open-quick")
    drain(quick, 1)
    _events(spark, landing, (61, 1))
    rows, held = drain(quick, 1)  # ends that have waited their time are out of the state and in the result
    assert held == [38, 39, 60, 61] and {k: v for k, v in rows.items() if k < 60} == full


def test_a_batch_of_executions_that_died_is_written_once(spark, monkeypatch):
    from pyspark.sql import DataFrameWriter

    from filingflow.session import scratch_dir
    from filingflow.streaming import feeds

    landing, sink, ckpt = scratch_dir(spark, "t-dead"), scratch_dir(spark, "t-dead-sink"), scratch_dir(spark, "t-dead-ckpt")
    schema = spark.createDataFrame([], EXECUTION_EVENTS).schema
    _events(spark, landing, *[(i, 1) for i in range(9)], *[(i, 5, "success") for i in range(6)])
    real = DataFrameWriter.parquet

    def dies(self, path, *a, **k):
        real(self, path, *a, **k)
        if sink in path:
            raise RuntimeError("died")

    monkeypatch.setattr(DataFrameWriter, "parquet", dies)
    with pytest.raises(Exception, match="died"):
        feeds.execution_pairing(spark, landing, schema, sink, ckpt)
    monkeypatch.setattr(DataFrameWriter, "parquet", real)
    got = feeds.execution_pairing(spark, landing, schema, sink, ckpt).collect()
    assert sorted((r["execution_id"], r["is_end"]) for r in got) == [(i, i < 6) for i in range(9)]
    assert spark.read.parquet(sink).count() == 6


def test_open_executions_share_a_row_of_state(spark, monkeypatch):
    from filingflow.session import scratch_dir
    from filingflow.streaming import feeds

    monkeypatch.setattr(feeds, "RUN_BUCKETS", 8, raising=False)
    landing, sink, ckpt = scratch_dir(spark, "t-share"), scratch_dir(spark, "t-share-sink"), scratch_dir(spark, "t-share-ckpt")
    schema = spark.createDataFrame([], EXECUTION_EVENTS).schema
    _events(spark, landing, *[(i, i % 7) for i in range(300)], *[(i, 9, "success") for i in range(200)], (None, 3))
    got = feeds.execution_pairing(spark, landing, schema, sink, ckpt).collect()
    assert {r["execution_id"]: (r["started_at"].minute, r["end_status"]) for r in got} == {
        i: (3 if i is None else i % 7, "success" if i is not None and i < 200 else None) for i in [None, *range(300)]
    }
    assert {r["execution_id"] for r in feeds.open_executions(spark, ckpt).collect()} == {None, *range(200, 300)}
    assert spark.read.format("statestore").load(ckpt).count() <= 8  # a row, and a call to Python, for each open run before
    _events(spark, landing, *[(i, 9, "late") for i in range(200, 300)], (None, 4, "late"))
    got = feeds.execution_pairing(spark, landing, schema, sink, ckpt).collect()
    assert len(got) == 301 and all(r["is_end"] for r in got)
    assert {(r["reports_found"], r["documents_processed"]) for r in got} == {(1, 2)}
    _events(spark, landing, *[(i, 9, "first") for i in range(400, 500)], *[(i, 1) for i in range(500, 600)])  # held next to each other
    feeds.execution_pairing(spark, landing, schema, sink, ckpt)
    _events(spark, landing, *[(i, 1) for i in range(400, 500)], *[(i, 9, "then") for i in range(500, 600)])
    got = [r for r in feeds.execution_pairing(spark, landing, schema, sink, ckpt).collect() if (r["execution_id"] or 0) >= 400]
    assert len(got) == 200 and {(r["reports_found"], r["documents_processed"], r["finished_at"].minute) for r in got} == {(1, 2, 9)}
    assert spark.read.format("statestore").load(ckpt).count() == 0
