"""Copy-on-write tables: buckets rewritten, crashes, conflicts, versions."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from filingflow.operators import registry as R
from filingflow.sources import snapshots as S

JOBS = "id long, job_name string, company string, enabled boolean, report_limit int, run_count long, last_run timestamp_ntz, next_run timestamp_ntz"


def jobs(spark, n):
    return spark.range(n).select(
        F.col("id"), F.concat(F.lit("job_"), F.col("id").cast("string")).alias("job_name"), F.lit("c").alias("company"), F.lit(True).alias("enabled"),
        F.lit(5).alias("report_limit"), F.lit(0).cast("long").alias("run_count"), F.lit(None).cast("timestamp_ntz").alias("last_run"), F.lit(None).cast("timestamp_ntz").alias("next_run"),
    )


def files(path):
    return {os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def state(df):
    return sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=str)


UPSERT = "job_name string, company string, change_no int"


def upsert(state, batch, last):
    return R.upsert_jobs(state, batch, "2024-01-01 00:00:00", last_id=last)


def test_a_small_change_rewrites_its_buckets_only(spark, tmp_path):
    table = S.SnapshotTable(spark, str(tmp_path), ["job_name"], buckets=200)
    base = jobs(spark, 1000)
    assert table.create(base) == 0 and state(table.read()) == state(base)
    before = files(tmp_path)
    batch = spark.createDataFrame([(f"job_{i}", "d", 1) for i in range(0, 1000, 100)] + [("new_b", "e", 1), ("new_a", "f", 1)], UPSERT)
    assert table.apply(batch, upsert) == 1
    assert before < files(tmp_path) and len({f.split("__bucket=")[1].split("/")[0] for f in files(tmp_path) - before}) <= 12
    assert state(table.read()) == state(R.upsert_jobs(base, batch, "2024-01-01 00:00:00"))
    assert {r["job_name"]: r["id"] for r in table.read().where("job_name like 'new%'").collect()} == {"new_a": 1000, "new_b": 1001}
    assert state(table.read(0)) == state(base)  # the version before is still there
    assert table.apply(batch.limit(0), upsert) == 1
    table.vacuum()
    assert len(files(tmp_path)) <= 200 and table.read().count() == 1002
    with pytest.raises(ValueError):
        table.read(0)


def test_deletes_and_updates_through_snapshots(spark, tmp_path):
    table, base = S.SnapshotTable(spark, str(tmp_path), ["job_name"], buckets=8), jobs(spark, 60)
    table.create(base)
    names = spark.createDataFrame([("job_3",), ("job_4",), ("nope",)], "job_name string")
    table.apply(names, lambda s, c, _: R.delete_jobs(s, c)[0])
    off = spark.createDataFrame([("job_5", False, 1)], "job_name string, enabled boolean, change_no int")
    table.apply(off, lambda s, c, _: R.set_enabled(s, c))
    assert state(table.read()) == state(R.set_enabled(R.delete_jobs(base, names)[0], off))
    every = base.select("job_name")
    table.apply(every, lambda s, c, _: R.delete_jobs(s, c)[0])
    assert table.read().count() == 0 and table.read().columns == base.columns
    new = spark.createDataFrame([("again", "x", 1)], UPSERT)
    table.apply(new, upsert)
    assert [(r["id"], r["job_name"]) for r in table.read().collect()] == [(60, "again")]  # ids are not given twice


def test_a_crash_leaves_the_old_state_and_one_of_two_writers_wins(spark, tmp_path, monkeypatch):
    table, base = S.SnapshotTable(spark, str(tmp_path), ["job_name"], buckets=4), jobs(spark, 40)
    table.create(base)
    batch = spark.createDataFrame([("job_1", "d", 1)], UPSERT)
    with pytest.raises(Exception, match="stop"):
        table.apply(batch, lambda s, c, last: upsert(s, c, last).withColumn("company", F.raise_error(F.lit("stop")).cast("string")))
    monkeypatch.setattr(S.Folder, "create", lambda self, name, text: (_ for _ in ()).throw(RuntimeError("dead before the manifest")))
    with pytest.raises(RuntimeError, match="dead"):
        table.apply(batch, upsert)
    monkeypatch.undo()
    assert table.manifest()["version"] == 0 and state(table.read()) == state(base)
    old = table.manifest()
    assert table.apply(batch, upsert) == 1
    with pytest.raises(S.Conflict):  # a writer that started from version 0
        table._commit(old, base.limit(0), [])
    table.vacuum()
    data = {f.split("/data/")[1].split("/")[0] for f in files(tmp_path)}
    assert data == set(json.loads(json.dumps(table.manifest()["live"])).values())  # what the dead writers left is gone
    with pytest.raises(ValueError, match="does not name"):
        table.apply(batch, lambda s, c, last: jobs(spark, 500))
