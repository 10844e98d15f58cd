"""Catalogue entries: streams drained with availableNow (R1-R3) and the pipeline."""

from __future__ import annotations

from pyspark.sql import functions as F

from filingflow.operators.common import cut_lineage
from filingflow.operators.pipeline import Pipeline
from filingflow.plans import q_listing, q_registry  # noqa: F401  (oracles registered there)
from filingflow.plans.catalog import ORACLES, register
from filingflow.session import scratch_dir
from filingflow.sources import tables as T
from filingflow.streaming import feeds


def _increments(df, name: str, increments: int, order_col: str | None = None):
    """Land a DataFrame as Parquet in several increments, each written by as many tasks as it has splits; yields (path, schema,
    files landed so far) after each of them. With ``order_col`` an increment is one range of it, so that they arrive in its order."""
    spark = df.sparkSession
    path = scratch_dir(spark, f"landing-{name}")
    staged = cut_lineage(df, f"staged-{name}")  # read once for the marks and once for each increment
    if order_col:
        marks = staged.approxQuantile(order_col, [i / increments for i in range(1, increments)], 0.01)
        c = F.col(order_col)
        parts = [
            staged.where((F.lit(True) if lo is None else c > lo) & (F.lit(True) if hi is None else c <= hi))
            for lo, hi in zip([None, *marks], [*marks, None])
        ]
    else:
        dealt = F.pmod(F.xxhash64(*staged.columns), F.lit(increments))
        parts = [staged.where(dealt == i) for i in range(increments)]
    for part in parts:
        part.write.mode("append").parquet(path)
        landed = spark.read.parquet(path)
        yield path, landed.schema, len(landed.inputFiles())


def _land(df, name: str, files: int, order_col: str | None = None):
    """All increments of a DataFrame landed, as (path, schema)."""
    *_, (path, schema, _) = _increments(df, name, files, order_col)
    return path, schema


@register("incremental_feed")
def q_incremental_feed(spark, sf):
    sink, checkpoint = scratch_dir(spark, "feed-sink"), scratch_dir(spark, "feed-ckpt")
    for landing, schema, files in _increments(T.listing_pages(spark, sf), "listing", 4, "page_no"):
        out = feeds.incremental_feed(spark, landing, schema, sink, checkpoint, files)  # an increment is one batch
    return out.select("company_id", "page_no", "pos", "date", "title", "report_type", "report_category", "rate_change", "exchange_rate", "link")


ORACLES["incremental_feed"] = ORACLES["normalise_listing"]


# Files land in id order, so the first arrival of an md5 survives and ids follow the order of arrival.
@register(
    "streaming_registry",
    """SELECT row_number() OVER (ORDER BY id) AS id, id AS arrival_id, md5_hash, file_size FROM file_arrivals
WHERE id IN (SELECT min(id) FROM file_arrivals GROUP BY md5_hash)""",
    ("file_arrivals",),
)
def q_streaming_registry(spark, sf):
    arr = T.file_arrivals(spark, sf).drop("text", "n_pages", "pages")
    registry, checkpoint = scratch_dir(spark, "registry"), scratch_dir(spark, "registry-ckpt")
    for landing, schema, files in _increments(arr, "arrivals", 4, "id"):
        reg = feeds.streaming_registry(spark, landing, schema, registry, checkpoint, files)  # an increment is one batch
    return reg.select("id", "arrival_id", "md5_hash", "file_size")


@register("execution_pairing")
def q_execution_pairing(spark, sf):
    log = T.job_execution_log(spark, sf).where(F.col("status") == "running")
    starts = log.select(
        F.col("id").alias("execution_id"), "job_name", "started_at", F.col("status").alias("start_status"),
        F.lit(None).cast("string").alias("end_status"), F.lit(None).cast("timestamp_ntz").alias("finished_at"),
        F.lit(None).cast("int").alias("reports_found"), F.lit(None).cast("int").alias("documents_processed"),
        F.lit(None).cast("bigint").alias("summary_report_id"), F.lit(None).cast("string").alias("error_message"),
        F.lit(None).cast("string").alias("log_file_path"), F.lit(False).alias("is_end"),
    )
    ends = q_registry._end_events(spark, sf).select(
        "execution_id", F.lit(None).cast("string").alias("job_name"), F.lit(None).cast("timestamp_ntz").alias("started_at"),
        F.lit(None).cast("string").alias("start_status"), F.col("status").alias("end_status"), "finished_at",
        "reports_found", "documents_processed", "summary_report_id", "error_message", "log_file_path", F.lit(True).alias("is_end"),
    )
    sink, checkpoint = scratch_dir(spark, "exec-state"), scratch_dir(spark, "exec-ckpt")
    for landing, schema, files in _increments(starts.unionByName(ends), "exec-events", 4):
        st = feeds.execution_pairing(spark, landing, schema, sink, checkpoint, files)  # an increment is one batch
    from filingflow.functions.text import micros_between

    secs = F.floor(micros_between(F.col("started_at"), F.col("finished_at")) / F.lit(1000000)).cast("int")
    return st.where(F.col("start_status").isNotNull()).select(
        F.col("execution_id").alias("id"), "job_name", F.coalesce("end_status", "start_status").alias("status"), "started_at",
        "finished_at", F.when(F.col("is_end"), secs).alias("duration_seconds"), "reports_found", "documents_processed",
        "summary_report_id", "error_message", "log_file_path",
    )


ORACLES["execution_pairing"] = ORACLES["close_execution"]


@register("pipeline_result")
def q_pipeline_result(spark, sf):
    return Pipeline(spark, sf).condensed


# Malformed items: pages numbered 3 of 7 have lost the marks between the parts of their headers.
_BAD_PAGE = "CAST(floor(id / 100) AS BIGINT) % 7 = 3"


def _pages_with_malformed(spark, sf):
    p = T.listing_pages(spark, sf)
    return p.withColumn("html", F.when(F.col("page_no") % 7 == 3, F.replace("html", F.lit(" | "), F.lit(" "))).otherwise(F.col("html")))


@register("pipeline_rejected", f"SELECT company_id, link FROM reports WHERE {_BAD_PAGE}", ("reports",))
def q_pipeline_rejected(spark, sf):
    return Pipeline(spark, sf, pages=_pages_with_malformed(spark, sf)).rejected().select("company_id", "link")


@register(
    "feed_rejects",
    f"""SELECT company_id, link, FALSE AS accepted FROM reports WHERE {_BAD_PAGE}
UNION ALL SELECT company_id, link, TRUE FROM reports WHERE NOT ({_BAD_PAGE})""",
    ("reports",),
)
def q_feed_rejects(spark, sf):
    """R1 over pages with malformed items: what the feed kept in each of its two sinks."""
    sink, checkpoint = scratch_dir(spark, "feed-sink"), scratch_dir(spark, "feed-ckpt")
    for landing, schema, files in _increments(_pages_with_malformed(spark, sf), "listing-bad", 3, "page_no"):
        good = feeds.incremental_feed(spark, landing, schema, sink, checkpoint, files)
    bad = feeds.read_batches(spark, f"{sink}-rejects")
    rows = [df.select("company_id", "link", F.lit(ok).alias("accepted")) for df, ok in ((good, True), (bad, False))]
    return rows[0].unionByName(rows[1])


@register(
    "pipeline_files",
    """SELECT row_number() OVER (ORDER BY id) AS id, company, file_name, md5_hash FROM file_arrivals
WHERE id IN (SELECT min(id) FROM file_arrivals GROUP BY md5_hash)""",
    ("file_arrivals",),
)
def q_pipeline_files(spark, sf):
    return Pipeline(spark, sf).files().select("id", "company", "file_name", "md5_hash")


@register("pipeline_overview")
def q_pipeline_overview(spark, sf):
    return Pipeline(spark, sf).overview()


@register("pipeline_report")
def q_pipeline_report(spark, sf):
    return Pipeline(spark, sf).report()
