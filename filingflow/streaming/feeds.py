"""Structured Streaming forms of the incremental paths: R1 feed, R2 registry, R3 executions.

Every stream keeps its checkpoint in the shared checkpoint folder and can be drained with
``trigger(availableNow=True)``; restarting a stream resumes from its checkpoint, so a file is
normalised once (R1). ``foreachBatch`` bodies are idempotent — a replayed micro-batch finds its
md5s / execution ids already registered — so executor or driver loss cannot double-write.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from filingflow.operators import registry as R
from filingflow.operators.common import cut_lineage
from filingflow.sources import listing as L


def incremental_feed(spark: SparkSession, landing: str, schema, sink: str, checkpoint: str, files_per_trigger: int = 1, rejects: str | None = None):
    """New listing pages since the last run -> Job N -> typed rows in ``sink``, items that cannot be typed in ``rejects``
    (``<sink>-rejects`` if not given; ``read_batches`` reads either).

    Each micro-batch writes its rows to folders of its own number, so a batch that is run again replaces what it wrote. The
    items are scanned once for both sinks.
    """
    pages = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(landing)
    rejects = rejects or f"{sink}-rejects"

    def keep(batch: DataFrame, batch_id: int) -> None:
        items = cut_lineage(L.listing_page_scan(batch), "feed-items")
        for rows, path in zip(L.normalise_listing(items), (sink, rejects)):
            rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id:08d}")

    q = pages.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return read_batches(spark, sink)


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """All rows that the batches of a feed have written to ``path``."""
    return spark.read.parquet(path).drop("batch")


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder is there, asked of its own file system; any other error is the caller's to see."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


REGISTRY_SCHEMA = (
    "id long, arrival_id long, company string, file_name string, file_type string, file_size long, md5_hash string, batch_id long"
)


REGISTRY_BUCKETS = 64
FILTER_BITS = 16  # for each md5: with four probes about one false hit in 400


def _md5_bucket(md5: Column) -> Column:
    return F.pmod(F.xxhash64(md5), F.lit(REGISTRY_BUCKETS)).cast("int")


def _probes(h1: np.ndarray, h2: np.ndarray, bits: int) -> np.ndarray:
    """Four places in a filter of ``bits`` bits (a power of two) for each pair of hashes."""
    a, b = h1.astype(np.uint64), h2.astype(np.uint64) | np.uint64(1)
    return np.stack([(a + np.uint64(i) * b) & np.uint64(bits - 1) for i in range(4)])


def membership_filters(rows: DataFrame) -> DataFrame:
    """(``bucket``, ``bits``): a Bloom filter over the md5s of each bucket of ``rows``, sized by their number."""

    def build(group: pa.Table) -> pa.Table:
        size = 1 << int(np.ceil(np.log2(max(64, FILTER_BITS * group.num_rows))))
        bits = np.zeros(size, bool)
        bits[_probes(group["h1"].to_numpy(), group["h2"].to_numpy(), size).ravel()] = True
        return pa.table({"bucket": pa.array([group["bucket"][0].as_py()], pa.int32()), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    return _hashed(rows).groupBy("bucket").applyInArrow(build, "bucket int, bits binary")


def _hashed(rows: DataFrame) -> DataFrame:
    md5 = F.col("md5_hash")
    return rows.where(md5.isNotNull()).select(_md5_bucket(md5).alias("bucket"), md5, F.xxhash64(md5, F.lit(1)).alias("h1"), F.xxhash64(md5, F.lit(2)).alias("h2")).distinct()


def maybe_registered(rows: DataFrame, filters: DataFrame) -> DataFrame:
    """(``bucket``, ``md5_hash``) of the md5s that some filter of their bucket has: all that are registered and a few more."""

    def probe(arrived: pa.Table, known: pa.Table) -> pa.Table:
        h1, h2 = arrived["h1"].to_numpy(), arrived["h2"].to_numpy()
        hit = np.zeros(arrived.num_rows, bool)
        for packed in known["bits"].to_pylist():
            bits = np.unpackbits(np.frombuffer(packed, np.uint8)).astype(bool)
            hit |= bits[_probes(h1, h2, len(bits))].all(axis=0)
        return arrived.select(["bucket", "md5_hash"]).filter(pa.array(hit))

    return _hashed(rows).groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInArrow(probe, "bucket int, md5_hash string")


def streaming_registry(spark: SparkSession, landing: str, schema, registry_path: str, checkpoint: str, files_per_trigger: int = 1):
    """R2: each micro-batch runs U3 (first arrival per md5, anti join on the registry, append).

    The registry is a Parquet folder in buckets of the md5 that only ever grows, with a Bloom filter for each batch and bucket
    beside it (``<registry>-filters``). A batch asks the filters first and reads the md5s of only those buckets that may hold one
    of its own; the exact check there decides. A batch's filters are written before its rows, so a batch that is run again
    after a failure finds what it wrote and appends nothing twice. Of the rest only the ids are read, for the next number.
    """
    arrivals = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(landing)
    filters_path = f"{registry_path.rstrip('/')}-filters"

    def current(s: SparkSession) -> DataFrame:
        stored = f"{REGISTRY_SCHEMA}, bucket int"
        return s.read.schema(stored).parquet(registry_path) if path_exists(s, registry_path) else s.createDataFrame([], stored)

    def register(batch: DataFrame, batch_id: int) -> None:
        s = batch.sparkSession
        known, first = current(s), R.first_arrival_dedup(batch)
        if path_exists(s, filters_path):
            maybe = cut_lineage(maybe_registered(first, s.read.schema("bucket int, bits binary").parquet(filters_path)), "maybe-registered")
            hit = [r[0] for r in maybe.select("bucket").distinct().collect()]  # at most one row for each bucket
            first = R.new_files_only(first, known.where(F.col("bucket").isin(hit)).join(maybe.select("md5_hash"), "md5_hash", "left_semi")) if hit else first
        fresh = cut_lineage(first.withColumnRenamed("id", "arrival_id"), "fresh-files")
        if fresh.isEmpty():
            return
        membership_filters(fresh).write.mode("append").parquet(filters_path)
        added = R.append_with_ids(known, fresh, ["arrival_id"]).withColumn("batch_id", F.lit(batch_id).cast("long"))
        added = added.withColumn("bucket", _md5_bucket(F.col("md5_hash"))).select(*known.columns)
        added.repartition("bucket").write.partitionBy("bucket").mode("append").parquet(registry_path)

    q = (
        arrivals.writeStream.foreachBatch(register)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return current(spark).drop("bucket")


START_COLS = ["job_name", "started_at", "start_status"]
END_COLS = ["end_status", "finished_at", "reports_found", "documents_processed", "summary_report_id", "error_message", "log_file_path"]


def fold_executions(events: DataFrame) -> DataFrame:
    """One row per execution: the fields of its first start and of its latest end, each taken from one event as a whole."""
    end = F.max(F.when(F.col("is_end"), F.struct(F.col("finished_at").alias("at"), *END_COLS)))
    start = F.min(F.when(F.col("start_status").isNotNull(), F.struct(F.col("started_at").alias("at"), *START_COLS)))
    one = events.groupBy("execution_id").agg(start.alias("s"), end.alias("e"))
    cols = [F.col("s")[c].alias(c) for c in START_COLS] + [F.col("e")[c].alias(c) for c in END_COLS]
    return one.select("execution_id", *cols, F.col("e").isNotNull().alias("is_end"))


EXECUTION_SCHEMA = (
    "execution_id long, job_name string, started_at timestamp_ntz, start_status string, end_status string, finished_at timestamp_ntz, "
    "reports_found int, documents_processed int, summary_report_id long, error_message string, log_file_path string, is_end boolean"
)
# What is known of a run: its start and its end, null if that is yet to come.
_START = "struct<job_name: string, started_at: timestamp_ntz, start_status: string>"
_END = (
    "struct<end_status: string, finished_at: timestamp_ntz, reports_found: string, documents_processed: string, "
    "summary_report_id: string, error_message: string, log_file_path: string>"
)
NUMBERS = {"reports_found": "int", "documents_processed": "int", "summary_report_id": "long"}  # go as text: pandas has no whole numbers with nulls
RUN_FIELDS = f"run_id string, start {_START}, end {_END}"
# Runs are kept in buckets of their ids, one row of state for each; the number belongs to a checkpoint, like its schema.
RUN_BUCKETS = 1024
BUCKET_STATE = f"runs array<struct<run_id: string, start: {_START}, end: {_END}, until: bigint>>"


def _nulls_first(at, fields: tuple) -> tuple:
    """Sort key of an event, as ``fold_executions`` orders them: by its time, then its fields, nulls first."""
    return tuple((v is not None, v) for v in (at, *fields))


def _open_runs(patience_ms: int):
    """Keeps an execution id in the state of its bucket from its first event until both its start and its end are there.

    An end without a start waits ``patience_ms`` for it (``until``, the time of the batch it stops waiting at), then it is emitted as
    it is: the start never came, or the run was closed before and this is another end of it. So the state holds the open
    runs and what came within that time. A call to Python, a frame and a row of state are for a bucket, not for a run.
    """

    def first(a: tuple | None, b: tuple) -> bool:
        return a is None or _nulls_first(b[1], b) < _nulls_first(a[1], a)

    def rank(end: tuple) -> tuple:
        return _nulls_first(end[1], tuple(int(v) if f in NUMBERS and v is not None else v for f, v in zip(END_COLS, end)))

    def last(a: tuple | None, b: tuple) -> bool:
        return a is None or rank(b) > rank(a)

    def fields_of(x, fields: list[str]) -> tuple:
        return tuple(v if v == v else None for v in (x[f] for f in fields))  # no NaT

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentProcessingTimeMs()
        held = {r[0]: (r[1] and tuple(r[1]), r[2] and tuple(r[2]), r[3]) for r in state.get[0]} if state.exists else {}
        came: dict[str | None, list] = {}
        for events in () if state.hasTimedOut else batches:
            # an event comes as a dict or a row, as this Spark's Arrow setting has it
            for run_id, start, end in zip(events["run_id"], events["start"], events["end"]):
                one = came.get(run_id) or came.setdefault(run_id, list(held.pop(run_id, (None, None)))[:2])
                if start is not None and first(one[0], start := fields_of(start, START_COLS)):
                    one[0] = start
                if end is not None and last(one[1], end := fields_of(end, END_COLS)):
                    one[1] = end
        done = [(run_id, start, end) for run_id, (start, end, until) in held.items() if until is not None and until <= now]
        for run_id, _, _ in done:
            del held[run_id]
        for run_id, (start, end) in came.items():
            if start and end:
                done.append((run_id, start, end))
            elif start or end:
                held[run_id] = (start, end, now + patience_ms if end else None)
        if held:
            state.update(([(run_id, *kept) for run_id, kept in held.items()],))
            waits = [kept[2] for kept in held.values() if kept[2] is not None]
            if waits:
                state.setTimeoutDuration(max(1, min(waits) - now))
        elif state.exists:
            state.remove()
        if done:
            ids, starts, ends = zip(*done)
            named = {c: [x and dict(zip(fields, x)) for x in side] for c, side, fields in (("start", starts, START_COLS), ("end", ends, END_COLS))}
            yield pd.DataFrame({"run_id": ids, **named})

    return run


def _flat(runs: DataFrame, run_id: Column) -> DataFrame:
    fields = [F.col(f"start.{c}").alias(c) for c in START_COLS] + [F.col(f"end.{c}").cast(NUMBERS.get(c, "timestamp_ntz" if c == "finished_at" else "string")).alias(c) for c in END_COLS]
    return runs.select(run_id.cast("long").alias("execution_id"), *fields, F.col("end").isNotNull().alias("is_end"))


def open_executions(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The runs in the state of ``execution_pairing``, read from its checkpoint; one row for each."""
    if not path_exists(spark, f"{checkpoint}/state/0"):
        return spark.createDataFrame([], EXECUTION_SCHEMA)
    state = spark.read.format("statestore").load(checkpoint)
    return _flat(state.select(F.explode("value.groupState.runs").alias("r")).select("r.*"), F.col("run_id"))


def execution_pairing(
    spark: SparkSession, landing: str, schema, sink: str, checkpoint: str, files_per_trigger: int = 1, patience_ms: int = 3_600_000
) -> DataFrame:
    """Start and end events of executions (one stream, ``is_end`` flag), one row per execution id: its first start and
    its latest end, null where there is none.

    Keyed state, in ``RUN_BUCKETS`` buckets of ids, holds a run only while it is open (``_open_runs``). A run that closes is written once to ``sink``, each batch to
    a folder of its own, so a batch that is run again replaces what it wrote. The result is the closed runs and the state; no
    event is read a second time. They are folded by id once more for ends that came after their run was closed and for
    events that were landed again. An event without an execution id belongs to one run of its own, of the null id.
    """
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(landing)
    start = F.when(F.col("start_status").isNotNull(), F.struct(*START_COLS))
    end = F.when(F.col("is_end"), F.struct(*[F.col(c).cast("string").alias(c) if c in NUMBERS else F.col(c) for c in END_COLS]))
    bucket = F.pmod(F.xxhash64("execution_id"), F.lit(RUN_BUCKETS)).cast("int")
    runs = events.select(bucket.alias("bucket"), F.col("execution_id").cast("string").alias("run_id"), start.alias("start"), end.alias("end")).groupBy("bucket")
    closed = runs.applyInPandasWithState(_open_runs(patience_ms), RUN_FIELDS, BUCKET_STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)

    def keep(batch: DataFrame, batch_id: int) -> None:
        _flat(batch, F.col("run_id")).write.mode("overwrite").parquet(f"{sink}/batch={batch_id:08d}")

    # a drain ends with its input: a waiting time asks for batches without data for ever
    idle = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(idle)
    spark.conf.set(idle, "false")
    try:
        q = closed.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(idle, before)
    q.awaitTermination()
    rows = open_executions(spark, checkpoint)
    if path_exists(spark, sink):
        rows = rows.unionByName(spark.read.schema(EXECUTION_SCHEMA).parquet(sink).drop("batch"))
    return fold_executions(rows)
