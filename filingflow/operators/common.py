"""Small building blocks shared by the operators.

* ``broadcast_if_small`` — broadcast only a side whose optimizer size estimate is under a bound;
  otherwise leave the join to the planner (and AQE's runtime broadcast conversion, which
  measures the real shuffle size before switching).
* ``ordinal`` — ``row_number()`` inside a group without putting the whole group in one task:
  count per (group, order-key bucket), prefix-sum the bucket counts, then number rows inside
  a bucket, which is bounded by the bucket width.
* ``cut_lineage`` — write an intermediate to the shared checkpoint folder and read it back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filingflow.session import scratch_dir

BROADCAST_MAX_BYTES = 64 * 1024 * 1024


def plan_size_bytes(df: DataFrame) -> int:
    """Optimizer estimate of ``df``'s size; no job is run."""
    try:
        return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except Exception:  # noqa: BLE001 - stats unavailable (e.g. connect mode): assume large
        return 1 << 62


def broadcast_if_small(df: DataFrame, max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    return F.broadcast(df) if plan_size_bytes(df) <= max_bytes else df


def ordinal(
    df: DataFrame,
    group_cols: list[str],
    order_col: str,
    out: str = "ordinal",
    total: str | None = None,
    bucket_width: int = 1 << 16,
) -> DataFrame:
    """1-based position of each row inside its group, ordered by ``order_col`` ascending.

    ``order_col`` must be a unique non-negative integer key inside the group (ids, positions).
    Work per task is bounded by ``bucket_width`` rows plus one row per (group, bucket), so a hot
    group holding a third of the table is spread over many tasks.
    """
    b = "__bucket"
    with_b = df.withColumn(b, F.floor(F.col(order_col) / F.lit(bucket_width)).cast("bigint"))
    counts = with_b.groupBy(*group_cols, b).agg(F.count(F.lit(1)).alias("__n"))
    w_prefix = Window.partitionBy(*group_cols).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("__off", F.coalesce(F.sum("__n").over(w_prefix), F.lit(0)))
    if total:
        offsets = offsets.withColumn(total, F.sum("__n").over(Window.partitionBy(*group_cols)))
    offsets = offsets.drop("__n")
    joined = with_b.join(offsets, on=[*group_cols, b], how="inner")
    w_in = Window.partitionBy(*group_cols, b).orderBy(order_col)
    res = joined.withColumn(out, (F.col("__off") + F.row_number().over(w_in)).cast("int"))
    if total:
        res = res.withColumn(total, F.col(total).cast("int"))
    return res.drop(b, "__off")


def top_k(rows: DataFrame, keys: list[str], order: list[Column], limit: Column, salt: Column, salts: int = 64, out: str = "rn") -> DataFrame:
    """The first ``limit`` rows (a column, any size, one value per key) of each key, numbered from 1 in ``out``.

    Rows are cut once per (key, salt) and then per key, so a hot key is spread over ``salts`` tasks
    and only its survivors meet.
    """
    part = rows.withColumns({"__limit": limit, "__salt": F.pmod(F.xxhash64(salt), F.lit(salts))})
    first = Window.partitionBy(*keys, "__salt").orderBy(*order)
    part = part.withColumn(out, F.row_number().over(first)).where(F.col(out) <= F.col("__limit"))
    last = Window.partitionBy(*keys).orderBy(*order)
    return part.withColumn(out, F.row_number().over(last)).where(F.col(out) <= F.col("__limit")).drop("__limit", "__salt")


def cut_lineage(df: DataFrame, name: str) -> DataFrame:
    """Materialise ``df`` as parquet in the shared checkpoint folder and continue from it."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def lower_key(c: str | Column) -> Column:
    """Case-insensitive join key (the registry compares company names without case)."""
    return F.lower(F.col(c) if isinstance(c, str) else c)


def dense_ids(df: DataFrame, order_cols: list[str], start: Column | int = 0, out: str = "id", partitions: int | None = None) -> DataFrame:
    """Number rows ``start+1, start+2, ...`` in ``order_cols`` order without a global window.

    Only the order columns are range-partitioned and written (distinct keys with their row counts);
    each partition's row count is taken (one small row per partition), offsets are prefix sums over
    those counts, and keys are numbered inside their own partition. The wide rows meet their number
    in one join; rows that share a key are numbered inside it, in no particular order.
    """
    n = partitions or max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    names = [f"__k{i}" for i in range(len(order_cols))]
    keys = df.select(*[F.col(c).alias(k) for c, k in zip(order_cols, names)]).groupBy(*names).agg(F.count(F.lit(1)).alias("__n"))
    # The range bounds are sampled; counting and numbering must see the same partitions: written once.
    ranged = cut_lineage(keys.repartitionByRange(n, *names).withColumn("__pid", F.spark_partition_id()), "dense-ids")
    counts = ranged.groupBy("__pid").agg(F.sum("__n").alias("__all"))
    w = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__pid", F.coalesce(F.sum("__all").over(w), F.lit(0)).alias("__off"))
    inside = Window.partitionBy("__pid").orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    numbered = ranged.join(F.broadcast(offsets), "__pid").withColumn("__first", F.col("__off") + F.coalesce(F.sum("__n").over(inside), F.lit(0)))
    same = None
    for c, k in zip(order_cols, names):
        hit = df[c].eqNullSafe(numbered[k])
        same = hit if same is None else same & hit
    joined = df.join(numbered.select(*names, "__first", "__n"), same)
    tie = F.row_number().over(Window.partitionBy(*names).orderBy(F.lit(0)))
    base = start if isinstance(start, Column) else F.lit(start)
    one = joined.where(F.col("__n") == 1).withColumn("__tie", F.lit(1))
    many = joined.where(F.col("__n") > 1).withColumn("__tie", tie)
    rows = one.unionByName(many).withColumn(out, (base + F.col("__first") + F.col("__tie")).cast("bigint"))
    return rows.drop(*names, "__first", "__n", "__tie")
