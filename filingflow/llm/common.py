"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from filingflow.session import scratch_dir

# ASCII white space as the contracts spell it, [\x20\x09-\x0D].
WHITE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A driver table, through Spark's own reader (any storage)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, every other code point untouched (all-ASCII texts take the faster built-in)."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def others(df: DataFrame, new: list[str]) -> list[str]:
    """The columns of ``df`` that ``new`` does not replace (names compare without case)."""
    taken = {n.lower() for n in new}
    return [f"`{c}`" for c in df.columns if c.lower() not in taken]


def fed_once(df: DataFrame, rest: list[str], text_col: str) -> tuple[DataFrame, int]:
    """The columns ``rest`` of ``df`` for a Python node that reads ``text_col``, and that column's place; the text goes there
    once, behind the others only if it isn't among them."""
    names = [c.strip("`").lower() for c in rest]
    if text_col.lower() in names:
        return df.select(*rest), names.index(text_col.lower())
    return df.select(*rest, F.col(text_col).alias("__text")), len(rest)


def own_names(operator):
    """Names that start with ``__`` belong to the operators: columns of the caller that do are renamed on the
    way in and get their names back on the way out."""

    @wraps(operator)
    def call(docs: DataFrame, *args, **options) -> DataFrame:
        away = {c: f"own_column_{i}" for i, c in enumerate(docs.columns) if c.startswith("__")}
        out = operator(docs.withColumnsRenamed(away) if away else docs, *args, **options)
        return out.withColumnsRenamed({v: k for k, v in away.items()}) if away else out

    return call


def with_row_key(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``__rk``, ``__rd``: a key that equal (id, text) rows share and no other rows do.

    Results that depend on the row's own text only may be joined back on it, repeated rows
    included; null ids and texts have a key too.
    """
    t, i = F.col(text_col), F.col(id_col)
    return df.withColumns(
        {
            "__rk": F.xxhash64(t, F.length(t), i.isNull()),
            "__rd": F.coalesce(i.cast("string"), F.lit("")),
        }
    )


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared checkpoint folder, read back: lineage ends here and
    an executor that is lost takes nothing with it."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def crc_bucket(id_col: Column, n: int) -> Column:
    """crc32 of the id written as text, modulo ``n`` (null ids: of the empty text)."""
    return (F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % n).cast("int")


def row_draw(id_col: Column, text_col: Column, seed: int) -> Column:
    """62 random bits fixed by id, text and seed: only rows equal in both share them."""
    return F.xxhash64(id_col, id_col.isNull(), text_col, F.lit(seed)).bitwiseAND(F.lit((1 << 62) - 1))


def least_draws(rows: DataFrame, kind: Column, draw: Column, most: Callable[[int], int], *out: Column) -> DataFrame:
    """``kind``, ``draw`` and ``out`` of the ``most(number of kinds)`` least draws of each kind, or of all if there are
    fewer; a draw counts once. Exact: distinct draws are counted by bit length, which leaves about twice as many
    candidates, and only those are ranked. No kind is lost, and repeated rows take no one's place."""
    spark = rows.sparkSession
    keyed = rows.withColumns({"__kind": kind, "__draw": draw, "__bits": F.length(F.bin(draw))})
    counts = keyed.select("__kind", "__draw", "__bits").distinct().groupBy("__kind", "__bits").count().collect()
    n = most(len({r["__kind"] for r in counts}))
    cut, seen = {}, {}
    for r in sorted(counts, key=lambda r: r["__bits"]):
        k = r["__kind"]
        if seen.get(k, 0) < n:
            cut[k], seen[k] = r["__bits"], seen.get(k, 0) + r["count"]
    cuts = F.broadcast(spark.createDataFrame(sorted(cut.items()), "__k string, __cut int"))  # one row per kind
    near = keyed.join(cuts, (F.col("__kind") == F.col("__k")) & (F.col("__bits") <= F.col("__cut")))
    near = near.select(F.col("__kind").alias("kind"), F.col("__draw").alias("draw"), *out).dropDuplicates(["kind", "draw"])
    place = F.row_number().over(Window.partitionBy("kind").orderBy("draw"))
    return near.withColumn("__place", place).where(F.col("__place") <= n).drop("__place")


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def range_marks(df: DataFrame, id_col: str, n: int) -> np.ndarray:
    """At most n - 1 ids that cut the table into about equal ranges (quantiles; only the id is read)."""
    if n < 2:
        return np.zeros(0, np.int64)
    got = df.agg(F.percentile_approx(F.col(id_col).cast("long"), [i / n for i in range(1, n)], 20 * n)).first()[0]
    return np.unique(np.array(got or [], np.int64))


def ranges_of(id_col: Column, marks: np.ndarray) -> Column:
    """Range of an id, ascending from 1; a null id is in range 0."""

    @F.pandas_udf("int")
    def place(ids: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in ids:
            at = np.searchsorted(marks, s.fillna(0).to_numpy(np.int64), "left") + 1
            yield pd.Series(np.where(s.isna(), 0, at).astype(np.int32))

    return place(id_col.cast("long"))


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the row offsets into them, without Python strings.

    Null rows are empty.
    """
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    kind = np.int64 if wide else np.int32
    if off is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    offsets = np.frombuffer(off, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    if len(offsets) == 0:
        offsets = np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def joined_bytes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The same two arrays for a list of byte strings."""
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    return np.frombuffer(b"".join(texts), np.uint8), offsets


def batch_of(schema: pa.Schema, **cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) for f in schema], schema=schema)
