"""Operator 10, sharding by jump consistent hashing.

A key's shard follows from its 64-bit hash and the number of shards alone: no ring, no table, and
shards that are appended take only the keys that move into them. The jumps run in numpy over
Arrow batches; slots are numbered block by block of a written table, so that a shard or a key
with most of the rows is never in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filingflow.llm.common import others, written

BLOCK_ROWS = 1 << 16


def jump_hash(keys: np.ndarray, n: int) -> np.ndarray:
    """Shard (0 to n-1) of each unsigned 64-bit key. All keys jump together until the last lands."""
    key = keys.astype(np.uint64)
    shard = np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    nxt = np.zeros(len(key), np.int64)
    while len(live):
        shard[live] = nxt[live]
        key[live] = key[live] * np.uint64(2862933555777941757) + np.uint64(1)
        step = (key[live] >> np.uint64(33)).astype(np.float64) + 1.0
        nxt[live] = ((shard[live] + 1) * (float(1 << 31) / step)).astype(np.int64)
        live = live[nxt[live] < n]
    return shard.astype(np.int32)


def shard_of(key: Column, n: int) -> Column:
    """Shard of a key column of any type (null is a key too), for ``n`` shards."""
    if n < 1:
        raise ValueError("at least one shard")

    @F.pandas_udf("int")
    def jump(hashes: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for h in hashes:
            yield pd.Series(jump_hash(h.to_numpy(np.int64).view(np.uint64), n))

    return jump(F.xxhash64(key))


def number_slots(rows: DataFrame, group: str = "shard") -> DataFrame:
    """``slot``: 0, 1, 2, ... without gaps inside each ``group``, in the order the rows are stored.

    ``rows`` must be a table read from files. Rows are counted per block of 65,536 stored rows, block
    offsets are prefix sums, and numbering happens inside a block: no task sees a whole group.
    """
    new = [*others(rows, ["slot"])]
    at = rows.select(
        *new,
        F.col("_metadata.file_name").alias("__file"),
        F.col("_metadata.row_index").alias("__row"),
        F.floor(F.col("_metadata.row_index") / BLOCK_ROWS).alias("__block"),
    )
    place = [group, "__file", "__block"]
    before = Window.partitionBy(group).orderBy("__file", "__block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = at.groupBy(*place).agg(F.count(F.lit(1)).alias("__n"))
    offsets = offsets.select(*place, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    inside = F.row_number().over(Window.partitionBy(*place).orderBy("__row")) - 1
    return at.join(offsets, place).select(*new, (F.col("__offset") + inside).cast("long").alias("slot"))


def shard_documents(docs: DataFrame, n: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``size`` (UTF-8 bytes + 1; null text: 1), ``text_crc32`` (null text: 0), ``law``,
    ``shard``, ``slot``, ``grown_shard`` (the shard if one more were appended).

    Equal ids share a shard; null is one id. Repeated rows get slots of their own. An empty table
    gives an empty table.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(F.col(id_col), n).alias("shard"),
        shard_of(F.col(id_col), n + 1).alias("grown_shard"),
    )
    return number_slots(written(rows, "shards"))
