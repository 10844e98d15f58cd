"""Operator 3, document fingerprints: bottom-k sketches of word-shingle hashes.

A sketch holds the k smallest distinct hashes of a text's shingles. Sketches of parts merge into the
sketch of the whole, and two sketches estimate resemblance, containment and the number of
distinct shingles. Words and shingles are hashed for whole Arrow batches at once in numpy.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filingflow.llm.common import joined_bytes, others, range_marks, ranges_of, shuffle_partitions, text_buffers

K = 128
SHINGLE = 5  # words
WIDTH = 6  # bytes of a hash
CHUNK = 4 << 20  # bytes hashed at a time, at least one text

_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)  # odd, so that its powers have inverses


def mix(x: np.ndarray) -> np.ndarray:
    """Every bit of each word spread over all."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64))
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]  # case does not count
_BACK = np.uint64(pow(int(_STEP), -1, 1 << 64))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word (run of anything but ASCII white space) and the number of words of each text."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    word = ~_WHITE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(word & (edge[:-1] | np.r_[True, ~word[:-1]]))
    ends = np.flatnonzero(word & (edge[1:] | np.r_[~word[1:], True])) + 1
    power = np.cumprod(np.full(n, _STEP))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * power, out=total[1:])
    shift = np.cumprod(np.full(n, _BACK))[starts]  # the sum starts at its first byte, wherever that is
    hashes = mix((total[ends] - total[starts]) * shift + (ends - starts).astype(np.uint64))
    counts = np.diff(np.searchsorted(starts, offsets))
    return hashes, counts


def shingle_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """One hash for each run of ``length`` words."""
    h = np.full(max(0, len(words) - length + 1), np.uint64(length), np.uint64)
    for i in range(length if len(h) else 0):
        h = mix(h * _STEP + words[i : i + len(h)])
    return h >> np.uint64(64 - 8 * WIDTH)


def sketches(data: np.ndarray, offsets: np.ndarray, k: int = K, shingle: int = SHINGLE) -> list[np.ndarray]:
    """The k smallest distinct shingle hashes of each text, ascending. Fewer words than a shingle are one
    shingle; no words, an empty sketch."""
    out, first = [], 0
    while first < len(offsets) - 1:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK, "right")) - 1)
        off = offsets[first : last + 1]
        words, counts = word_hashes(data[off[0] : off[-1]], off - off[0])
        whole = shingle_hashes(words, shingle)
        at = 0
        for c in counts.tolist():
            if c >= shingle:
                out.append(bottom(whole[at : at + c - shingle + 1], k))
            else:
                out.append(shingle_hashes(words[at : at + c], c) if c else np.zeros(0, np.uint64))
            at += c
        first = last
    return out


def bottom(hashes: np.ndarray, k: int) -> np.ndarray:
    if len(hashes) > 8 * k:  # most are too large to be among the k smallest distinct ones
        few = hashes[hashes <= np.partition(hashes, 4 * k)[4 * k]]
        least = np.unique(few)
        if len(least) >= k:
            return least[:k]
    return np.unique(hashes)[:k]


# ------------------------------------------------------------------------------------- estimates


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """Sketch of the union of two parts."""
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of shingles that both have among those that either has (both empty: 1)."""
    both = np.sort(np.concatenate([a, b]))
    twice = both[:-1] == both[1:]
    if not len(both):
        return 1.0
    union = len(both) - int(twice.sum())
    if union <= k:
        return int(twice.sum()) / union
    first = np.r_[True, ~twice]
    limit = both[np.flatnonzero(first)[k - 1]]
    return int((twice & (both[:-1] <= limit)).sum()) / k


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles (exact below k)."""
    return float(len(a)) if len(a) < k else (k - 1) / ((float(a[k - 1]) + 1) / float(1 << (8 * WIDTH)))


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of the first text's shingles that the second has (empty first: 1)."""
    if not len(a):
        return 1.0
    shared = resemblance(a, b, k) * distinct(merge(a, b, k), k)
    return min(1.0, shared / distinct(a, k))


def to_text(a: np.ndarray) -> str:
    return base64.b64encode(a.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - WIDTH :].tobytes()).decode()


def from_text(s: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(s), np.uint8).reshape(-1, WIDTH)
    return np.pad(raw, ((0, 0), (8 - WIDTH, 0))).copy().view(">u8").ravel().astype(np.uint64)


# -------------------------------------------------------------------------------------- operator


def with_sketch(docs: DataFrame, k: int = K, shingle: int = SHINGLE, text_col: str = "text") -> DataFrame:
    """``docs`` with ``sketch`` (array of bigint, ascending); a column of this name is replaced. Null and blank texts
    have empty sketches."""

    @F.pandas_udf("array<bigint>")
    def sketch(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            data, off = joined_bytes([t.encode() for t in s.fillna("")])
            yield pd.Series([x.astype(np.int64) for x in sketches(data, off, k, shingle)])

    return docs.select(*others(docs, ["sketch"]), sketch(F.col(text_col)).alias("sketch"))


def merge_sketches(parts: DataFrame, by: list[str], k: int = K) -> DataFrame:
    """(``by``, ``sketch``): the sketches of all parts of a group merged. Hashes are made distinct before they move and cut to
    the k smallest in every task, so a group of any number of parts stays small. Groups whose parts are
    all empty have an empty sketch."""
    values = parts.select(*by, F.explode("sketch").alias("__h")).distinct()
    least = Window.partitionBy(*by).orderBy("__h")
    kept = values.withColumn("__n", F.row_number().over(least)).where(F.col("__n") <= k)
    merged = kept.groupBy(*by).agg(F.sort_array(F.collect_list("__h")).alias("sketch"))
    keys = parts.select(*by).distinct()
    match = [keys[c].eqNullSafe(merged[c]) for c in by]
    empty = F.array().cast("array<bigint>")
    return keys.join(merged, match, "left").select(*[keys[c] for c in by], F.coalesce(merged["sketch"], empty).alias("sketch"))


# ---------------------------------------------------------------------------- neighbours in order


def deal_in_order(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows dealt by ranges of descending id, each range sorted and followed by the first row of the next
    (``__tail``), the last by the very first. The text moves once.

    Bounds are quantiles of the ids. Null ids form the last range. Only the ranges' first ids (one for
    each) reach the driver.
    """
    n = shuffle_partitions(docs.sparkSession)
    marks = range_marks(docs, id_col, n)

    def falling(c: Column) -> Column:  # the first range has the largest ids, the last the null ones
        return F.lit(len(marks) + 1) - ranges_of(c, marks)

    ids = docs.select(F.col(id_col).alias("id"))
    firsts = ids.groupBy(falling(F.col("id")).alias("r")).agg(F.max("id").alias("id")).orderBy("r").collect()
    before = {r["r"]: (firsts[i - 1]["r"], r["id"]) for i, r in enumerate(firsts)}
    here = F.col("__range")
    cases = [F.lit(x) for r, (prev, top) in before.items() for x in (r, F.struct(F.lit(prev).alias("to"), F.lit(top).cast("long").alias("id")))]
    head = F.element_at(F.create_map(*cases), here) if cases else F.lit(None).cast("struct<to:int,id:bigint>")
    own = F.struct(here.alias("to"), F.lit(False).alias("tail"))
    copy = F.struct(head["to"].alias("to"), F.lit(True).alias("tail"))
    rows = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"), falling(F.col(id_col)).alias("__range"))
    rows = rows.withColumn("__to", F.explode(F.when(F.col("__id").eqNullSafe(head["id"]), F.array(own, copy)).otherwise(F.array(own))))
    rows = rows.select(F.col("__to.to").alias("__range"), F.col("__to.tail").alias("__tail"), "__id", "__text")
    return rows.repartitionById(n, F.col("__range") % n).sortWithinPartitions("__range", "__tail", F.desc_nulls_last("__id"), F.xxhash64("__text"))


def edit_likeness(docs: DataFrame, k: int = K, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: its fingerprint, that of its edited text (the last third of its code points
    replaced by the first as many of the next document), and the likeness to both.

    Next is the next smaller id; the first follows the last; rows with the same id follow each other by
    text hash; null ids come last. Null texts are empty; a single document is its own next. An empty
    table gives an empty table.
    """
    schema = (
        docs.select(F.col(id_col).cast("long").alias("doc_id"))
        .withColumns({"n_chars": F.lit(0).cast("long"), "edited_sha256": F.lit(""), "fingerprint": F.lit(""), "edited_fingerprint": F.lit("")})
        .withColumns({"near_edited": F.lit(0.0), "near_next": F.lit(0.0), "n_distinct": F.lit(0.0)})
        .schema
    )
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # (tail, id, text, sketch) of the row before
        for b in batches:
            data, off = text_buffers(b.column(3))
            tails, ids, texts = b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()
            rows = list(zip(tails, ids, texts, sketches(data, off, k, shingle)))
            pairs = [(x, y) for x, y in zip([last, *rows[:-1]] if last else rows[:-1], rows if last else rows[1:]) if not x[0]]
            last = rows[-1] if rows else last
            edited = []
            for (_, _, text, _), (_, _, after, _) in pairs:
                third = len(text) // 3
                edited.append((text[: len(text) - third] + after[:third]).encode())
            other = sketches(*joined_bytes(edited), k, shingle)
            out = [
                (x[1], len(x[2]), hashlib.sha256(raw).hexdigest(), to_text(x[3]), to_text(e), resemblance(x[3], e, k), resemblance(x[3], y[3], k), distinct(x[3], k))
                for (x, y), raw, e in zip(pairs, edited, other)
            ]
            if out:
                cols = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 3))]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return deal_in_order(docs, id_col, text_col).mapInArrow(run, schema)
