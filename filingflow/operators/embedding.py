"""Dense embeddings by a distributed randomised SVD of the TF-IDF matrix.

Rows are texts, columns are hashed terms, weights are tf * idf with rows of length one. A random basis Ω of a few more columns
than wanted is drawn from a seed; one pass over the texts gives B = Aᵀ(AΩ), whose QR factor Q spans nearly the row space, a
second pass gives AᵀAQ, and so Q and the small matrix QᵀAᵀAQ give the right singular vectors. A text's embedding is its
row times these vectors, scaled to length one.

Each task adds up its texts in one (terms x columns) array and returns its rows; they are summed in Spark. What the driver
holds (term frequencies, Q, the small matrix) is bounded by the number of terms, not by the texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filingflow.operators.common import cut_lineage

SLICE = 1 << 16  # weights added up at a time
PIECE = 1 << 12  # of those, multiplied at a time: few enough to stay in a core's cache


@dataclass(frozen=True)
class Svd:
    terms: int = 1 << 14  # hashed terms
    dims: int = 64  # of an embedding
    extra: int = 8  # more columns while the basis is sought
    seed: int = 7


def term_numbers(text: Column, terms: int) -> Column:
    """Hashed number of every word of a text (letters and digits, lower case), in order; null and wordless texts have none."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 0)
    return F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(terms)).cast("int"))


class Rows:
    """TF-IDF rows of a batch: row, term and weight of every entry that is not zero."""

    def __init__(self, lists: pa.Array, idf: np.ndarray):
        if isinstance(lists, pa.ChunkedArray):
            lists = lists.combine_chunks()
        self.n, m = len(lists), len(idf)
        size = np.diff(lists.offsets.to_numpy()) if self.n else np.zeros(0, np.int64)
        entry = np.repeat(np.arange(self.n, dtype=np.int64), size) * m + lists.flatten().to_numpy(zero_copy_only=False)
        key, times = np.unique(entry, return_counts=True)
        self.row, self.term = key // m, key % m
        w = times * idf[self.term]
        norm = np.sqrt(np.bincount(self.row, w * w, self.n))[self.row]
        self.weight = np.divide(w, norm, out=np.zeros(len(w)), where=norm > 0)

    def times(self, basis: np.ndarray) -> np.ndarray:
        """The rows times ``basis``."""
        out = np.zeros((self.n, basis.shape[1]))
        self._add(out, self.row, self.term, self.weight, basis)
        return out

    def add_back(self, total: np.ndarray, product: np.ndarray) -> None:
        """Adds the transposed rows times ``product`` to ``total``."""
        o = np.argsort(self.term, kind="stable")
        self._add(total, self.term[o], self.row[o], self.weight[o], product)

    @staticmethod
    def _add(out: np.ndarray, to: np.ndarray, source: np.ndarray, weight: np.ndarray, basis: np.ndarray) -> None:
        for begin in range(0, len(to), SLICE):
            end = min(begin + SLICE, len(to))
            first = begin + np.flatnonzero(np.r_[True, to[begin + 1 : end] != to[begin : end - 1]])
            at = 0
            while at < len(first):  # a row's part of the slice is one sum, however the slice is cut
                stop = max(at + 1, int(np.searchsorted(first, first[at] + PIECE)))
                some = slice(first[at], first[stop] if stop < len(first) else end)
                out[to[first[at:stop]]] += np.add.reduceat(weight[some, None] * basis[source[some]], first[at:stop] - first[at], axis=0)
                at = stop


def _gram_times(texts: DataFrame, idf: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """AᵀA times ``basis``: one pass over ``texts`` (``terms``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(basis.shape)
        for b in batches:
            rows = Rows(b.column(0), idf)
            rows.add_back(total, rows.times(basis))
        used = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(list(total[used]), pa.list_(pa.float64()))], names=["term", "row"])

    parts = texts.mapInArrow(run, "term int, row array<double>")
    summed = parts.groupBy("term").agg(Summarizer.sum(array_to_vector("row")).alias("s")).select("term", vector_to_array("s").alias("s"))
    out = np.zeros(basis.shape)
    for r in summed.collect():  # at most one row for each hashed term
        out[r["term"]] = r["s"]
    return out


def fit(texts: DataFrame, how: Svd = Svd()) -> tuple[np.ndarray, np.ndarray]:
    """(idf, singular vectors) of a table with ``terms`` (see ``term_numbers``), which is read three times."""
    df = texts.where(F.size("terms") > 0)
    n = df.count()
    idf = np.zeros(how.terms)
    for r in df.select(F.explode(F.array_distinct("terms")).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect():
        idf[r["t"]] = np.log((n + 1) / (r["n"] + 1))
    wide = min(how.dims + how.extra, how.terms)
    start = np.random.default_rng(how.seed).normal(size=(how.terms, wide))
    basis = np.linalg.qr(_gram_times(df, idf, start))[0]
    value, vector = np.linalg.eigh(basis.T @ _gram_times(df, idf, basis))
    best = basis @ vector[:, np.argsort(-value)[: how.dims]]
    sign = np.sign(best[np.abs(best).argmax(axis=0), np.arange(best.shape[1])])
    return idf, best * np.where(sign == 0, 1, sign)


def embed_texts(texts: DataFrame, text_col: str = "chunk", how: Svd = Svd()) -> DataFrame:
    """``texts`` with ``vec`` ARRAY<DOUBLE> of length one (of length zero for texts without words, and where every word is
    in every text). Fitting runs three jobs while the frame is built; only term numbers go to Python."""
    numbered = cut_lineage(texts.withColumn("__terms", term_numbers(F.col(text_col), how.terms)), "term-numbers")
    idf, vectors = fit(numbered.select(F.col("__terms").alias("terms")), how)

    @F.arrow_udf("array<double>")
    def project(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            y = Rows(lists, idf).times(vectors)
            norm = np.sqrt((y * y).sum(axis=1, keepdims=True))
            yield pa.array(list(np.divide(y, norm, out=np.zeros_like(y), where=norm > 1e-12)), pa.list_(pa.float64()))

    return numbered.withColumn("vec", project("__terms")).drop("__terms")
