"""Operator 13, periodic runs: stretches of words that repeat with a period, found by seeds on diagonals.

A run of period q and length at least max(L, 2q) matches itself at lag q over at least max(L - q, q) words. So the lags
below L share k-grams of L/2 words, and the lags from k to 2k share k-grams of k words, for k = L, 2L, 4L ... Each
class of lags has its own index of k-grams (a gram of twice the length is a pair of grams), which holds only grams that
occur again in the same document. Pairs of occurrences are seeds; a table of the furthest word covered on each lag
skips the seeds of a stretch that was extended before. Inside a run of a short period, whose grams occur at
every period, only the first period's grams make pairs, and none with the same run: the others start nowhere.
Documents are read side by side, each followed by a word that matches no other.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filingflow.llm.common import fed_once, others, own_names, text_buffers

SLICE_BYTES = 2 << 20  # text read side by side; a longer text is read alone
ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """64 well mixed bits of each number."""
    x = (x.astype(np.uint64) + np.uint64(1)) * ODD
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _extend(w: np.ndarray, at: int, lag: int) -> tuple[int, int]:
    """The maximal stretch [s, e) around ``at`` whose words equal those ``lag`` further on; empty if ``at`` itself differs."""
    e, step, last = at, 64, len(w) - lag
    while e < last:
        m = min(step, last - e)
        differ = w[e : e + m] != w[e + lag : e + lag + m]
        t = int(differ.argmax())
        if differ[t]:
            e += t
            break
        e, step = e + m, min(step * 4, 1 << 20)
    s, step = at, 64
    while s > 0 and e > at:
        m = min(step, s)
        differ = (w[s - m : s] != w[s - m + lag : s + lag])[::-1]
        t = int(differ.argmax())
        if differ[t]:
            s -= t
            break
        s, step = s - m, min(step * 4, 1 << 20)
    return s, e


class _Runs:
    """Runs found so far, and the furthest-covered table."""

    def __init__(self, w: np.ndarray, least: int):
        self.w, self.least = w, least
        self.found: list[tuple[int, int, int]] = []  # start, end, period
        self.ends: set[tuple[int, int]] = set()
        self.covered: dict[int, int] = {}

    def seeds(self, lag: np.ndarray, at: np.ndarray) -> None:
        """Seeds in the order of lag, then place; neighbours on one diagonal are one."""
        first = np.r_[True, (lag[1:] != lag[:-1]) | (at[1:] != at[:-1] + 1)] if len(lag) else np.zeros(0, bool)
        for q, i in zip(lag[first].tolist(), at[first].tolist()):
            if i < self.covered.get(q, 0):
                continue
            s, e = _extend(self.w, i, q)
            self.covered[q] = max(e, i + 1)
            # a multiple of a smaller period has the same two ends as the run of that period, which was found before
            if e - s >= max(self.least - q, q) and (s, e + q) not in self.ends:
                self.ends.add((s, e + q))
                self.found.append((s, e + q, q))

    def short(self, k: int) -> list[tuple[int, int, int]]:
        return [r for r in self.found if 2 * r[2] <= k <= r[1] - r[0]]


def _recurring(gram: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the grams that occur more than once, and their places, by place."""
    _, number, times = np.unique(gram, return_inverse=True, return_counts=True)
    again = times[number] > 1
    return number[again], at[again]


def _pairs(gram: np.ndarray, at: np.ndarray, low: int, high: int, pick: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, second) places of equal grams with ``low <= second - first < high`` (negative bounds look back), for the
    ``pick``-ed places."""
    wide = np.int64(4 * n + 4)
    order = np.lexsort((at, gram))
    key = gram[order] * wide + at[order]
    mine = gram[pick] * wide + at[pick]
    a, b = np.searchsorted(key, mine + low), np.searchsorted(key, mine + high)
    size = b - a
    inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    return np.repeat(at[pick], size), at[order][np.repeat(a, size) + inside]


def find_runs(w: np.ndarray, doc: np.ndarray, least: int = 12) -> list[tuple[int, int, int]]:
    """(start, end, smallest period) of every maximal run of ``w`` of at least max(``least``, twice its period) words, by
    start, then period. ``doc`` numbers the texts; words between texts are unlike any other, with number -1."""
    n, k = len(w), (least + 1) // 2
    runs = _Runs(w, least)
    if n < 2 * k:
        return []
    word, gram = _mixed(w), np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        gram = gram * ODD + word[j : n - k + 1 + j]
    at = np.flatnonzero((doc[: n - k + 1] >= 0) & (doc[: n - k + 1] == doc[k - 1 :]))
    gram, at = _recurring(gram[at] ^ _mixed(doc[at] + np.int64(1 << 40)), at)
    table = np.full(n + 2 * k + 1, -1, np.int64)
    table[at] = gram
    for q in range(1, 2 * k):
        hit = at[table[at + q] == gram]
        runs.seeds(np.full(len(hit), q), hit)
    while len(at):
        # grams of twice the length: two neighbours that both occur again
        pair = table[np.minimum(at + k, n)]
        more = pair >= 0
        gram, at = _recurring(gram[more] * np.int64(n + 1) + pair[more], at[more])
        k *= 2
        table[:] = -1
        table[at] = gram
        short = runs.short(k)
        owner, inner = np.full(n + 1, -1, np.int64), np.zeros(n + 2, np.int32)
        for r, (s, e, p) in enumerate(short):
            owner[s : e - k + 1] = r
            if s + p <= e - k:
                inner[s + p] += 1
                inner[e - k + 1] -= 1
        starts = np.flatnonzero(np.cumsum(inner)[at] == 0)
        i1, j1 = _pairs(gram, at, k, 2 * k, starts, n)
        j2, i2 = _pairs(gram, at, 1 - 2 * k, 1 - k, starts, n)
        i, j = np.r_[i1, i2], np.r_[j1, j2]
        apart = (owner[i] < 0) | (owner[i] != owner[j])
        seed = np.unique((j - i)[apart] * np.int64(n + 1) + i[apart])
        runs.seeds(seed // (n + 1), seed % (n + 1))
    return sorted(runs.found, key=lambda r: (r[0], r[2]))


def _read_slice(texts: list[bytes], least: int) -> Iterator[tuple[list[tuple[int, int, int]], bytes]]:
    """(start, length, period) of every run and the text without its repetitions, for each text."""
    words = [t.split() for t in texts]
    size = np.array([len(x) for x in words])
    first = np.cumsum(size + 1) - (size + 1)  # one place after each text is its own
    w, doc = np.empty(int((size + 1).sum()), np.int64), np.repeat(np.arange(len(texts)), size + 1)
    ends = first + size
    inside = np.ones(len(w), bool)
    inside[ends] = False
    flat = np.empty(int(size.sum()), object)
    flat[:] = [x for ws in words for x in ws]
    w[inside] = pd.factorize(flat)[0]
    w[ends] = len(flat) + np.arange(len(texts))
    doc[ends] = -1
    of: dict[int, list] = {}
    for s, e, p in find_runs(w, doc, least):
        of.setdefault(int(doc[s]), []).append((s - int(first[doc[s]]), e - s, p))
    for d, ws in enumerate(words):
        runs = of.get(d, [])
        if runs:
            drop = np.zeros(len(ws) + 1, np.int64)
            for s, length, p in runs:
                drop[s + p] += 1
                drop[s + length] -= 1
            ws = compress(ws, (np.cumsum(drop[:-1]) == 0).tolist())
        yield runs, b" ".join(ws)


@own_names
def collapse_runs(docs: DataFrame, least: int = 12, text_col: str = "text") -> DataFrame:
    """``docs`` with ``runs`` (array of start, length, period in words, by start, then period) and ``collapsed``, the words that
    no run repeats, joined by one blank; columns of these names are replaced.

    A run is a stretch of words between ASCII white space that equals itself at its smallest period q, has at least
    max(``least``, 2q) words and can't be made longer. A word goes if a run contains it after that run's first q words. Null,
    empty and blank texts have no words: no runs and an empty text. Texts are read whole, whatever their length, each by
    itself; repeated rows get equal results, an empty table gives an empty table.
    """
    new = ["runs", "collapsed"]
    rest = others(docs, new)
    fed, at = fed_once(docs, rest, text_col)
    kind = "array<struct<start:bigint,length:bigint,period:bigint>>"
    schema = docs.select(*rest, F.lit(None).cast(kind).alias(new[0]), F.lit("").alias(new[1])).schema
    names = schema.names
    arrow = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = text_buffers(b.column(at))
            raw, edges = data.tobytes(), off.tolist()
            runs, kept, row = [], [], 0
            while row < b.num_rows:
                stop = max(row + 1, int(np.searchsorted(off, off[row] + SLICE_BYTES, "right")) - 1)
                for found, text in _read_slice([raw[s:e] for s, e in zip(edges[row:stop], edges[row + 1 : stop + 1])], least):
                    runs.append([{"start": s, "length": n, "period": p} for s, n, p in found])
                    kept.append(text)
                row = stop
            cols = [*b.columns[: len(rest)], pa.array(runs, arrow), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return fed.mapInArrow(run, schema)
