"""Operator 12, hard negatives by an inverted multi-index.

1. Two codebooks, one for each half of the vectors, are fitted on a bounded sample; every row is in the cell of its two
   nearest codewords. Cells keep their size and the largest distance of a member from the codeword in each half.
2. For each anchor, half scores (codeword times anchor, plus the anchor's length times the codeword's radius) are sorted, and
   a heap visits pairs of them by descending sum: an upper bound of every score in the cell. The sample's own rows already
   give k scores inside a window; the heap stops at the first bound below the k-th of them, so that no row
   of a cell that was not visited can be among the first k: the window is certified.
3. Cells are packed into blocks of rows (a large cell is cut into several), anchors into blocks of neighbouring anchors. A
   task scores one block of rows against the anchors of one block that visit it, and keeps the first k of each window.
   The parts meet in a salted top-k.

Positives are one such search (one window, same label), negatives the next (one window for each positive, other
labels). Scores are exact integers. Nothing but the sample, the codebooks and one row for each cell reaches the driver.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filingflow.llm.common import written
from filingflow.operators.common import top_k

LIMIT = float(1 << 53)  # integers up to here are exact doubles; components are held within it
INT64 = 1 << 63


@dataclass(frozen=True)
class Index:
    """Sizes of the index; results are the same for all of them."""

    codewords: int = 16  # of each half, so at most 256 cells
    sample: int = 4096  # rows that the codebooks are fitted on and that certify first windows
    rounds: int = 12  # of k-means
    block_rows: int = 8192
    block_anchors: int = 512
    seed: int = 7


def integers(vectors: pa.Array, width: int = 0) -> np.ndarray:
    """floor(256 x) of every component, as doubles (rows, at least ``width``); shorter vectors end in zeros."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    size = np.diff(vectors.offsets.to_numpy()).astype(np.int64) if len(vectors) else np.zeros(0, np.int64)
    wide = max(width, int(size.max(initial=0)))
    flat = np.asarray(vectors.flatten(), np.float64)
    with np.errstate(over="ignore"):
        flat = np.clip(np.floor(256 * flat), -LIMIT, LIMIT)
    if len(size) and (size == wide).all():
        return flat.reshape(len(size), wide)
    out = np.zeros((len(size), wide))
    out[np.arange(wide) < size[:, None]] = flat
    return out


def exact_scores(rows: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Inner products (rows, anchors), exact: doubles while all partial sums are, big integers otherwise (held within 64 bits)."""
    wide = max(rows.shape[1], anchors.shape[1])
    rows, anchors = (np.pad(x, ((0, 0), (0, wide - x.shape[1]))) for x in (rows, anchors))
    if np.abs(rows).max(initial=0) * np.abs(anchors).max(initial=0) * max(wide, 1) < LIMIT:
        return (rows @ anchors.T).astype(np.int64)
    big = [[int(x) for x in r] for r in rows.tolist()], [[int(x) for x in r] for r in anchors.tolist()]
    sums = [[max(-INT64, min(INT64 - 1, sum(x * y for x, y in zip(r, a)))) for a in big[1]] for r in big[0]]
    return np.array(sums, np.int64).reshape(len(rows), len(anchors))


def codebook(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Lloyd's k-means on at most ``k`` different rows drawn by the seed."""
    some = np.unique(x, axis=0)
    if not len(some):
        return np.zeros((1, x.shape[1]))
    c = some[np.sort(np.random.default_rng(seed).permutation(len(some))[:k])].astype(np.float64)
    for _ in range(rounds):
        near = nearest(x, c)[0]
        for j in range(len(c)):
            if (near == j).any():
                c[j] = x[near == j].mean(axis=0)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest codeword of every row and the distance to it; whichever is shorter ends in zeros."""
    wide = max(x.shape[1], c.shape[1])
    x, c = (np.pad(v, ((0, 0), (0, wide - v.shape[1]))) for v in (x, c))
    near = ((c * c).sum(axis=1) - 2 * (x @ c.T)).argmin(axis=1) if len(x) else np.zeros(0, np.int64)
    return near, np.sqrt(((x - c[near]) ** 2).sum(axis=1))


class Codebooks:
    """The fitted halves, the sample, and (once rows are counted) the cells."""

    def __init__(self, sample: pa.Table, how: Index):
        self.ids = np.array([-1 if v is None else v for v in sample["id"].to_pylist()], np.int64)
        self.known = np.array([v is not None for v in sample["id"].to_pylist()], bool)
        self.labels = sample["label"].to_numpy()
        self.rows = integers(sample["vec"])
        self.cut = self.rows.shape[1] // 2
        self.books = [codebook(self.rows[:, part], how.codewords, how.rounds, how.seed) for part in (slice(0, self.cut), slice(self.cut, None))]

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x[:, : self.cut], x[:, self.cut :]

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cell number and the two distances of every row."""
        (a, ra), (b, rb) = (nearest(h, c) for h, c in zip(self.halves(x), self.books))
        return a * len(self.books[1]) + b, ra, rb

    def fill(self, cells: list, block_rows: int) -> None:
        """Takes (cell, rows, largest distances) of every cell that has rows, and packs neighbouring cells into blocks."""
        n1, n2 = (len(b) for b in self.books)
        self.radius = np.full((2, n1 * n2), -np.inf)
        self.blocks = pack([(r["cell"], r["n"]) for r in cells], block_rows)
        for r in cells:
            self.radius[:, r["cell"]] = r["r1"], r["r2"]
        grid = self.radius.reshape(2, n1, n2)
        self.reach = grid[0].max(axis=1, initial=-np.inf), grid[1].max(axis=0, initial=-np.inf)  # of a codeword in all its cells

    def visit(self, anchor: np.ndarray, stop: float, most: float) -> list[int]:
        """Cells that may hold a score in [``stop``, ``most``], by descending bound."""
        parts = self.halves(anchor[None])
        dots, norms = [], []
        for h, c in zip(parts, self.books):
            wide = min(h.shape[1], c.shape[1])
            dots.append(c[:, :wide] @ h[0, :wide])
            norms.append(float(np.sqrt((h * h).sum())))
        slack = 1e-9 * (1 + sum(float(np.abs(d).max(initial=0)) for d in dots) + sum(n * float(r[np.isfinite(r)].max(initial=0)) for n, r in zip(norms, self.reach)))
        tops = [np.where(np.isfinite(r), d + n * r, -np.inf) for d, n, r in zip(dots, norms, self.reach)]
        order = [np.argsort(-t, kind="stable").tolist() for t in tops]
        tops = [t[o].tolist() for t, o in zip(tops, order)]
        n1, n2, out = len(tops[0]), len(tops[1]), []
        heap, seen = [(-(tops[0][0] + tops[1][0]), 0, 0)], {(0, 0)}
        while heap:
            bound, i, j = heapq.heappop(heap)
            if -bound + slack < stop or bound == np.inf:
                break  # certified: no later cell has a score of ``stop``
            cell = order[0][i] * n2 + order[1][j]
            if cell in self.blocks:
                r1, r2 = self.radius[:, cell]
                mid, far = dots[0][order[0][i]] + dots[1][order[1][j]], norms[0] * r1 + norms[1] * r2
                if mid + far + slack >= stop and mid - far - slack <= most:
                    out.append(cell)
            for step in ((i + 1, j), (i, j + 1)):
                if step[0] < n1 and step[1] < n2 and step not in seen:
                    seen.add(step)
                    heapq.heappush(heap, (-(tops[0][step[0]] + tops[1][step[1]]), *step))
        return out


def pack(sizes: list[tuple[int, int]], most: int) -> dict[int, tuple[int, int]]:
    """cell -> (first block, blocks): neighbouring cells share a block of about ``most`` rows, larger cells have several."""
    out, block, room = {}, -1, 0
    for cell, n in sorted(sizes):
        if n > most:
            parts = -(-n // most)
            out[cell], block, room = (block + 1, parts), block + parts, 0
            continue
        if n > room:
            block, room = block + 1, most
        out[cell], room = (block, 1), room - n
    return out


def block_of(df: DataFrame, blocks: dict[int, tuple[int, int]], out: str) -> DataFrame:
    """``df`` with the block of its ``cell``; rows of a large cell are dealt by ``at``. One row for each cell is broadcast."""
    table = df.sparkSession.createDataFrame([(c, f, n) for c, (f, n) in blocks.items()], "cell int, __first long, __n long")
    spread = F.col("__first") + F.pmod(F.col("at"), F.col("__n"))
    return df.join(F.broadcast(table), "cell").withColumn(out, spread).drop("__first", "__n")


def _requests(index: Codebooks, same: bool, k: int, low: int, high: int):
    """Anchors with their windows -> what each asks of the blocks: cells, lower and upper ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = integers(b.column("vec"), index.rows.shape[1])
            ids, labels = b.column("id").to_pylist(), b.column("label").to_pylist()
            wins = b.column("scores").to_pylist()
            lows, highs, asked = [], [], []
            for at in range(0, len(x), 256):
                near = exact_scores(index.rows, x[at : at + 256])
                for j in range(near.shape[1]):
                    i, s = at + j, near[:, j]
                    fit = ((index.labels == labels[i]) if same else (index.labels != labels[i])) & ~(index.known & (index.ids == ids[i]))
                    ends = [(-(-low * p // 100), high * p // 100) for p in wins[i]] if not same else [(-INT64, INT64 - 1)]
                    stops = []
                    for lo, hi in ends:
                        inside = np.sort(s[fit & (s >= lo) & (s <= hi)])[::-1]
                        if lo <= hi:
                            stops.append(float(inside[k - 1]) if len(inside) >= k else float(lo))
                    cells = index.visit(x[i], min(stops), max(float(hi) for _, hi in ends)) if stops else []
                    by_block: dict[tuple[int, int], list[int]] = {}
                    for c in cells:
                        by_block.setdefault(index.blocks[c], []).append(c)
                    asked.append([{"first": f, "n": n, "cells": cs} for (f, n), cs in by_block.items()])
                    lows.append([lo for lo, _ in ends])
                    highs.append([hi for _, hi in ends])
            kind = pa.list_(pa.struct([("first", pa.int64()), ("n", pa.int64()), ("cells", pa.list_(pa.int32()))]))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column("aid"), b.column("id"), b.column("label"), b.column("vec"), b.column("ab"), pa.array(lows, longs), pa.array(highs, longs), pa.array(asked, kind)],
                names=["aid", "id", "label", "vec", "ab", "lo", "hi", "asked"],
            )

    return run


def _score(same: bool, k: int):
    """One block of rows against the anchors of one block: the first ``k`` rows of every window."""

    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out: dict[str, list] = {n: [] for n in ("aid", "win", "id", "score")}
        ids = np.array([INT64 - 1 if v is None else v for v in rows["id"].to_pylist()], np.int64)
        known = np.array([v is not None for v in rows["id"].to_pylist()], bool)
        order = np.lexsort((ids, ~known))  # by id, so that a stable sort by score breaks ties
        ids, known = ids[order], known[order]
        labels, cells = rows["label"].to_numpy()[order], rows["cell"].to_numpy()[order]
        r, a = integers(rows["vec"])[order], integers(anchors["vec"])
        who = list(zip(*(anchors[c].to_pylist() for c in ("aid", "id", "label", "lo", "hi", "cells"))))
        for at in range(0, len(who), 64):
            scores = exact_scores(r, a[at : at + 64])
            for j, (aid, own, label, los, his, asked) in enumerate(who[at : at + 64]):
                s = scores[:, j]
                fit = np.isin(cells, asked) & ((labels == label) if same else (labels != label)) & ~(known & (ids == own))
                for win, (lo, hi) in enumerate(zip(los, his)):
                    hit = np.flatnonzero(fit & (s >= lo) & (s <= hi))
                    if len(hit) > 4 * k:  # no row below the k-th score can stay
                        hit = hit[s[hit] >= np.partition(s[hit], len(hit) - k)[len(hit) - k]]
                    hit = hit[np.argsort(-s[hit], kind="stable")[:k]]
                    out["aid"] += [aid] * len(hit)
                    out["win"] += [win] * len(hit)
                    out["id"] += [i if ok else None for i, ok in zip(ids[hit].tolist(), known[hit].tolist())]
                    out["score"] += s[hit].tolist()
        return pa.table({"aid": pa.array(out["aid"], pa.int64()), "win": pa.array(out["win"], pa.int32()), "id": pa.array(out["id"], pa.int64()), "score": pa.array(out["score"], pa.int64())})

    return run


def search(rows: DataFrame, anchors: DataFrame, index: Codebooks, same: bool, k: int, low: int = 0, high: int = 0) -> DataFrame:
    """(``aid``, ``win``, ``id``, ``score``, ``rn``): the first ``k`` rows of each window of each anchor.

    ``rows``: id, label, vec, cell, block; ``anchors``: aid, id, label, vec, ab, scores (of the positives, one window each).
    """
    width = "aid long, id long, label long, vec array<{0}>, ab long, lo array<long>, hi array<long>, asked array<struct<first:long,n:long,cells:array<int>>>"
    kind = rows.schema["vec"].dataType.elementType.simpleString()
    asked = anchors.select("aid", "id", "label", "vec", "ab", "scores").mapInArrow(_requests(index, same, k, low, high), width.format(kind))
    asked = asked.withColumn("a", F.explode("asked")).withColumn("block", F.explode(F.sequence(F.col("a.first"), F.col("a.first") + F.col("a.n") - 1)))
    asked = written(asked.select("block", "ab", "aid", "id", "label", "vec", "lo", "hi", F.col("a.cells").alias("cells")), "anchor-visits")
    units = written(asked.select("block", "ab").distinct(), "visited-blocks")
    fed = rows.join(units, "block").select("block", "ab", "id", "label", "vec", "cell")
    got = asked.groupBy("block", "ab").cogroup(fed.groupBy("block", "ab")).applyInArrow(_score(same, k), "aid long, win int, id long, score long")
    order = [F.desc("score"), F.asc_nulls_last("id")]
    return top_k(got, ["aid", "win"], order, F.lit(k), F.struct("score", "id"), salts=16)


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, how: Index = Index(),
    id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding",
) -> DataFrame:
    """(``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``).

    A row's score is the inner product of floor(256 x) with the anchor's. For each anchor (a row with an id for which
    ``is_anchor`` holds) the first ``positives`` other rows of its label are its positives, and for each of them the first
    ``negatives`` rows of other labels whose score lies between ``low`` and ``high`` per cent of the positive's are
    returned, higher scores first, ties by smaller id (null ids last). All of them, if there are fewer.

    Labels are integers. Rows with a null label, a null vector or a null or non-finite component take no part.
    Vectors of different lengths meet as if the shorter ended in zeros; an empty vector scores 0. Rows that share
    the anchor's id are not other rows; anchors equal in id, label and vector count once, other repeated rows each count.
    Components beyond 2**53 count as that bound, scores beyond 64 bits as theirs. An empty table gives an empty table.
    """
    vec, spark = F.col(vec_col), vectors.sparkSession
    whole = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = vectors.where(F.col(label_col).isNotNull() & vec.isNotNull() & F.coalesce(whole, F.lit(False)))
    base = usable.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), vec.alias("vec"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    draw = F.xxhash64("id", "label", "vec", F.monotonically_increasing_id())
    index = Codebooks(base.select("id", "label", "vec", draw.alias("draw")).orderBy("draw").limit(how.sample).drop("draw").toArrow(), how)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell, r1, r2 = index.place(integers(b.column("vec"), index.rows.shape[1]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32()), pa.array(r1), pa.array(r2)], names=[*b.schema.names, "cell", "r1", "r2"])

    dealt = base.withColumn("at", F.monotonically_increasing_id())
    schema = dealt.withColumns({"cell": F.lit(0), "r1": F.lit(0.0), "r2": F.lit(0.0)}).schema
    placed = written(dealt.mapInArrow(place, schema), "vector-cells")
    index.fill(placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("r1").alias("r1"), F.max("r2").alias("r2")).collect(), how.block_rows)
    rows = block_of(placed.select("id", "label", "vec", "cell", "at"), index.blocks, "block")

    chosen = placed.where(F.col("anchor") & F.col("id").isNotNull()).select("id", "label", "vec", "cell").distinct()
    chosen = written(chosen.withColumn("at", F.monotonically_increasing_id()), "anchors")
    counted = chosen.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()
    chosen = block_of(chosen, pack([(r["cell"], r["n"]) for r in counted], how.block_anchors), "ab").withColumnRenamed("at", "aid")

    near = search(rows, chosen.withColumn("scores", F.array().cast("array<long>")), index, same=True, k=positives)
    near = written(near.select("aid", (F.col("rn") - 1).alias("win"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    windows = near.groupBy("aid").agg(F.transform(F.sort_array(F.collect_list(F.struct("win", "positive_score"))), lambda w: w["positive_score"]).alias("scores"))
    hard = search(rows, chosen.join(windows, "aid"), index, same=False, k=negatives, low=low, high=high)
    named = near.join(chosen.select("aid", F.col("id").alias("anchor_id")), "aid")
    out = hard.join(named, ["aid", "win"])
    return out.select("anchor_id", "positive_id", F.col("rn").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
