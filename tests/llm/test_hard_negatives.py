"""The inverted multi-index against scores of all rows."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from filingflow.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, is_anchor, positives=5, negatives=10, low=30, high=90):
    ok = [(i, [math.floor(256 * float(np.float32(x))) for x in v], c) for i, v, c in rows if c is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    order = lambda r: (-r[0], r[1] is None, r[1])
    out, done = [], set()
    for a, va, ca in ok:
        if a is None or not is_anchor(a) or (a, tuple(va), ca) in done:
            continue
        done.add((a, tuple(va), ca))
        scored = sorted(((sum(x * y for x, y in zip(va, v)), i, c) for i, v, c in ok if i != a), key=order)
        for ps, p, _ in [r for r in scored if r[2] == ca][:positives]:
            inside = [r for r in scored if r[2] != ca and low * ps <= 100 * r[0] <= high * ps][:negatives]
            out += [(a, p, k, n, ps, ns) for k, (ns, n, _) in enumerate(inside, 1)]
    return sorted(out, key=str)


def made(n=700, d=12, labels=4, seed=3):
    rng = np.random.default_rng(seed)
    centre = rng.normal(0, 1, (labels, d))
    out = []
    for i in range(n):
        c = int(rng.integers(0, labels))
        out.append((i, [float(x) for x in (centre[int(rng.integers(0, labels))] + centre[c] + rng.normal(0, 0.6, d)).astype(np.float32)], c))
    return out


def mined(spark, rows, every=20, **options):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return sorted((tuple(r) for r in H.hard_negatives(df, F.col("vec_id") % every == 0, **options).collect()), key=str)


def test_matches_brute_force_with_small_blocks(spark):
    rows = made()
    want = brute(rows, lambda i: i % 20 == 0)
    assert len(want) > 1000
    how = H.Index(codewords=6, sample=64, block_rows=50, block_anchors=7)
    assert mined(spark, rows, how=how) == want
    assert mined(spark, rows) == want


def test_heap_visits_by_bound_and_skips_cells(spark):
    rows = made(2000, labels=8)
    table = spark.createDataFrame(rows, SCHEMA).select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("label"), F.col("embedding").alias("vec")).toArrow()
    index = H.Codebooks(table, H.Index(codewords=12))
    x = H.integers(table["vec"])
    cell, r1, r2 = index.place(x)
    index.fill([{"cell": int(c), "n": int((cell == c).sum()), "r1": r1[cell == c].max(), "r2": r2[cell == c].max()} for c in np.unique(cell)], 100)
    skipped = 0
    for i in range(0, 2000, 100):
        s = H.exact_scores(x, x[i : i + 1])[:, 0]
        stop = np.sort(s)[-30]
        got = index.visit(x[i], float(stop), float(s.max()))
        assert set(cell[s >= stop].tolist()) <= set(got) and len(got) == len(set(got))
        assert set(np.unique(cell).tolist()) == set(index.visit(x[i], -np.inf, np.inf))
        skipped += len(np.unique(cell)) - len(got)
    assert skipped > 0


def test_hot_vector_ties_and_repeats(spark):
    rng = random.Random(1)
    hot = [1.0, 0.5, -0.25, 2.0]
    rows = [(i, hot, i % 3) for i in range(300)] + [(i, [rng.choice([0.0, 0.5, 1.0, 1.5]) for _ in range(4)], i % 3) for i in range(300, 500)]
    rows += [(None, hot, 1), (None, [1.0, 1.0, 0.0, 1.0], 2), (40, hot, 40 % 3), (40, hot, 2), (41, hot, 0)]
    how = H.Index(codewords=4, sample=16, block_rows=20, block_anchors=3)
    assert mined(spark, rows, how=how) == brute(rows, lambda i: i % 20 == 0)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 1.0], 1), (1, [1.0, 0.9], 1), (2, [0.5, 0.5], 2), (3, None, 2), (4, [1.0, None], 2), (5, [nan, 1.0], 2), (6, [inf, 1.0], 2),
            (7, [0.5, 0.4, 9.0], 2), (8, [0.8], 3), (9, [], 3), (10, [0.6, 0.6], None), (20, [], 3), (40, [-1.0, -1.0], 1), (60, [3e38, 3e38], 1), (61, [3e38, 1.0], 2)]
    got = mined(spark, rows)
    small = [r for r in rows if r[0] not in (60, 61)]
    assert mined(spark, small) == brute(small, lambda i: i % 20 == 0)
    assert {r[0] for r in got} >= {0} and all(-(1 << 63) <= r[4] < 1 << 63 for r in got)
    assert mined(spark, []) == []
    assert mined(spark, [(1, [1.0], 1)]) == [] and mined(spark, [(None, [1.0], 1), (0, None, None)]) == []


def test_clashing_names(spark):
    df = spark.createDataFrame(made(60), SCHEMA)
    plain = H.hard_negatives(df, F.col("vec_id") % 20 == 0).collect()
    for c in ("id", "cell", "at", "anchor", "rank", "scores", "block"):
        df = df.withColumn(c, F.lit("own"))
    assert sorted(H.hard_negatives(df, F.col("vec_id") % 20 == 0).collect()) == sorted(plain)
