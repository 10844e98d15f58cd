"""Operator 5, SimHash near-duplicates over a Gray-order hierarchical index.

1. Fingerprints (numpy over Arrow batches): 64 majority bits of the XXH64 of word shingles.
2. Links. Two fingerprints at most d bits apart agree on one of d + 1 blocks of bits, so each
   fingerprint is dealt to d + 1 keys (block number, block bits); keys that still hold too many
   are dealt again by blocks of their remaining bits, where again one must agree. Inside a task
   the fingerprints of a key are sorted by Gray rank, neighbours share most bits, and groups of
   neighbours become upper nodes that hold the bits all members share (a mask and a pattern).
   A search goes down from the roots, adds up differences on the bits that each node fixes, and
   drops whole groups once the sum passes d.
3. Components of the links by alternating large-star and small-star steps.

Copies are grouped by fingerprint before anything moves, links leave a task as stars (at most one
per fingerprint), and no list of links, components or fingerprints reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filingflow.llm.common import own_names, shuffle_partitions, text_buffers, with_row_key, written

BITS = 64
SEED = 42
FANOUT = 8  # children of a node of the index
KEY_ROWS = 2048  # a key with more fingerprints is dealt again by its remaining bits
FRONTIER = 1 << 20  # (query, node) pairs that a search holds at once, at most about


# ---------------------------------------------------------------------------------- fingerprints


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """64-bit SimHash of one text; A-Z lower-cased, words between ASCII white space."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        grams = [b" ".join(words)]
    else:
        line = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate([[0], ends[: -shingle]]).tolist()
        grams = [line[a:b] for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist())]
    h = xxhash.xxh64_intdigest
    ones, n = np.zeros(BITS, np.int64), len(grams)
    for at in range(0, n, 1 << 16):
        some = grams[at : at + (1 << 16)]
        hashes = np.fromiter((h(g, SEED) for g in some), np.uint64, len(some))
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, columns: list[str], text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``columns`` of ``docs`` and ``__fp`` (bigint whose bits are the fingerprint)."""
    narrow = docs.select(*[F.col(f"`{c}`") for c in columns], F.col(text_col).alias("__text"))
    schema = narrow.drop("__text").withColumn("__fp", F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = text_buffers(b.column(b.num_columns - 1))
            raw = data.tobytes()
            fps = np.fromiter((fingerprint(raw[s:e], shingle) for s, e in zip(off[:-1].tolist(), off[1:].tolist())), np.uint64, b.num_rows)
            cols = [b.column(i) for i in range(b.num_columns - 1)] + [pa.array(fps.view(np.int64))]
            yield pa.RecordBatch.from_arrays(cols, names=[*columns, "__fp"])

    return narrow.mapInArrow(run, schema)


# ----------------------------------------------------------------------------------------- index


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of each word in the reflected Gray sequence."""
    r = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(s)
    return r


class GrayIndex:
    """Levels of nodes over the fingerprints of one or more keys, each key a tree of its own.

    A node fixes the bits on which all fingerprints below it agree and its parent's do not; the
    differences on them, added up from root to leaf, are the Hamming distance.
    """

    def __init__(self, key: np.ndarray, fp: np.ndarray):
        order = np.lexsort((gray_rank(fp), key))
        self.key, self.fp, self.order = key[order], fp[order], order
        first = np.r_[True, self.key[1:] != self.key[:-1]] if len(key) else np.zeros(0, bool)
        mask, pattern, tree = np.full(len(fp), ~np.uint64(0)), self.fp.copy(), np.cumsum(first) - 1
        levels, children = [(mask, pattern)], []
        while len(tree) and np.any(tree[1:] == tree[:-1]):
            start = np.r_[True, tree[1:] != tree[:-1]]
            at = np.flatnonzero(start)
            place = np.arange(len(tree)) - np.repeat(at, np.diff(np.r_[at, len(tree)]))
            heads = np.flatnonzero(place % FANOUT == 0)
            ones = np.bitwise_and.reduceat(pattern, heads)
            zeros = ~np.bitwise_or.reduceat(pattern, heads)
            fixed = np.bitwise_and.reduceat(mask, heads) & (ones | zeros)
            levels.append((fixed, ones & fixed))
            children.append((heads, np.diff(np.r_[heads, len(tree)])))
            mask, pattern, tree = fixed, ones & fixed, tree[heads]
        self.children = children[::-1]
        self.levels = levels[::-1]
        self.tree_of = np.cumsum(first) - 1
        for depth in range(len(self.levels) - 1, 0, -1):  # bits that the parent fixes are its own
            heads, sizes = self.children[depth - 1]
            m, p = self.levels[depth]
            own = m & ~np.repeat(self.levels[depth - 1][0], sizes)
            self.levels[depth] = (own, p & own)

    def search(self, queries: np.ndarray, d: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (position of a query, position of a fingerprint of its key) at most ``d`` bits apart, each pair
        once, in blocks. Positions are those after sorting."""
        stack = [(0, queries, self.tree_of[queries], np.zeros(len(queries), np.uint8))]
        while stack:
            depth, q, node, acc = stack.pop()
            mask, pattern = self.levels[depth]
            acc = acc + np.bitwise_count((self.fp[q] ^ pattern[node]) & mask[node])
            near = acc <= d
            q, node, acc = q[near], node[near], acc[near]
            if depth == len(self.levels) - 1:
                once = q < node
                yield q[once], node[once]
                continue
            heads, sizes = self.children[depth]
            n = sizes[node]
            for at in _blocks(n, FRONTIER):
                k = n[at]
                child = np.repeat(heads[node[at]], k) + np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)
                stack.append((depth + 1, np.repeat(q[at], k), child, np.repeat(acc[at], k)))


def _blocks(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Slices whose sizes add up to about ``most``."""
    if len(sizes):
        part = np.cumsum(sizes) // most
        cuts = np.r_[0, np.flatnonzero(part[1:] != part[:-1]) + 1, len(sizes)]
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            yield slice(a, b)


def merge_stars(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``parent`` (each position's smallest known mate) after the links a - b, for whole arrays at a time."""
    while True:
        ra, rb = parent[a], parent[b]
        apart = ra != rb
        if not apart.any():
            return parent
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up


def links_of(key: np.ndarray, fp: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (as stars around the smallest of each local component) between fingerprints of equal keys."""
    index = GrayIndex(key, fp)
    parent = np.arange(len(fp))
    same = np.r_[False, index.key[1:] == index.key[:-1]] if len(fp) else np.zeros(0, bool)
    many = np.flatnonzero(same | np.r_[same[1:], False]) if len(fp) else np.zeros(0, np.int64)
    for block in _blocks(np.ones(len(many), np.int64), 1024):
        for a, b in index.search(many[block], d):
            parent = merge_stars(parent, a, b)
    far = np.flatnonzero(parent != np.arange(len(fp)))
    return index.fp[parent[far]], index.fp[far]


# ----------------------------------------------------------------------------------------- links


def find_links(fps: DataFrame, d: int) -> DataFrame:
    """(``a``, ``b``): links that join all distinct ``__fp`` at most ``d`` bits apart (not every pair)."""
    n, parts, found = shuffle_partitions(fps.sparkSession), d + 1, None
    # ``__rest``: the bits that no round has made part of the key yet, moved together at the low end.
    # Keys are hashes; two that collide share a tree, which costs comparisons and changes nothing.
    now, free = fps.select("__fp", F.col("__fp").alias("__rest"), F.lit(0).cast("long").alias("__key")), BITS
    while True:
        edges = [free * i // parts for i in range(parts + 1)]
        dealt = []
        for i, (lo, hi) in enumerate(zip(edges[:-1], edges[1:])):
            bits = F.shiftrightunsigned("__rest", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1))
            low = F.col("__rest").bitwiseAND(F.lit((1 << lo) - 1))
            high = F.shiftleft(F.shiftrightunsigned("__rest", hi), lo) if hi < BITS else F.lit(0).cast("long")
            dealt.append(F.struct(low.bitwiseOR(high).alias("rest"), F.xxhash64("__key", F.lit(i), bits).alias("key")))
        now = now.select("__fp", F.explode(F.array(*dealt)).alias("__d")).select("__fp", F.col("__d.rest").alias("__rest"), F.col("__d.key").alias("__key"))
        free -= min(hi - lo for lo, hi in zip(edges[:-1], edges[1:]))
        last = free <= 16  # 48 equal bits: at most 65,536 fingerprints to a key
        counts = now.groupBy("__key").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > 1)
        counts = written(counts.select("__key", (F.col("__n") > (1 << 62 if last else KEY_ROWS)).alias("__hot")), "simhash-keys")
        part = now.join(counts.where(~F.col("__hot")), "__key", "left_semi").select("__fp", "__key")
        part = part.repartition(n, "__key").mapInArrow(_linker(d), "a long, b long")
        found = part if found is None else found.unionByName(part)
        if last or counts.where("__hot").isEmpty():
            return found
        now = now.join(counts.where("__hot"), "__key", "left_semi")


def _linker(d: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [[b.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in (1, 0)] for b in batches]
        if got:
            a, b = links_of(np.concatenate([k for k, _ in got]), np.concatenate([f for _, f in got]), d)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return run


# ------------------------------------------------------------------------------------ components


def components(edges: DataFrame, a: str = "a", b: str = "b", name: str = "components") -> DataFrame:
    """(``node``, ``root``) for every node of an edge: the smallest node it reaches.

    Large-star: each node's larger neighbours are tied to its smallest; small-star: its smaller
    ones are. The forest is stars once a round changes nothing; every round is written.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    def state(links: DataFrame) -> tuple:
        return tuple(links.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first())

    e = written(e, name)
    seen = state(e)
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("s"))
        e = written(small.select(F.col("s.v").alias("u"), F.col("s.m").alias("v")).where("u > v").distinct(), name)
        now = state(e)
        if now == seen:  # the round changed no link
            break
        seen = now
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.withColumn("root", F.col("node")))


@own_names
def near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, ``fingerprint``, ``component_id``) for every row.

    Texts of fewer than ``shingle`` words are one shingle of all words; null, empty and blank texts have
    fingerprint 0 and link like any other. Equal fingerprints are one node, whatever their number;
    ``component_id`` is the smallest id reachable over links of at most ``distance`` bits (ids that are
    null don't count unless all are). Repeated rows stay. An empty table gives an empty table.
    """
    rows = written(with_fingerprints(docs, [id_col], text_col, shingle), "simhash-rows")
    nodes = rows.groupBy("__fp").agg(F.min(id_col).alias("__least"))
    nodes = _rooted(written(nodes, "simhash-nodes"), distance)
    least = nodes.groupBy("__root").agg(F.min("__least").alias("component_id"))
    label = nodes.join(least, "__root").select(F.col("__fp").alias("__of"), "component_id")
    return rows.join(label, F.col("__fp") == F.col("__of")).select(
        id_col, F.lower(F.lpad(F.hex("__fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def _rooted(nodes: DataFrame, distance: int) -> DataFrame:
    """``nodes`` (distinct ``__fp``) with ``__root``, the component of each."""
    comp = components(find_links(nodes.select("__fp"), distance), name="simhash-components")
    return nodes.join(comp, nodes["__fp"] == comp["node"], "left").select(*nodes.columns, F.coalesce("root", "__fp").alias("__root"))


@own_names
def keep_representatives(docs: DataFrame, shingle: int = 3, distance: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id (null ids come last; of rows with
    the same id, one of the smallest text hash). Columns are unchanged."""
    keyed = with_row_key(docs, id_col, text_col)
    keyed = keyed.withColumn("__id", F.struct(F.col(id_col).isNull().alias("null"), F.col(id_col).alias("id"), "__rk", "__rd"))
    rows = written(with_fingerprints(keyed, ["__id"], text_col, shingle), "simhash-rows")
    nodes = rows.groupBy("__fp").agg(F.min("__id").alias("__least"))
    first = _rooted(written(nodes, "simhash-nodes"), distance).groupBy("__root").agg(F.min("__least").alias("__least"))
    times = rows.groupBy(F.col("__id.__rk").alias("__rk"), F.col("__id.__rd").alias("__rd")).agg(F.count(F.lit(1)).alias("__n"))
    chosen = first.select("__least.__rk", "__least.__rd").join(times, ["__rk", "__rd"])
    kept = keyed.drop("__id").join(written(chosen, "simhash-kept"), ["__rk", "__rd"])
    cols = [F.col(f"`{c}`") for c in docs.columns]
    again = kept.where("__n > 1").groupBy("__rk", "__rd").agg(F.first(F.struct(*cols)).alias("__row"))
    return kept.where("__n = 1").select(*cols).unionByName(again.select("__row.*"))
