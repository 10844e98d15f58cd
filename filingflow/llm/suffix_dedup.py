"""Operator 6, suffix-array de-duplication: bytes covered by strings of ``length`` bytes that occur twice.

1. Anchors. Every window of ``length`` bytes elects the k-gram of least hash inside it (the leftmost of
   equals). Equal windows elect the same k-gram at the same place, so windows need comparing only
   within the group of their k-gram. The windows of one anchor are neighbours; the bytes they
   cover are its segment. Anchors whose k-gram is unique drop out; a group whose segments are all
   equal is repeated whole. What is left are the ends of copied passages and edited places.
2. Suffix arrays. Distinct segments of the remaining groups meet in tasks as strings of 8-byte symbols
   (cut at the anchor, so that equal windows are cut alike). Their suffixes are sorted by linear
   grouping: groups by Lyndon prefix, processed from the largest down along previous-smaller
   pointers, then each group's order is emitted; nothing is renamed and nothing recurses.
   Neighbours that agree on all symbols that a window must hold form classes, and inside a class
   the few bytes at either end decide, byte for byte, which windows are equal.
3. Runs of repeated windows go back to all documents with that segment and are cut out.

Groups of more distinct segments than a task should hold count their windows by hash instead, one
row for each window, combined before the shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filingflow.llm.common import others, own_names, shuffle_partitions, text_buffers, written
from filingflow.llm.fingerprints import mix

LENGTH = 400
GRAM = 32
SYMBOL = 8  # bytes of a symbol
GROUP_SEGMENTS = 4096  # distinct segments of a group that one task sorts
TASK_SYMBOLS = 1 << 18  # symbols sorted together
CHUNK = 1 << 20  # windows that are hashed together; longer texts are hashed piece by piece

_BASES = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)]
_BYTES = [mix(np.arange(300 * i + 1, 300 * i + 257, dtype=np.uint64)) for i in (1, 2)]


class Hashes:
    """Hash of any substring of ``data`` (polynomial modulo 2^64, then mixed)."""

    def __init__(self, data: np.ndarray, which: int = 0):
        base, n = _BASES[which], len(data)
        self.total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTES[which][data] * np.cumprod(np.full(n, base)), out=self.total[1:])
        self.back = np.cumprod(np.full(n + 1, np.uint64(pow(int(base), -1, 1 << 64))))

    def __call__(self, start, end) -> np.ndarray:
        return mix((self.total[end] - self.total[start]) * self.back[start])


# ---------------------------------------------------------------------------------------- anchors


def elected(order: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` positions, the position of its least value (the leftmost of equals)."""
    n = len(order)
    key = (order.astype(np.uint64) << np.uint64(32)) | np.arange(n, dtype=np.uint64)
    padded = np.full(-(-n // width) * width, ~np.uint64(0))
    padded[:n] = key
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[: n - width + 1], ahead[width - 1 : n])
    return (least & np.uint64(0xFFFFFFFF)).astype(np.int64)


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(text, anchor position, first window, k-gram hash, segment hash) for each text that has a window; positions are within the text. An
    anchor's last window is the one before the next anchor's first.

    A text of more than ``CHUNK`` windows is hashed in pieces that overlap by a window less a byte; an
    anchor on a seam comes twice, with the windows of either piece.
    """
    if len(data) < length:
        return
    hashes = Hashes(data)
    at = np.arange(len(data) - gram + 1)
    grams = hashes(at, at + gram)
    place = elected((grams >> np.uint64(32)).astype(np.uint32), length - gram + 1)
    for i in np.flatnonzero(np.diff(offsets) >= length).tolist():
        a, b = int(offsets[i]), int(offsets[i + 1]) - length + 1
        own = place[a:b]
        first = np.r_[0, np.flatnonzero(own[1:] != own[:-1]) + 1]
        pos, end = own[first], np.r_[first[1:], b - a] - 1 + length
        segment = mix(hashes(a + first, a + end) ^ ((pos - a - first).astype(np.uint64) << np.uint64(32)) ^ (end - first).astype(np.uint64))
        yield i, pos - a, first, grams[pos], segment


def long_anchors(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """The same for one long text, piece by piece."""
    parts = []
    for a in range(0, len(data) - length + 1, CHUNK):
        piece = data[a : a + CHUNK + length - 1]
        for _, pos, first, grams, segment in anchors(piece, np.array([0, len(piece)]), length, gram):
            parts.append((pos + a, first + a, grams, segment))
    return tuple(np.concatenate(x) for x in zip(*parts))


def find_anchors(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(``__rk``, ``__rd``, ``lo``, ``windows``, ``at``, ``kh``, ``sh``): one row for each anchor of each row."""
    schema = "__rk long, __rd long, n int, at array<int>, lo array<int>, kh array<long>, sh array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = text_buffers(b.column(2))
            keys = [b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)]
            first = 0
            while first < b.num_rows:
                last = max(first + 1, int(np.searchsorted(off, off[first] + CHUNK, "right")) - 1)
                o = off[first : last + 1]
                if o[-1] - o[0] > CHUNK + length:
                    got = [(0, *long_anchors(data[o[0] : o[-1]], length, gram))]
                else:
                    got = list(anchors(data[o[0] : o[-1]], o - o[0], length, gram))
                if got:
                    rows = np.array([g[0] for g in got]) + first
                    cuts = pa.array(np.r_[0, np.cumsum([len(g[1]) for g in got])], pa.int32())
                    lists = [
                        pa.ListArray.from_arrays(cuts, pa.array(np.concatenate([g[i] for g in got]).astype(kind).view(seen)))
                        for i, kind, seen in ((1, np.int32, np.int32), (2, np.int32, np.int32), (3, np.uint64, np.int64), (4, np.uint64, np.int64))
                    ]
                    size = (off[rows + 1] - off[rows]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(keys[0][rows]), pa.array(keys[1][rows]), pa.array(size), *lists], names=["__rk", "__rd", "n", "at", "lo", "kh", "sh"])
                first = last

    rows = written(docs.select("__rk", "__rd", F.col("__text")).mapInArrow(run, schema), "repeat-anchors")
    ends = F.concat(F.slice("lo", 2, F.size("lo")), F.array(F.col("n") - length + 1))
    one = rows.select("__rk", "__rd", F.explode(F.arrays_zip("at", "lo", ends.alias("hi"), "kh", "sh")).alias("x"))
    return one.select("__rk", "__rd", "x.lo", (F.col("x.hi") - F.col("x.lo")).alias("windows"), (F.col("x.at") - F.col("x.lo")).alias("at"), "x.kh", "x.sh")


# ----------------------------------------------------------------------------------- suffix array


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of all suffixes of ``text`` (non-negative integers) in ascending order, by linear grouping.

    Phase 1 takes groups of suffixes from the largest down. Each suffix of the group points to the
    nearest one before it whose group is smaller; that one's group context is thereby extended, so it
    moves to the end of its group, behind those without such a mark, those with more marks last.
    Phase 2 walks the order from the left and puts the suffix before each one, and those it points
    to, into the next free place of their groups.
    """
    n = len(text) + 1  # with an end that is smaller than all
    symbols = np.r_[np.unique(text, return_inverse=True)[1] + 1, 0]
    by_symbol = np.argsort(symbols, kind="stable")
    first = np.flatnonzero(np.r_[True, np.diff(symbols[by_symbol]) != 0])
    size = [0] * n
    for s, k in zip(first.tolist(), np.diff(np.r_[first, n]).tolist()):
        size[s] = k
    rank = np.empty(n, np.int64)
    rank[by_symbol] = np.arange(n)
    group = first[symbols].tolist()  # place of the first of a suffix's group
    order, rank, pointer = by_symbol.tolist(), rank.tolist(), [-1] * n
    end = n
    while end > 0:
        start = group[order[end - 1]]
        marks: dict[int, int] = {}
        for s in sorted(order[start:end]) if end - start > 1 else order[start:end]:
            p = s - 1
            while p >= 0 and group[p] >= start:
                p = pointer[p]
            pointer[s] = p
            if p >= 0:
                marks[p] = marks.get(p, 0) + 1
        if len(marks) == 1:
            moved = [(group[p], k, p) for p, k in marks.items()]
        else:
            moved = sorted([(group[p], k, p) for p, k in marks.items()], reverse=True)
        i, many = 0, len(moved)
        while i < many:
            old = moved[i][0]
            free = old + size[old]
            while i < many and moved[i][0] == old:
                k, last = moved[i][1], free
                members = []
                while i < many and moved[i][0] == old and moved[i][1] == k:
                    p = moved[i][2]
                    free -= 1
                    q, at = order[free], rank[p]
                    order[at], rank[q] = q, at
                    order[free], rank[p] = p, free
                    members.append(p)
                    i += 1
                for p in members:
                    group[p] = free
                size[free] = last - free
            if free > old:
                size[old] = free - old
        end = start
    free_at = list(range(n))  # next free place of the group that starts there
    placed = [False] * n
    out = [0] * n
    out[0] = n - 1
    placed[n - 1] = True
    for i in range(n):
        s = out[i] - 1
        while s >= 0 and not placed[s]:
            g = group[s]
            out[free_at[g]] = s
            free_at[g] += 1
            placed[s] = True
            s = pointer[s]
    return np.array(out[1:], np.int64)


def repeated_windows(segments: list[bytes], at: list[int], length: int) -> list[np.ndarray]:
    """For each segment, which of its windows (starts 0 to len - length) occur a second time among all of them.

    ``at`` is the anchor's place in each segment; equal windows have it at the same distance.
    """
    joined = np.frombuffer(b"".join(segments) + bytes(2 * SYMBOL), np.uint8)
    size = np.array([len(s) for s in segments])
    base = np.cumsum(size) - size
    lead = np.array(at) % SYMBOL
    count = (size - lead) // SYMBOL
    # positions of all symbols, each segment's closed by an end mark
    slots = count + 1
    seg = np.repeat(np.arange(len(segments)), slots)
    inside = np.arange(len(seg)) - np.repeat(np.cumsum(slots) - slots, slots)
    pos = (base + lead)[seg] + SYMBOL * inside
    words = np.lib.stride_tricks.as_strided(joined, (len(joined) - SYMBOL + 1, SYMBOL), (1, 1))
    value = words[np.minimum(pos, len(words) - 1)].copy().view(">u8").ravel().astype(np.uint64)
    mark = inside == count[seg]
    text = np.unique(value, return_inverse=True)[1] + 1
    text[mark] = 0
    order = suffix_array(text)
    need = length // SYMBOL - 1  # whole symbols in any window
    starts = order[inside[order] + need <= count[seg[order]]]
    flags = [np.zeros(max(0, int(s) - length + 1), bool) for s in size]
    if len(starts) < 2:
        return flags
    same = np.ones(len(starts) - 1, bool)
    for i in range(need):
        live = np.flatnonzero(same)
        same[live] = text[starts[live] + i] == text[starts[live + 1] + i]
    kind = np.cumsum(np.r_[True, ~same])
    shared = np.r_[False, same] | np.r_[same, False]
    starts, kind = starts[shared], kind[shared]
    if not len(starts):
        return flags
    s = seg[starts]
    p = pos[starts]
    left = np.where(p >= SYMBOL, p - SYMBOL, 0)
    before = words[left].copy().view(">u8").ravel().astype(np.uint64)
    short = p < SYMBOL  # fewer bytes before it in the buffer: shift what is there into place
    before[short] = words[np.zeros(short.sum(), int)].copy().view(">u8").ravel().astype(np.uint64) >> (8 * (SYMBOL - p[short])).astype(np.uint64)
    after = words[np.minimum(p + SYMBOL * need, len(words) - 1)].copy().view(">u8").ravel().astype(np.uint64)
    for e in range(SYMBOL):
        o = p - base[s] - e  # window's start in its segment
        ok = np.flatnonzero((o >= 0) & (o + length <= size[s]))
        if len(ok) < 2:
            continue
        tail = after[ok] >> np.uint64(8 * e)
        ends = tail if not e else (before[ok] & np.uint64((1 << (8 * e)) - 1)) << np.uint64(64 - 8 * e) | tail
        by = np.lexsort((ends, kind[ok]))
        equal = (kind[ok][by][1:] == kind[ok][by][:-1]) & (ends[by][1:] == ends[by][:-1])
        for j in ok[by[np.r_[False, equal] | np.r_[equal, False]]].tolist():
            flags[s[j]][o[j]] = True
    return flags


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of True."""
    edge = np.diff(np.r_[0, flags.astype(np.int8), 0])
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


# ------------------------------------------------------------------------------------ comparisons

_RUNS = "kh long, sh long, a int, b int"


def _run_rows(rows: list[tuple[int, int]], flags: list[np.ndarray]) -> pa.RecordBatch:
    out = [(k, h, a, b) for (k, h), f in zip(rows, flags) for a, b in zip(*(x.tolist() for x in runs(f)))]
    cols = list(zip(*out)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["kh", "sh", "a", "b"])


def _sorter(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, segments, at, symbols = [], [], [], 0

        def flush() -> pa.RecordBatch:
            return _run_rows(rows, repeated_windows(segments, at, length))

        for b in batches:
            for k, h, a, raw in zip(*(b.column(i).to_pylist() for i in range(4))):
                if rows and (k, h) == rows[-1]:
                    continue  # a repeated row's copy
                if symbols > TASK_SYMBOLS and k != rows[-1][0]:
                    yield flush()
                    rows, segments, at, symbols = [], [], [], 0
                rows.append((k, h))
                segments.append(raw)
                at.append(a)
                symbols += len(raw) // SYMBOL
        if rows:
            yield flush()

    return run


def _window_hashes(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, h, _, raw in zip(*(b.column(i).to_pylist() for i in range(4))):
                data = np.frombuffer(raw, np.uint8)
                o = np.arange(len(data) - length + 1)
                both = [Hashes(data, i)(o, o + length).view(np.int64) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(o), k)), pa.array(np.full(len(o), h)), pa.array(o.astype(np.int32)), *map(pa.array, both)], names=["kh", "sh", "o", "h1", "h2"])

    return run


def _close(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flags = []
            for o in b.column(2).to_pylist():
                f = np.zeros(max(o) + 1, bool)
                f[o] = True
                flags.append(f)
            yield _run_rows(list(zip(b.column(0).to_pylist(), b.column(1).to_pylist())), flags)

    return run


def compare_segments(segments: DataFrame, length: int) -> DataFrame:
    """(``kh``, ``sh``, ``a``, ``b``): runs of windows of each distinct segment that occur again in its group.

    ``segments``: (kh, sh, at, raw, big), written; ``big`` marks groups that no single task should hold.
    """
    n = shuffle_partitions(segments.sparkSession)
    cols = ["kh", "sh", "at", "raw"]
    small = segments.where("not big").select(*cols).repartition(n, "kh").sortWithinPartitions("kh", "sh")
    found = small.mapInArrow(_sorter(length), _RUNS)
    if segments.where("big").isEmpty():
        return found
    wins = segments.where("big").dropDuplicates(["kh", "sh"]).select(*cols).mapInArrow(_window_hashes(length), "kh long, sh long, o int, h1 long, h2 long")
    wins = written(wins, "repeat-windows")
    twice = written(wins.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h1", "h2"), "repeat-twice")
    back = wins.join(twice, ["h1", "h2"], "left_semi").groupBy("kh", "sh").agg(F.collect_list("o").alias("o"))
    return found.unionByName(back.mapInArrow(_close(length), _RUNS))


# -------------------------------------------------------------------------------------- operator


def repeated_spans(keyed: DataFrame, length: int, gram: int) -> DataFrame:
    """(``__rk``, ``__rd``, ``__spans``): byte ranges (start, end) of each row that repeated strings cover, unmerged."""
    found = find_anchors(keyed, length, gram)
    groups = found.groupBy("kh").agg(F.count(F.lit(1)).alias("n"), F.min("sh").alias("least"), F.max("sh").alias("most")).where("n > 1")
    groups = written(groups.select("kh", (F.col("least") != F.col("most")).alias("mixed")), "repeat-groups")
    again = written(found.join(groups, "kh"), "repeat-found")  # anchors whose k-gram occurs again
    whole = again.where("not mixed").select("__rk", "__rd", F.col("lo").alias("start"), (F.col("lo") + F.col("windows") - 1 + length).alias("end"))

    place = F.struct("__rk", "__rd", "lo", "windows", "at")
    kinds = again.where("mixed").groupBy("kh", "sh").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("p"))
    kinds = written(kinds.select("kh", "sh", "n", "p.*"), "repeat-kinds")
    # only the keys of large groups, written: the join below can then split or broadcast, whatever a group's size
    hot = written(kinds.groupBy("kh").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > GROUP_SEGMENTS).select("kh", F.lit(True).alias("big")), "repeat-large")
    raw = F.substring(F.col("__text").cast("binary"), F.col("lo") + 1, F.col("windows") - 1 + length)
    marked = kinds.join(hot, "kh", "left").withColumn("big", F.coalesce("big", F.lit(False)))
    segments = marked.join(keyed, ["__rk", "__rd"]).select("kh", "sh", "at", raw.alias("raw"), "big")
    part = compare_segments(written(segments, "repeat-segments"), length)
    copies = kinds.where("n > 1").select("kh", "sh", F.lit(0).alias("a"), (F.col("windows") - 1).alias("b"))
    part = written(part.unionByName(copies), "repeat-runs")
    pieces = again.where("mixed").join(part, ["kh", "sh"])
    pieces = pieces.select("__rk", "__rd", (F.col("lo") + F.col("a")).alias("start"), (F.col("lo") + F.col("b") + length).alias("end"))
    return whole.unionByName(pieces).groupBy("__rk", "__rd").agg(F.collect_set(F.struct("start", "end")).alias("__spans"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


@own_names
def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_removed``, ``spans`` (array of removed byte ranges, merged), ``kept_bytes`` (binary: a cut may
    fall inside a character) and ``kept_sha256``; columns of these names are replaced.

    Every byte goes that a string of ``length`` bytes covers which starts anywhere else too, in any
    row or in the same one; judged on the input. Null and empty texts have no bytes, shorter texts
    than ``length`` lose nothing, repeated rows lose each other's bytes. An empty table gives an empty table.
    """
    if not SYMBOL <= gram <= length or length < 4 * SYMBOL or length % SYMBOL:
        raise ValueError("length must be a multiple of 8 of at least 32 and no less than gram")
    new = ["n_bytes", "n_removed", "spans", "kept_bytes", "kept_sha256"]
    rest = others(docs, new)
    text = F.coalesce(F.col(text_col), F.lit(""))
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    keys = {"__rk": F.xxhash64(text, ident), "__rd": F.xxhash64(ident, F.length(text)), "__text": text}
    keyed = docs.withColumns(keys)
    spans = repeated_spans(keyed.select("__rk", "__rd", "__text"), length, gram)
    fed = keyed.join(spans, ["__rk", "__rd"], "left").select(*rest, "__text", "__spans")
    blank = {"n_bytes": F.lit(0).cast("long"), "n_removed": F.lit(0).cast("long"), "spans": F.array().cast("array<struct<start:int,end:int>>")}
    schema = docs.select(*rest).withColumns(blank | {"kept_bytes": F.lit(b""), "kept_sha256": F.lit("")}).schema
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = text_buffers(b.column(b.num_columns - 2))
            raw, lists, kept = data.tobytes(), [], []
            for a, e, own in zip(off[:-1].tolist(), off[1:].tolist(), b.column(b.num_columns - 1).to_pylist()):
                cut = merged([(x["start"], x["end"]) for x in own or ()])
                lists.append([{"start": s, "end": t} for s, t in cut])
                ends = [0, *[x for pair in cut for x in pair], e - a]
                kept.append(b"".join(raw[a + s : a + t] for s, t in zip(ends[::2], ends[1::2])))
            size = np.diff(off)
            gone = size - np.array([len(k) for k in kept])
            sha = [hashlib.sha256(k).hexdigest() for k in kept]
            cols = [*b.columns[:-2], pa.array(size), pa.array(gone), pa.array(lists, kind), pa.array(kept, pa.binary()), pa.array(sha)]
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return fed.mapInArrow(run, schema)
