"""Operator 7, token ids in a binary format, compressed by Re-Pair grammars.

Documents are dealt by ranges of ascending id, tokenized in numpy-sized batches and stored as shards of
about ``SHARD_IDS`` ids. A shard is one binary record (rows of a Parquet table, so that writing is atomic
and any storage will do):

    magic ``RPS1`` | counts: documents, ids, rules, symbols | document ids | id-is-null flags | ids per document
    | rules (pairs of symbols) | expansion length of each rule | symbols

all little-endian. Frequent pairs of ids are replaced by nonterminals again and again; a rule stands for
two symbols, and expansion lengths let a reader find and expand only the symbols that cover the ids
asked for.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filingflow.llm.common import range_marks, ranges_of, shuffle_partitions, text_buffers, written

SHARD_IDS = 1 << 18
BATCH_BYTES = 1 << 22  # texts that are cut into pieces together
MAGIC = b"RPS1"
END = 0  # id after each document
FIRST_RULE = 1 << 17  # symbols from here on are nonterminals; the vocabularies are smaller
MIN_USES = 8  # a pair that occurs less often gets no rule
SLOTS = 1 << 18  # of the first, hashed count of pairs


# ------------------------------------------------------------------------------------- tokenizing


class _Places(dict):
    """Place of each key in the order of first use; a key that is asked for gets the next place."""

    def __missing__(self, key: str) -> int:
        self[key] = at = len(self)
        return at


# Kinds of bytes. OTHER: a character beyond ASCII that is neither white space nor surely a letter; DOUBT: white space beyond
# ASCII, general punctuation and control characters, which are surely neither letters nor digits.
LETTER, DIGIT, MARK, APOSTROPHE, SPACE, LINE, OTHER, DOUBT = range(8)


def _kinds() -> bytes:
    kind = [DOUBT] * 0x20 + [MARK] * 0x5F + [DOUBT] + [OTHER] * 0x80
    for chars, k in (("\t\n\r", LINE), (" ", SPACE), ("'", APOSTROPHE), ("0123456789", DIGIT)):
        for c in chars:
            kind[ord(c)] = k
    for c in range(0x80):
        if chr(c).isalpha():
            kind[c] = LETTER
    return bytes(kind)


def _cuts() -> bytes:
    """For a pair of kinds (8 * first + second): 1 if a piece ends between them, 2 if one ends before the first."""
    seen = (LETTER, DIGIT, MARK, APOSTROPHE, OTHER)  # surely not white space
    cut = [0] * 256
    for a in range(8):
        for b in range(8):
            between = (a in seen and b in (SPACE, LINE)) or (a == LINE and b in seen)
            between |= a == LETTER and b in (DIGIT, MARK, APOSTROPHE, DOUBT)
            between |= (a in (DIGIT, MARK) and b == LETTER) or (a == DIGIT and b in (MARK, APOSTROPHE, DOUBT)) or (a in (MARK, APOSTROPHE) and b == DIGIT)
            cut[8 * a + b] = between + 2 * (a in (SPACE, LINE) and b in seen)
    return bytes(cut)


class Encoder:
    """The tokenizer behind a cache of pieces.

    The tokenizer's byte-level pattern takes a space, if there is one, with the letters, digits or other
    marks that follow it, and else white space up to the last of a run. So it always ends a token before
    white space that follows something else, before the last of a run of white space, behind a tab or a
    line end before something else, and between letters, digits and other marks, but for an apostrophe
    before letters, which may take some of them. Texts are cut there, all of a batch at once; each
    distinct piece is encoded by the tokenizer once and looked up after that. A text with one of the
    tokenizer's special tokens is one piece.
    """

    MOST = 1_200_000  # cached pieces; the cache starts anew beyond that
    MOST_BYTES = 32 * MOST  # and beyond so many bytes of pieces
    TOGETHER = 500  # pieces given to the tokenizer in one call, as words of a text that is cut already
    KINDS, CUTS = _kinds(), _cuts()

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = {i: t.content.encode() for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.special = list(added.values())
        widths = {i: len(word) for word, i in self.tokenizer.get_vocab().items()}  # the vocabulary has one character a byte
        widths |= {i: len(word) for i, word in added.items()}
        self.width = np.zeros(max(widths) + 1, np.int64)  # bytes that each id stands for
        self.width[list(widths)] = list(widths.values())
        self._clear()

    def _clear(self) -> None:
        self.places, self.bytes = _Places({"": 0}), 0  # the end id
        self.flat, self.ends = np.array([END], np.int32), np.array([0, 1], np.int32)

    def _starts(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Where the pieces start; the texts between ``off`` have their own."""
        n, raw = len(data), data.tobytes()
        kind = np.empty(n + 2, np.uint8)
        kind[:n] = np.frombuffer(raw.translate(self.KINDS), np.uint8)
        far = np.r_[data, np.zeros(2, np.uint8)]

        def put(at: np.ndarray, width: int, k: int) -> None:
            for i in range(width):
                kind[at + i] = k

        at = np.flatnonzero((data >= 0xC3) & (data <= 0xC9))  # U+00C0 to U+024F
        put(at[(data[at] != 0xC3) | ((far[at + 1] != 0x97) & (far[at + 1] != 0xB7))], 2, LETTER)
        at = np.flatnonzero(data == 0xC2)
        put(at[(far[at + 1] == 0x85) | (far[at + 1] == 0xA0)], 2, DOUBT)
        for lead in (0xE1, 0xE2, 0xE3):
            at = np.flatnonzero(data == lead)
            second, third = far[at + 1], far[at + 2]
            if lead == 0xE1:
                white = ((second == 0x9A) & (third == 0x80)) | ((second == 0xA0) & (third == 0x8E))
            elif lead == 0xE2:  # U+2000 to U+206F
                white = (second == 0x80) | ((second == 0x81) & (third <= 0xAF))
            else:
                white = (second == 0x80) & (third == 0x80)
            put(at[white], 3, DOUBT)
        pairs = ((kind[: n - 1] << 3) | kind[1:n]).tobytes()
        flags = np.zeros(n + 1, np.uint8)  # of the pair that ends here
        flags[1:n] = np.frombuffer(pairs.translate(self.CUTS), np.uint8)
        flags[off] = 0
        cut = (flags[:n] & 1) | (flags[1:] >> 1)
        for word in self.special:
            at = raw.find(word)
            while at >= 0:
                i = int(np.searchsorted(off, at, "right"))
                cut[off[i - 1] : off[i]] = 0
                at = raw.find(word, int(off[i]))
        cut[off[:-1][off[:-1] < n]] = 1
        return np.flatnonzero(cut)

    def _learn(self, new: list[str], sizes: np.ndarray) -> None:
        """Encodes pieces of these bytes that are seen first and appends them to the cache. Ids stand for bytes, so the
        bytes they have in all tell where a piece's ids end."""
        groups = [new[i : i + self.TOGETHER] for i in range(0, len(new), self.TOGETHER)]
        got = self.tokenizer.encode_batch_fast(groups, is_pretokenized=True, add_special_tokens=False)
        ids, want = np.concatenate([np.array(g.ids, np.int32) for g in got]), np.cumsum(sizes)
        upto = np.cumsum(self.width[ids])
        ends = np.searchsorted(upto, want) + 1
        if len(ids) != ends[-1] or not np.array_equal(upto[ends - 1], want):  # ids that stand for more or less than their bytes
            got = self.tokenizer.encode_batch_fast(new, add_special_tokens=False)
            ids, ends = np.concatenate([np.array(g.ids, np.int32) for g in got]), np.cumsum([len(g.ids) for g in got])
        self.ends = np.concatenate([self.ends, (len(self.flat) + ends).astype(np.int32)])
        self.flat = np.concatenate([self.flat, ids])
        self.bytes += int(want[-1])

    def __call__(self, texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, ``END`` after each, and the number of ids of each."""
        if len(self.places) > self.MOST or self.bytes > self.MOST_BYTES:
            self._clear()
        data, off = text_buffers(pa.array(texts, pa.string()) if isinstance(texts, list) else texts)
        if not len(data):
            return np.full(len(off) - 1, END, np.int32), np.ones(len(off) - 1, np.int64)
        starts = self._starts(data, off)
        cuts = np.r_[starts, len(data)].astype(np.int32)
        pieces = pa.StringArray.from_buffers(len(starts), pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()
        before, keys = len(self.places), pieces.dictionary
        places = np.fromiter(map(self.places.__getitem__, keys.to_numpy(zero_copy_only=False)), np.int32, len(keys))
        if len(self.places) > before:
            self._learn(list(islice(self.places, before, None)), np.diff(text_buffers(keys)[1])[places >= before])
        closed = np.searchsorted(starts, off[1:])  # pieces before each text's end
        at = np.insert(places[pieces.indices.to_numpy()], closed, 0)
        first = self.ends[at]
        n = self.ends[at + 1] - first
        stop = np.cumsum(n)
        out = self.flat[np.repeat(first - (stop - n), n) + np.arange(int(stop[-1]))]
        return out, np.diff(stop[closed + np.arange(len(closed))], prepend=0)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder: read once and its cache kept for the tasks that follow."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


# ---------------------------------------------------------------------------------------- Re-Pair


def _frequent(seq: np.ndarray, least: int, places: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all pairs that occur ``least`` times or more, the places where one stands, and which one it is. A hashed
    count leaves few places to be counted exactly. With ``places`` (ascending) only the pairs there are counted."""
    first, second = (seq[:-1], seq[1:]) if places is None else (seq[places], seq[places + 1])
    code = (first.astype(np.int64) << 32) | second
    slot = ((code ^ first.astype(np.int64) * 0x9E3779B1) * 0x85EBCA6B >> 15) & (SLOTS - 1)
    many = np.bincount(slot, minlength=SLOTS) >= least
    maybe = np.flatnonzero(many[slot] & (first != END))  # a rule never runs over a document's end
    found = pa.array(code[maybe]).dictionary_encode()
    pairs, which = found.dictionary.to_numpy(), found.indices.to_numpy()
    good = np.bincount(which, minlength=len(pairs)) >= least
    order = np.flatnonzero(good)[np.argsort(pairs[good])]
    number = np.full(len(pairs), -1, np.int32)
    number[order] = np.arange(len(order))
    which = number[which]
    good = np.flatnonzero(which >= 0)
    here = maybe[good]
    return pairs[order], here if places is None else places[here], which[good]


def _apart(here: np.ndarray) -> np.ndarray:
    """Numbers of those of these ascending places that are taken, so that no two are neighbours: every other one of a run."""
    first = np.flatnonzero(np.diff(here, prepend=-2) != 1)
    place = np.arange(len(here)) - np.repeat(first, np.diff(first, append=len(here)))
    return np.flatnonzero(place & 1 == 0)


def compress(ids: np.ndarray, least: int = MIN_USES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Re-Pair: (symbols, rules (n, 2), expansion lengths), until no pair occurs ``least`` times. Each round replaces all
    frequent pairs from left to right where they don't overlap; rules may use the nonterminals of earlier rounds. No
    replacement makes a pair of old symbols more frequent, so a round counts those that were frequent and the new ones."""
    seq, rules, lengths = ids.astype(np.int32), [np.zeros((0, 2), np.int64)], np.zeros(0, np.int64)
    worth, places = max(2, least // 2), None
    while len(seq) > 1:
        pairs, here, which = _frequent(seq, least, places)
        if not len(pairs):
            break
        again = np.zeros(len(seq) + 1, bool)  # places of the pairs to be counted next
        again[here] = True
        taken = _apart(here)
        good = np.bincount(which[taken], minlength=len(pairs)) >= worth
        if not good.any():  # pairs took each other's places: the most frequent one alone has enough
            own = which == np.bincount(which).argmax()
            here, which = here[own], which[own]
            taken = _apart(here)
            good = np.bincount(which[taken], minlength=len(pairs)) >= worth
            if not good.any():
                break
        here, which = here[taken], which[taken]
        kept = np.flatnonzero(good[which])
        here, which = here[kept], (np.cumsum(good) - 1)[which[kept]]
        new = pairs[good]
        pair = np.stack([new >> 32, new & 0xFFFFFFFF], axis=1)
        size = np.where(pair >= FIRST_RULE, lengths[np.clip(pair - FIRST_RULE, 0, max(0, len(lengths) - 1))] if len(lengths) else 1, 1)
        seq[here] = FIRST_RULE + len(lengths) + which
        again[here] = again[here - 1] = True  # if the symbol before goes, the one before it is new too; -1 is the spare place
        keep = np.ones(len(seq), bool)
        keep[here + 1] = False
        keep = np.flatnonzero(keep)
        seq, places = seq[keep], np.flatnonzero(again[keep])
        places = places[places < len(seq) - 1]
        rules.append(pair)
        lengths = np.r_[lengths, size.sum(axis=1)]
    return seq.astype(np.int64), np.concatenate(rules), lengths


def expand(symbols: np.ndarray, rules: np.ndarray) -> np.ndarray:
    """The ids that the symbols stand for. Each rule among them is expanded once and looked up."""
    big = np.flatnonzero(symbols >= FIRST_RULE)
    if not len(big):
        return symbols
    named = symbols[big] - FIRST_RULE
    used = np.zeros(len(rules), bool)
    used[named] = True
    seq = np.flatnonzero(used) + FIRST_RULE
    owner = np.arange(len(seq))
    while (more := seq >= FIRST_RULE).any():
        n = 1 + more
        first = (np.cumsum(n) - n)[more]
        pair = rules[seq[more] - FIRST_RULE]
        seq, owner = np.repeat(seq, n), np.repeat(owner, n)
        seq[first], seq[first + 1] = pair[:, 0], pair[:, 1]
    size = np.bincount(owner)
    which = (np.cumsum(used) - 1)[named]
    long = size[which]
    n = np.ones(len(symbols), np.int64)
    n[big] = long
    out = np.repeat(symbols, n)
    out[np.flatnonzero(out >= FIRST_RULE)] = seq[np.repeat((np.cumsum(size) - size)[which] - (np.cumsum(long) - long), long) + np.arange(int(long.sum()))]
    return out


def pack(doc_ids: list, counts: np.ndarray, ids: np.ndarray) -> bytes:
    """One shard as bytes."""
    symbols, rules, lengths = compress(ids)
    known = np.array([0 if i is None else i for i in doc_ids], "<i8")
    null = np.array([i is None for i in doc_ids], np.uint8)
    head = struct.pack("<4s4q", MAGIC, len(known), len(ids), len(rules), len(symbols))
    return b"".join([head, known, null, counts.astype("<u8"), rules.astype("<u4"), lengths.astype("<u8"), symbols.astype("<u4")])


class Shard:
    """A reader of one packed shard."""

    def __init__(self, raw: bytes):
        magic, docs, self.n_ids, rules, symbols = struct.unpack_from("<4s4q", raw)
        if magic != MAGIC:
            raise ValueError("not a shard of token ids")
        at = struct.calcsize("<4s4q")

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(raw, kind, n, at)
            at += got.nbytes
            return got

        known, null = take("<i8", docs), take("u1", docs)
        self.doc_ids = [None if z else int(i) for i, z in zip(known, null)]
        self.counts = take("<u8", docs).astype(np.int64)
        self.rules = take("<u4", 2 * rules).reshape(-1, 2).astype(np.int64)
        self.lengths = take("<u8", rules).astype(np.int64)
        self.symbols = take("<u4", symbols).astype(np.int64)
        size = np.ones(symbols, np.int64)
        big = self.symbols >= FIRST_RULE
        size[big] = self.lengths[self.symbols[big] - FIRST_RULE]
        self.ends = np.cumsum(size)

    def ids(self, lo: int = 0, hi: int | None = None) -> np.ndarray:
        """Ids ``lo`` to ``hi`` of the shard; only the symbols that cover them are expanded."""
        hi = self.n_ids if hi is None else min(hi, self.n_ids)
        if lo >= hi:
            return np.zeros(0, np.int64)
        a, b = np.searchsorted(self.ends, lo, "right"), np.searchsorted(self.ends, hi, "left") + 1
        before = int(self.ends[a - 1]) if a else 0
        return expand(self.symbols[a:b], self.rules)[lo - before : hi - before]

    def document(self, i: int) -> np.ndarray:
        """Ids of the ``i``-th document, end id included."""
        end = int(self.counts[: i + 1].sum())
        return self.ids(end - int(self.counts[i]), end)


# -------------------------------------------------------------------------------------- operator


def write_shards(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", shard_ids: int = SHARD_IDS) -> DataFrame:
    """The written table of shards: (``range``, ``shard``, ``n_docs``, ``n_ids``, ``payload``), in ascending order of ids.

    Null texts are empty (one end id); null ids come first; rows with the same id are ordered by text hash.
    A text is never split: a very long one is a shard of its own. An empty table gives no shards.
    """
    n = shuffle_partitions(docs.sparkSession)
    marks = range_marks(docs, id_col, n)
    rows = docs.select(ranges_of(F.col(id_col), marks).alias("range"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    dealt = rows.repartitionById(n, F.col("range") % n).sortWithinPartitions("range", F.asc_nulls_first("id"), F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        names = ["range", "shard", "n_docs", "n_ids", "payload"]
        held: list = []  # (id, number of ids, ids) of the shard being filled
        here, shard, filled = None, 0, 0

        def flush() -> pa.RecordBatch:
            ids = np.concatenate([x[2] for x in held])
            raw = pack([x[0] for x in held], np.array([x[1] for x in held]), ids)
            return pa.RecordBatch.from_arrays(
                [pa.array([here], pa.int32()), pa.array([shard], pa.int64()), pa.array([len(held)], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([raw], pa.binary())],
                names=names,
            )

        for b in batches:
            sizes, at = text_buffers(b.column(2))[1], 0
            while at < b.num_rows:
                here_on = max(1, int(np.searchsorted(sizes, sizes[at] + BATCH_BYTES, "right")) - 1 - at)
                some = b.slice(at, here_on)
                at += here_on
                ranges, doc_ids = some.column(0).to_pylist(), some.column(1).to_pylist()
                ids, counts = encode(some.column(2))
                cuts = np.r_[0, np.cumsum(counts)]
                for i, (r, d) in enumerate(zip(ranges, doc_ids)):
                    if held and (r != here or filled + counts[i] > shard_ids):
                        yield flush()
                        held, filled = [], 0
                        shard += 1
                    if r != here:
                        here, shard = r, 0
                    held.append((d, int(counts[i]), ids[cuts[i] : cuts[i + 1]]))
                    filled += int(counts[i])
        if held:
            yield flush()

    return written(dealt.mapInArrow(run, "range int, shard long, n_docs long, n_ids long, payload binary"), "token-shards")


def read_documents(shards: DataFrame) -> DataFrame:
    """(``doc_id``, ``start``, ``n_tokens``, ``ids_crc32``) of every document, decoded from the shards."""
    place = shards.select("range", "shard", "n_ids")  # one narrow row for each shard
    ranges = place.groupBy("range").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    ranges = ranges.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("range").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = place.select("range", "shard", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("inside")).join(ranges, "range")
    starts = starts.select("range", "shard", (F.col("base") + F.col("inside")).alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r, number, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                shard = Shard(raw.as_py())
                ids = shard.ids().astype("<u4")
                ends = np.cumsum(shard.counts)
                firsts = ends - shard.counts
                crc = [zlib.crc32(ids[a:e]) for a, e in zip(firsts.tolist(), ends.tolist())]
                n = len(firsts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, r, np.int32)), pa.array(np.full(n, number)), pa.array(shard.doc_ids, pa.int64()), pa.array(firsts), pa.array(shard.counts), pa.array(crc, pa.int64())],
                    names=["range", "shard", "doc_id", "first", "n_tokens", "ids_crc32"],
                )

    # decoded where they are read; narrow rows, not payloads, meet the starts
    read = shards.select("range", "shard", "payload").mapInArrow(run, "range int, shard long, doc_id long, first long, n_tokens long, ids_crc32 long")
    return read.join(starts, ["range", "shard"]).select("doc_id", (F.col("start") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")
