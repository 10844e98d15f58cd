"""SimHash, suffix arrays, fingerprints and decontamination against brute force."""

import hashlib
import re
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from filingflow.llm import decontamination, fingerprints, simhash, suffix_dedup
from filingflow.llm.common import joined_bytes


def own(df, *names):
    for n in names:
        df = df.withColumn(n, F.lit("own"))
    return df


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def brute_simhash(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps, d=3):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= d:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def near_texts(n=60):
    rng = np.random.default_rng(5)
    base = [" ".join(f"w{int(x)}" for x in rng.integers(0, 900, 200)) for _ in range(8)]
    out = []
    for _ in range(n):
        words = base[int(rng.integers(0, 8))].split()
        for _ in range(int(rng.integers(0, 3))):
            words[int(rng.integers(0, 200))] = f"e{int(rng.integers(0, 99))}"
        out.append(" ".join(words))
    return out


def test_simhash_matches_brute_force(make_docs):
    texts = [*near_texts(), "", None, "One", "one two", "ONE two", " \n", "one two three"]
    got = {r["doc_id"]: r for r in simhash.near_duplicates(make_docs(list(enumerate(texts)))).collect()}
    fps = [brute_simhash(t) for t in texts]
    roots = brute_components(fps)
    assert [(got[i]["fingerprint"], got[i]["component_id"]) for i in range(len(texts))] == [(f"{f:016x}", r) for f, r in zip(fps, roots)]


def test_gray_index_finds_all_links():
    rng = np.random.default_rng(2)
    centres = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = np.unique(np.array([c ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, int(rng.integers(1, 6)), dtype=np.uint64)) for c in centres for _ in range(30)]))
    key = (fps >> np.uint64(63)).astype(np.uint64)
    a, b = simhash.links_of(key, fps, 3)
    same = [(x, y) for x, y in zip(a, b)]
    parent = {int(f): int(f) for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in same:
        parent[find(int(y))] = find(int(x))
    want = brute_components([int(f) | int(k) * (0xFF << 70) for f, k in zip(fps, key)])
    classes = {}
    for f, r in zip(fps, want):
        classes.setdefault(r, set()).add(find(int(f)))
    assert all(len(c) == 1 for c in classes.values()) and len({next(iter(c)) for c in classes.values()}) == len(classes)


def test_hot_keys_are_dealt_again(spark, monkeypatch):
    monkeypatch.setattr(simhash, "KEY_ROWS", 4)
    rng = np.random.default_rng(8)
    fps = sorted({int(rng.integers(0, 4)) << 40 | 1 << int(rng.integers(0, 60)) for _ in range(120)})
    links = simhash.find_links(spark.createDataFrame([(f,) for f in fps], "__fp long"), 3).collect()
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in links:
        assert (r["a"] ^ r["b"]).bit_count() <= 64
        parent[find(r["b"])] = find(r["a"])
    want = brute_components(fps)
    assert len({find(f) for f in fps}) == len(set(want))


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 40)] + [(100, 102), (102, 101), (7, 7)]
    got = dict(simhash.components(spark.createDataFrame(chain, "a long, b long")).collect())
    assert got == {i: 1 for i in range(1, 41)} | {100: 100, 101: 100, 102: 100}


def test_simhash_odd_rows(odd_docs, no_docs):
    got = simhash.near_duplicates(own(odd_docs, "fingerprint", "component_id")).collect()
    assert len(got) == odd_docs.count()
    assert {r["fingerprint"] for r in got if r["doc_id"] in (1, 2, 3)} == {"0" * 16}
    kept = simhash.keep_representatives(own(odd_docs, "extra"))
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in kept.collect())
    assert kept.columns == [*odd_docs.columns, "extra"]
    assert sum(i[1] == 4 for i in ids) == 1 and sum(i[1] == 5 for i in ids) == 1 and not any(i[1] in (2, 3) for i in ids)
    assert simhash.near_duplicates(no_docs).collect() == [] and simhash.keep_representatives(no_docs).collect() == []


# ------------------------------------------------------------------------------------ suffix array


def test_suffix_array_matches_sorting():
    rng = np.random.default_rng(0)
    for _ in range(400):
        t = rng.integers(0, int(rng.integers(1, 5)) + 1, int(rng.integers(1, 40)))
        assert suffix_dedup.suffix_array(t).tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())


def brute_repeats(texts, length):
    raw = [(t or "").encode() for t in texts]
    n = Counter(b[o : o + length] for b in raw for o in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for o in range(len(b) - length + 1):
            if n[b[o : o + length]] > 1:
                gone[o : o + length] = True
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def repeat_texts():
    rng = np.random.default_rng(4)
    pool = "".join(chr(int(c)) for c in rng.integers(97, 123, 400)) + "äöü" * 20
    out = ["ab" * 60, "é" * 90, None, "", "short"]
    for _ in range(40):
        parts = []
        for _ in range(int(rng.integers(1, 5))):
            a = int(rng.integers(0, 300))
            parts.append(pool[a : a + int(rng.integers(10, 160))] if rng.random() < 0.6 else "".join(chr(int(c)) for c in rng.integers(97, 123, 60)))
        out.append("".join(parts))
    return out + out[-2:]


def check_repeats(make_docs):
    texts = repeat_texts()
    cut = suffix_dedup.remove_repeats(own(make_docs(list(enumerate(texts))), "spans"), length=64, gram=16)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], len(r["spans"]), r["kept_sha256"]) for r in cut.collect()}
    assert [got[i] for i in range(len(texts))] == brute_repeats(texts, 64)


def test_repeats_match_brute_force(make_docs):
    check_repeats(make_docs)


def test_large_groups_match_brute_force(make_docs, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "GROUP_SEGMENTS", 1)
    check_repeats(make_docs)


def test_long_texts_are_hashed_in_pieces(make_docs, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 100)
    rng = np.random.default_rng(11)
    texts = ["".join(chr(int(c)) for c in rng.integers(97, 99 + i, 700)) for i in range(4)]
    texts += [texts[1][100:400] + texts[2][250:600], texts[3], "ab" * 300]
    data, off = joined_bytes([t.encode() for t in texts])
    whole = {(i, int(p)) for i, pos, *_ in suffix_dedup.anchors(data, off, 64, 16) for p in pos}
    pieces = {(i, int(p)) for i, t in enumerate(texts) for p in suffix_dedup.long_anchors(np.frombuffer(t.encode(), np.uint8), 64, 16)[0]}
    assert whole == pieces
    segments, at, src = [], [], []
    for i, t in enumerate(texts):
        raw = t.encode()
        pos, first, *_ = suffix_dedup.long_anchors(np.frombuffer(raw, np.uint8), 64, 16)
        last = np.r_[first[1:], len(raw) - 63] - 1
        for p, a, b in zip(pos.tolist(), first.tolist(), last.tolist()):
            segments.append(raw[a : b + 64])
            at.append(p - a)
            src.append((i, a))
    found = {(i, a + int(o)) for (i, a), f in zip(src, suffix_dedup.repeated_windows(segments, at, 64)) for o in np.flatnonzero(f)}
    n = Counter(t[o : o + 64] for t in texts for o in range(len(t) - 63))
    assert found == {(i, o) for i, t in enumerate(texts) for o in range(len(t) - 63) if n[t[o : o + 64]] > 1}


def test_repeats_odd_rows(odd_docs, no_docs):
    got = suffix_dedup.remove_repeats(odd_docs, length=32, gram=16).collect()
    assert len(got) == odd_docs.count()
    assert all(r["n_removed"] == r["n_bytes"] for r in got if r["doc_id"] == 4)
    assert all(r["n_bytes"] == 0 and r["spans"] == [] for r in got if r["doc_id"] in (1, 2))
    assert suffix_dedup.remove_repeats(no_docs).collect() == []


# ------------------------------------------------------------------------------------ fingerprints


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def test_sketch_estimates():
    words = [f"w{i}" for i in range(5000)]
    a = " ".join(words[:3000])
    b = " ".join(words[1000:4000])
    x, y = fingerprints.sketches(*joined_bytes([a.encode(), b.encode()]))
    truth = len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))
    assert abs(fingerprints.resemblance(x, y) - truth) < 0.15
    assert abs(fingerprints.containment(x, y) - len(shingles(a) & shingles(b)) / len(shingles(a))) < 0.2
    assert abs(fingerprints.distinct(x) - 2996) < 900
    whole = fingerprints.sketches(*joined_bytes([(" ".join(words[:2004])).encode()]))[0]
    parts = fingerprints.sketches(*joined_bytes([" ".join(words[:1004]).encode(), " ".join(words[1000:2004]).encode()]))
    assert fingerprints.merge(*parts).tolist() == whole.tolist()
    assert fingerprints.from_text(fingerprints.to_text(x)).tolist() == x.tolist()


def test_small_sketches_are_exact(make_docs):
    texts = near_texts(20) + ["", None, "a b", "A  b\n", "a b c d e f", "x a b c d e f"]
    pairs = [(a or "", b or "") for a in texts for b in texts]
    for a, b in pairs[:400] + pairs[-60:]:
        x, y = fingerprints.sketches(*joined_bytes([a.encode(), b.encode()]), k=1000)
        j = len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b)) if shingles(a) | shingles(b) else 1.0
        assert fingerprints.resemblance(x, y, 1000) == j


def test_edited_texts(make_docs, odd_docs, no_docs):
    texts = {i * 3 - 10: t for i, t in enumerate([*near_texts(30), "", None, "é" * 10, "one"])}
    got = {r["doc_id"]: r for r in fingerprints.edit_likeness(make_docs(list(texts.items()))).collect()}
    order = sorted(texts, reverse=True)
    for i, d in enumerate(order):
        t, nxt = texts[d] or "", texts[order[(i + 1) % len(order)]] or ""
        m = len(t) // 3
        edited = t[: len(t) - m] + nxt[:m]
        r = got[d]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r["near_edited"] <= 1 and (r["fingerprint"] == r["edited_fingerprint"]) <= (r["near_edited"] == 1.0)
    assert len({got[d]["fingerprint"] for d in order if not (texts[d] or "").strip()}) == 1
    assert fingerprints.edit_likeness(odd_docs).count() == odd_docs.count()
    assert fingerprints.edit_likeness(no_docs).collect() == []
    one = fingerprints.edit_likeness(make_docs([(5, "a b c d e f g h i")])).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0


def test_merge_sketches(make_docs):
    docs = make_docs([(i, t, None, f"s{i % 3}") for i, t in enumerate(near_texts(12) + [""])])
    got = {r["source"]: list(r["sketch"]) for r in fingerprints.merge_sketches(fingerprints.with_sketch(docs, k=64), ["source"], k=64).collect()}
    by = {}
    for r in docs.collect():
        by.setdefault(r["source"], []).append(fingerprints.sketches(*joined_bytes([r["text"].encode()]), k=64)[0])
    assert got == {s: np.unique(np.concatenate(x))[:64].astype(np.int64).tolist() for s, x in by.items()}


# ---------------------------------------------------------------------------------- decontamination


def words(t):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or "")) if w]


def test_decontamination_matches_brute_force(make_docs, spark):
    rng = np.random.default_rng(6)
    vocab = [f"v{i}" for i in range(40)]
    say = lambda n: " ".join(vocab[int(i)] for i in rng.integers(0, 40, n))
    items = [(10, say(25)), (9, say(14)), (2, "Short, item!"), (3, None), (4, "..."), (5, say(10)), (6, None)]
    items.append((11, items[0][1]))
    texts = [say(30) for _ in range(10)] + [None, "", "short-ITEM", say(5) + " short item " + say(5)]
    texts += [say(3) + ". " + items[0][1].upper() + "! " + say(2), items[1][1][:-3], " ".join([items[5][1]] * 2)]
    found = decontamination.decontaminate(
        own(make_docs(list(enumerate(texts))), "items", "N_Words"), spark.createDataFrame(items, "item_id long, text string"), n=10
    )
    got = {r["doc_id"]: r for r in found.collect()}
    for i, t in enumerate(texts):
        w, hit, names = words(t), set(), set()
        for k, item in items:
            iw = words(item)
            n = min(10, len(iw))
            for a in range(len(iw) - n + 1 if n else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == iw[a : a + n]:
                        hit |= set(range(p, p + n))
                        names.add(str(k))
        r = got[i]
        assert (r["n_words"], r["n_hit"], r["items"]) == (len(w), len(hit), sorted(names)), (i, t)
        assert sum(s["end"] - s["start"] for s in r["spans"]) == len(hit)


def test_decontamination_odd_rows(odd_docs, no_docs, spark):
    items = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog again and again"), (None, "and so")], "item_id long, text string")
    none = items.where("item_id = 77")
    got = decontamination.decontaminate(odd_docs, items).collect()
    assert len(got) == odd_docs.count() and {r["n_hit"] > 0 for r in got if r["doc_id"] == 4} == {True}
    assert all(r["n_hit"] == 0 for r in decontamination.decontaminate(odd_docs, none).collect())
    assert decontamination.decontaminate(no_docs, items).collect() == []
    clean = decontamination.drop_contaminated(own(odd_docs, "__w2"), items)
    assert clean.columns == [*odd_docs.columns, "__w2"] and clean.where("doc_id = 4").count() == 0 and clean.where("doc_id = 8").count() == 1
    assert decontamination.drop_contaminated(no_docs, none).collect() == []
