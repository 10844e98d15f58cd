"""Line dedup, mixing and sharding: brute force, edge rows, clashing names."""

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from filingflow.llm import line_dedup, mixing, sharding


def own(df, *names):
    for n in names:
        df = df.withColumn(n, F.lit("own"))
    return df


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def test_lines_match_brute_force(make_docs):
    texts = ["Head\nbody %d\n  FOOT \n" % i for i in range(12)] + ["État\n" * 3, "foot", "\thead\x0b\nfoot\nrest", "", None, "\n\n", "body 1\nfoot"]
    docs = make_docs(list(enumerate(texts)))
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs, min_docs=5).collect()}
    key = lambda x: lower(x.strip(" \t\n\x0b\x0c\r"))
    n = Counter(k for t in texts for k in {key(x) for x in (t or "").split("\n")} if k)
    for i, t in enumerate(texts):
        lines = (t or "").split("\n")
        kept = [x for x in lines if n[key(x)] < 5]
        assert (got[i]["n_lines"], got[i]["n_dropped"], got[i]["kept_text"]) == (len(lines), len(lines) - len(kept), "\n".join(kept)), t


def test_lines_odd_rows(odd_docs, no_docs):
    got = line_dedup.dedup_lines(own(odd_docs, "kept_text", "N_LINES", "extra"), min_docs=2).collect()
    assert len(got) == odd_docs.count()
    assert all(r["kept_text"] == "" and r["n_dropped"] == 0 and r["n_lines"] == 1 for r in got if r["text"] in (None, ""))
    assert {r["n_dropped"] for r in got if r["doc_id"] == 4} == {2} and {r["extra"] for r in got} == {"own"}
    assert line_dedup.dedup_lines(no_docs).collect() == []


def test_lines_of_one_document_count_once(make_docs):
    docs = make_docs([(1, "mine\nboth")] * 12 + [(1, "mine\nother")] + [(i, f"both\nown {i}") for i in range(2, 5)] + [(None, "none")] * 9)
    got = line_dedup.dedup_lines(docs, min_docs=4).collect()
    assert {(r["doc_id"], r["kept_text"]) for r in got} == {(1, "mine"), (1, "mine\nother"), *[(i, f"own {i}") for i in range(2, 5)], (None, "none")}
    assert len(got) == docs.count()


def brute_targets(sizes, budget=1.5, cap=2.0, weights=(5, 2, 1)):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    left, total, out = set(order), budget * sum(sizes.values()), {}
    while left:
        share = {s: total * w[s] / sum(w[x] for x in left) for s in left}
        over = [s for s in left if share[s] >= cap * sizes[s]]
        if not over:
            out |= share
            break
        for s in over:
            out[s] = cap * sizes[s]
            total -= out[s]
            left.remove(s)
    return out


def test_mixing_targets_and_copies(make_docs):
    rng = np.random.default_rng(3)
    docs = make_docs([(i, " ".join("w" * 3 for _ in range(int(rng.integers(0, 40)))), None, f"s{int(rng.integers(0, 9)) ** 2 % 7}" if i % 11 else None) for i in range(600)])
    plan = mixing.mix_plan(docs).collect()
    sizes = Counter()
    for r in plan:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
        sizes[r["source"]] += r["size"]
    want = brute_targets(dict(sizes))
    taken = Counter()
    for r in plan:
        assert math.isclose(r["target"], want[r["source"]], rel_tol=1e-9) and r["source_size"] == sizes[r["source"]]
        rate = r["target"] / r["source_size"]
        assert r["copies"] in (math.floor(rate), math.floor(rate) + 1) and r["copies"] <= 2
        taken[r["source"]] += r["copies"] * r["size"]
    assert all(abs(taken[s] - want[s]) < 0.05 * want[s] for s in sizes)
    assert sorted((r["doc_id"], r["copies"]) for r in plan) == sorted((r["doc_id"], r["copies"]) for r in mixing.mix_plan(docs.repartition(7)).collect())
    mixed = Counter(r["doc_id"] for r in mixing.mix(docs).collect())
    assert all(mixed[r["doc_id"]] == r["copies"] for r in plan)


def test_mixing_rows_without_an_id_draw_by_their_texts(make_docs):
    docs = make_docs([(None if i % 3 == 0 else 7 if i % 3 == 1 else i, f"text {i} " + "w " * (i % 30), None, "ab"[i % 2]) for i in range(400)])
    plan = mixing.mix_plan(docs).collect()
    for s in "ab":
        rows = [r for r in plan if r["source"] == s]
        assert abs(sum(r["copies"] * r["size"] for r in rows) - rows[0]["target"]) < 0.05 * rows[0]["target"]
        rate = rows[0]["target"] / rows[0]["source_size"]
        for key in (None, 7):  # no id moves as a block
            hot = [r["copies"] - math.floor(rate) for r in rows if r["doc_id"] == key]
            assert rate == math.floor(rate) or 0 < sum(hot) < len(hot)


def test_mixing_odd_rows(odd_docs, no_docs, make_docs):
    plan = mixing.mix_plan(own(odd_docs, "extra")).collect()
    assert len(plan) == odd_docs.count()
    assert all(r["size"] == 0 for r in plan if not (r["text"] or "").strip())
    assert mixing.mix(own(odd_docs, "Size", "copies")).columns == [*odd_docs.columns, "Size", "copies"]
    assert mixing.mix_plan(no_docs).collect() == [] and mixing.mix(no_docs).collect() == []
    blank = mixing.mix_plan(make_docs([(1, "", "en", "a"), (2, None, "en", "b")])).collect()
    assert all(r["target"] == 0 and r["copies"] == 0 for r in blank)


def jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash():
    keys = np.random.default_rng(1).integers(0, 1 << 63, 500, dtype=np.uint64)
    for n in (1, 2, 8, 9, 100):
        assert sharding.jump_hash(keys, n).tolist() == [jump(int(k), n) for k in keys]
    a, b = sharding.jump_hash(keys, 8), sharding.jump_hash(keys, 9)
    assert set(b[a != b].tolist()) == {8} and 20 < (a != b).sum() < 100


def test_shards(odd_docs, no_docs, make_docs):
    docs = make_docs([(i % 500, f"text {i}") for i in range(3000)])
    got = sharding.shard_documents(docs, 8).collect()
    assert len(got) == 3000 and len({(r["doc_id"], r["shard"]) for r in got}) == 500
    for s in range(8):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert all(r["grown_shard"] in (r["shard"], 8) for r in got)
    odd = sharding.shard_documents(own(odd_docs, "slot", "shard"), 8).collect()
    assert len(odd) == odd_docs.count()
    assert {(r["size"], r["text_crc32"]) for r in odd if r["doc_id"] == 1} == {(1, 0)}
    assert len({r["shard"] for r in odd if r["doc_id"] is None}) == 1
    assert sharding.shard_documents(no_docs).collect() == []


def test_one_key_with_most_rows(make_docs):
    got = sharding.shard_documents(make_docs([(1, "same")] * 2000 + [(i, "x") for i in range(50)]), 8).collect()
    hot = [r["slot"] for r in got if r["doc_id"] == 1 and r["size"] == 5]
    assert len(set(hot)) == 2000
    # ids, not contents, decide
    assert sharding.shard_documents(make_docs([(1, "other")]), 8).first()["shard"] == next(r["shard"] for r in got if r["doc_id"] == 1)


def test_lines_many_lost_in_one_text(make_docs):
    """200,000 lines, half of them lost: reassembly is linear in the lines."""
    import time

    shared = [f"shared {i}" for i in range(100_000)]
    text = "\n".join(x for i, s in enumerate(shared) for x in (s, f"own {i}"))
    began = time.time()
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(make_docs([(1, text), (2, "\n".join(shared))]), min_docs=2).collect()}
    assert got[1]["kept_text"] == "\n".join(f"own {i}" for i in range(100_000)) and got[1]["n_dropped"] == 100_000
    assert got[2]["kept_text"] == "" and got[2]["n_dropped"] == 100_000 and time.time() - began < 60
