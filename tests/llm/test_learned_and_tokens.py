"""Language identification, quality, token shards: gradients, held-out accuracy, round trips; the pipeline."""

import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from filingflow.llm import language_id, quality, token_store
from filingflow.llm.common import load
from filingflow.llm.queries import QUERIES

BPE = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.01"
SF_SMALL = "/root/testdata/sf0.001"


def own(df, *names):
    for n in names:
        df = df.withColumn(n, F.lit("own"))
    return df


# ---------------------------------------------------------------------------------------- language


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    net = language_id.Network(["a", "b", "c"], 3, 1)
    b, label = rng.integers(0, 256, (7, 5)).astype(np.uint8), rng.integers(0, 3, 5)
    _, grads = net.gradients(b, label)
    for w, g in zip(net.weights(), grads):
        for _ in range(4):
            i = tuple(int(rng.integers(0, n)) for n in w.shape)
            i = (int(b[0, 0]), *i[1:]) if w.shape[0] == 256 else i
            keep = w[i]
            w[i] = keep + 1e-5
            up, _ = net.gradients(b, label)
            w[i] = keep - 1e-5
            down, _ = net.gradients(b, label)
            w[i] = keep
            assert abs((up - down) / 2e-5 - g[i]) < 1e-6


def test_reader_matches_training_form():
    rng = np.random.default_rng(1)
    net = language_id.Network(["a", "b"], 4, 2)
    reader = language_id.Reader(net)
    text = rng.integers(97, 123, 300).astype(np.uint8)
    best, score, share = reader.documents(text, np.array([0, 300, 300]))
    total, hits = np.zeros(2), np.zeros(2)
    for a in range(0, 300, reader.LENGTH):
        b = text[a : a + reader.LENGTH][:, None]
        f, _ = net.ahead.forward(b)
        r, _ = net.back.forward(b[::-1])
        z = np.concatenate([f, r[::-1]], axis=2) @ net.v + net.c
        p = np.exp(z) / np.exp(z).sum(axis=2, keepdims=True)
        total += p.sum(axis=(0, 1))
        hits += np.bincount(p[:, 0].argmax(axis=1), minlength=2)
    assert best[0] == total.argmax() and abs(score[0] - total.max() / 300) < 1e-4 and abs(share[0] - hits[best[0]] / 300) < 0.02
    assert score[1] == 0


def test_languages_held_out(spark):
    got = QUERIES["op2_language_id"](spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = got.join(docs, "doc_id").collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    assert np.mean([r["lang_pred"] == r["lang"] for r in held if r["lang"]]) > 0.97


def test_language_odd_rows(odd_docs, no_docs, make_docs):
    got = language_id.identify(own(odd_docs, "score"), language_id.Training(steps=5)).collect()
    assert len(got) == odd_docs.count()
    assert all((r["lang_pred"], r["score"]) == ("und", 0.0) for r in got if r["doc_id"] in (1, 2, 3, 6))
    assert all(r["lang_pred"] in ("en", "de") for r in got if r["doc_id"] in (4, 7, 8))
    assert language_id.identify(no_docs).collect() == []
    unknown = language_id.identify(make_docs([(1, "no labels here")])).collect()
    assert unknown[0]["lang_pred"] == "und"


def test_every_language_is_learned(make_docs):
    pairs = [(a, b) for a in "bcdfghjklm" for b in "nprstvwxz"][:80]
    rows = [(80 * j + i, " ".join((a + v + b + v) * 2 for v in "aeiou"[j % 4 :] * 3), f"l{i:02}") for i, (a, b) in enumerate(pairs) for j in range(4)]
    docs = make_docs(rows)
    net = language_id.learn(docs, language_id.Training(), F.lit(True), "doc_id", "text", "lang")
    assert net.langs == sorted({r[2] for r in rows})
    got = language_id.label_languages(docs, net).where("lang >= 'l64'").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in got]) > 0.8


def test_sample_is_shared_and_keeps_rare_languages(make_docs):
    draw = language_id.row_draw(F.col("doc_id"), F.col("text"), 1)
    docs = make_docs([(None, f"text {i}", "big") for i in range(900)] + [(1, "same", "big")] * 300 + [(None, "only", "rare")] * 3)
    got = language_id.least_draws(docs, F.col("lang"), draw, lambda n: 80 // n, F.col("text")).collect()
    assert sorted(r["kind"] for r in got) == ["big"] * 40 + ["rare"]
    every = sorted({(r["d"]) for r in docs.where("lang = 'big'").select(draw.alias("d")).collect()})
    assert sorted(r["draw"] for r in got if r["kind"] == "big") == every[:40]


# ----------------------------------------------------------------------------------------- quality


def test_risk_gradient_and_non_negativity():
    rng = np.random.default_rng(3)
    pos = rng.normal(1, 1, (300, quality.SIZE)).astype(np.float32)
    neg = rng.normal(-1, 1, (300, quality.SIZE)).astype(np.float32)
    unl = np.concatenate([pos[:150] + 0.1, neg])
    model = quality.fit(pos, unl, 1 / 3, quality.Training(steps=200))
    assert (model.score(pos) > 0.5).mean() > 0.95 and (model.score(neg) < 0.5).mean() > 0.95


def test_quality_held_out(spark):
    got = QUERIES["op8_quality"](spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = got.join(labels, "doc_id").collect()
    assert got.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    assert np.mean([r["predicted"] == r["quality"] for r in held]) > 0.95


def test_both_branches_of_the_risk_have_its_gradient():
    """One step from zero weights moves along minus the gradient of the risk that the branch minimises."""
    rng = np.random.default_rng(5)
    pos, unl = rng.normal(0.4, 1, (40, quality.SIZE)), rng.normal(-0.2, 1, (60, quality.SIZE))
    for prior in (0.2, 0.9):  # the second clips: the unlabelled risk is less than the positives' share of it
        w0 = rng.normal(0, 0.01, quality.SIZE + 1) + (0 if prior < 0.5 else 0.3 * np.r_[pos.mean(axis=0) - unl.mean(axis=0), 0])
        value, got = quality.risk(pos, unl, w0, prior)
        clipped = quality.negative_risk(pos, unl, w0, prior) < 0
        assert clipped == (prior > 0.5)
        for k in (0, 7, quality.SIZE):
            step = np.zeros(quality.SIZE + 1)
            step[k] = 1e-5
            f = (lambda w: -quality.negative_risk(pos, unl, w, prior)) if clipped else (lambda w: quality.risk(pos, unl, w, prior)[0])
            assert abs((f(w0 + step) - f(w0 - step)) / 2e-5 - got[k]) < 1e-5


def test_prior_is_estimated_from_positives_and_unlabelled_rows():
    rng = np.random.default_rng(6)
    for share in (0.3, 0.6, 0.85):
        pos = rng.normal(0.25, 1, (800, quality.SIZE)).astype(np.float32)
        mixed = np.where(rng.random(1600)[:, None] < share, 0.25, -0.25) + rng.normal(0, 1, (1600, quality.SIZE))
        assert abs(quality.estimate_prior(pos, mixed.astype(np.float32), quality.Training()) - share) < 0.1


def test_prior_is_near_the_share_of_labels(spark):
    docs, labels = load(spark, SF, "documents"), load(spark, SF, "labels").select("doc_id", "quality")
    model = quality.learn(docs.select("doc_id", "text"), labels, quality.Training(), 3, 1, "doc_id", "text", "quality")
    share = labels.agg(F.avg("quality")).first()[0]
    assert abs(model.prior - share) < 0.12


def test_quality_samples_are_bounded_with_hot_and_null_ids(make_docs, spark):
    rows = [(7, f"hot words number {i}") for i in range(400)] + [(None, f"no id {i}") for i in range(400)] + [(i, f"plain {i}") for i in range(100, 200)]
    labels = spark.createDataFrame([(7, 1), (None, 1), (101, 1)], "doc_id long, quality int")
    sizes, real = [], quality._collect
    try:
        quality._collect = lambda d, c: sizes.append(d.count()) or real(d, c)
        how = quality.Training(positives=50, unlabelled=60, steps=5)
        assert quality.learn(make_docs(rows).select("doc_id", "text"), labels, how, 3, 5, "doc_id", "text", "quality")
    finally:
        quality._collect = real
    assert sizes == [50, 60]


def test_quality_odd_rows(odd_docs, no_docs, spark):
    labels = spark.createDataFrame([(4, 1), (8, 1), (6, 0), (5, None), (99, 1)], "doc_id long, quality int")
    got = quality.classify(own(odd_docs, "extra"), labels, quality.Training(steps=5)).collect()
    assert len(got) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (1, 2)}) == 1
    assert quality.classify(no_docs, labels).collect() == []
    assert {r["score"] for r in quality.classify(odd_docs, labels.where("quality = 7")).collect()} == {0.5}


# ------------------------------------------------------------------------------------------ tokens


def test_encoder_equals_the_tokenizer():
    whole = Tokenizer.from_file(BPE)
    texts = ["  a  b ", "x<|endoftext|> y", "a\n\n b \n  c\t\n", "it's  o'k 's", " lead", "", "a b   c", "\n", "a \n", "Ünï 漢字 😀 x", "a b c a b c", "it's o'shop 'tis .'s don't've", "a1b2 3.5% x-y_z (q). ñé\nÀb", "ałb c²d µx", "tab\there", "nbsp\u00a0x", "a\x00b", "e\u0301x y", "×÷ a×b"]
    encode = token_store.Encoder(BPE)
    for _ in range(2):
        ids, counts = encode(texts)
        want = [[*whole.encode(t, add_special_tokens=False).ids, 0] for t in texts]
        assert ids.tolist() == [x for w in want for x in w] and counts.tolist() == [len(w) for w in want]


def test_encoder_cuts_only_where_the_tokenizer_does():
    whole, rng = Tokenizer.from_file(BPE), np.random.default_rng(11)
    odd = ["\u0085", "\u00a0", "\u1680", "\u180e", "\u2003", "\u200b", "\u2019", "\u2028", "\u202f", "\u205f", "\u2071", "\u3000", "\ufeff", "\x00", "\x0b", "\x0c", "\x1c", "\x7f"]
    signs = [*"aBz09.-'\" \n\t\rsté×÷łƻɏɐµª²漢😀жא٣ǅʰ", *odd, "'s", "'ll", "  ", "\n\n", " a", " don't", "<|endoftext|>"]
    encode = token_store.Encoder(BPE)
    for _ in range(40):
        texts = ["".join(rng.choice(signs, rng.integers(0, 30))) for _ in range(100)]
        ids, counts = encode(texts)
        want = [[*e.ids, 0] for e in whole.encode_batch_fast(texts, add_special_tokens=False)]
        assert ids.tolist() == [x for w in want for x in w] and counts.tolist() == [len(w) for w in want]


def test_pieces_reach_the_tokenizer_once():
    class Counting:
        def __init__(self, inner):
            self.inner, self.calls, self.pieces = inner, 0, 0

        def encode_batch_fast(self, texts, **how):
            self.calls += 1
            self.pieces += sum(len(t) if isinstance(t, list) else 1 for t in texts)
            return self.inner.encode_batch_fast(texts, **how)

    encode = token_store.Encoder(BPE)
    encode.tokenizer = count = Counting(encode.tokenizer)
    texts = ["two  blanks\tand tabs\r\n", " zażółć gęślą\n\njaźń ", "“quoted” words — it's 1234, 漢字 and 😀 blanks", "a<|endoftext|>b"]
    first = encode(texts)
    assert count.calls == 1
    again = encode([t for t in texts for _ in range(3)])
    assert count.calls == 1 and count.pieces == len(encode.places) - 1
    assert np.array_equal(again[1], np.repeat(first[1], 3))
    encode.MOST_BYTES = 10  # the cache starts anew
    assert [x.tolist() for x in encode(texts)] == [x.tolist() for x in first] and count.calls == 2
    encode.width = encode.width + 1  # ids that don't tell where pieces end: one by one
    assert [x.tolist() for x in encode(texts)] == [x.tolist() for x in first] and count.calls == 4


def test_later_rounds_count_changed_pairs_only(monkeypatch):
    counted, real = [], token_store._frequent
    monkeypatch.setattr(token_store, "_frequent", lambda seq, least, places=None: counted.append(len(seq) - 1 if places is None else len(places)) or real(seq, least, places))
    rng = np.random.default_rng(2)
    ids = np.concatenate([np.r_[rng.integers(1, 100_000, 500), np.arange(7, 7 + k % 9)] for k in range(90)]).astype(np.int32)
    symbols, rules, _ = token_store.compress(ids)
    assert len(counted) > 3 and sum(counted[1:]) < len(ids) // 10
    assert np.array_equal(token_store.expand(symbols, rules), ids)


def test_repair_round_trip_and_random_access():
    rng = np.random.default_rng(7)
    for ids in (rng.integers(0, 5, 3000), np.zeros(500, int), np.full(400, 7), np.array([3]), np.zeros(0, int), np.tile([4, 5, 6, 7], 300)):
        ids = ids.astype(np.int32)
        symbols, rules, lengths = token_store.compress(ids)
        assert np.array_equal(token_store.expand(symbols, rules), ids)
        counts = np.array([len(ids) // 3, len(ids) - len(ids) // 3])
        shard = token_store.Shard(token_store.pack([None, 5], counts, ids))
        assert shard.doc_ids == [None, 5]
        for _ in range(20):
            lo, hi = sorted(int(x) for x in rng.integers(0, len(ids) + 1, 2))
            assert shard.ids(lo, hi).tolist() == ids[lo:hi].tolist()
        assert shard.document(1).tolist() == ids[counts[0] :].tolist()
    assert len(token_store.compress(np.tile(np.array([4, 5, 6, 7], np.int32), 300))[0]) < 100


def test_pairs_of_one_slot_are_counted_apart():
    slots = {}
    for a in range(1, 2000):
        code = (a << 32) | (a + 1)
        slot = (((code ^ (code >> 32) * 0x9E3779B1) * 0x85EBCA6B) >> 15) & (token_store.SLOTS - 1)
        if slot in slots:
            break
        slots[slot] = a
    often, rare = slots[slot], a
    ids = [x for i in range(50) for x in (often, often + 1, 5000 + i)] + [rare, rare + 1]
    pairs, here, which = token_store._frequent(np.array(ids), 8)
    assert pairs.tolist() == [(often << 32) | (often + 1)] and here.tolist() == list(range(0, 150, 3)) and not which.any()


def test_repair_goes_on_until_no_pair_is_frequent():
    rng = np.random.default_rng(5)
    rare = np.concatenate([np.r_[rng.integers(1, 100_000, 500), 7, 8] for _ in range(60)])  # far under 2% of the places
    blocked = np.concatenate([np.arange(9), *[[a, 200, 201, 202, b] for a, b in rng.integers(300, 99_999, (9, 2))]])
    for ids in (rare, blocked, rng.integers(1, 60, 40_000)):
        symbols, rules, _ = token_store.compress(ids.astype(np.int32))
        _, times = np.unique((symbols[:-1] << 32) | symbols[1:], return_counts=True)
        assert len(rules) and times.max() < token_store.MIN_USES
        assert np.array_equal(token_store.expand(symbols, rules), ids)


def test_tokens_match_brute_force(spark):
    got = {r["doc_id"]: r for r in QUERIES["op7_token_ids"](spark, SF_SMALL).collect()}
    whole, start = Tokenizer.from_file(BPE), 0
    for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").orderBy("doc_id").collect():
        ids = [*whole.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        g = got.pop(r["doc_id"])
        assert (g["start"], g["n_tokens"], g["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert not got


def test_tokens_odd_rows(odd_docs, no_docs):
    rows = token_store.read_documents(token_store.write_shards(odd_docs, BPE, shard_ids=50)).orderBy("start").collect()
    assert len(rows) == odd_docs.count()
    assert [r["doc_id"] for r in rows] == sorted((r["doc_id"] for r in rows), key=lambda i: (i is not None, i or 0))
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(rows, rows[1:])) and rows[0]["start"] == 0
    assert token_store.read_documents(token_store.write_shards(no_docs, BPE)).collect() == []


# ---------------------------------------------------------------------------------------- pipeline


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontamination", "mixture", "shards"]
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, SF_SMALL).cache()
        if name != "shards":
            assert after.columns == docs.columns
        if name in ("language", "near_duplicates", "decontamination"):
            assert after.join(before, "doc_id", "left_anti").count() == 0
        if name == "near_duplicates":
            assert after.count() == after.select("doc_id").distinct().count() < before.count()
        before = after
    assert before.count() > 0


def test_pipeline_odd_rows(spark, odd_docs, no_docs):
    for start in (own(odd_docs, "score", "size", "__n"), no_docs):
        rows = start
        for name, stage in corpus_pipeline.STAGES:
            rows = stage(spark, rows, SF_SMALL)
            if name != "shards":
                assert rows.columns == start.columns
        ids = [r["doc_id"] for r in rows.collect()]
        assert not {1, 2, 3, 6} & set(ids)
