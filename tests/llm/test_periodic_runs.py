"""Periodic runs against a plain search of every period."""

import hashlib
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from filingflow.llm import periodic_runs, queries
from tests.conftest import SF_SMALL
from tests.llm.conftest import clash


def brute_runs(words, least=12):
    number = {x: i for i, x in enumerate(dict.fromkeys(words))}
    w, out = np.array([number[x] for x in words], np.int64), []
    for q in range(1, len(w) // 2 + 1):
        same = np.r_[False, w[q:] == w[:-q], False].astype(np.int8)
        edge = np.flatnonzero(np.diff(same))
        for s, e in zip(edge[::2].tolist(), edge[1::2].tolist()):
            n = e - s + q
            part = w[s : s + n]
            if n >= max(least, 2 * q) and not any(np.array_equal(part[p:], part[:-p]) for p in range(1, q) if q % p == 0):
                out.append((s, n, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(words) if i not in gone)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def random_texts(n):
    rng, out = random.Random(11), []
    for _ in range(n):
        ws = [str(rng.randrange(rng.choice([1, 2, 3, 40]))) for _ in range(rng.choice([0, 5, 12, 40, 120]))]
        for _ in range(rng.randint(0, 3)):
            if ws:
                p, s = rng.randint(1, max(1, len(ws) // 3)), rng.randrange(len(ws))
                ws = ws[:s] + ws[s : s + p] * rng.randint(2, 6) + ws[s + p :]
        out.append(rng.choice([" ", "\n", " \t "]).join(ws))
    return out


def test_runs_match_brute_force(make_docs):
    texts = random_texts(300)
    got = {r["doc_id"]: r for r in periodic_runs.collapse_runs(make_docs(list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        runs = brute_runs(words_of(t))
        assert [tuple(r) for r in got[i]["runs"]] == runs, t
        assert got[i]["collapsed"] == brute_collapsed(words_of(t), runs)


def test_other_least_lengths():
    for least in (2, 3, 5, 8, 13):
        for t in random_texts(60):
            (found, _), = periodic_runs._read_slice([t.encode()], least)
            assert found == brute_runs(words_of(t), least), (least, t)


def test_query_matches_brute_force(spark):
    got = {r["doc_id"]: r for r in queries.QUERIES["op13_periodic_runs"](spark, SF_SMALL).collect()}
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    planted = 0
    for d in docs:
        words, h = words_of(d["text"]), zlib.crc32(str(d["doc_id"]).encode())
        if h % 10 == 0 and words:
            n, g = len(words), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            planted += 1
        runs = brute_runs(words)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        r = got[d["doc_id"]]
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *best)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert r["runs_sha256"] == sha("".join(f"{s},{n},{q}\n" for s, n, q in runs))
        assert r["collapsed_sha256"] == sha(brute_collapsed(words, runs))
    assert len(got) == len(docs) and planted > 5


def test_odd_rows_and_clashing_names(odd_docs, no_docs):
    out = periodic_runs.collapse_runs(clash(odd_docs, "runs", "collapsed", "RUNS2", "__text"))
    rows = out.collect()
    assert len(rows) == odd_docs.count() and {"RUNS2", "__text", "lang"} <= set(out.columns) and out.columns.count("runs") == 1
    by_text = {r["text"]: r for r in rows}
    assert by_text[None]["runs"] == [] and by_text[None]["collapsed"] == "" and by_text[""]["collapsed"] == ""
    assert by_text["negative id"]["collapsed"] == "negative id"
    replaced = periodic_runs.collapse_runs(odd_docs.withColumnRenamed("text", "collapsed"), text_col="collapsed")
    assert sorted(r["collapsed"] for r in replaced.collect()) == sorted(r["collapsed"] for r in rows)
    assert periodic_runs.collapse_runs(no_docs).collect() == []


def test_very_long_texts(make_docs):
    same, blocks = "a " * 200_000, ("a " * 300 + "b ") * 300
    got = {r["doc_id"]: r for r in periodic_runs.collapse_runs(make_docs([(1, same), (2, blocks), (3, " ".join(map(str, range(200_000))))])).collect()}
    assert [tuple(r) for r in got[1]["runs"]] == [(0, 200_000, 1)] and got[1]["collapsed"] == "a"
    assert max(tuple(r)[1:] for r in got[2]["runs"]) == (300 * 301, 301) and len(got[2]["runs"]) == 301
    assert got[3]["runs"] == [] and got[3]["collapsed"].endswith(" 199999")


def test_planted_period_keeps_rows_without_id(make_docs):
    docs = make_docs([(None, "x y z"), (None, None)]).select("doc_id", "text")
    assert {r["text"] for r in queries.with_planted_period(docs).collect()} == {"x y z", None}
    assert queries.with_planted_period(docs).where(F.col("text").isNull()).count() == 1
