"""Randomised SVD against numpy's, k-means++ against the even start."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import IDF, HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from filingflow.operators import documents as D
from filingflow.operators import embedding as E
from tests.conftest import SF_SMALL


def dense(lists, idf):
    a = np.zeros((len(lists), len(idf)))
    for i, terms in enumerate(lists):
        for t in terms:
            a[i, t] += idf[t]
    norm = np.linalg.norm(a, axis=1, keepdims=True)
    return np.divide(a, norm, out=np.zeros_like(a), where=norm > 0)


def test_vectors_span_the_leading_singular_space(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("text").repartition(5)
    how = E.Svd(terms=512, dims=6, extra=20)
    terms = docs.select(E.term_numbers(F.col("text"), how.terms).alias("terms"))
    idf, v = E.fit(terms, how)
    a = dense([r["terms"] for r in terms.collect()], idf)
    n = sum(bool(x.any()) for x in a)
    df = (a > 0).sum(axis=0)
    assert np.allclose(idf[df > 0], np.log((n + 1) / (df[df > 0] + 1)))
    exact = np.linalg.svd(a, full_matrices=False)
    assert np.allclose(v.T @ v, np.eye(6), atol=1e-9)
    kept, best = np.linalg.norm(a @ v) ** 2, (exact[1][:6] ** 2).sum()
    assert 0.97 * best <= kept <= best * (1 + 1e-9)


def hashed(chunks, dim=256):
    """The plainer embedding that the SVD is measured against: hashed TF-IDF of as many columns."""
    tok = chunks.withColumn("tok", F.filter(F.split(F.lower("chunk"), r"[^\p{L}\p{N}]+"), lambda t: F.length(t) > 0))
    tf = HashingTF(inputCol="tok", outputCol="tf", numFeatures=dim).transform(tok)
    norm = Normalizer(inputCol="w", outputCol="v").transform(IDF(inputCol="tf", outputCol="w").fit(tf).transform(tf))
    return norm.withColumn("vec", vector_to_array("v"))


def margin(rows):
    """Mean cosine of pairs of one label less that of pairs of two."""
    x, label = np.array([r["vec"] for r in rows]), np.array([r["lang"] for r in rows])
    c, same = x @ x.T, label[:, None] == label[None]
    off = ~np.eye(len(x), dtype=bool)
    return c[same & off].mean() - c[~same].mean()


def test_neighbours_of_one_label_are_closer_than_with_hashed_tf_idf(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").where("lang is not null and length(text) > 40").select("lang", F.col("text").alias("chunk"))
    how = E.Svd(dims=8)  # 200 texts have few directions in common
    dense_rows, hashed_rows = D.embed_chunks(docs, how=how).collect(), hashed(docs).collect()
    assert np.allclose([np.linalg.norm(r["vec"]) for r in dense_rows], 1) and len(dense_rows[0]["vec"]) == 8
    assert margin(dense_rows) > margin(hashed_rows) + 0.05


def test_texts_without_words_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, ""), (3, None), (4, "--"), (5, "a x y " * 50_000), (6, "q r")], "id long, chunk string")
    got = {r["id"]: np.linalg.norm(r["vec"]) for r in D.embed_chunks(df, how=E.Svd(terms=64, dims=4)).collect()}
    assert {i: round(float(n), 9) for i, n in got.items()} == {1: 1.0, 2: 0.0, 3: 0.0, 4: 0.0, 5: 1.0, 6: 1.0}
    assert D.embed_chunks(df.limit(0)).collect() == []


def inertia(x, c):
    return ((x[:, None] - c[None]) ** 2).sum(axis=2).min(axis=1).sum()


def test_spread_start_is_no_worse_than_the_even_start(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").orderBy("vec_id").collect()
    x = np.array([r["embedding"] for r in rows], np.float64)
    even = spread = 0.0
    for g in range(0, len(x), 100):
        part = x[g : g + 100]
        even += inertia(part, D._lloyd(part, part[[(i * len(part)) // 5 for i in range(5)]].copy())[0])
        c, d = D.kmeans(part, 5, g)
        assert np.isclose(d.min(axis=1).sum(), inertia(part, c)) and np.array_equal(c, D.kmeans(part, 5, g)[0])
        spread += inertia(part, c)
    assert spread <= even


def test_seeding_of_few_different_points():
    x = np.array([[0.0, 0], [0, 0], [0, 0], [1, 1]])
    c, d = D.kmeans(x, 3, -5)
    assert c.shape == (3, 2) and d.shape == (4, 3) and d.min(axis=1).max() == 0
    far = np.r_[np.zeros((50, 2)), np.full((50, 2), 9.0), np.full((2, 2), 99.0)]
    assert {tuple(r) for r in D._spread_start(far, 3, np.random.default_rng(0)).tolist()} == {(0, 0), (9, 9), (99, 99)}


def test_texts_are_computed_once(spark):
    docs = spark.createDataFrame([(1, ["ab cd ef", "gh ij"]), (2, ["ab kl mn"]), (3, None)], "doc_id long, pages array<string>")
    out = D.embed_chunks(D.chunk_documents(docs))
    assert out._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1  # chunked a second time before
    assert sorted((r["doc_id"], r["chunk_no"], r["chunk"]) for r in out.collect()) == [(1, 0, "ab cd ef"), (1, 1, "gh ij"), (2, 0, "ab kl mn")]
    assert out.columns == ["doc_id", "chunk_no", "chunk", "vec"]
