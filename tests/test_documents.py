"""Document condensation: chunker invariants, tiers, k-means contract, unique representatives."""

from __future__ import annotations

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from filingflow.functions import text as X
from filingflow.functions.html import page_text
from filingflow.operators import documents as D
from tests.conftest import SF_SMALL, rows

WS = re.compile(r"\s", re.UNICODE)


def _check_chunks(text: str, size: int) -> None:
    chunks = D.split_text(text, size)
    assert all(len(c) <= size for c in chunks)
    assert all(c == c.strip() and c for c in chunks)
    assert WS.sub("", "".join(chunks)) == WS.sub("", text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab cd\n\n\tźż.")), max_size=400), st.integers(min_value=3, max_value=60))
def test_split_text_invariants(text, size):
    _check_chunks(text, size)


def test_split_text_prefers_paragraphs():
    text = "alpha beta\n\ngamma delta\n\nepsilon"
    assert D.split_text(text, 12) == ["alpha beta", "gamma delta", "epsilon"]
    assert D.split_text(text, 2000) == [text]
    assert D.split_text("", 10) == []
    assert D.split_text("   \n\n  ", 10) == []


def test_chunk_invariants_on_documents(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    for size in (2000, 1000):
        got = D.chunk_invariants(docs, size).where(~F.col("size_ok")).count()
        assert got == 0


def test_size_tiers(spark):
    df = spark.createDataFrame([(1,), (11,), (158,), (2,), (40,)], "p int")
    k, b = D.size_tier(F.col("p"))
    assert rows(df.select("p", k, b)) == [(1, 1, 50), (11, 5, 600), (158, 9, 1200), (2, 1, 50), (40, 9, 1200)]


def test_too_few_chunks_message(spark):
    df = spark.createDataFrame([(4, 5)], "n int, k int")
    assert rows(df.select(D.too_few_chunks_message(F.col("n"), F.col("k")))) == [("n_samples=4 should be >= n_clusters=5.",)]


def _points(spark):
    data = []
    centres = [(0.0, 0.0), (10.0, 0.0), (0.0, 10.0)]
    pid = 0
    for g in (1, 2):
        for cx, cy in centres:
            for dx, dy in ((0.1, 0.0), (-0.1, 0.0), (0.0, 0.1), (0.0, -0.1)):
                data.append((g, pid, [cx + dx, cy + dy]))
                pid += 1
    return spark.createDataFrame(data, "grp long, pid long, vec array<double>")


def _split(out):
    return out.where(F.col("pid").isNotNull()), out.where(F.col("pid").isNull()).select("grp", "cluster", "center")


def test_kmeans_contract_and_determinism(spark):
    pts = _points(spark)
    k = spark.createDataFrame([(1, 3), (2, 3)], "grp long, k int")
    a1, c1 = _split(D.kmeans_per_group(pts, k))
    a2, _ = _split(D.kmeans_per_group(pts, k))
    assert sorted(rows(a1, "grp", "pid", "cluster")) == sorted(rows(a2, "grp", "pid", "cluster"))
    assert dict(rows(c1.groupBy("grp").count())) == {1: 3, 2: 3}
    # the three well separated blobs end up in three different clusters
    per = a1.groupBy("grp", "cluster").agg(F.count(F.lit(1)).alias("n"))
    assert sorted(r[0] for r in rows(per, "n")) == [4] * 6
    best = D.distances_to_centroids(pts, c1).groupBy("grp", "pid").agg(F.min("dist").alias("b"))
    assert a1.join(best, ["grp", "pid"]).where(F.abs(F.col("dist") - F.col("b")) > 1e-12).count() == 0
    assert sorted(rows(D.distances_of_clustering(D.kmeans_per_group(pts, k)), "grp", "pid", "cluster")) == sorted(
        rows(D.distances_to_centroids(pts, c1), "grp", "pid", "cluster")
    )


def test_kmeans_skips_groups_with_too_few_points(spark):
    k = spark.createDataFrame([(1, 20)], "grp long, k int")
    assert D.kmeans_per_group(_points(spark), k).count() == 0


def test_twelve_clusters_give_twelve_picks(spark):
    pts = spark.createDataFrame([(1, i, [float(i)]) for i in range(30)], "grp long, pid long, vec array<double>")
    cents = spark.createDataFrame([(1, j, [0.01 * j]) for j in range(12)], "grp long, cluster int, center array<double>")
    got = rows(D.select_representatives(pts, cents).orderBy("order"), "cluster", "pid")
    assert got == [(j, j) for j in range(12)]


def test_representatives_are_unique(spark):
    # two centroids whose nearest point is the same point 0: the second cluster takes its next nearest
    pts = spark.createDataFrame([(1, 0, [0.0]), (1, 1, [1.0]), (1, 2, [5.0])], "grp long, pid long, vec array<double>")
    cents = spark.createDataFrame([(1, 0, [0.1]), (1, 1, [0.2])], "grp long, cluster int, center array<double>")
    got = rows(D.select_representatives(pts, cents).orderBy("order"), "cluster", "pid")
    assert got == [(0, 0), (1, 1)]
    plain = sorted(rows(D.nearest_per_cluster(pts, cents), "cluster", "pid"))
    assert plain == [(0, 0), (1, 0)]


def test_extractive_summary_reads_the_whole_text(spark):
    cases = [
        ("  one two\nthree   four five ", 3, "one two three"),  # a sentence that is too long alone is cut
        ("a a a. b c d e. the end here!", 4, "b c d e."),
        ("a a a. b c d e. the end here!", 7, "b c d e. the end here!"),
        ("x. " * 500 + "the last one counts most.", 5, "the last one counts most."),
        ("", 5, ""),
        (None, 5, ""),
        ("...", 5, ""),
    ]
    df = spark.createDataFrame([(i, t, b) for i, (t, b, _) in enumerate(cases)], "i int, t string, b int")
    got = dict(rows(df.select("i", D.extractive_summary(F.col("t"), F.col("b")))))
    assert got == {i: want for i, (_, _, want) in enumerate(cases)}


def test_character_references():
    cases = {
        "Sp&oacute;&#322;ka &ndash; A&amp;B": "Spółka – A&B",
        "&#x142;&#X0142; &amp;lt; &lt;b&gt;": "łł &lt; <b>",
        "a&nbsp;b&#160;c": "a b c",
        "&nope; & &; &#; &#xZZ; AT&T": "&nope; & &; &#; &#xZZ; AT&T",
        "&apos;&quot;&eacute": "'\"é",
        "&#128512;&hellip;&check;": "😀…✓",
    }
    assert {k: page_text(k) for k in cases} == cases


def test_chunks_stay_inside_pages(spark):
    df = spark.createDataFrame([(1, ["aaa bbb", " ", "ccc"]), (2, []), (3, None)], "doc_id long, pages array<string>")
    assert sorted(rows(D.chunk_documents(df, 2000), "doc_id", "chunk_no", "chunk")) == [(1, 0, "aaa bbb"), (1, 1, "ccc")]


def test_document_scan_reads_pages_by_their_tokens(spark):
    html = '<html><script>var t="</p>";</script><style>p{}</style><!-- c > d --><p title="a > b">A &amp; B</p><p>C</p><!-- open <p>lost'
    df = spark.createDataFrame([(1, "u", html), (2, None, None), (3, "", "")], "page_id long, url string, html string")
    assert sorted(rows(D.document_scan(df))) == [(1, "u", "A & B C", 1), (2, None, None, 1), (3, "", "", 1)]


def test_kmeans_groups_cut_by_arrow_batches(spark):
    pts = _points(spark)
    k = spark.createDataFrame([(1, 3), (2, 3)], "grp long, k int")
    whole = sorted(rows(_split(D.kmeans_per_group(pts, k))[0], "grp", "pid", "cluster"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")  # groups of 12 span batches
    try:
        assert sorted(rows(_split(D.kmeans_per_group(pts, k))[0], "grp", "pid", "cluster")) == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_summarise_with_model_hook(spark):
    def _model():
        """A stand-in for a caller's model, built once per partition by the hook."""

        def answer(prompt, budget):
            if "bad" in prompt:
                raise ValueError("no answer")
            return " ".join(prompt.split()[:budget])

        return answer

    prompts = spark.createDataFrame([(1, "alpha beta gamma delta", 3, 1), (2, "bad", 9, 4)], "grp long, prompt string, budget int, n_pages int")
    got = dict(rows(D.summarise_with_model(prompts, _model, "m")))
    assert got == {
        1: "#### Model: m | Liczba stron: 1 ####\nalpha beta gamma",
        2: "#### zbyt mały dokument, 4 stron w raporcie #### no answer",
    }


def test_overview_reads_all_files_and_model_failures_stay_local(spark):
    from filingflow.operators import report as P

    files = [(i, "c", f"f{i}.pdf", "a a a.") for i in range(700)] + [(900, "c", "last.htm", "many different words in here."), (901, "d", "x.pdf", "bad"), (902, "e", "x.txt", "not a document.")]
    df = spark.createDataFrame(files, "id long, company string, file_name string, summary_text string")
    got = dict(rows(P.collective_overview(df, words=9)))
    assert got == {"c": "a a a. many different words in here.", "d": "bad"}

    def _model():
        def answer(prompt, budget):
            assert budget == 1500
            if "x.pdf" in prompt:
                raise ValueError("no")
            return "fine"

        return answer

    out = rows(P.overview_with_model(df, _model), "company", "part", "overview")
    assert {o for c, _, o in out if c == "c"} == {"fine"} and len([1 for c, *_ in out if c == "c"]) == 15
    assert [o for c, _, o in out if c == "d"] == ["❌ Nie udało się wygenerować zbiorczego raportu: no\n\n\n## File 1/1: x.pdf ##\nbad\n"]


def test_g_format_matches_python(spark):
    from filingflow.operators.report import _g_format

    vals = [0.0, 21.42, -0.33, 108.0, 1.01, 1234.5678, 12345.67, 0.0001234, 0.00001234, 123456.0, 1234567.0, -2.7, 0.5]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    got = [r[0] for r in df.select(_g_format(F.col("v"))).collect()]
    assert got == [format(v, "g") for v in vals]


def test_long_pages_are_cut_at_separators_not_piece_by_piece(monkeypatch):
    text = "\n".join(" ".join("w" * (1 + (i * j) % 13) for i in range(60)) for j in range(30)) + " " + "z" * 90
    words = D._merge(D._pieces(text.replace("\n", " "), " ")[:-1], 50, 0)
    monkeypatch.setattr(D, "_merge", None)  # every word went through it before
    assert D.split_text(text.replace("\n", " "), 50) == [*words, "z" * 49, "z" * 41]
    assert max(map(len, D.split_text(text, 50))) <= 50 and D.split_text(" short\n", 50) == ["short"]


def test_kmeans_takes_whole_arrow_batches(spark):
    pts = spark.createDataFrame([(g, p, [float(p % 3), float(g)]) for g in range(4) for p in range(6)], "grp long, pid long, vec array<double>")
    out = D.kmeans_per_group(pts, spark.createDataFrame([(g, 1 + g % 3) for g in range(4)], "grp long, k int"))
    assert "MapInArrow" in out._jdf.queryExecution().toString()  # a pandas frame for each group before
    got = out.where("pid is null").groupBy("grp").count().collect()
    assert {(r["grp"], r["count"]) for r in got} == {(0, 1), (1, 2), (2, 3), (3, 1)}
