"""Document condensation: S3, D1-D9, W5, W4 — chunk -> embed -> per-document k-means ->
representative chunks -> prompt -> summary, over whole tables of documents.

* Chunking (D1) is a per-row Python helper (an Arrow UDF): the recursive
  separator splitter has no compact native form. Pages are split one by one.
* Embedding (D5) is a distributed randomised SVD of TF-IDF (``operators.embedding``).
* K-means per document (D6) is one Arrow pass over points dealt by document; centres, assignments
  and the distances that pick representatives all come from it. The chunks of one document meet in
  one task, as its text did before.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filingflow.functions import text as X
from filingflow.functions.html import page_text, scan_pages
from filingflow.functions.text import _at
from filingflow.operators.common import ordinal, top_k
from filingflow.operators.embedding import Svd, embed_texts


# ----------------------------------------------------------------------------- S3 HTML -> text

def document_scan(pages: DataFrame) -> DataFrame:
    """S3 over landed HTML pages: one text per page, read by the tokenizer in one Arrow pass; an HTML file loads as one section
    (X16), a null page has a null text."""
    read = scan_pages(pages, ["page_id", "url"], lambda html: [(page_text(html),)], {"text": "string"}, null_row=(None,))
    return read.withColumn("n_pages", F.lit(1))


# ----------------------------------------------------------------------------- D1 chunking

SEPARATORS = ("\n\n", "\n", " ", "")


def _pieces(text: str, sep: str) -> list[str]:
    """Split keeping each separator at the start of the piece that follows it."""
    if sep == "":
        return list(text)
    parts = text.split(sep)
    return [p for p in [parts[0]] + [sep + p for p in parts[1:]] if p != ""]


def _merge(pieces: list[str], size: int, overlap: int) -> list[str]:
    """Greedy packing of pieces into chunks of at most ``size`` characters (stripped)."""
    out: list[str] = []
    cur: deque[str] = deque()
    total = 0
    for p in pieces:
        n = len(p)
        if cur and total + n > size:
            doc = "".join(cur).strip()
            if doc:
                out.append(doc)
            while cur and (total > overlap or total + n > size):
                total -= len(cur.popleft())
        cur.append(p)
        total += n
    doc = "".join(cur).strip()
    if doc:
        out.append(doc)
    return out


def _packed(text: str, sep: str, size: int, rest: tuple[str, ...]) -> list[str]:
    """What ``_merge`` makes of the pieces of ``text`` (without overlap), cut where the separators stand instead of piece by piece."""
    if not sep:
        return [c for at in range(0, len(text), size) if (c := text[at : at + size].strip())]
    out: list[str] = []
    at, n = 0, len(text)
    while at < n:
        end = n if n - at <= size else text.rfind(sep, at + 1, at + size + 1)
        if end < 0 or end - at >= size and text.find(sep, at + 1, end) < 0:  # a piece that is too long by itself
            end = end if end >= 0 else text.find(sep, at + 1)
            end = end if end >= 0 else n
            piece = text[at:end]
            out.extend(split_text(piece, size, 0, rest) if rest else [piece])
        elif chunk := text[at:end].strip():
            out.append(chunk)
        at = end
    return out


def split_text(text: str, size: int = 2000, overlap: int = 0, seps: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Recursive character splitting — the first separator present splits the text; short
    pieces are packed greedily, pieces still too long are split again with the next separator."""
    if len(text) < size:  # all pieces are packed into one chunk
        whole = text.strip()
        return [whole] if whole else []
    sep, rest = seps[-1], ()
    for i, s in enumerate(seps):
        if s == "" or s in text:
            sep, rest = s, (seps[i + 1 :] if s != "" else ())
            break
    if not overlap and (len(sep) == 1 or sep == "" and size > 1):
        return _packed(text, sep, size, rest)
    out: list[str] = []
    good: list[str] = []
    for piece in _pieces(text, sep):
        if len(piece) < size:
            good.append(piece)
            continue
        if good:
            out.extend(_merge(good, size, overlap))
            good = []
        out.extend(split_text(piece, size, overlap, rest) if rest else [piece])
    if good:
        out.extend(_merge(good, size, overlap))
    return out


CHUNK_CHARS = 1 << 20  # characters of chunks that a task holds as Python strings


def chunk_column(pages: Column, size: int = 2000, overlap: int = 0) -> Column:
    """D1 as a column: the chunks of an ARRAY<STRING> of pages, each page split by itself, in page order
    (an Arrow UDF that takes a document at a time; a chunk never crosses a page)."""

    @F.arrow_udf("array<string>")
    def _chunks(docs: pa.Array) -> pa.Array:
        docs = docs.combine_chunks() if isinstance(docs, pa.ChunkedArray) else docs
        flat, at = docs.flatten(), 0
        done, held, chars, counts = [pa.array([], pa.string())], [], 0, [0]
        for n in docs.value_lengths().fill_null(0).to_pylist():
            found = [c for page in flat.slice(at, n).to_pylist() for c in split_text(page or "", size, overlap)]
            at += n
            held += found
            counts.append(len(found))
            chars += sum(map(len, found))
            if chars >= CHUNK_CHARS:
                done.append(pa.array(held, pa.string()))
                held, chars = [], 0
        done.append(pa.array(held, pa.string()))
        return pa.ListArray.from_arrays(pa.array(np.cumsum(counts), pa.int32()), pa.concat_arrays(done))

    return _chunks(pages)


def pages_of(docs: DataFrame) -> Column:
    """The ``pages`` array, or the whole text as one page."""
    return F.col("pages") if "pages" in docs.columns else F.array(F.coalesce(F.col("text"), F.lit("")))


def chunk_documents(docs: DataFrame, size: int = 2000, overlap: int = 0, id_col: str = "doc_id") -> DataFrame:
    """One row per chunk (id, chunk_no 0-based over the whole document, chunk)."""
    arr = docs.select(id_col, chunk_column(pages_of(docs), size, overlap).alias("chunks"))
    return arr.select(id_col, F.posexplode("chunks").alias("chunk_no", "chunk"))


UNICODE_WS_CLASS = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in X.PY_WHITESPACE) + "]"


def chunk_invariants(docs: DataFrame, size: int = 2000) -> DataFrame:
    """D1 check: no chunk longer than ``size``; every chunk lies inside one page; the whitespace-free join of the chunks
    equals the whitespace-free text (nothing lost, nothing duplicated)."""
    arr = docs.select("doc_id", pages_of(docs).alias("pages"), chunk_column(pages_of(docs), size).alias("chunks"))
    inside = F.forall("chunks", lambda c: F.exists("pages", lambda p: F.contains(p, c)))
    return arr.select(
        "doc_id",
        F.coalesce(F.array_max(F.transform("chunks", lambda c: F.length(c))) <= size, F.lit(True)).alias("size_ok"),
        inside.alias("page_ok"),
        F.md5(F.regexp_replace(F.array_join("chunks", ""), UNICODE_WS_CLASS, "")).alias("md5_nows"),
    )


# ----------------------------------------------------------------------------- D2-D4


# Fixed values: (pages <= 2) -> 1 cluster / 50 tokens; (pages >= 40) -> 9 / 1200; else 5 / 600.
def size_tier(n_pages: Column) -> tuple[Column, Column]:
    """Cluster count and token budget from the page count."""
    k = F.when(n_pages <= 2, 1).when(n_pages >= 40, 9).otherwise(5)
    budget = F.when(n_pages <= 2, 50).when(n_pages >= 40, 1200).otherwise(600)
    return k.cast("int"), budget.cast("int")


# The two message texts below.
def empty_document_message(file_name: Column) -> Column:
    """D3: fixed message for a document without any text chunk."""
    return F.concat(F.lit("❌ Brak tekstu do przetworzenia w: "), file_name)


def too_few_chunks_message(n_chunks: Column, k: Column) -> Column:
    """The clustering library's error text when chunks < clusters."""
    return F.concat(
        F.lit("n_samples="), n_chunks.cast("string"), F.lit(" should be >= n_clusters="), k.cast("string"), F.lit(".")
    )


# ----------------------------------------------------------------------------- D5 embeddings

def embed_chunks(chunks: DataFrame, text_col: str = "chunk", how: Svd = Svd()) -> DataFrame:
    """Dense vectors of length one from a randomised SVD of the chunk table's TF-IDF matrix; adds ``vec`` ARRAY<DOUBLE>.

    Fitted over the whole chunk table, see ``operators.embedding``; jobs run while the frame is built.
    """
    return embed_texts(chunks, text_col, how)


def l2_norm(vec: Column) -> Column:
    return F.sqrt(F.aggregate(vec, F.lit(0.0).cast("double"), lambda acc, x: acc + x * x))


# ----------------------------------------------------------------------------- D6 k-means


def sq_dist(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def _centroid_arrays(centroids: DataFrame) -> DataFrame:
    """(grp, cluster, center) -> one row per group with its (cluster, center) list (<= 9 entries)."""
    return centroids.groupBy("grp").agg(F.sort_array(F.collect_list(F.struct("cluster", "center"))).alias("__cs"))


def _means(assigned: DataFrame) -> DataFrame:
    m = assigned.groupBy("grp", "cluster").agg(Summarizer.mean(array_to_vector("vec")).alias("__m"))
    return m.select("grp", "cluster", vector_to_array("__m").alias("center"))


KMEANS_STARTS = 3  # seedings of a group, the one that ends with the least inertia stays
KMEANS_SEED = 42
SMALL_GROUP = 256  # points whose differences from all centres are held at once


def _spread_start(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means++ seeding: the first centre at random, each next one drawn in proportion to the squared distance from the
    nearest so far; of a few such draws the one that leaves the least total distance."""
    picks = [int(rng.integers(len(x)))]
    d = ((x - x[picks[0]]) ** 2).sum(axis=1)
    tries = 2 + int(np.log(max(k, 1)))
    while len(picks) < k:
        total = d.sum()
        if total <= 0:  # fewer different points than centres
            picks.append(len(picks) % len(x))
            continue
        drawn = np.minimum(np.searchsorted(np.cumsum(d), rng.random(tries) * total, "right"), len(x) - 1)
        left = np.minimum(d[:, None], ((x[:, None, :] - x[drawn][None]) ** 2).sum(axis=2))
        best = int(left.sum(axis=0).argmin())
        picks.append(int(drawn[best]))
        d = left[:, best]
    return x[picks].copy()


def _lloyd(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lloyd's k-means from the centres ``c`` until no label changes: (centres, squared distances of every point to every centre).

    Ties to the smaller cluster; an empty cluster keeps its centre.
    Labels that repeat an earlier sum of distances end the loop, so it always ends.
    """
    k, lab, best = len(c), None, np.inf
    while True:
        if len(x) <= SMALL_GROUP:  # the same sums in one step
            d = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
        else:
            d = np.stack([((x - c[j]) ** 2).sum(axis=1) for j in range(k)], axis=1)
        new, total = d.argmin(axis=1), d.min(axis=1).sum()
        if lab is not None and (np.array_equal(new, lab) or total >= best):
            return c, d
        lab, best = new, total
        for j in range(k):
            if (lab == j).any():
                c[j] = x[lab == j].mean(axis=0)


def kmeans(x: np.ndarray, k: int, group: int) -> tuple[np.ndarray, np.ndarray]:
    """The best of ``KMEANS_STARTS`` seeded runs; draws depend on the group's number alone, so reruns agree."""
    if k == 1:  # any start ends in the mean
        c = x.mean(axis=0, keepdims=True)
        return c, ((x - c) ** 2).sum(axis=1, keepdims=True)
    runs = [_lloyd(x, _spread_start(x, k, np.random.default_rng([KMEANS_SEED, group % (1 << 64), i]))) for i in range(KMEANS_STARTS)]
    return min(runs, key=lambda r: r[1].min(axis=1).sum())


_KMEANS = "grp long, pid long, cluster int, dist double, dists array<double>, center array<double>"


def _kmeans_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows arrive dealt by group and sorted by (grp, pid); a group cut by a batch's end is carried into the next."""
    carry: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        grp = batch["grp"].to_numpy()
        last = int(np.searchsorted(grp, grp[-1]))  # where the last group begins
        if last or carry and carry[-1]["grp"][0].as_py() != grp[0]:
            yield _cluster_rows([*carry, batch.slice(0, last)])
            carry = []
        carry.append(batch.slice(last))
    if carry:
        yield _cluster_rows(carry)


def _cluster_rows(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    """The points and then the centres of every group of ``parts``, which holds whole groups."""
    t = pa.Table.from_batches(parts).combine_chunks()
    n, grp, ks, vec = t.num_rows, t["grp"].to_numpy(), t["k"].to_numpy(), t["vec"].combine_chunks()
    if vec.null_count or len(set(vec.value_lengths().to_pylist())) != 1:
        raise ValueError("all vectors of a clustering need one length")
    x = vec.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)
    first = np.flatnonzero(np.r_[True, grp[1:] != grp[:-1]])
    near, dist, dists, centers, k = np.zeros(n, np.int32), np.zeros(n), [], [], ks[first]
    for a, b, of in zip(first, [*first[1:], n], k):
        c, d = kmeans(x[a:b], int(of), int(grp[a]))
        near[a:b] = d.argmin(axis=1)
        dist[a:b] = d[np.arange(b - a), near[a:b]]
        dists.append(d.ravel())
        centers.append(c.ravel())
    m, width = int(k.sum()), x.shape[1]
    point, center = np.r_[np.zeros(n, bool), np.ones(m, bool)], np.r_[np.ones(n, bool), np.zeros(m, bool)]
    lists = lambda sizes, values, null: pa.ListArray.from_arrays(
        pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(np.concatenate(values), pa.float64()), mask=pa.array(null)
    )
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.r_[grp, np.repeat(grp[first], k)], pa.int64()),
            pa.concat_arrays([t["pid"].combine_chunks().cast(pa.int64()), pa.nulls(m, pa.int64())]),
            pa.array(np.r_[near, np.arange(m) - np.repeat(np.cumsum(k) - k, k)], pa.int32()),
            pa.array(np.r_[dist, np.zeros(m)], pa.float64(), mask=point),
            lists(np.r_[ks, np.zeros(m, ks.dtype)], dists, point),
            lists(np.r_[np.zeros(n, np.int64), np.full(m, width)], centers, center),
        ],
        names=["grp", "pid", "cluster", "dist", "dists", "center"],
    )


def kmeans_per_group(points: DataFrame, k: DataFrame) -> DataFrame:
    """Lloyd's k-means with k-means++ seeding inside every group. ``points``: (grp, pid, vec); ``k``: (grp, k).

    One Python node gives all a caller needs: a row per point (cluster, squared distance, distances to
    all centres) and a row per centre (``pid`` NULL, ``center``). Iterated until nothing changes, the same
    for groups of any size; groups with fewer points than k are left out (the caller reports them, D4).
    A group is the chunks of one document, which was one row to begin with, so it fits a task.
    """
    sizes = points.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).join(k.select("grp", "k"), "grp").where("n >= k")
    pts = points.select("grp", "pid", F.col("vec").cast("array<double>").alias("vec")).join(sizes.select("grp", "k"), "grp")
    return pts.repartition("grp").sortWithinPartitions("grp", "pid").mapInArrow(_kmeans_batches, _KMEANS)


# ----------------------------------------------------------------------------- D7 / W5 representatives


def distances_to_centroids(points: DataFrame, centroids: DataFrame) -> DataFrame:
    """(grp, pid, cluster, dist, k) for every point against every centroid of its group."""
    j = points.join(_centroid_arrays(centroids), "grp")
    d = j.select("grp", "pid", F.size("__cs").alias("k"), F.explode(F.transform("__cs", lambda c: F.struct(c["cluster"].alias("cluster"), sq_dist(F.col("vec"), c["center"]).alias("dist")))).alias("x"))
    return d.select("grp", "pid", "x.cluster", "x.dist", "k")


def distances_of_clustering(clustered: DataFrame) -> DataFrame:
    """The same rows from the output of ``kmeans_per_group``."""
    d = clustered.where(F.col("pid").isNotNull()).select("grp", "pid", F.size("dists").alias("k"), F.posexplode("dists").alias("cluster", "dist"))
    return d.select("grp", "pid", "cluster", "dist", "k")


def nearest_per_cluster(points: DataFrame, centroids: DataFrame) -> DataFrame:
    """The point nearest to each centroid (ties -> smaller pid), partially aggregated."""
    d = distances_to_centroids(points, centroids)
    return d.groupBy("grp", "cluster").agg(F.min_by("pid", F.struct("dist", "pid")).alias("pid"))


def select_representatives(points: DataFrame, centroids: DataFrame) -> DataFrame:
    """D7 for given centroids; see ``unique_picks``."""
    return unique_picks(distances_to_centroids(points, centroids))


def unique_picks(distances: DataFrame) -> DataFrame:
    """One representative per cluster in cluster order, each the nearest point to its centroid
    that an earlier cluster has not taken already (the clustering filter's unique pick).

    With k clusters only the k nearest candidates of each can matter (at most k - 1 are taken before),
    so the candidates are a salted top-k per (group, cluster), and the sequential pick is a fold over
    at most k * k candidates per group.
    """
    cand = top_k(distances, ["grp", "cluster"], [F.col("dist"), F.col("pid")], F.col("k"), F.col("pid"), salts=16)
    per = cand.groupBy("grp", "cluster").agg(F.sort_array(F.collect_list(F.struct("dist", "pid"))).alias("c"))
    grp = per.groupBy("grp").agg(F.sort_array(F.collect_list(F.struct("cluster", "c"))).alias("cl"))
    init = F.array().cast("array<struct<cluster:int,pid:bigint>>")

    def step(acc, cl):
        taken = F.transform(acc, lambda a: a["pid"])
        free = F.filter(cl["c"], lambda x: ~F.array_contains(taken, x["pid"]))
        pick = _at(free, 1)["pid"]
        return F.when(pick.isNull(), acc).otherwise(
            F.concat(acc, F.array(F.struct(cl["cluster"].cast("int").alias("cluster"), pick.cast("bigint").alias("pid"))))
        )

    picked = grp.select("grp", F.aggregate("cl", init, step).alias("p"))
    return picked.select("grp", F.posexplode("p").alias("order", "x")).select("grp", "order", "x.cluster", "x.pid")


def label_centroids(points: DataFrame) -> DataFrame:
    """Centroids of given cluster labels: (grp, cluster=label, center)."""
    return _means(points.withColumnRenamed("label", "cluster"))


# ----------------------------------------------------------------------------- D8 / D9

# The per-document summarisation prompt.
PROMPT_TEMPLATE = (
    "Summarize this financial text form polish GPW stock in no more than 200 words and use financial language:\n\n"
    "{text}, answer me in Polish language"
)


def build_prompts(reps: DataFrame, text_col: str = "chunk") -> DataFrame:
    """Representatives (grp, order, text) joined by blank lines, in pick order, into the template;
    the prompt length is reported. At most 9 representatives per document."""
    g = reps.groupBy("grp").agg(F.sort_array(F.collect_list(F.struct("order", F.col(text_col).alias("t")))).alias("r"))
    joined = F.array_join(F.transform("r", lambda x: x["t"]), "\n\n")
    head, tail = PROMPT_TEMPLATE.split("{text}")
    return g.select(
        "grp", joined.alias("combined"), F.concat(F.lit(head), joined, F.lit(tail)).alias("prompt")
    ).withColumn("prompt_length", F.length("prompt"))


def extractive_summary(text: Column, budget: Column, max_words: int = 200) -> Column:
    """D9 default (no model): the sentences with the most different words, from the whole text, as many as fit into
    min(``max_words``, budget) words, in text order."""
    return X.fill_budget(X.sentence_rows(text), F.least(F.lit(max_words), budget))


def summary_header(model: Column, n_pages: Column) -> Column:
    """``#### Model: m | Liczba stron: n ####``."""
    return F.concat(F.lit("#### Model: "), model, F.lit(" | Liczba stron: "), n_pages.cast("string"), F.lit(" ####"))


def summarise(prompts: DataFrame, model: str, budget_col: str = "budget", pages_col: str = "n_pages") -> DataFrame:
    """Per prompt ``header\\nsummary``; the summary is extractive unless a model hook is used."""
    s = extractive_summary(F.col("combined"), F.col(budget_col))
    return prompts.withColumn("summary", F.concat(summary_header(F.lit(model), F.col(pages_col)), F.lit("\n"), s))


# Fixed value: what stands for header and summary when the model fails, before the reason.
def model_failed(n_pages: Column) -> Column:
    return F.concat(F.lit("#### zbyt mały dokument, "), n_pages.cast("string"), F.lit(" stron w raporcie #### "))


def summarise_with_model(prompts: DataFrame, model_fn, model: str, budget_col: str = "budget", pages_col: str = "n_pages") -> DataFrame:
    """D9 hook: a caller's model applied per Arrow batch (built once per partition): (grp, summary).

    The model gets the prompt and the token budget; its answer follows the header line. A prompt on which
    the model raises gets the failure text with the reason instead of both; other rows go on.
    """

    def run(batches):
        fn = model_fn()
        for pdf in batches:
            out = []
            for prompt, budget, header, failed in zip(pdf["prompt"], pdf["budget"], pdf["header"], pdf["failed"]):
                try:
                    out.append(f"{header}\n{fn(prompt, int(budget))}")
                except Exception as e:  # noqa: BLE001 - whatever the caller's model raises
                    out.append(f"{failed}{e}")
            yield pd.DataFrame({"grp": pdf["grp"], "summary": out})

    n = F.col(pages_col)
    fed = prompts.select("grp", "prompt", F.col(budget_col).alias("budget"), summary_header(F.lit(model), n).alias("header"), model_failed(n).alias("failed"))
    return fed.mapInPandas(run, "grp long, summary string")


# ----------------------------------------------------------------------------- W4


def file_i_of_n(files: DataFrame, group_col: str = "company", order_col: str = "id") -> DataFrame:
    """``File i/N`` numbering per company without gathering a company into one task."""
    return ordinal(files, [group_col], order_col, out="file_i", total="file_n")
