"""Catalogue entries: documents — S3, D1-D9, D11, W4, W5, J7."""

from __future__ import annotations

from pyspark.sql import functions as F

from filingflow.operators import documents as D
from filingflow.operators import registry as R
from filingflow.operators.common import cut_lineage
from filingflow.plans.catalog import ORACLES, register
from filingflow.session import scratch_dir
from filingflow.sources import tables as T
from filingflow.sources.files import write_text_files
from filingflow.sources.landed import landed_documents

MODEL = "llama3.2:latest"
WS_CLASS = D.UNICODE_WS_CLASS
_HAS_TEXT = f"regexp_replace(text, '{WS_CLASS}', '', 'g') <> ''"


@register(
    "document_scan",
    """SELECT page_id, url, trim(regexp_replace(
  replace(replace(replace(replace(replace(replace(
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
      '(?is)<script\\b[^>]*>.*?</script>', ' ', 'g'), '(?is)<style\\b[^>]*>.*?</style>', ' ', 'g'),
      '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'),
    '&middot;', '·'), '&copy;', '©'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'),
  '[ \\t\\n\\r\\f]+', ' ', 'g'), ' ') AS text, 1 AS n_pages FROM pages""",
)
def q_document_scan(spark, sf):
    return D.document_scan(T.read(spark, sf, "pages"))


# A folder of files in three charsets stands for the landing zone: files of one page each, named by page.
_CHARSET = """CASE WHEN page_id % 3 = 0 THEN 'utf-8' WHEN page_id % 3 = 1 THEN 'utf-16-le'
  WHEN regexp_matches(html, '[^\\x{01}-\\x{FF}]') THEN 'utf-8' ELSE 'cp1252' END"""


@register(
    "landed_page_scan",
    f"""SELECT concat('page ', page_id, CASE WHEN page_id % 2 = 0 THEN '.html' ELSE '.htm' END) AS file_name,
  {_CHARSET} AS charset, text, 1 AS n_pages FROM ({ORACLES['document_scan']}) JOIN (SELECT page_id, html FROM pages) USING (page_id)""",
)
def q_landed_page_scan(spark, sf):
    """Lands every page as a file while it is built, then reads the folder: charset and text of each file."""
    p = T.read(spark, sf, "pages").select("page_id", "html")
    latin = F.replace("html", F.lit('charset="utf-8"'), F.lit('charset="iso-8859-1"'))
    content = (
        F.when(F.col("page_id") % 3 == 0, F.encode("html", "UTF-8"))
        .when(F.col("page_id") % 3 == 1, F.concat(F.unhex(F.lit("FFFE")), F.encode("html", "UTF-16LE")))
        .when(F.col("html").rlike(r"[^\x01-\xFF]"), F.encode("html", "UTF-8"))
        .otherwise(F.encode(latin, "ISO-8859-1"))
    )
    ending = F.when(F.col("page_id") % 2 == 0, ".html").otherwise(".htm")
    name = F.concat(F.lit("page "), F.col("page_id").cast("string"), ending)
    folder = scratch_dir(spark, "landed-pages")
    write_text_files(p.select(name.alias("name"), F.lit(0).alias("part"), content.alias("text")), folder)
    return landed_documents(spark, folder).select("file_name", "charset", "text", "n_pages")


def _paged(spark, sf):
    return T.file_arrivals(spark, sf).select(F.col("id").alias("doc_id"), "pages")


@register(
    "chunk_documents",
    f"SELECT doc_id, TRUE AS size_ok, TRUE AS page_ok, md5(regexp_replace(text, '{WS_CLASS}', '', 'g')) AS md5_nows FROM documents",
)
def q_chunk_documents(spark, sf):
    return D.chunk_invariants(_paged(spark, sf), 2000)


@register(
    "chunk_documents_1000",
    f"SELECT doc_id, TRUE AS size_ok, TRUE AS page_ok, md5(regexp_replace(text, '{WS_CLASS}', '', 'g')) AS md5_nows FROM documents",
)
def q_chunk_documents_1000(spark, sf):
    return D.chunk_invariants(_paged(spark, sf), 1000)


@register(
    "size_tier",
    """SELECT id, n_pages, CASE WHEN n_pages <= 2 THEN 1 WHEN n_pages >= 40 THEN 9 ELSE 5 END AS n_clusters,
  CASE WHEN n_pages <= 2 THEN 50 WHEN n_pages >= 40 THEN 1200 ELSE 600 END AS token_budget FROM file_arrivals""",
    ("file_arrivals",),
)
def q_size_tier(spark, sf):
    f = T.file_arrivals(spark, sf)
    k, b = D.size_tier(F.col("n_pages"))
    return f.select("id", "n_pages", k.alias("n_clusters"), b.alias("token_budget"))


def _file_chunks(spark, sf):
    """Per arrival: its chunk array and size tier."""
    f = T.file_arrivals(spark, sf)
    k, b = D.size_tier(F.col("n_pages"))
    return f.select(
        "id", "company", "file_name", "n_pages", k.alias("k"), b.alias("budget"),
        D.chunk_column(F.col("pages")).alias("chunks"),
    )


# One arrival in thirty is a scan: its pages hold nothing but white space.
@register(
    "empty_document",
    f"""SELECT id, concat('❌ Brak tekstu do przetworzenia w: ', file_name) AS message FROM file_arrivals
WHERE id % 30 = 4 OR NOT ({_HAS_TEXT})""",
    ("file_arrivals",),
)
def q_empty_document(spark, sf):
    blank = F.transform("pages", lambda p: F.lit(" \n\t"))
    scans = T.file_arrivals(spark, sf).withColumn("pages", F.when(F.col("id") % 30 == 4, blank).otherwise(F.col("pages")))
    c = scans.select("id", "file_name", D.chunk_column(F.col("pages")).alias("chunks"))
    return c.where(F.size("chunks") == 0).select("id", D.empty_document_message(F.col("file_name")).alias("message"))


# A page of at most 500 characters is one chunk unless it is blank; an HTML file is one page and wants one cluster.
_FEW_SQL = f"""WITH p AS (SELECT id, file_name, n_pages, CASE WHEN n_pages >= 40 THEN 9 WHEN n_pages <= 2 THEN 1 ELSE 5 END AS k,
  len(list_filter(list_transform(range(0, n_pages), lambda i: substr(text, 500 * i + 1, 500)),
    lambda x: regexp_replace(x, '{WS_CLASS}', '', 'g') <> '')) AS n FROM file_arrivals WHERE file_type = 'pdf')
SELECT id, file_name, concat('n_samples=', n, ' should be >= n_clusters=', k, '.') AS error FROM p WHERE n > 0 AND n < k"""


@register("too_few_chunks", _FEW_SQL, ("file_arrivals",))
def q_too_few_chunks(spark, sf):
    c = _file_chunks(spark, sf).withColumn("n_chunks", F.size("chunks"))
    bad = c.where((F.col("n_chunks") > 0) & (F.col("n_chunks") < F.col("k")))
    return bad.select("id", "file_name", D.too_few_chunks_message(F.col("n_chunks"), F.col("k")).alias("error"))


def _doc_chunks(spark, sf):
    return D.chunk_documents(_paged(spark, sf))


@register("embed_chunks", f"SELECT doc_id, TRUE AS all_unit FROM documents WHERE {_HAS_TEXT}")
def q_embed_chunks(spark, sf):
    e = D.embed_chunks(_doc_chunks(spark, sf))
    n = D.l2_norm(F.col("vec"))
    ok = (F.abs(n - 1.0) < 1e-9) | (n == 0.0)
    return e.groupBy("doc_id").agg(F.bool_and(ok).alias("all_unit"))


# vectors of one document: a group's size does not grow with the table
GROUP = 100


def _embedding_points(spark, sf):
    e = T.read(spark, sf, "embeddings")
    return e.select(
        F.floor(F.col("vec_id") / GROUP).cast("bigint").alias("grp"), F.col("vec_id").alias("pid"),
        F.col("embedding").cast("array<double>").alias("vec"), "label",
    )


@register(
    "cluster_chunks",
    """SELECT vec_id // 100 AS grp, CAST(5 AS BIGINT) AS n_centroids, TRUE AS all_nearest, count(*) AS n_points FROM embeddings
GROUP BY vec_id // 100 HAVING count(*) >= 5""",
)
def q_cluster_chunks(spark, sf):
    pts = _embedding_points(spark, sf).drop("label")
    k = pts.select("grp").distinct().withColumn("k", F.lit(5))
    out = cut_lineage(D.kmeans_per_group(pts, k), "kmeans")
    cents = out.where(F.col("pid").isNull()).select("grp", "cluster", "center")
    assigned = out.where(F.col("pid").isNotNull()).select("grp", "pid", "cluster", "dist")
    # independent check: the assigned distance is the minimum over all centroids of the group
    best = D.distances_to_centroids(pts, cents).groupBy("grp", "pid").agg(F.min("dist").alias("best"))
    near = F.col("dist") <= F.col("best") * (1 + 1e-9)
    chk = assigned.join(best, ["grp", "pid"]).groupBy("grp").agg(F.bool_and(near).alias("all_nearest"), F.count(F.lit(1)).alias("n_points"))
    n = cents.groupBy("grp").agg(F.count(F.lit(1)).alias("n_centroids"))
    return n.join(chk, "grp")


_LABEL_DIST = """e AS (SELECT vec_id, vec_id // 100 AS grp, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
x AS (SELECT e.grp, e.label, r.i, e.v[r.i] AS xi FROM e, range(1, 65) r(i)),
c AS (SELECT grp, label, i, avg(xi) AS ci FROM x GROUP BY ALL),
cv AS (SELECT grp, label, list(ci ORDER BY i) AS cvec FROM c GROUP BY ALL),
d AS (SELECT e.grp, cv.label AS cluster, e.vec_id AS pid,
  list_sum(list_transform(range(1, len(e.v) + 1), lambda i: (e.v[i] - cv.cvec[i]) * (e.v[i] - cv.cvec[i]))) AS dist
  FROM e JOIN cv ON cv.grp = e.grp)"""

_W5_SQL = f"""WITH {_LABEL_DIST}
SELECT grp, CAST(cluster AS INTEGER) AS cluster, arg_min(pid, (dist, pid)) AS pid FROM d GROUP BY grp, cluster"""


def _w5(spark, sf):
    pts = _embedding_points(spark, sf)
    return D.nearest_per_cluster(pts.drop("label"), D.label_centroids(pts))


@register("nearest_chunk_per_cluster", _W5_SQL)
def q_nearest_chunk_per_cluster(spark, sf):
    return _w5(spark, sf)


def _d7_sql(max_clusters: int = 10) -> str:
    """The sequential unique pick, unrolled over the (at most 10) labels of a group."""
    steps = ["s0 AS (SELECT DISTINCT grp, CAST([] AS BIGINT[]) AS pids, CAST([] AS INTEGER[]) AS cls FROM d)"]
    for n in range(1, max_clusters + 1):
        steps.append(
            f"""s{n} AS (SELECT g.grp,
  CASE WHEN p.pid IS NULL THEN g.pids ELSE list_append(g.pids, p.pid) END AS pids,
  CASE WHEN p.pid IS NULL THEN g.cls ELSE list_append(g.cls, p.cluster) END AS cls
  FROM s{n - 1} g LEFT JOIN LATERAL (
    SELECT l.cluster, (SELECT arg_min(d.pid, (d.dist, d.pid)) FROM d
      WHERE d.grp = g.grp AND d.cluster = l.cluster AND NOT list_contains(g.pids, d.pid)) AS pid
    FROM lab l WHERE l.grp = g.grp AND l.step = {n}) p ON TRUE)"""
        )
    return f"""WITH {_LABEL_DIST},
lab AS (SELECT grp, cluster, row_number() OVER (PARTITION BY grp ORDER BY cluster) AS step FROM (SELECT DISTINCT grp, cluster FROM d)),
{','.join(steps)}
SELECT grp, CAST(o - 1 AS INTEGER) AS "order", CAST(cls[o] AS INTEGER) AS cluster, pids[o] AS pid
FROM s{max_clusters}, range(1, len(pids) + 1) r(o)"""


@register("select_representatives", _d7_sql())
def q_select_representatives(spark, sf):
    pts = _embedding_points(spark, sf)
    return D.select_representatives(pts.drop("label"), D.label_centroids(pts))


# Representatives stand for chunks here: point p, picked n-th, speaks for chunk n (counted round) of document p.
_HEAD, _TAIL = D.PROMPT_TEMPLATE.replace(chr(10), "' || chr(10) || '").split("{text}")


@register(
    "build_prompts",
    f"""WITH w AS ({_W5_SQL}),
c AS (SELECT id, list_filter(list_transform(range(0, n_pages), lambda i: trim(substr(text, 500 * i + 1, CASE WHEN i = n_pages - 1 THEN length(text) ELSE 500 END),
    ' ' || chr(9) || chr(10) || chr(13))), lambda x: x <> '') AS chunks FROM file_arrivals WHERE file_type = 'pdf'),
g AS (SELECT grp, string_agg(chunks[cluster % len(chunks) + 1], chr(10) || chr(10) ORDER BY cluster) AS combined
  FROM w JOIN c ON c.id = w.pid WHERE len(chunks) > 0 GROUP BY grp)
SELECT grp, combined, concat('{_HEAD}', combined, '{_TAIL}') AS prompt,
  CAST(length(concat('{_HEAD}', combined, '{_TAIL}')) AS INTEGER) AS prompt_length FROM g""",
    ("file_arrivals",),
)
def q_build_prompts(spark, sf):
    pdf = T.file_arrivals(spark, sf).where(F.col("file_type") == "pdf").select("id", D.chunk_column(F.col("pages")).alias("chunks"))
    reps = _w5(spark, sf).select("grp", F.col("cluster").alias("order"), F.col("pid").alias("id"))
    met = reps.join(pdf.where(F.size("chunks") > 0), "id")
    return D.build_prompts(met.select("grp", "order", F.get("chunks", F.col("order") % F.size("chunks")).alias("chunk")))


# Sentences of the whole text ranked by their number of different words; those that fit the budget, in text order.
_SUMMARIES = """sent AS (SELECT id, i AS pos, trim(s[i], ' ') AS s FROM (
    SELECT id, s, unnest(range(1, len(s) + 1)) AS i FROM (
      SELECT id, regexp_extract_all(regexp_replace(text, '[ \\t\\n\\r\\f]+', ' ', 'g'), '[^.!?]+[.!?]*') AS s FROM file_arrivals))),
sw AS (SELECT id, pos, s, string_split(s, ' ') AS w, least(200, CASE WHEN n_pages <= 2 THEN 50 WHEN n_pages >= 40 THEN 1200 ELSE 600 END) AS cap
  FROM sent JOIN file_arrivals USING (id) WHERE s <> ''),
rk AS (SELECT id, pos, s, w, cap, row_number() OVER o AS r, sum(len(w)) OVER o AS used FROM sw
  WINDOW o AS (PARTITION BY id ORDER BY len(list_distinct(w)) DESC, pos)),
pick AS (SELECT id, string_agg(CASE WHEN r = 1 THEN array_to_string(w[1 : cap], ' ') ELSE s END, ' ' ORDER BY pos) AS t
  FROM rk WHERE used <= cap OR r = 1 GROUP BY id),
summaries AS (SELECT f.id, f.company, f.file_name, concat('#### Model: llama3.2:latest | Liczba stron: ', CAST(n_pages AS VARCHAR), ' ####', chr(10),
  coalesce(t, '')) AS summary FROM file_arrivals f LEFT JOIN pick USING (id))"""


def _file_summaries(spark, sf):
    f = T.file_arrivals(spark, sf).select("id", "company", "file_name", "n_pages", F.col("text").alias("combined"))
    _, b = D.size_tier(F.col("n_pages"))
    return D.summarise(f.withColumn("budget", b), MODEL)


@register("summarise_batch", f"WITH {_SUMMARIES} SELECT id, summary FROM summaries", ("file_arrivals",))
def q_summarise_batch(spark, sf):
    return _file_summaries(spark, sf).select("id", "summary")


@register(
    "attach_summaries",
    f"""WITH {_SUMMARIES}
SELECT f.id, s.summary AS new_summary FROM downloaded_files f LEFT JOIN summaries s
  ON lower(s.company) = lower(f.company) AND s.file_name = f.file_name""",
    ("downloaded_files", "file_arrivals"),
)
def q_attach_summaries(spark, sf):
    s = _file_summaries(spark, sf).select("company", "file_name", "summary")
    return R.attach_summaries(T.downloaded_files(spark, sf), s).select("id", "new_summary")


@register(
    "write_back_summaries",
    f"""WITH {_SUMMARIES}
SELECT f.id, CASE WHEN s.summary IS NOT NULL THEN TRUE ELSE f.is_summarized END AS is_summarized,
  coalesce(s.summary, f.summary_text) AS summary_text
FROM downloaded_files f LEFT JOIN summaries s
  ON lower(s.company) = lower(f.company) AND s.file_name = f.file_name""",
    ("downloaded_files", "file_arrivals"),
)
def q_write_back_summaries(spark, sf):
    s = _file_summaries(spark, sf).select("company", "file_name", "summary")
    files = T.downloaded_files(spark, sf)
    att = R.attach_summaries(files, s)
    changes = att.where(F.col("new_summary").isNotNull()).select(
        "id", F.col("new_summary").alias("summary_text"), F.col("id").alias("change_no")
    )
    return R.update_file_summary(files, changes).select("id", "is_summarized", "summary_text")


@register(
    "file_i_of_n",
    """SELECT id, company, CAST(row_number() OVER (PARTITION BY company ORDER BY id) AS INTEGER) AS file_i,
  CAST(count(*) OVER (PARTITION BY company) AS INTEGER) AS file_n FROM downloaded_files""",
    ("downloaded_files",),
)
def q_file_i_of_n(spark, sf):
    return D.file_i_of_n(T.downloaded_files(spark, sf).select("id", "company"))
