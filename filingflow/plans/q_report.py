"""Catalogue entries: reports and sinks — A7, D10, S8, S9, U11."""

from __future__ import annotations

from pyspark.sql import functions as F

from filingflow.operators import report as P
from filingflow.operators.common import cut_lineage
from filingflow.operators.registry import append_with_ids
from filingflow.plans.catalog import register
from filingflow.session import scratch_dir
from filingflow.sources import listing as L
from filingflow.sources import tables as T

AS_OF = "2024-02-01 00:00:00"
MODEL = "llama3.2:latest"

_BLOCKS = """d AS (SELECT id, lower(company) AS company, file_name, summary_text,
  row_number() OVER (PARTITION BY lower(company) ORDER BY id) AS i, count(*) OVER (PARTITION BY lower(company)) AS n
  FROM downloaded_files WHERE suffix(file_name, '.pdf') OR suffix(file_name, '.html') OR suffix(file_name, '.htm')),
b AS (SELECT company, i, CAST((i - 1) // 50 AS INTEGER) AS part,
  concat(chr(10), '## File ', i, '/', n, ': ', file_name, ' ##', chr(10),
    CASE WHEN summary_text IS NOT NULL THEN concat(summary_text, chr(10))
    ELSE concat('File not found: ', company, '/', file_name, chr(10)) END) AS block FROM d)"""

_A7 = f"""WITH {_BLOCKS}
SELECT company, part, string_agg(block, '' ORDER BY i) AS text FROM b GROUP BY company, part"""


def _files(spark, sf):
    return T.downloaded_files(spark, sf).select("id", "company", "file_name", "summary_text")


@register("concat_summaries", _A7, ("downloaded_files",))
def q_concat_summaries(spark, sf):
    return P.concat_summaries(_files(spark, sf))


# All sentences of all summaries of a company ranked by their number of different words; those that fit into 300 words.
_OVERVIEW = """osent AS (SELECT company, id, i AS pos, trim(s[i], ' ') AS s FROM (
    SELECT company, id, s, unnest(range(1, len(s) + 1)) AS i FROM (
      SELECT lower(company) AS company, id, regexp_extract_all(regexp_replace(summary_text, '[ \\t\\n\\r\\f]+', ' ', 'g'), '[^.!?]+[.!?]*') AS s
      FROM downloaded_files WHERE summary_text IS NOT NULL AND (suffix(file_name, '.pdf') OR suffix(file_name, '.html') OR suffix(file_name, '.htm'))))),
ork AS (SELECT company, id, pos, s, row_number() OVER o AS r, sum(len(string_split(s, ' '))) OVER o AS used FROM osent WHERE s <> ''
  WINDOW o AS (PARTITION BY company ORDER BY len(list_distinct(string_split(s, ' '))) DESC, id, pos)),
ov AS (SELECT company, string_agg(CASE WHEN r = 1 THEN array_to_string(string_split(s, ' ')[1 : 300], ' ') ELSE s END, ' ' ORDER BY id, pos) AS overview
  FROM ork WHERE used <= 300 OR r = 1 GROUP BY company)"""


@register("collective_overview", f"WITH {_OVERVIEW} SELECT company, overview FROM ov", ("downloaded_files",))
def q_collective_overview(spark, sf):
    return P.collective_overview(_files(spark, sf).withColumn("company", F.lower("company")))


def _items(spark, sf):
    items = L.listing_page_scan(T.listing_pages(spark, sf))
    return items.join(T.companies(spark, sf).select(F.col("id").alias("company_id"), F.col("name").alias("company")), "company_id")


def _report_files(spark, sf, items=None, content=True):
    parts = P.collective_report(_items(spark, sf) if items is None else items, _files(spark, sf), AS_OF, MODEL)
    return P.write_reports(parts, scratch_dir(spark, "reports"), content)


_PL = """CASE report_type WHEN 'current' THEN 'Bieżący' WHEN 'quarterly' THEN 'Kwartalny'
  WHEN 'semi-annual' THEN 'Półroczny' WHEN 'interim' THEN 'Śródroczny' ELSE 'Roczny' END"""


def _g(c: str) -> str:
    return f"rtrim(rtrim(CAST(CAST({c} AS DECIMAL(20,2)) AS VARCHAR), '0'), '.')"


_S8 = f"""WITH {_BLOCKS},
parts AS (SELECT company, part, string_agg(block, '' ORDER BY i) AS text FROM b GROUP BY company, part),
{_OVERVIEW},
nf AS (SELECT lower(company) AS company, count(*) AS n_files FROM downloaded_files GROUP BY 1),
lr AS (SELECT lower(c.name) AS company, r.id, r.date AS d,
  strftime(r.date, '%d-%m-%Y') AS c_date,
  CASE WHEN r.title = '' THEN concat('UNTITLED ', {_PL.replace('report_type', 'r.report_type')}, ' REPORT') ELSE r.title END AS c_title,
  {_PL.replace('report_type', 'r.report_type')} AS c_type, coalesce(r.report_category, 'unknown') AS c_cat,
  {_g('r.rate_change')} AS g_er, {_g('r.exchange_rate')} AS g_rc, r.link AS c_link
  FROM reports r JOIN companies c ON c.id = r.company_id),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY company ORDER BY d DESC, id DESC) AS rn FROM lr) WHERE rn <= 5),
dec AS (SELECT company,
  max(CASE WHEN contains(g_er, '.') THEN length(g_er) - strpos(g_er, '.') ELSE 0 END) AS de,
  max(CASE WHEN contains(g_rc, '.') THEN length(g_rc) - strpos(g_rc, '.') ELSE 0 END) AS dr FROM top GROUP BY company),
cells AS (SELECT t.*,
  CASE WHEN contains(g_er, '.') THEN rpad(g_er, CAST(length(g_er) + de - (length(g_er) - strpos(g_er, '.')) AS INTEGER), ' ')
       WHEN de > 0 THEN rpad(g_er, CAST(length(g_er) + de + 1 AS INTEGER), ' ') ELSE g_er END AS c_er,
  CASE WHEN contains(g_rc, '.') THEN rpad(g_rc, CAST(length(g_rc) + dr - (length(g_rc) - strpos(g_rc, '.')) AS INTEGER), ' ')
       WHEN dr > 0 THEN rpad(g_rc, CAST(length(g_rc) + dr + 1 AS INTEGER), ' ') ELSE g_rc END AS c_rc
  FROM top t JOIN dec USING (company)),
w AS (SELECT company, count(*) AS n_rows,
  CAST(greatest(6, max(length(c_date))) AS INTEGER) AS w1, CAST(greatest(7, max(length(c_title))) AS INTEGER) AS w2, CAST(greatest(13, max(length(c_type))) AS INTEGER) AS w3,
  CAST(greatest(17, max(length(c_cat))) AS INTEGER) AS w4, CAST(greatest(15, max(length(c_er))) AS INTEGER) AS w5, CAST(greatest(13, max(length(c_rc))) AS INTEGER) AS w6,
  CAST(greatest(6, max(length(c_link))) AS INTEGER) AS w7 FROM cells GROUP BY company),
lines AS (SELECT c.company, string_agg(concat('| ', rpad(c_date, w1, ' '), ' | ', rpad(c_title, w2, ' '), ' | ', rpad(c_type, w3, ' '),
  ' | ', rpad(c_cat, w4, ' '), ' | ', lpad(c_er, w5, ' '), ' | ', lpad(c_rc, w6, ' '), ' | ', rpad(c_link, w7, ' '), ' |'),
  chr(10) ORDER BY rn) AS body FROM cells c JOIN w USING (company) GROUP BY c.company),
tbl AS (SELECT w.company, w.n_rows, concat('| ', rpad('date', w1, ' '), ' | ', rpad('title', w2, ' '), ' | ', rpad('report type', w3, ' '),
  ' | ', rpad('report category', w4, ' '), ' | ', lpad('exchange rate', w5, ' '), ' | ', lpad('rate change', w6, ' '), ' | ',
  rpad('link', w7, ' '), ' |', chr(10),
  '|:', repeat('-', w1 + 1), '|:', repeat('-', w2 + 1), '|:', repeat('-', w3 + 1), '|:', repeat('-', w4 + 1), '|',
  repeat('-', w5 + 1), ':|', repeat('-', w6 + 1), ':|:', repeat('-', w7 + 1), '|', chr(10), l.body) AS tbl
  FROM w JOIN lines l USING (company)),
head AS (SELECT t.company, 0 AS part, concat('# Zbiorczy Raport GPW - ', t.company, chr(10), chr(10), '**Wygenerowano:** {AS_OF}',
  chr(10), chr(10), '---', chr(10), chr(10), '## 📊 Informacje o raporcie', chr(10), chr(10), '- **Firma:** ', t.company,
  chr(10), '- **Okres:** N/A - N/A', chr(10), '- **Liczba raportów:** ', t.n_rows, chr(10), '- **Pobranych plików:** ',
  coalesce(nf.n_files, 0), chr(10), '- **Model AI:** {MODEL}', chr(10), chr(10), '---', chr(10), chr(10),
  '## 📝 Zbiorczy Raport (Analiza LLM)', chr(10), chr(10), coalesce(ov.overview, '*Brak zbiorczego podsumowania*'),
  chr(10), chr(10), '---', chr(10), chr(10), '## 📋 Lista raportów', chr(10), chr(10), t.tbl, chr(10), chr(10),
  '---', chr(10), chr(10), '## 🤖 Szczegółowe Podsumowania Dokumentów (AI)', chr(10), chr(10)) AS text
  FROM tbl t LEFT JOIN nf ON nf.company = t.company LEFT JOIN ov ON ov.company = t.company),
body AS (SELECT p.company, p.part + 1 AS part, p.text FROM parts p WHERE p.company IN (SELECT company FROM tbl)),
tail AS (SELECT t.company, coalesce((SELECT max(part) FROM body WHERE body.company = t.company), 0) + 1 AS part,
  concat(chr(10), chr(10), '---', chr(10), chr(10), '{P.DEFAULT_FOOTER}', chr(10)) AS text FROM tbl t)
SELECT company, CAST(part AS INTEGER) AS part, text FROM head
UNION ALL SELECT company, CAST(part AS INTEGER), text FROM body
UNION ALL SELECT company, CAST(part AS INTEGER), text FROM tail"""


@register(
    "collective_report_sink",
    f"SELECT company, string_agg(text, '' ORDER BY part) AS text FROM ({_S8}) GROUP BY company",
    ("downloaded_files", "reports", "companies"),
)
def q_collective_report_sink(spark, sf):
    """Writes one Markdown file for each company while it is built and reads the files back."""
    return _report_files(spark, sf).select("company", F.decode("content", "UTF-8").alias("text"))


@register(
    "run_result_sink",
    f"""SELECT l.id, concat('Raport GPW - ', j.company, chr(10), 'Wygenerowano: {AS_OF}', chr(10), 'Dzień: ', CASE WHEN l.id % 4 = 0 THEN 'None' ELSE strftime(l.started_at, '%Y-%m-%d') END, chr(10),
  'Model: ', j.model, chr(10), repeat('=', 80), chr(10), chr(10),
  'SUCCESS! ', CASE WHEN l.documents_processed > 0 THEN concat('downloaded ', l.documents_processed, ' files ') ELSE '' END,
  chr(10), chr(10), repeat('=', 80), chr(10), 'Znaleziono ', l.documents_processed, ' załączników', chr(10)) AS text
FROM job_execution_log l JOIN scheduled_jobs j ON j.job_name = l.job_name WHERE l.status = 'success'""",
    ("job_execution_log", "scheduled_jobs"),
)
def q_run_result_sink(spark, sf):
    """Writes one text file for each run while it is built and reads the files back."""
    log = T.job_execution_log(spark, sf).where(F.col("status") == "success")
    jobs = T.scheduled_jobs(spark, sf).select("job_name", "company", "model")
    j = log.join(jobs, "job_name")
    n = F.col("documents_processed")
    day = F.when(F.col("id") % 4 != 0, F.to_date("started_at"))  # three runs of four ask for a day
    txt = P.run_result_text(F.col("company"), AS_OF, day, F.col("model"), P.scrape_status_text(n), n)
    files = P.write_run_results(j.select("id", "job_name", txt.alias("text")), scratch_dir(spark, "run-results"))
    return files.select("id", F.decode("content", "UTF-8").alias("text"))


@register(
    "append_summary_report",
    f"""WITH s8 AS ({_S8}),
agg AS (SELECT company, CAST(sum(octet_length(encode(text))) AS BIGINT) AS file_size FROM s8 GROUP BY company),
{_OVERVIEW},
nf AS (SELECT lower(company) AS company, count(*) AS n_files FROM downloaded_files GROUP BY 1),
nr AS (SELECT lower(c.name) AS company, least(count(*), 5) AS n_rows FROM reports r JOIN companies c ON c.id = r.company_id GROUP BY 1),
rows AS (SELECT a.company, a.file_size, nr.n_rows, coalesce(nf.n_files, 0) AS n_files, ov.overview FROM agg a
  JOIN nr USING (company) LEFT JOIN nf USING (company) LEFT JOIN ov USING (company))
SELECT (SELECT max(id) FROM summary_reports) + row_number() OVER (ORDER BY company) AS id, 'manual' AS job_name, company,
  CAST(NULL AS DATE) AS date_from, CAST(NULL AS DATE) AS date_to, CAST(n_rows AS INTEGER) AS report_count,
  CAST(n_files AS INTEGER) AS document_count, concat('reports/', company, '_20240201_000000_summary.md') AS file_path,
  'md' AS file_format, file_size, '{MODEL}' AS model_used, substr(overview, 1, 200) AS summary_preview,
  concat('["', company, '", "manual"]') AS tags FROM rows""",
    ("downloaded_files", "reports", "companies", "summary_reports"),
)
def q_append_summary_report(spark, sf):
    items = cut_lineage(_items(spark, sf), "report-items")  # read by the reports and their counts
    files = _report_files(spark, sf, items, content=False)
    size = files.groupBy("company").agg(F.sum("file_size").cast("bigint").alias("file_size"))
    files = _files(spark, sf).withColumn("company", F.lower("company"))
    nf = files.groupBy("company").agg(F.count(F.lit(1)).alias("document_count"))
    ov = P.collective_overview(files)
    nr = items.withColumn("company", F.lower("company")).groupBy("company").agg(F.least(F.count(F.lit(1)), F.lit(5)).alias("report_count"))
    rows = (
        size.join(nr, "company").join(nf, "company", "left").join(ov, "company", "left")
        .select(
            F.lit("manual").alias("job_name"), "company", F.lit("N/A").alias("date_from_text"), F.lit("N/A").alias("date_to_text"),
            "report_count", F.coalesce("document_count", F.lit(0)).alias("document_count"), "file_size",
            F.lit(MODEL).alias("model_used"), "overview",
        )
    )
    new = P.summary_report_rows(rows, "20240201_000000")
    return append_with_ids(T.summary_reports(spark, sf), new, ["company"])
