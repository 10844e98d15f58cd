"""DuckDB text of the registry bindings, used only by the oracle queries.

Same bindings as ``filingflow.sources.tables`` (FIXTURES §2), written once in DuckDB's dialect.
``with_tables(body, *names)`` prepends the named CTEs and everything they depend on.
"""

from __future__ import annotations

import re

CTES: dict[str, str] = {
    "companies": """
SELECT c_custkey AS id, c_name AS name, concat(c_name, ' S.A.') AS full_name, c_mktsegment AS sector
FROM customer""",
    "reports": """
SELECT o_orderkey AS id, o_custkey AS company_id, CAST(o_orderdate AS DATE) AS date,
  CASE WHEN o_orderkey % 10 = 0 THEN '' ELSE concat('Report ', CAST(o_orderkey AS VARCHAR)) END AS title,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'current' WHEN '2-HIGH' THEN 'quarterly'
    WHEN '3-MEDIUM' THEN 'semi-annual' WHEN '4-NOT SPECIFIED' THEN 'interim' ELSE 'annual' END AS report_type,
  CASE o_orderstatus WHEN 'F' THEN 'ESPI' WHEN 'O' THEN 'EBI' ELSE NULL END AS report_category,
  CAST((o_orderkey % 2001) - 1000 AS DOUBLE) / 100 AS rate_change,
  CAST(CAST(floor(o_totalprice) AS BIGINT) % 50000 AS DOUBLE) / 100 AS exchange_rate,
  concat('https://www.gpw.pl/komunikat?geru_id=', CAST(o_orderkey AS VARCHAR)) AS link
FROM orders""",
    "listing_raw": """
SELECT id, company_id,
  concat(lpad(CAST(day(date) AS VARCHAR), 2, '0'), '-', lpad(CAST(month(date) AS VARCHAR), 2, '0'), '-',
    CAST(year(date) AS VARCHAR), ' 15:41:53 | ',
    CASE report_type WHEN 'current' THEN 'Bieżący' WHEN 'quarterly' THEN 'Kwartalny'
      WHEN 'semi-annual' THEN 'Półroczny' WHEN 'interim' THEN 'Śródroczny' ELSE 'Roczny' END,
    CASE WHEN report_category IS NULL THEN '' ELSE concat(' | ', report_category) END,
    ' | ', CAST(id % 99 AS VARCHAR), '/2024') AS header_text,
  concat('  ', title, ' ') AS title_text,
  CASE WHEN rate_change >= 0 THEN 'profit' ELSE 'loss' END AS change_class,
  concat('Zmiana ', replace(CAST(CAST(abs(rate_change) AS DECIMAL(10,2)) AS VARCHAR), '.', ','), '%') AS change_text,
  concat('Kurs', replace(CAST(CAST(exchange_rate AS DECIMAL(12,2)) AS VARCHAR), '.', ',')) AS price_text,
  concat('komunikat?geru_id=', CAST(id AS VARCHAR)) AS href
FROM reports""",
    "file_arrivals": """
SELECT doc_id AS id, concat('customer#', lpad(CAST(doc_id % 97 AS VARCHAR), 9, '0')) AS company,
  doc_id * 7 AS report_id,
  concat('doc ', CAST(doc_id AS VARCHAR), CASE WHEN doc_id % 3 = 0 THEN '.html' ELSE '.pdf' END) AS file_name,
  CASE WHEN doc_id % 3 = 0 THEN 'html' ELSE 'pdf' END AS file_type,
  n_chars AS file_size, md5(text) AS md5_hash, text,
  CASE WHEN doc_id % 3 = 0 THEN 1 ELSE greatest(1, CAST(ceil(n_chars / 500.0) AS INT)) END AS n_pages
FROM documents""",
    "downloaded_files": """
SELECT f.id, f.company, f.report_id, f.file_name, f.file_type, f.file_size, f.md5_hash,
  l.doc_id IS NOT NULL AS is_summarized,
  CASE WHEN l.doc_id IS NOT NULL THEN f.text END AS summary_text
FROM file_arrivals f LEFT JOIN labels l ON l.doc_id = f.id
WHERE f.id IN (SELECT min(id) FROM file_arrivals GROUP BY md5_hash)""",
    "scheduled_jobs": """
SELECT user_id AS id, concat('job_', CAST(user_id AS VARCHAR)) AS job_name,
  concat('Customer#', lpad(CAST(user_id % 97 AS VARCHAR), 9, '0')) AS company,
  concat(CAST(user_id % 60 AS VARCHAR), ' ', CAST(user_id % 24 AS VARCHAR),
    CASE user_id % 3 WHEN 0 THEN ' * * *' WHEN 1 THEN concat(' * * ', CAST(user_id % 7 AS VARCHAR))
      ELSE concat(' ', CAST(user_id % 28 + 1 AS VARCHAR), ' * *') END) AS cron_schedule,
  user_id % 4 <> 0 AS enabled, 'llama3.2:latest' AS model,
  CASE WHEN user_id % 5 = 0 THEN NULL ELSE CAST(user_id % 100 + 1 AS INT) END AS report_limit,
  CASE WHEN user_id % 6 = 0 THEN NULL ELSE '["current","quarterly"]' END AS report_types,
  max(ts) AS last_run, count(*) AS run_count
FROM events GROUP BY user_id""",
    "job_execution_log": """
SELECT event_id AS id, concat('job_', CAST(user_id AS VARCHAR)) AS job_name,
  CASE event_type WHEN 'error' THEN 'failed' WHEN 'click' THEN 'running' WHEN 'signup' THEN 'cancelled' ELSE 'success' END AS status,
  ts AS started_at,
  CASE WHEN event_type = 'click' THEN NULL ELSE ts + to_microseconds(CAST(round(value * 1000000) AS BIGINT)) END AS finished_at,
  CAST(floor(value) AS INT) AS reports_found,
  CAST(event_id % 9 AS INT) AS documents_processed,
  CASE WHEN event_type = 'error' THEN concat('n_samples=', CAST(event_id % 5 AS VARCHAR),
    ' should be >= n_clusters=5. ', repeat('x', CAST(event_id % 120 AS INT))) END AS error_message
FROM events""",
    "summary_reports": """
SELECT conv_id * 100 + turn AS id, concat('job_', CAST(conv_id % 101 AS VARCHAR)) AS job_name,
  concat('Customer#', lpad(CAST(conv_id % 97 AS VARCHAR), 9, '0')) AS company,
  CASE WHEN conv_id % 3 = 0 THEN NULL ELSE CAST('2024-01-01' AS DATE) END AS date_from,
  CASE WHEN conv_id % 3 = 0 THEN NULL ELSE CAST('2024-03-31' AS DATE) END AS date_to,
  CASE WHEN turn % 2 = 0 THEN 'md' ELSE 'pdf' END AS file_format,
  CAST(length(text) AS BIGINT) AS file_size, substr(text, 1, 200) AS summary_preview,
  CAST(concat('2024-01-', lpad(CAST(conv_id % 28 + 1 AS VARCHAR), 2, '0'), ' 00:00:00') AS TIMESTAMP) AS created_at
FROM conversations WHERE role = 'assistant'""",
    "run_summaries": """
SELECT event_id * 10 AS id, concat('job_', CAST(user_id AS VARCHAR)) AS job_name,
  ts + to_microseconds(CAST(floor(value) * 500000 AS BIGINT)) AS created_at
FROM events WHERE event_type IN ('view', 'purchase') AND event_id % 3 = 0""",
    "search_history": """
SELECT event_id AS id, concat('Customer#', lpad(CAST(user_id % 97 AS VARCHAR), 9, '0')) AS company_name,
  CAST(floor(value) AS INT) % 25 + 1 AS report_amount,
  CASE user_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'PDF' ELSE 'PDF HTML' END AS download_type,
  CASE WHEN event_id % 5 = 0 THEN NULL ELSE 'current quarterly' END AS report_type,
  CASE WHEN event_id % 7 = 0 THEN NULL ELSE 'ESPI EBI' END AS report_category,
  ts AS created_at
FROM events WHERE event_type = 'click'""",
}

DEPENDS = {
    "listing_raw": ["reports"],
    "downloaded_files": ["file_arrivals"],
}


def with_tables(body: str, *names: str) -> str:
    """``WITH <needed bindings> <body>``; dependencies are added before their users."""
    order: list[str] = []

    def add(n: str) -> None:
        for d in DEPENDS.get(n, []):
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    if not order:
        return body
    body = body.strip()
    if body.upper().startswith("WITH "):
        head = ",\n".join(f"{n} AS ({CTES[n]}\n)" for n in order)
        return f"WITH {head},\n{body[5:]}"
    head = ",\n".join(f"{n} AS ({CTES[n]}\n)" for n in order)
    return f"WITH {head}\n{body}"


def tables_in(sql: str) -> list[str]:
    return [n for n in CTES if re.search(rf"\b{n}\b", sql)]
