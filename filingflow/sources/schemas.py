"""Registry schemas (FIXTURES §1) and a conform step that enforces them on any frame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

REGISTRY_DDL = {
    "companies": "id bigint, name string, full_name string, sector string",
    "reports": "id bigint, company_id bigint, date date, title string, report_type string, report_category string, rate_change double, "
    "exchange_rate double, link string",
    "downloaded_files": "id bigint, company string, report_id bigint, file_name string, file_type string, file_size bigint, md5_hash string, "
    "is_summarized boolean, summary_text string",
    "scheduled_jobs": "id bigint, job_name string, company string, cron_schedule string, enabled boolean, model string, report_limit int, "
    "report_types string, last_run timestamp_ntz, run_count bigint",
    "summary_reports": "id bigint, job_name string, company string, date_from date, date_to date, file_format string, file_size bigint, "
    "summary_preview string, created_at timestamp_ntz",
    "job_execution_log": "id bigint, job_name string, status string, started_at timestamp_ntz, finished_at timestamp_ntz, reports_found int, "
    "documents_processed int, error_message string",
    "search_history": "id bigint, company_name string, report_amount int, download_type string, report_type string, report_category string, "
    "created_at timestamp_ntz",
}
_TYPES = {
    "bigint": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(), "boolean": T.BooleanType(),
    "date": T.DateType(), "timestamp_ntz": T.TimestampNTZType(),
}


def _schema(ddl: str) -> T.StructType:
    """The type of a DDL text, without a session (modules are imported before there is one)."""
    pairs = [field.split() for field in ddl.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


REGISTRY_SCHEMAS: dict[str, T.StructType] = {name: _schema(ddl) for name, ddl in REGISTRY_DDL.items()}

# ENUM domains of the registry.
DOMAINS = {
    ("reports", "report_type"): ("current", "semi-annual", "quarterly", "interim", "annual"),
    ("reports", "report_category"): ("ESPI", "EBI"),
    ("summary_reports", "file_format"): ("md", "pdf"),
    ("job_execution_log", "status"): ("success", "failed", "running", "cancelled"),
    ("downloaded_files", "file_type"): ("pdf", "html", "csv"),
}


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns in schema order with the declared types."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def domain_check(df: DataFrame, table: str) -> DataFrame:
    """Values outside the ENUM domains become NULL (the database would reject or blank them)."""
    out = df
    for (t, c), vals in DOMAINS.items():
        if t == table and c in out.columns:
            out = out.withColumn(c, F.when(F.col(c).isin(*vals), F.col(c)))
    return out
