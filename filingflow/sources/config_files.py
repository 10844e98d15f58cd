"""S5 legacy_config_scan: a folder of legacy job-config JSON documents -> job rows.

The reader is schema-first: unknown keys are dropped, missing keys come back NULL and are filled
with the config defaults (enabled True, report_limit 5, description ''). ``multi_line=True``
reads one pretty-printed document per file (the legacy layout); JSON lines otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEGACY_SCHEMA = T.StructType(
    [
        T.StructField("job_name", T.StringType()),
        T.StructField("company", T.StringType()),
        T.StructField("date_from", T.StringType()),
        T.StructField("date_to", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("cron_schedule", T.StringType()),
        T.StructField("enabled", T.BooleanType()),
        T.StructField("report_limit", T.IntegerType()),
        T.StructField("report_types", T.ArrayType(T.StringType())),
        T.StructField("report_categories", T.ArrayType(T.StringType())),
        T.StructField("email_notify", T.StringType()),
        T.StructField("description", T.StringType()),
    ]
)


def legacy_config_scan(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    raw = spark.read.schema(LEGACY_SCHEMA).option("multiLine", multi_line).json(path)
    return raw.select(
        "job_name", "company", "date_from", "date_to", "model", "cron_schedule",
        F.coalesce("enabled", F.lit(True)).alias("enabled"),
        F.coalesce("report_limit", F.lit(5)).alias("report_limit"),
        "report_types", "report_categories", "email_notify",
        F.coalesce("description", F.lit("")).alias("description"),
    )


def write_legacy_configs(configs: DataFrame, path: str) -> None:
    """Land job configs as JSON documents (used to build the legacy folder from the registry)."""
    configs.write.mode("overwrite").json(path)
