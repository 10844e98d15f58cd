"""S7 listing CSV export (S8 and S9 write plain files, see ``sources.files`` and ``operators.report``).

One file for each company, written by the tasks that own the companies' rows and committed as a whole: the driver handles one
folder for each task, not one for each company.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from filingflow.sources.files import read_files, write_text_files

LISTING_COLUMNS = ["date", "title", "report type", "report category", "exchange rate", "rate change", "link"]
NO_COMPANY = "__HIVE_DEFAULT_PARTITION__"  # stands for a missing or empty name
CSV_SCHEMA = ", ".join(f"`{c}` string" for c in ["_c0", *LISTING_COLUMNS])


def listing_csv_export(frame: DataFrame, path: str, limit: int = 5) -> None:
    """Per company the listing frame of its newest ``limit`` items, with the pandas-style
    index column (0-based, blank header), written as ``<company>.csv`` with a header.

    The per-company cut uses ``row_number() <= limit`` with a literal bound, which Spark turns
    into a partial WindowGroupLimit before the shuffle; a company's file is one row of at most ``limit`` lines.
    """
    # the frame is in listing order (newest first), so the index counts from the newest filing
    named = frame.withColumn("company", F.when(F.col("company") != "", F.col("company")).otherwise(NO_COMPANY))
    w = Window.partitionBy("company").orderBy(F.desc(F.to_date("date", "dd-MM-yyyy")), F.desc("page_no"), F.desc("pos"))
    top = named.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= limit)
    line = F.to_csv(F.struct((F.col("rn") - 1).cast("int").alias("_c0"), *[F.col(f"`{c}`") for c in LISTING_COLUMNS]))
    lines = top.select("company", F.struct("rn", F.concat(line, F.lit("\n")).alias("line")).alias("row"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list("row")), lambda r: r["line"]), "")
    header = ",".join(["", *LISTING_COLUMNS]) + "\n"
    files = lines.groupBy("company").agg(F.concat(F.lit(header), body).alias("text"))
    write_text_files(files.select(F.concat("company", F.lit(".csv")).alias("name"), F.lit(0).alias("part"), "text"), path)


def read_listing_csv(spark: SparkSession, path: str) -> DataFrame:
    """The exported rows, every column and the company as text."""
    files = read_files(spark, path, "*.csv")
    company = F.regexp_replace("name", r"\.csv$", "")
    lines = F.slice(F.split(F.decode("content", "UTF-8"), "\n"), 2, 1 << 30)  # below the header
    rows = files.select(F.when(company != NO_COMPANY, company).alias("company"), F.explode(lines).alias("line")).where(F.col("line") != "")
    return rows.select(F.from_csv("line", CSV_SCHEMA).alias("r"), "company").select("r.*", "company")
