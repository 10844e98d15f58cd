"""Landed files (S1, S3): a folder of HTML files in any of their charsets, read by Spark's binary file source.

Files are packed into splits by size (``spark.sql.files.maxPartitionBytes``, with ``openCostInBytes`` for each), keys come from
the path, and decoding shares the Arrow pass of the HTML reader, so a file's bytes leave the JVM once.
"""

from __future__ import annotations

import codecs
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filingflow.functions.html import page_text, scan_pages
from filingflow.sources.listing import ITEM_FIELDS, listing_rows

# Marks at the start of a file, and labels that stand for another charset.
BYTE_ORDER_MARKS = ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"))
WIDER = {"ascii": "cp1252", "iso8859-1": "cp1252", "iso8859-9": "cp1254", "utf-16": "utf-8", "utf-16-le": "utf-8", "utf-16-be": "utf-8"}
DEFAULT_CHARSET = "cp1250"  # Central European, where neither a mark, a declaration nor the bytes say otherwise

_DECLARED = re.compile(rb"""<meta\s[^>]*?charset\s*=\s*["']?\s*([A-Za-z0-9_.:-]+)""", re.I)
_LOOK = 1024  # bytes in which a charset may be declared


def charset_of(data: bytes) -> tuple[str, int]:
    """Charset of a file and the length of its mark: the mark, else the declaration, else UTF-8 if the bytes are, else
    ``DEFAULT_CHARSET``."""
    for mark, name in BYTE_ORDER_MARKS:
        if data.startswith(mark):
            return name, len(mark)
    said = _DECLARED.search(data[:_LOOK])
    if said:
        try:
            name = codecs.lookup(said[1].decode()).name
            return WIDER.get(name, name), 0
        except LookupError:
            pass
    try:
        data.decode("utf-8")
        return "utf-8", 0
    except UnicodeDecodeError:
        return DEFAULT_CHARSET, 0


def decode_file(data: bytes) -> tuple[str, str]:
    """(charset, text) of a file; bytes that its charset does not have become replacement characters."""
    name, skip = charset_of(data)
    return name, data[skip:].decode(name, "replace")


def landed_files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """(``path``, ``company``, ``file_name``, ``size``, ``modified``, ``content``): files below ``folder`` whose name fits ``glob``;
    the company is the folder that a file lies in. Names that start with ``_`` or ``.`` are not landed yet, empty
    files have no row."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    parts = F.split("path", "/")
    return found.select(
        "path", F.get(parts, F.size(parts) - 2).alias("company"), F.get(parts, F.size(parts) - 1).alias("file_name"),
        F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content",
    )


def landed_documents(spark: SparkSession, folder: str, glob: str = "*.{html,htm}") -> DataFrame:
    """S3 over a folder: (``path``, ``company``, ``file_name``, ``charset``, ``text``, ``n_pages``), one row for each file."""

    def read(data: bytes) -> list[tuple]:
        charset, html = decode_file(data)
        return [(charset, page_text(html))]

    docs = scan_pages(landed_files(spark, folder, glob), ["path", "company", "file_name"], read, {"charset": "string", "text": "string"}, "content")
    return docs.withColumn("n_pages", F.lit(1))


def landed_listing(spark: SparkSession, folder: str, glob: str = "*.{html,htm}") -> DataFrame:
    """S1 over a folder: the items of every listing file, with the file they came from."""
    fields = {"pos": "int", **dict.fromkeys(ITEM_FIELDS, "string")}
    return scan_pages(landed_files(spark, folder, glob), ["path", "company", "file_name"], lambda data: listing_rows(decode_file(data)[1]), fields, "content")
