from __future__ import annotations

import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


@pytest.fixture(scope="session")
def make_docs(spark):
    """Rows (doc_id, text[, lang[, source]]) as a documents table."""

    def make(rows, partitions=3):
        full = [(r[0], r[1], *(list(r[2:]) + [None, None])[:2], len(r[1]) if r[1] is not None else None) for r in rows]
        return spark.createDataFrame(full, DOCS).repartition(partitions)

    return make


LONG = " ".join(f"word{i % 97} line{i % 13}" for i in range(4000))


@pytest.fixture(scope="session")
def odd_docs(make_docs):
    """Nulls in every column, empty, blank and very long texts, ties and repeated rows."""
    return make_docs(
        [
            (1, None, None, None),
            (None, "a text without an id", "en", "s1"),
            (None, None, None, None),
            (2, "", "en", "s1"),
            (3, " \t\n\r\x0b\x0c ", None, "s2"),
            (4, "the quick brown fox jumps over the lazy dog again and again\nand so on", "en", "s1"),
            (4, "the quick brown fox jumps over the lazy dog again and again\nand so on", "en", "s1"),
            (5, "the quick brown fox jumps over the lazy dog again and again\nand so on", "en", None),
            (5, "another text under the same id", "en", "s3"),
            (6, "12345 67890 !!! ???", None, "s3"),
            (7, "Ünï çødé ÄÖÜ ñandú 漢字 😀 text", "de", "s2"),
            (8, LONG, "en", "s1"),
            (9, "x" * 5000, "en", "s1"),
            (-3, "negative id", "en", "s1"),
        ]
    )


@pytest.fixture(scope="session")
def no_docs(make_docs):
    return make_docs([])


def clash(df, *names):
    """``df`` with extra columns of these names."""
    from pyspark.sql import functions as F

    for n in names:
        df = df.withColumn(n, F.lit("own"))
    return df
