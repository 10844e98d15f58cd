"""Operator 1, line de-duplication: lines whose key many documents share go from all of them.

Native: split, key, hash, count, join and reassembly are built-in functions only. Two shuffles carry
16-byte line hashes (the count is combined before it moves, so a line that every document holds
is one row per task); the whole texts move once, to meet the positions they lose.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filingflow.llm.common import WHITE, ascii_lower, others, own_names, with_row_key, written


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(WHITE)))


@own_names
def dedup_lines(
    docs: DataFrame, min_docs: int = 10, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` with ``n_lines``, ``n_dropped`` and ``kept_text`` (columns of these names are replaced).

    A key of at least ``min_chars`` code points that occurs in ``min_docs`` documents or more loses all
    its lines everywhere. Lines end at ``\\n`` only. Null and empty texts are one empty line; a
    document that loses every line keeps the empty text. Rows of one id are one document; rows without an
    id are none that can be told apart and count for nothing, but lose the same lines. An empty table
    gives an empty table.
    """
    base = with_row_key(docs, id_col, text_col)
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)
    keys = F.transform(lines, lambda x: F.when(F.length(F.btrim(x, F.lit(WHITE))) >= min_chars, F.unhex(F.md5(line_key(x).cast("binary")))))
    # written once: the hashes are read for the counts and again for the positions
    narrow = written(base.select("__rk", "__rd", F.col(id_col).isNotNull().alias("__known"), keys.alias("__keys")), "line-keys")
    # __rd is the id; (key, id) pairs are told apart first, so that a hot line's documents stay spread
    shared = (
        narrow.where(F.col("__known"))
        .select("__rd", F.explode(F.array_compact("__keys")).alias("__key"))  # array_distinct of binaries would be quadratic
        .distinct()
        .groupBy("__key")
        .agg(F.count(F.lit(1)).alias("__n"))
        .where(F.col("__n") >= min_docs)
        .select("__key")
    )
    # written, so that both sides of the join below are shuffled as they are and a hot line can be split
    shared = written(shared, "shared-lines")
    lost = (
        narrow.select("__rk", "__rd", F.posexplode("__keys").alias("__pos", "__key"))
        .where(F.col("__key").isNotNull())
        .join(shared, "__key", "left_semi")
        .groupBy("__rk", "__rd")
        .agg(F.sort_array(F.collect_set("__pos")).alias("__lost"))
    )
    new = ["n_lines", "n_dropped", "kept_text"]
    n = F.size("__lines")
    # Kept positions are a set difference, and lines are looked up by position: linear in the lines. (A slice inside the
    # lambda would copy all lines for every piece.)
    kept = F.transform(F.array_except(F.sequence(F.lit(0), n - 1), F.col("__lost")), lambda i: F.get("__lines", i))
    met = base.join(lost, ["__rk", "__rd"], "left").withColumn("__lines", lines)
    return met.select(
        *others(docs, new),
        n.cast("long").alias("n_lines"),
        F.coalesce(F.size("__lost"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("__lost").isNull(), F.coalesce(F.col(text_col), F.lit(""))).otherwise(F.array_join(kept, "\n")).alias("kept_text"),
    )
