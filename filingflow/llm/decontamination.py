"""Operator 9, benchmark decontamination: n-gram windows of test items found in training text.

Native: words, windows, look-up, check and merged spans are built-in functions. The benchmark's
windows are a hash set that is broadcast below a size bound (beyond it the same join shuffles);
training windows are exploded and probed in one pass, so only true hits ever move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filingflow.llm.common import ascii_lower, others, own_names, with_row_key, written
from filingflow.operators.common import broadcast_if_small

# Fixed value: everything in ASCII that is no digit or lower-case letter splits words.
SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of the text with A-Z lower-cased (null: none)."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SPLIT, -1), lambda w: w != "")


def item_windows(items: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """(``__gram``, ``__len``, ``__item``): every window of ``n`` words of an item, distinct; an item of fewer words, but
    not none, is one window."""
    w = items.select(F.col(id_col).cast("string").alias("__item"), words_of(F.col(text_col)).alias("__w")).where(F.size("__w") > 0)
    w = w.withColumn("__len", F.least(F.size("__w"), F.lit(n)))
    at = F.explode(F.sequence(F.lit(1), F.size("__w") - F.col("__len") + 1))
    return (
        w.select("__item", "__len", "__w", at.alias("__i"))
        .select("__item", "__len", F.array_join(F.slice("__w", F.col("__i"), F.col("__len")), " ").alias("__gram"))
        .distinct()
    )


def find_hits(docs: DataFrame, items: DataFrame, n: int, id_col: str, text_col: str, item_id: str, item_text: str) -> DataFrame:
    """(``__rk``, ``__rd``, ``__start``, ``__len``, ``__item``): one row per window of an item in a document (0-based word)."""
    grams = item_windows(items, n, item_id, item_text)
    lens = sorted(r[0] for r in grams.select("__len").distinct().collect())  # at most n values
    probe = grams.select(F.xxhash64("__gram").alias("__h"), F.col("__gram").alias("__item_gram"), "__item")
    keyed = with_row_key(docs, id_col, text_col).select("__rk", "__rd", words_of(F.col(text_col)).alias("__w"))
    at = keyed.select("__rk", "__rd", "__w", F.posexplode("__w").alias("__start", "__word"))
    if lens == [n]:
        wide = at.withColumn("__len", F.lit(n))
    else:
        wide = at.withColumn("__len", F.explode(F.array(*[F.lit(x) for x in lens] or [F.lit(n)])))
    wide = wide.where(F.col("__start") + F.col("__len") <= F.size("__w"))
    gram = F.array_join(F.slice("__w", F.col("__start") + 1, F.col("__len")), " ")
    seen = wide.select("__rk", "__rd", "__start", "__len", gram.alias("__gram")).withColumn("__h", F.xxhash64("__gram"))
    return (
        seen.join(broadcast_if_small(probe), "__h")
        .where(F.col("__gram") == F.col("__item_gram"))
        .select("__rk", "__rd", "__start", "__len", "__item")
        .distinct()
    )


@own_names
def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    n: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit``, ``n_items``, ``items`` (array, sorted) and ``spans`` (array of (start, end) word
    ranges, merged); columns of these names are replaced. A document is contaminated if ``n_hit`` > 0.

    A word is hit inside any occurrence of a window. Null and empty texts have no words; items
    without words match nothing; items with the same text all count. Repeated rows get the same
    result. Empty tables on either side are fine.
    """
    new = ["n_words", "n_hit", "n_items", "items", "spans"]
    # written: the windows are sought once, for the spans and for the items
    hits = written(find_hits(docs, items, n, id_col, text_col, item_id, item_text), "benchmark-hits")
    key = ["__rk", "__rd"]
    ends = hits.select(*key, "__start", (F.col("__start") + F.col("__len")).alias("__end")).distinct()
    order = Window.partitionBy(*key).orderBy("__start", "__end")
    reach = F.max("__end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.withColumn("__reach", F.coalesce(reach, F.lit(-1)))
    ends = ends.withColumn("__span", F.sum((F.col("__start") > F.col("__reach")).cast("int")).over(order))
    spans = ends.groupBy(*key, "__span").agg(F.min("__start").alias("start"), F.max("__end").alias("end"))
    found = spans.groupBy(*key).agg(
        F.sum(F.col("end") - F.col("start")).alias("__hit"), F.sort_array(F.collect_list(F.struct("start", "end"))).alias("__spans")
    )
    named = hits.groupBy(*key).agg(F.sort_array(F.collect_set("__item")).alias("__items"))
    result = found.join(named, key)
    return (
        with_row_key(docs, id_col, text_col)
        # counted before the join, so that the text moves only if the caller keeps it
        .withColumn("__words", F.size(words_of(F.col(text_col))).cast("long"))
        .join(result, key, "left")
        .select(
            *others(docs, new),
            F.col("__words").alias("n_words"),
            F.coalesce("__hit", F.lit(0)).cast("long").alias("n_hit"),
            F.coalesce(F.size("__items"), F.lit(0)).cast("long").alias("n_items"),
            F.coalesce("__items", F.array().cast("array<string>")).alias("items"),
            F.coalesce("__spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans"),
        )
    )


@own_names
def drop_contaminated(docs: DataFrame, items: DataFrame, n: int = 10, **cols) -> DataFrame:
    """``docs`` without the documents that hold a window of an item, columns unchanged."""
    id_col, text_col = cols.get("id_col", "doc_id"), cols.get("text_col", "text")
    hits = find_hits(docs, items, n, id_col, text_col, cols.get("item_id", "item_id"), cols.get("item_text", "text"))
    keyed = with_row_key(docs, id_col, text_col)
    return keyed.join(hits.select("__rk", "__rd").distinct(), ["__rk", "__rd"], "left_anti").select(*[f"`{c}`" for c in docs.columns])
