"""Operator 4, mixing sources to target weights.

Native. Sizes are summed per source before the shuffle, so a source with a third of all rows is one
row per task. The targets follow from one row per source (shares by weight, capped, the excess
dealt again); each document is then emitted floor(rate) times and once more with probability
equal to the fraction, by a draw that its id, its text and the seed alone decide. One aggregate
gives the words that each of 32 fixed seeds takes; a source uses the seed that comes nearest its target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filingflow.llm.common import others, own_names, shuffle_partitions, written
from filingflow.operators.common import dense_ids

SEED = "mix-1"
DRAW_DIGITS = 13  # hex digits of a draw: 52 bits, exact in a double
DRAW_RANGE = 16**DRAW_DIGITS
SEEDS = 32


def word_count(text: Column) -> Column:
    """Number of runs of anything but ASCII white space (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def draw_parts(id_col: Column, text_col: Column, seed: str) -> tuple[Column, Column]:
    """Two whole numbers below ``DRAW_RANGE`` fixed by the id, the text and the seed."""
    text = F.md5(F.coalesce(text_col, F.lit("")).cast("binary"))
    h = F.md5(F.concat(F.coalesce(id_col.cast("string"), F.lit("null")), F.lit(f":{seed}:"), text).cast("binary"))
    at = lambda i: F.conv(F.substring(h, i, DRAW_DIGITS), 16, 10).cast("long")
    return at(1), at(1 + DRAW_DIGITS)


def extra_copy(a: Column, b: Column, number: Column, part: Column) -> Column:
    """Whether seed ``number`` gives a document one more copy, with probability ``part``; its draws for two seeds are independent."""
    u = (a + number * b).bitwiseAND(F.lit(DRAW_RANGE - 1))
    return u.cast("double") < part * F.lit(float(DRAW_RANGE))


def nearest_seeds(words: DataFrame, targets: DataFrame) -> DataFrame:
    """``targets`` with ``whole`` and ``part`` of each source's rate and the ``number`` of the seed that comes nearest its target.

    ``words`` has (source, size, a, b); all seeds' sums come from one pass, added up before the shuffle.
    """
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rated = targets.withColumn("whole", F.floor(rate)).withColumn("part", rate - F.col("whole")).withColumnRenamed("source", "__s")
    rows = words.join(rated, F.col("source").eqNullSafe(F.col("__s")))
    extra = [F.sum(F.when(extra_copy(F.col("a"), F.col("b"), F.lit(j), F.col("part")), F.col("size")).otherwise(F.lit(0))) for j in range(SEEDS)]
    sums = rows.groupBy("__s", "source_size", "target", "whole", "part").agg(*[e.alias(f"__x{j}") for j, e in enumerate(extra)])
    off = [F.abs(F.col(f"__x{j}") + F.col("whole") * F.col("source_size") - F.col("target")) for j in range(SEEDS)]
    best = F.array_min(F.array(*[F.struct(o.alias("off"), F.lit(j).alias("j")) for j, o in enumerate(off)]))["j"]
    return sums.select("__s", "source_size", "target", "whole", "part", best.alias("number"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...], budget: float, cap: float) -> DataFrame:
    """One row per source: ``source``, ``source_size``, ``target``.

    ``sizes`` has (source, size). Sources in code point order, null last, take ``weights`` in turn and
    share ``budget`` times the total; a target stops at ``cap`` times its source and the rest is
    shared again by weight until none is above.
    """
    spark = sizes.sparkSession
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("__last", F.col("source").isNull())
    per = written(per, "mix-sizes")  # read twice below; the words are counted once
    # numbered range by range; no task holds all sources
    num = dense_ids(per, ["__last", "source"], out="__i", partitions=min(8, shuffle_partitions(spark)))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("__i") - 1) % len(weights) + 1).cast("int"))
    src = written(
        num.select("source", "source_size", w.alias("__w"), (F.col("source_size") * F.lit(float(cap))).alias("__cap")), "mix-sources"
    )
    total, all_w = src.agg(F.sum("source_size"), F.sum("__w")).first()
    total = float(total or 0) * budget
    level, capped = (total / all_w if all_w else 0.0), 0
    while True:
        full = F.col("__cap") <= F.col("__w") * F.lit(level)
        n, used, left = src.agg(
            F.count(F.when(full, 1)), F.coalesce(F.sum(F.when(full, F.col("__cap"))), F.lit(0.0)), F.sum(F.when(~full, F.col("__w")))
        ).first()
        if n == capped or not left:
            break
        capped, level = n, (total - used) / left
    share = F.col("__w") * F.lit(level)
    return src.select("source", "source_size", F.when(F.col("__cap") <= share, F.col("__cap")).otherwise(share).alias("target"))


@own_names
def mix_plan(
    docs: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    budget: float = 1.5,
    cap: float = 2.0,
    seed: str = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target`` and ``copies`` (columns of these names are replaced).

    A document without words has size 0 and is emitted by the same draw; a source without words has
    target and rate 0. Null sources are one source, last. Rows with the same id and text share one draw
    (a null text draws as an empty one). An empty table gives an empty table.
    """
    new = ["size", "source_size", "target", "copies"]
    rest = others(docs, new)
    a, b = draw_parts(F.col(id_col), F.col(text_col), seed)
    size = word_count(F.col(text_col))
    # written: sizes and draws are read several times, the texts once
    words = written(docs.select(F.col(source_col).alias("source"), size.alias("size"), a.alias("a"), b.alias("b")), "mix-words")
    plan = written(nearest_seeds(words, source_targets(words.select("source", "size"), weights, budget, cap)), "mix-seeds")
    sized = docs.select(*rest, size.alias("size"), F.col(source_col).alias("__source"), a.alias("__a"), b.alias("__b"))
    copies = F.col("whole") + extra_copy(F.col("__a"), F.col("__b"), F.col("number"), F.col("part")).cast("int")
    return sized.join(plan, F.col("__source").eqNullSafe(F.col("__s")), "left").select(
        *rest, "size", "source_size", "target", copies.cast("int").alias("copies")
    )


@own_names
def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixture itself: the columns of ``docs``, each document ``copies`` times (0: not at all)."""
    plan = ("size", "source_size", "target", "copies")
    own = {c: f"__own_{i}" for i, c in enumerate(docs.columns) if c.lower() in plan}  # set aside and given back
    rows = mix_plan(docs.withColumnsRenamed(own), **options).where(F.col("copies") > 0)
    rows = rows.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop(*plan, "__copy")
    return rows.withColumnsRenamed({v: k for k, v in own.items()}).select(*[f"`{c}`" for c in docs.columns])
