"""From raw documents to shards: language, near-duplicates, benchmark leaks, mixture, shards.

Each stage takes (spark, docs, sf_dir) and returns what it kept with the columns of documents, the last
one the shards. ``run`` writes every stage's rows as Parquet to the shared checkpoint folder and
reads them back as the next one's input, so each stage starts from files and an executor that is lost
costs its tasks only. Rows with nulls in any column pass through like others, empty tables give empty
tables, and extra columns stay as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filingflow.llm import decontamination, language_id, mixing, sharding, simhash
from filingflow.llm.common import load, written

# A language fits if its mean probability over all bytes is this part of the way from chance (1 / languages) to certainty.
LANGUAGE_MARGIN = 0.1
SHARDS = 8

#: Training of a network and float arithmetic; SQL has neither.
ORACLE_SQL = None


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those whose bytes no language fits; learns from the non-null
    ``lang`` of these documents."""
    net = language_id.learn(docs, language_id.Training(), F.lit(True), "doc_id", "text", "lang")
    own = {c: f"__own_{i}" for i, c in enumerate(docs.columns) if c.lower() in ("lang_pred", "score", "label_share")}
    labelled = language_id.label_languages(docs.withColumnsRenamed(own), net, "text")
    chance = 1 / len(net.langs) if net else 1.0
    known = (F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= chance + LANGUAGE_MARGIN * (1 - chance) - 1e-3)
    kept = labelled.where(known if net else F.col("text").rlike(r"\p{L}")).drop("lang_pred", "score", "label_share")
    return kept.withColumnsRenamed({v: k for k, v in own.items()}).select(*[f"`{c}`" for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose SimHash fingerprints link (three words, three bits)."""
    return simhash.keep_representatives(docs, shingle=3, distance=3)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold ten consecutive words of a benchmark item (a shorter item: all of it)."""
    return decontamination.drop_contaminated(docs, load(spark, sf_dir, "benchmark"), n=10)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and skips documents so that sources come near their target shares of words."""
    return mixing.mix(docs, weights=(5, 2, 1), budget=1.5, cap=2.0)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row of the mixture."""
    return sharding.shard_documents(docs, n=SHARDS)


STAGES = [
    ("language", keep_known_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("mixture", mix_sources),
    ("shards", shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; the rows of the last."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
