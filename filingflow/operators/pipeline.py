"""The whole condensation run as one DAG over all companies and files at once.

listing pages -> Job N -> registry files -> chunks -> size tier -> (empty / too few chunks) ->
embeddings -> per-document k-means -> representatives -> prompts -> summaries -> write-back ->
per-company blocks, overview and report. Nothing is collected.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filingflow.operators import documents as D
from filingflow.operators import registry as R
from filingflow.operators import report as P
from filingflow.operators.common import cut_lineage
from filingflow.sources import listing as L
from filingflow.sources import tables as T


def condense_files(files: DataFrame, model: str, chunk_size: int = 2000) -> DataFrame:
    """Per file: (id, company, file_name, summary, error) — summary for condensed files and for
    empty ones (its fixed message is stored, X17); error for files with fewer chunks than
    clusters (the run continues, nothing is stored)."""
    k, budget = D.size_tier(F.col("n_pages"))
    base = files.select("id", "company", "file_name", "n_pages", k.alias("k"), budget.alias("budget"), D.pages_of(files).alias("pages"))
    # read by the counts, the embedding and the prompts: written once
    chunks = cut_lineage(D.chunk_documents(base.select("id", "pages"), chunk_size, id_col="id"), "chunks")
    counts = chunks.groupBy("id").agg(F.count(F.lit(1)).alias("n_chunks"))
    meta = base.drop("pages").join(counts, "id", "left").withColumn("n_chunks", F.coalesce("n_chunks", F.lit(0)))
    empty = meta.where(F.col("n_chunks") == 0).select(
        "id", "company", "file_name", D.empty_document_message(F.col("file_name")).alias("summary"),
        F.lit(None).cast("string").alias("error"),
    )
    few = meta.where((F.col("n_chunks") > 0) & (F.col("n_chunks") < F.col("k"))).select(
        "id", "company", "file_name", F.lit(None).cast("string").alias("summary"),
        D.too_few_chunks_message(F.col("n_chunks"), F.col("k")).alias("error"),
    )
    ok = meta.where(F.col("n_chunks") >= F.col("k"))
    ok_chunks = chunks.join(ok.select("id"), "id", "left_semi")
    emb = D.embed_chunks(ok_chunks)
    pts = emb.select(F.col("id").alias("grp"), F.col("chunk_no").cast("bigint").alias("pid"), "vec")
    clustered = D.kmeans_per_group(pts, ok.select(F.col("id").alias("grp"), "k"))
    reps = D.unique_picks(D.distances_of_clustering(clustered))
    reps = reps.join(emb.select(F.col("id").alias("grp"), F.col("chunk_no").cast("bigint").alias("pid"), "chunk"), ["grp", "pid"])
    prompts = D.build_prompts(reps).withColumnRenamed("grp", "id").join(ok.select("id", "company", "file_name", "n_pages", "budget"), "id")
    summed = D.summarise(prompts, model).select(
        "id", "company", "file_name", "summary", F.lit(None).cast("string").alias("error")
    )
    return summed.unionByName(empty).unionByName(few)


class Pipeline:
    """D12 over a registry: each result is a frame of its own, and only what is asked for is planned and run."""

    def __init__(self, spark: SparkSession, sf_dir: str, model: str = "llama3.2:latest", as_of: str = "2024-02-01 00:00:00", pages: DataFrame | None = None):
        self.spark, self.sf_dir, self.model, self.as_of, self.pages = spark, sf_dir, model, as_of, pages

    @cached_property
    def items(self) -> DataFrame:
        return L.listing_page_scan(self.pages if self.pages is not None else T.listing_pages(self.spark, self.sf_dir))

    @cached_property
    def arrivals(self) -> DataFrame:
        return T.file_arrivals(self.spark, self.sf_dir)

    @cached_property
    def condensed(self) -> DataFrame:
        """Summary or error of every downloaded document (the md5 check only keeps duplicates out of the registry, so a
        duplicate's summary has no registry row to be written back to). Written once for all its readers."""
        docs = self.arrivals.where(P.is_document(F.col("file_name")))
        return cut_lineage(condense_files(docs, self.model), "condensed")

    def reports(self) -> DataFrame:
        return L.normalise_listing(self.items)[0]

    def rejected(self) -> DataFrame:
        return L.normalise_listing(self.items)[1]

    def files(self) -> DataFrame:
        """The registry's files after the run, summaries attached."""
        registry = R.register_files(T.downloaded_files(self.spark, self.sf_dir).limit(0), self.arrivals.drop("text", "n_pages", "pages"))
        registry = cut_lineage(registry, "registry")  # read by the match and by the update
        stored = self.condensed.where(F.col("summary").isNotNull())
        att = R.attach_summaries(registry, stored.select("id", "company", "file_name", "summary"))
        changes = att.where(F.col("new_summary").isNotNull()).select("id", F.col("new_summary").alias("summary_text"), F.col("id").alias("change_no"))
        return R.update_file_summary(registry, changes)

    def per_file(self) -> DataFrame:
        failed = F.concat(F.lit("Error processing "), F.col("file_name"), F.lit(": "), F.col("error"))
        return self.condensed.select("id", "company", "file_name", F.coalesce("summary", failed).alias("summary_text"))

    def overview(self) -> DataFrame:
        return P.collective_overview(self.per_file().withColumn("company", F.lower("company")))

    def report(self) -> DataFrame:
        c = T.companies(self.spark, self.sf_dir).select(F.col("id").alias("company_id"), F.col("name").alias("company"))
        return P.collective_report(self.items.join(c, "company_id"), self.per_file(), self.as_of, self.model)
