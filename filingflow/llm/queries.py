"""The ``opN_*`` queries: each operator over its whole table, and the DuckDB statement where SQL has one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filingflow.llm import decontamination, fingerprints, hard_negatives, html_extraction, language_id, line_dedup, mixing, periodic_runs, quality, sharding, simhash, suffix_dedup, token_store
from filingflow.llm.common import load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return deco


_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


@register(
    "op1_line_dedup",
    f"""
WITH lines AS (
  SELECT doc_id, i AS pos, ls[i] AS line, translate(trim(ls[i], {_WS}), {_LOWER}) AS key
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
shared AS (SELECT key FROM lines WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
marked AS (SELECT l.*, s.key IS NOT NULL AS lost FROM lines l LEFT JOIN shared s ON l.key = s.key)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(lost AS BIGINT)) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""",
)
def q_line_dedup(spark, sf_dir):
    kept = line_dedup.dedup_lines(load(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10, min_chars=1)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


@register("op2_language_id")
def q_language_id(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return language_id.identify(docs, folds=4, held=2).select("doc_id", "held_out", "lang_pred", "score", "label_share")


@register("op3_fingerprints")
def q_fingerprints(spark, sf_dir):
    return fingerprints.edit_likeness(load(spark, sf_dir, "documents").select("doc_id", "text"))


@register(
    "op4_mixing",
    r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':mix-1:' || md5(coalesce(text, ''))) AS h FROM documents),
src AS (
  SELECT source, CAST(sum(size) AS DOUBLE) AS ss,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w
  FROM sized GROUP BY source),
lv AS (
  SELECT source, ss, w, (1.5 * sum(ss) OVER ()
      - coalesce(sum(2 * ss) OVER (ORDER BY 2 * ss / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY 2 * ss / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM src),
water AS (SELECT first(level ORDER BY 2 * ss / w, source NULLS LAST) AS level FROM lv WHERE 2 * ss > w * level),
tgt AS (SELECT source, ss, least(2 * ss, w * coalesce((SELECT level FROM water), 0)) AS target FROM src),
rated AS (
  SELECT d.doc_id, d.source, d.size, t.ss, t.target, CASE WHEN t.ss > 0 THEN t.target / t.ss ELSE 0 END AS rate,
    CAST(('0x' || substr(h, 1, 13)) AS BIGINT) AS a, CAST(('0x' || substr(h, 14, 13)) AS BIGINT) AS b
  FROM sized d JOIN tgt t ON d.source IS NOT DISTINCT FROM t.source),
tried AS (
  SELECT doc_id, source, size, ss, target, floor(rate) AS whole, j,
    CAST((a + j * b) & 4503599627370495 AS DOUBLE) < (rate - floor(rate)) * 4503599627370496.0::DOUBLE AS extra
  FROM rated, range(32) AS seeds(j)),
best AS (
  SELECT source, j FROM (
    SELECT source, j, abs(CAST(sum(CASE WHEN extra THEN size ELSE 0 END) AS DOUBLE) + any_value(whole) * any_value(ss) - any_value(target)) AS off
    FROM tried GROUP BY source, j)
  QUALIFY row_number() OVER (PARTITION BY source ORDER BY off, j) = 1)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(ss AS BIGINT) AS source_size, target,
  CAST(size * (whole + CASE WHEN extra THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM tried t JOIN best ON t.source IS NOT DISTINCT FROM best.source AND t.j = best.j
""",
)
def q_mixing(spark, sf_dir):
    plan = mixing.mix_plan(load(spark, sf_dir, "documents").select("doc_id", "text", "source"), weights=(5, 2, 1), budget=1.5, cap=2.0)
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


@register("op5_simhash")
def q_simhash(spark, sf_dir):
    return simhash.near_duplicates(load(spark, sf_dir, "documents"), shingle=3, distance=3)


@register("op6_suffix_dedup")
def q_suffix_dedup(spark, sf_dir):
    cut = suffix_dedup.remove_repeats(load(spark, sf_dir, "documents").select("doc_id", "text"), length=400)
    return cut.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


@register("op7_token_ids")
def q_token_ids(spark, sf_dir):
    shards = token_store.write_shards(load(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    return token_store.read_documents(shards)


@register("op8_quality")
def q_quality(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.classify(docs, load(spark, sf_dir, "labels").select("doc_id", "quality"), folds=3, held=1)
    return scored.select("doc_id", "held_out", "score", "predicted")


@register(
    "op9_decontamination",
    r"""
WITH dw AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
bw AS (
  SELECT CAST(item_id AS VARCHAR) AS item, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
grams AS (
  SELECT DISTINCT item, k, array_to_string(w[i : i + k - 1], ' ') AS gram
  FROM (SELECT item, w, least(len(w), 10) AS k, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM bw WHERE len(w) > 0)),
lens AS (SELECT DISTINCT k FROM grams),
wins AS (
  SELECT doc_id, i, k, array_to_string(w[i : i + k - 1], ' ') AS gram
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, lens WHERE len(w) >= k)),
hits AS (SELECT DISTINCT doc_id, i, w.k, item FROM wins w JOIN grams g ON w.gram = g.gram AND w.k = g.k),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS sha FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  coalesce(sha, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
""",
)
def q_decontamination(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.decontaminate(docs, load(spark, sf_dir, "benchmark"), n=10)
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


@register("op10_sharding")
def q_sharding(spark, sf_dir):
    return sharding.shard_documents(load(spark, sf_dir, "documents").select("doc_id", "text"), n=8)


@register("op11_html_extraction")
def q_html_extraction(spark, sf_dir):
    pages = load(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_extraction.extract_main_text(pages).select("page_id", "url", "text", "n_chars")


@register(
    "op12_hard_negatives",
    """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, a.label = v.label AS same, v.vec_id, CAST(list_dot_product(a.q, v.q) AS BIGINT) AS score
  FROM v a JOIN v ON a.vec_id % 100 = 0 AND v.vec_id <> a.vec_id),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) <= 10
""",
)
def q_hard_negatives(spark, sf_dir):
    rows = load(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(rows.withColumn("label", label), F.col("vec_id") % 100 == 0, positives=5, negatives=10, low=30, high=90)


def with_planted_period(docs: DataFrame) -> DataFrame:
    """The contract's input of op13: texts whose id draws 0 of 10 become periodic from word ``a`` on (a null id draws nothing).

    The period is cut out of the words once and repeated as a whole, so a text of any length is linear work.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    drawn = docs.withColumn("h", h).withColumn("words", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), 0)))
    drawn = drawn.withColumn("n", F.when(F.col("words").isNotNull(), F.size("words"))).withColumn("g", F.floor(F.col("h") / 10))
    drawn = drawn.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    drawn = drawn.withColumn("p", (F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)) + 1).cast("int"))
    times = F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")
    tail = F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), times))
    new = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), F.slice(tail, F.lit(1), F.col("n") - F.col("a"))), " ")
    return drawn.select("doc_id", F.when(F.col("a").isNotNull(), new).otherwise(F.col("text")).alias("text"))


@register("op13_periodic_runs")
def q_periodic_runs(spark, sf_dir):
    docs = with_planted_period(load(spark, sf_dir, "documents").select("doc_id", "text"))
    found = periodic_runs.collapse_runs(docs, least=12)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    text = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-best["start"]).alias("start"),
        best["length"].alias("length"),
        (-best["period"]).alias("period"),
        F.floor(1000 * F.try_divide(best["length"].cast("decimal(20,0)"), -best["period"])).cast("long").alias("exponent_milli"),
        F.sha2(text, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
