"""Per-company reports: A7 concat_summaries, D10 collective overview, S8 collective report,
S9 run-result artifact, U11 summary-report registry rows.

A company's document list is unbounded, so its text is never assembled in one task: blocks are
numbered with the skew-safe ``ordinal`` and packed into *parts* of at most ``BLOCKS_PER_PART``
blocks; a report is the ordered sequence of its parts, which one task streams into the company's Markdown file. The filings table only ever holds the newest ``limit`` (<= 100) rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filingflow.functions import text as X
from filingflow.operators.common import cut_lineage, ordinal, top_k
from filingflow.sources.files import read_files, write_text_files
from filingflow.sources.listing import listing_frame, newest_items


BLOCKS_PER_PART = 50
OVERVIEW_WORDS = 300
NO_DOCUMENTS = "*No documents to summarize*"


def is_document(name: Column) -> Column:
    """F14 (summary side): .pdf / .html / .htm, case-sensitive."""
    return name.endswith(".pdf") | name.endswith(".html") | name.endswith(".htm")


def summary_blocks(files: DataFrame) -> DataFrame:
    """A7 blocks: ``\\n## File i/N: name ##\\n`` + summary (or the not-found line), numbered per company."""
    docs = files.where(is_document(F.col("file_name")))
    num = ordinal(docs, ["company"], "id", out="file_i", total="file_n")
    body = F.when(F.col("summary_text").isNotNull(), F.concat(F.col("summary_text"), F.lit("\n"))).otherwise(
        F.concat(F.lit("File not found: "), F.col("company"), F.lit("/"), F.col("file_name"), F.lit("\n"))
    )
    block = F.concat(
        F.lit("\n## File "), F.col("file_i").cast("string"), F.lit("/"), F.col("file_n").cast("string"), F.lit(": "),
        F.col("file_name"), F.lit(" ##\n"), body,
    )
    return num.select("company", "file_i", "file_n", block.alias("block"))


def concat_summaries(files: DataFrame) -> DataFrame:
    """(company, part, text) — the ordered blocks of each company, ``BLOCKS_PER_PART`` per part.
    A company whose files include no document gets the single line ``*No documents to summarize*``."""
    b = summary_blocks(files).withColumn("part", F.floor((F.col("file_i") - 1) / BLOCKS_PER_PART).cast("int"))
    parts = b.groupBy("company", "part").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("file_i", "block"))), lambda x: x["block"]), "").alias("text")
    )
    none = (
        files.groupBy("company").agg(F.count_if(is_document(F.col("file_name"))).alias("n"))
        .where(F.col("n") == 0)
        .select("company", F.lit(0).alias("part"), F.lit(NO_DOCUMENTS).alias("text"))
    )
    return parts.unionByName(none)


def collective_overview(files: DataFrame, words: int = OVERVIEW_WORDS) -> DataFrame:
    """D10 default (no model): (company, overview), the sentences with the most different words among all files of the
    company, as many as fit into ``words`` words, in file order.

    Every sentence of every summary is ranked. A budget of ``words`` words holds at most as many
    sentences, so that many per company leave the partial top-k, whatever the company's size. A
    company without a summary has no row.
    """
    docs = files.where(is_document(F.col("file_name")) & F.col("summary_text").isNotNull())
    rows = docs.select("company", "id", F.explode(X.sentence_rows(F.col("summary_text"))).alias("r"))
    rows = rows.select("company", "id", "r.*")
    rank = [F.col("score"), F.col("id"), F.col("pos")]
    top = top_k(rows, ["company"], rank, F.lit(words), F.col("id"), out="rn")
    used = F.sum("n").over(Window.partitionBy("company").orderBy(*rank).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    cut = F.array_join(F.slice(F.split("s", " "), 1, words), " ")  # a first sentence that is too long by itself
    top = top.withColumn("used", used).withColumn("s", F.when(F.col("rn") == 1, cut).otherwise(F.col("s")))
    kept = top.where((F.col("used") <= words) | (F.col("rn") == 1))
    lines = F.sort_array(F.collect_list(F.struct("id", "pos", "s")))
    return kept.groupBy("company").agg(F.array_join(F.transform(lines, lambda x: x["s"]), " ").alias("overview"))


# The collective prompt sent to a caller's model, and what replaces its answer if it fails.
COLLECTIVE_PROMPT = (
    "Na podstawie poniższych pojedynczych streszczeń raportów giełdowych dla firmy {company}, \n"
    "stwórz JEDNO ZBIORCZE PODSUMOWANIE (około 300-500 słów) które:\n\n"
    "1. Wyciąga najważniejsze informacje ze wszystkich raportów\n"
    "2. Identyfikuje kluczowe trendy i zmiany\n"
    "3. Podaje konkretne liczby i fakty\n"
    "4. Jest napisane profesjonalnym językiem finansowym\n"
    "5. Odpowiada na pytanie: Jak wiedzie się firmie?\n\n"
    "Pojedyncze streszczenia raportów:\n\n"
    "{individual_summaries}\n\n"
    "ZBIORCZY RAPORT (po polsku):"
)


# What comes before the reason and the summaries when the model fails, and the tokens it may answer with.
COLLECTIVE_FAILED = "❌ Nie udało się wygenerować zbiorczego raportu: "
COLLECTIVE_BUDGET = 1500


def collective_prompts(files: DataFrame) -> DataFrame:
    """(company, part, summaries, prompt): the collective prompt over the concatenated summaries, one prompt for each part of at
    most ``BLOCKS_PER_PART`` files, so that a prompt is bounded."""
    head, rest = COLLECTIVE_PROMPT.split("{company}")
    middle, tail = rest.split("{individual_summaries}")
    text = F.concat(F.lit(head), F.col("company"), F.lit(middle), F.col("text"), F.lit(tail))
    return concat_summaries(files).where(F.col("text") != NO_DOCUMENTS).select("company", "part", F.col("text").alias("summaries"), text.alias("prompt"))


def overview_with_model(files: DataFrame, model_fn, budget: int = COLLECTIVE_BUDGET) -> DataFrame:
    """D10 hook: (company, part, overview) from a caller's model (prompt, token budget), built once per partition; where it raises,
    the failure text with the reason, a blank line and the summaries themselves; other rows go on."""

    def run(batches):
        fn = model_fn()
        for pdf in batches:
            out = []
            for prompt, summaries in zip(pdf["prompt"], pdf["summaries"]):
                try:
                    out.append(fn(prompt, budget))
                except Exception as e:  # noqa: BLE001 - whatever the caller's model raises
                    out.append(f"{COLLECTIVE_FAILED}{e}\n\n{summaries}")
            yield pdf[["company", "part"]].assign(overview=out)

    return collective_prompts(files).mapInPandas(run, "company string, part int, overview string")


# ----------------------------------------------------------------------------- pipe table

TABLE_COLUMNS = ["date", "title", "report type", "report category", "exchange rate", "rate change", "link"]
NUMERIC_COLUMNS = {"exchange rate", "rate change"}


def _strip_fraction_zeros(s: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(s, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def _g_format(x: Column) -> Column:
    """Python ``format(v, 'g')``: six significant digits; fixed notation when the decimal exponent
    lies in [-4, 6), otherwise ``d.ddddde+XX``; trailing zeros removed. The exponent is read from
    the value rounded to six digits; it gives the fixed notation's precision."""
    d = x.cast("double")
    sci = F.format_string("%.5e", d)
    exp = F.regexp_extract(sci, r"e([+-]\d+)$", 1).cast("int")
    digits = F.greatest(F.lit(0), F.least(F.lit(9), 5 - exp))  # one format by the exponent, not a branch for each
    fixed = _strip_fraction_zeros(F.call_function("format_string", F.concat(F.lit("%."), digits.cast("string"), F.lit("f")), d))
    mant, ex = F.regexp_extract(sci, r"^(.*)e", 1), F.regexp_extract(sci, r"(e[+-]\d+)$", 1)
    scientific = F.concat(_strip_fraction_zeros(mant), ex)
    general = F.when(d == 0, F.lit("0")).when((exp >= -4) & (exp < 6), fixed).otherwise(scientific)
    # exact fast path: below 1e4 with at most two decimals the value has at most six significant
    # digits, so its two-decimal text without trailing zeros is already the 'g' text
    short = F.rtrim(F.rtrim(d.cast("decimal(20,2)").cast("string"), F.lit("0")), F.lit("."))  # the text always has a point
    out = F.when((F.abs(d) < 1e4) & (F.bround(d, 2) == d), short).otherwise(general)
    return F.when(out == "-0", F.lit("0")).otherwise(out)


def listing_tables(frame: DataFrame, key: str, limit: int) -> DataFrame:
    """(key, n_rows, table): the newest ``limit`` listing rows of each key as a Markdown pipe table.

    Row-wise and code-generated: cells are plain column expressions, widths and decimal places
    are window maxima over the key (already partitioned by the top-k window), lines are padded
    per row, and only the at most ``limit`` + 2 finished lines are collected per key.
    """
    w = Window.partitionBy(key).orderBy(F.desc("ord"))
    top = frame.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= limit)
    wk = Window.partitionBy(key)
    cell = {c: f"__c{i}" for i, c in enumerate(TABLE_COLUMNS)}
    width = {c: f"__w{i}" for i, c in enumerate(TABLE_COLUMNS)}

    def frac_len(t: Column) -> Column:
        return F.when(t.contains("."), F.length(t) - F.instr(t, ".")).otherwise(0)

    cols = []
    for c in TABLE_COLUMNS:
        src = F.col(f"`{c}`")
        cols.append((_g_format(src) if c in NUMERIC_COLUMNS else F.coalesce(src.cast("string"), F.lit(""))).alias(cell[c]))
    t = top.select(key, "__rn", *cols)
    for c in NUMERIC_COLUMNS:
        v = F.col(cell[c])
        decs = F.max(frac_len(v)).over(wk)
        aligned = F.when(v.contains("."), F.rpad(v, F.length(v) + decs - frac_len(v), " ")).otherwise(
            F.when(decs > 0, F.rpad(v, F.length(v) + decs + 1, " ")).otherwise(v)
        )
        t = t.withColumn(cell[c], aligned)
    t = t.select("*", *[F.greatest(F.lit(len(c) + 2), F.max(F.length(cell[c])).over(wk)).alias(width[c]) for c in TABLE_COLUMNS])

    def pad(v: Column, c: str) -> Column:
        return F.lpad(v, F.col(width[c]), " ") if c in NUMERIC_COLUMNS else F.rpad(v, F.col(width[c]), " ")

    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[pad(F.col(cell[c]), c) for c in TABLE_COLUMNS]), F.lit(" |"))
    header = F.concat(F.lit("| "), F.concat_ws(" | ", *[pad(F.lit(c), c) for c in TABLE_COLUMNS]), F.lit(" |"))
    align = F.concat(
        F.lit("|"),
        F.concat_ws(
            "|",
            *[
                F.concat(F.repeat(F.lit("-"), F.col(width[c]) + 1), F.lit(":"))
                if c in NUMERIC_COLUMNS
                else F.concat(F.lit(":"), F.repeat(F.lit("-"), F.col(width[c]) + 1))
                for c in TABLE_COLUMNS
            ],
        ),
        F.lit("|"),
    )
    g = t.select(key, "__rn", line.alias("__line"), header.alias("__h"), align.alias("__a")).groupBy(key).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.first("__h").alias("__h"),
        F.first("__a").alias("__a"),
        F.sort_array(F.collect_list(F.struct("__rn", "__line"))).alias("__lines"),
    )
    table = F.array_join(F.concat(F.array("__h", "__a"), F.transform("__lines", lambda x: x["__line"])), "\n")
    return g.select(key, "n_rows", table.alias("table"))


# Headings and labels of the report, here and in ``report_header``.
DEFAULT_FOOTER = "*Raport wygenerowany automatycznie*"


def report_header(company: Column, as_of: str, date_from: Column, date_to: Column, n_reports: Column, n_files: Column,
                  model: str, overview: Column, table: Column) -> Column:
    """S8 part 0: title, metadata, overview, filings table, heading of the per-file summaries."""
    return F.concat(
        F.lit("# Zbiorczy Raport GPW - "), company, F.lit(f"\n\n**Wygenerowano:** {as_of}\n\n---\n\n"),
        F.lit("## 📊 Informacje o raporcie\n\n- **Firma:** "), company,
        F.lit("\n- **Okres:** "), date_from, F.lit(" - "), date_to,
        F.lit("\n- **Liczba raportów:** "), n_reports.cast("string"),
        F.lit("\n- **Pobranych plików:** "), n_files.cast("string"),
        F.lit(f"\n- **Model AI:** {model}\n\n---\n\n## 📝 Zbiorczy Raport (Analiza LLM)\n\n"),
        F.coalesce(overview, F.lit("*Brak zbiorczego podsumowania*")),
        F.lit("\n\n---\n\n## 📋 Lista raportów\n\n"),
        F.when(table.isNull(), F.lit("*Brak raportów*\n\n")).otherwise(F.concat(table, F.lit("\n\n"))),
        F.lit("---\n\n## 🤖 Szczegółowe Podsumowania Dokumentów (AI)\n\n"),
    )


def collective_report(items: DataFrame, files: DataFrame, as_of: str, model: str, date_request: str = "",
                      limit: int = 5, footer: str = DEFAULT_FOOTER) -> DataFrame:
    """(company, part, text) — part 0 header + table, parts 1.. the A7 parts, last part the footer.

    ``items``: the rows of S1 with ``company`` (only the newest ``limit`` of each are typed);
    ``files``: (id, company, file_name, summary_text). Company keys are compared lower-cased.
    """
    dfrom, dto = X.range_from_to(F.lit(date_request))
    newest = newest_items(items.withColumn("company", F.lower("company")), "company", limit)
    # a few rows per company, read by all three kinds of parts
    listing = cut_lineage(listing_tables(listing_frame(newest), "company", limit), "report-listing")
    fl = files.withColumn("company", F.lower("company"))
    counts = fl.groupBy("company").agg(F.count(F.lit(1)).alias("n_files"), F.count_if(is_document(F.col("file_name"))).alias("n_docs"))
    heads = listing.join(counts, "company", "left").join(collective_overview(fl), "company", "left")
    head = heads.select(
        "company", F.lit(0).alias("part"),
        report_header(
            F.col("company"), as_of, dfrom, dto, F.col("n_rows"), F.coalesce("n_files", F.lit(0)), model,
            F.col("overview"), F.col("table"),
        ).alias("text"),
    )
    body = concat_summaries(fl).join(listing.select("company"), "company", "left_semi")
    body = body.select("company", (F.col("part") + 1).alias("part"), "text")
    # files without a document still have one part, the line that says so
    parts = F.when(F.col("n_files").isNull(), F.lit(0)).otherwise(F.greatest(F.lit(1), F.ceil(F.col("n_docs") / BLOCKS_PER_PART)))
    tail = listing.select("company").join(counts, "company", "left").select(
        "company", (parts + 1).cast("int").alias("part"), F.lit(f"\n\n---\n\n{footer}\n").alias("text")
    )
    return head.unionByName(body).unionByName(tail)


def write_reports(parts: DataFrame, path: str, content: bool = True) -> DataFrame:
    """S8 sink: one Markdown file ``<company>.md`` for each company, its parts in order; returns (``company``, ``file_size``, ``content``)
    of the files as they were committed (without ``content`` only their sizes). A company of very many parts has further volumes (``<company>.2.md``)."""
    write_text_files(parts.withColumn("name", F.concat("company", F.lit(".md"))), path)
    files = read_files(parts.sparkSession, path, "*.md", content)
    return files.select(F.regexp_replace("name", r"\.md$", "").alias("company"), F.col("size").alias("file_size"), "content")


def write_run_results(runs: DataFrame, path: str) -> DataFrame:
    """S9 sink: one text file ``<job>_<run>.txt`` for each run of (``id``, ``job_name``, ``text``); returns (``id``, ``content``) of the
    files as they were committed."""
    name = F.concat("job_name", F.lit("_"), F.col("id").cast("string"), F.lit(".txt"))
    write_text_files(runs.select(name.alias("name"), F.lit(0).alias("part"), "text"), path)
    files = read_files(runs.sparkSession, path, "*.txt")
    return files.select(F.regexp_extract("name", r"_([0-9]+)\.txt$", 1).cast("long").alias("id"), "content")


def run_result_text(company: Column, as_of: str, date_to: Column, model: Column, status_text: Column, n_docs: Column) -> Column:
    """The run artifact — header lines, status text, attachment count."""
    rule = "=" * 80
    return F.concat(
        F.lit("Raport GPW - "), company, F.lit(f"\nWygenerowano: {as_of}\nDzień: "), F.coalesce(date_to.cast("string"), F.lit("None")),
        F.lit("\nModel: "), model, F.lit(f"\n{rule}\n\n"), status_text, F.lit(f"\n\n{rule}\nZnaleziono "), n_docs.cast("string"),
        F.lit(" załączników\n"),
    )


def scrape_status_text(n_files: Column) -> Column:
    """The scrape's status line: ``SUCCESS! downloaded N files `` (count part only when N > 0)."""
    return F.concat(F.lit("SUCCESS! "), F.when(n_files > 0, F.concat(F.lit("downloaded "), n_files.cast("string"), F.lit(" files "))).otherwise(F.lit("")))


def summary_report_rows(reports: DataFrame, as_of_stamp: str, report_dir: str = "reports") -> DataFrame:
    """Registry rows for generated reports: dates converted (N/A -> NULL), preview = first
    200 characters of the overview, tags as JSON, format ``md`` (X9)."""
    df = X.parse_date_text(F.col("date_from_text"))
    dt = X.parse_date_text(F.col("date_to_text"))
    return reports.select(
        "job_name", "company",
        F.when(F.col("date_from_text") != "N/A", df).alias("date_from"),
        F.when(F.col("date_to_text") != "N/A", dt).alias("date_to"),
        F.col("report_count").cast("int").alias("report_count"),
        F.col("document_count").cast("int").alias("document_count"),
        F.concat(F.lit(f"{report_dir}/"), F.col("company"), F.lit(f"_{as_of_stamp}_summary.md")).alias("file_path"),
        F.lit("md").alias("file_format"),
        F.col("file_size").cast("bigint").alias("file_size"),
        F.col("model_used"),
        F.substring("overview", 1, 200).alias("summary_preview"),
        X.json_list_encode(F.array(F.lower("company"), F.replace(F.col("job_name"), F.lit("_"), F.lit("-")))).alias("tags"),
    )
