"""Search surface over the registry: F1-F16, T1-T3.

Optional arguments follow the reference's rule that a falsy value means "no filter". Every
recency order gets the id as a tie-break so ``orderBy().limit()`` (TakeOrderedAndProject, a
per-partition top-k followed by a single merge of k rows per partition) is deterministic.
Point look-ups take a *table* of requests and join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filingflow.functions import text as X
from filingflow.operators.common import cut_lineage, lower_key, top_k


def search_reports(reports: DataFrame, company_id=None, date_from=None, date_to=None, report_type=None, limit=100):
    """inclusive date bounds, newest first."""
    df = reports
    if company_id:
        df = df.where(F.col("company_id") == company_id)
    if date_from:
        df = df.where(F.col("date") >= F.lit(date_from).cast("date"))
    if date_to:
        df = df.where(F.col("date") <= F.lit(date_to).cast("date"))
    if report_type:
        df = df.where(F.col("report_type") == report_type)
    return df.orderBy(F.desc("date"), F.desc("id")).limit(limit)


def search_files(files: DataFrame, company=None, is_summarized=None, recency_col="id"):
    """optional company / summarised filters, newest first, no limit."""
    df = files
    if company:
        df = df.where(F.col("company") == company)
    if is_summarized is not None:
        df = df.where(F.col("is_summarized") == F.lit(bool(is_summarized)))
    return df.orderBy(F.desc(recency_col), F.desc("id"))


def file_by_name(requests: DataFrame, files: DataFrame) -> DataFrame:
    """F3 batched: for each (company, file_name) request the registered file with the smallest id."""
    first = files.groupBy("company", "file_name").agg(
        F.min_by(F.struct("id", "file_size", "md5_hash"), F.col("id")).alias("f")
    )
    q = requests.select("company", "file_name").distinct()
    j = q.join(first, ["company", "file_name"], "left")
    return j.select(
        "company", "file_name", F.col("f.id").alias("file_id"), F.col("f.file_size").alias("file_size"),
        F.col("f.md5_hash").alias("md5_hash"),
    )


def search_summary_reports(summaries: DataFrame, company=None, date_from=None, date_to=None, limit=50):
    """``date_from >= x``, ``date_to <= y`` (NULL dates never match), newest first, tags decoded."""
    df = summaries
    if company:
        df = df.where(F.col("company") == company)
    if date_from:
        df = df.where(F.col("date_from") >= F.lit(date_from).cast("date"))
    if date_to:
        df = df.where(F.col("date_to") <= F.lit(date_to).cast("date"))
    if "tags_json" in df.columns:
        df = df.withColumn("tags", X.json_list_decode(F.col("tags_json"))).drop("tags_json")
    return df.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def browse_summary_reports(summaries: DataFrame, company=None, job_filter=None, limit=50):
    """F4 with limit 50 *then* the case-insensitive job substring, then display columns.

    The limit is applied before the job filter on purpose (the reference filters the 50 rows it
    fetched); Catalyst keeps the GlobalLimit below the Filter.
    """
    top = search_summary_reports(summaries, company=company, limit=limit)
    if job_filter:
        top = top.where(F.lower("job_name").contains(job_filter.lower()))
    na = F.lit("N/A")
    return top.select(
        "id", "job_name", "company",
        F.coalesce(F.col("date_from").cast("string"), na).alias("date_from"),
        F.coalesce(F.col("date_to").cast("string"), na).alias("date_to"),
        F.coalesce(F.upper("file_format"), na).alias("file_format"),
        X.size_kb_text(F.col("file_size")).alias("file_size"),
        F.coalesce(F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"), na).alias("created_at"),
    )


def summary_report_by_id(requests: DataFrame, summaries: DataFrame, id_col="requested_id") -> DataFrame:
    """F6 batched: equality look-up of summary reports by id; misses keep NULLs."""
    q = requests.select(F.col(id_col).alias("requested_id")).distinct()
    return q.join(summaries, q["requested_id"] == summaries["id"], "left").drop("id")


def search_execution_log(log: DataFrame, job_name=None, limit=50) -> DataFrame:
    """newest start first."""
    df = log
    if job_name:
        df = df.where(F.col("job_name") == job_name)
    return df.orderBy(F.desc("started_at"), F.desc("id")).limit(limit)


def decode_job(jobs: DataFrame) -> DataFrame:
    """Job rows as the application reads them: JSON lists decoded, report_limit NULL -> 5."""
    out = jobs.withColumn("report_limit", F.coalesce(F.col("report_limit"), F.lit(5)))
    for c in ("report_types", "report_categories"):
        if c in out.columns and dict(out.dtypes)[c] == "string":
            out = out.withColumn(c, X.json_list_decode(F.col(c)))
    return out


def list_jobs(jobs: DataFrame, enabled_only=False) -> DataFrame:
    """F8: all (or enabled) jobs ordered by job_name."""
    df = jobs.where(F.col("enabled")) if enabled_only else jobs
    return decode_job(df).orderBy("job_name")


def job_by_name(requests: DataFrame, jobs: DataFrame) -> DataFrame:
    """F9 batched: jobs by name, same decoding as F8; misses keep NULLs."""
    q = requests.select(F.col("job_name").alias("requested_job")).distinct()
    j = q.join(jobs, q["requested_job"] == jobs["job_name"], "left")
    return decode_job(j).withColumn(
        "report_limit", F.when(F.col("job_name").isNull(), F.lit(None)).otherwise(F.col("report_limit"))
    )


def recent_searches(history: DataFrame, limit=50) -> DataFrame:
    """newest searches first."""
    return history.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def recent_searches_display(history: DataFrame, limit=2) -> DataFrame:
    """F10 display form: the last ``limit`` searches, NULL or '' shown as "not specified"."""
    top = recent_searches(history, limit)

    def ns(c: str) -> Column:
        return F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("not specified"))

    return top.select(
        "id", ns("company_name").alias("company_name"), ns("report_amount").alias("report_amount"),
        ns("download_type").alias("download_type"), ns("report_date").alias("report_date"),
        ns("report_type").alias("report_type"), ns("report_category").alias("report_category"),
    )


GRAM = 3


def _grams(c: Column, n: int) -> Column:
    """Every distinct run of ``n`` characters (none if the text is shorter)."""
    at = F.sequence(F.lit(1), F.length(c) - n + 1)
    return F.when(F.length(c) >= n, F.array_distinct(F.transform(at, lambda i: F.substring(c, i, F.lit(n))))).otherwise(
        F.array().cast("array<string>")
    )


def company_lookup(requests: DataFrame, companies: DataFrame, name_col="name") -> DataFrame:
    """F11 batched: the request text is a case-insensitive LIKE pattern; first hit = smallest id.

    Each pattern takes the narrowest exact way, by its form:

    * no wildcard: equality, an equi join;
    * text and one ``%`` at its end: the smallest id per name prefix is aggregated first, so a prefix
      that all names share is one row;
    * wildcards only: the smallest id per name length decides;
    * anything else: blocks of ids are read in ascending order, and a pattern visits those that hold all n-grams (of 1 to 3
      characters) of its literal runs, until its first hit (``_first_like``; jobs run while the frame is built).
    """
    q = requests.select(F.col(name_col).alias("pattern")).where(F.col(name_col).isNotNull()).distinct()
    q = q.withColumn("lp", F.lower("pattern")).withColumn("runs", F.filter(F.split("lp", "[%_]"), lambda r: r != ""))
    any_, one = F.col("lp").contains("%"), F.col("lp").contains("_")
    form = (
        F.when(~any_ & ~one, F.lit("text"))
        .when(F.size("runs") == 0, F.lit("wild"))
        .when(F.col("lp").rlike("^[^%_]+%$"), F.lit("prefix"))
        .otherwise(F.lit("grams"))
    )
    q = q.withColumn("form", form)
    c = companies.select("id", lower_key("name").alias("lname")).where(F.col("name").isNotNull())

    text = q.where("form = 'text'").join(c.groupBy("lname").agg(F.min("id").alias("company_id")), F.col("lp") == F.col("lname"), "left")

    starts = c.select("id", F.explode(F.transform(F.sequence(F.lit(1), F.length("lname")), lambda i: F.substring("lname", F.lit(1), i))).alias("start"))
    starts = starts.groupBy("start").agg(F.min("id").alias("company_id"))
    prefix = q.where("form = 'prefix'").join(starts, F.expr("substring(lp, 1, length(lp) - 1)") == F.col("start"), "left")

    lengths = c.groupBy(F.length("lname").alias("len")).agg(F.min("id").alias("id"))  # one row for each length
    least = F.length("lp") - F.length(F.replace("lp", F.lit("_")))
    wild = q.where("form = 'wild'").withColumns({"least": least, "open": any_})
    spans = wild.select("pattern", "least", "open").join(
        F.broadcast(lengths.agg(F.sort_array(F.collect_list(F.struct("len", "id"))).alias("lens")))
    )
    fit = F.filter("lens", lambda x: F.when(F.col("open"), x["len"] >= F.col("least")).otherwise(x["len"] == F.col("least")))
    wild = spans.select("pattern", F.array_min(F.transform(fit, lambda x: x["id"])).alias("company_id"))

    hits = _first_like(q.where("form = 'grams'").select("pattern", "lp", "runs"), c)
    out = [x.select("pattern", "company_id") for x in (text, prefix, wild, hits)]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


BLOCK_IDS = 1024  # ids of a posting block
FIRST_BLOCKS = 16  # blocks that are read first; each next round reads 16 times as many


def _first_like(patterns: DataFrame, names: DataFrame) -> DataFrame:
    """(``pattern``, ``company_id``): the smallest id whose name is like ``lp``, read in ascending blocks of ids with an early end.

    A round reads the next range of ids only. Its postings are (n-gram, block) pairs; a pattern visits the blocks that hold
    all n-grams of its literal runs, and LIKE decides inside them. Patterns with a hit are done, as later ids are larger,
    and the search ends when none is left. Names meet patterns by block, so an n-gram that all names share is no hot key.
    """
    ends = names.agg(F.min("id"), F.max("id")).first()
    longest = F.aggregate("runs", F.lit(""), lambda a, r: F.when(F.length(r) > F.length(a), r).otherwise(a))
    sized = patterns.withColumn("n", F.least(F.lit(GRAM), F.length(longest)))
    of_run = lambda r: F.when(
        F.length(r) >= F.col("n"), F.transform(F.sequence(F.lit(1), F.length(r) - F.col("n") + 1), lambda i: F.substring(r, i, F.col("n")))
    ).otherwise(F.array().cast("array<string>"))
    wanted = sized.select("pattern", "lp", F.array_distinct(F.flatten(F.transform("runs", of_run))).alias("grams"))
    open_ = cut_lineage(wanted, "open-patterns")
    found = open_.select("pattern", F.lit(None).cast("long").alias("company_id")).limit(0)
    at, width = (None, 0) if ends[0] is None else (ends[0] // BLOCK_IDS, FIRST_BLOCKS)
    while at is not None and at <= ends[1] // BLOCK_IDS and not open_.isEmpty():
        inside = names.where(F.col("id").between(at * BLOCK_IDS, (at + width) * BLOCK_IDS - 1))
        inside = inside.withColumn("block", F.floor(F.col("id") / BLOCK_IDS).cast("long"))
        postings = inside.select("block", F.explode(F.flatten(F.array(*[_grams(F.col("lname"), n) for n in range(1, GRAM + 1)]))).alias("gram")).distinct()
        visits = open_.select("pattern", "lp", F.size("grams").alias("need"), F.explode("grams").alias("gram")).join(postings, "gram")
        visits = visits.groupBy("pattern", "lp", "need", "block").agg(F.count(F.lit(1)).alias("got")).where("got = need")
        # written, so that the join below shuffles plain tables, which AQE can split
        visits = cut_lineage(visits.select("pattern", "lp", "block"), "visited-blocks")
        hit = visits.join(inside, "block").where(F.expr("lname LIKE lp")).groupBy("pattern").agg(F.min("id").alias("company_id"))
        hit = cut_lineage(hit, "like-hits")
        found = found.unionByName(hit)
        open_ = cut_lineage(open_.join(hit.select("pattern"), "pattern", "left_anti"), "open-patterns")
        at, width = at + width, width * FIRST_BLOCKS
    return found.unionByName(open_.select("pattern", F.lit(None).cast("long").alias("company_id")))


def list_companies(companies: DataFrame) -> DataFrame:
    """dropdown list, sorted by name."""
    return companies.select("id", "name", "full_name", "sector").orderBy("name", "id")


DEFAULT_RUN_TYPES = ["current", "quarterly", "semi-annual", "annual"]
DEFAULT_CATEGORIES = ["ESPI", "EBI"]


def per_request_limit(rows: DataFrame, request_col: str, order: list[Column], limit_col: str, salt_col: str = "id") -> DataFrame:
    """At most ``limit_col`` rows per request, numbered ``rn``; the limit is the request's own, of any size."""
    return top_k(rows, [request_col], order, F.col(limit_col), F.col(salt_col)).withColumn("rn", F.col("rn").cast("int"))


def job_requests(jobs: DataFrame) -> DataFrame:
    """One listing request per job: company key, type set, category set, first and last day (NULL: open), report limit.

    ``report_categories`` (JSON list) and ``date_request`` (a day, ``day - day`` or empty) are optional columns.
    """

    def optional(name: str) -> Column:
        return F.col(name) if name in jobs.columns else F.lit(None).cast("string")

    def items(c: Column, default: list[str]) -> Column:
        return F.coalesce(X.json_list_decode(c), F.array(*[F.lit(t) for t in default]))

    first, last = X.range_from_to(optional("date_request"))
    return jobs.select(
        "job_name",
        lower_key("company").alias("ckey"),
        items(F.col("report_types"), DEFAULT_RUN_TYPES).alias("types"),
        items(optional("report_categories"), DEFAULT_CATEGORIES).alias("categories"),
        F.when(first != "N/A", X.parse_date_text(first)).alias("first_day"),
        F.when(last != "N/A", X.parse_date_text(last)).alias("last_day"),
        F.coalesce(F.col("report_limit"), F.lit(5)).alias("lim"),
    )


def _cut_to_largest(reports: DataFrame, requests: DataFrame, companies: DataFrame, groups: list[str]) -> DataFrame:
    """Reports with their company key, each group cut to the largest limit that any request of the company has (exact: none
    takes more)."""
    c = companies.select(F.col("id").alias("company_id"), lower_key("name").alias("ckey"))
    most = requests.groupBy("ckey").agg(F.max("lim").alias("__most"))
    r = reports.join(c, "company_id").join(most, "ckey")
    return top_k(r, ["company_id", *groups], [F.desc("date"), F.desc("id")], F.col("__most"), F.col("id"), out="__g").drop("__g", "__most")


def _no_day() -> Column:
    """Stands for the day of a report without a date: the oldest, and in no range of days."""
    return F.lit("0001-01-01").cast("date")


def _months(first: Column, last: Column) -> Column:
    """First days of the months from one day to another."""
    return F.when(first <= last, F.sequence(F.trunc(first, "month"), F.trunc(last, "month"), F.expr("INTERVAL 1 MONTH"))).otherwise(F.array().cast("array<date>"))


def _needed_days(requests: DataFrame, counts: DataFrame) -> DataFrame:
    """(requests' columns, ``day``): the newest days of each request that hold its first ``lim`` rows together.

    ``counts``: (ckey, report_type, report_category, day, n). Requests and days meet by company and month, so that a company
    with many reports and many requests is spread over its months; a request has at most a row for each day here.
    """
    known = F.when(F.col("day") != _no_day(), F.col("day"))
    span = counts.groupBy("ckey").agg(F.min(known).alias("__min"), F.max(known).alias("__max"))
    asked = requests.join(span, "ckey")
    asked = asked.withColumns({"__from": F.greatest("first_day", "__min"), "__to": F.least("last_day", "__max")})
    undated = F.col("first_day").isNull() & F.col("last_day").isNull()
    none = F.array().cast("array<date>")
    months = F.concat(F.coalesce(_months(F.col("__from"), F.col("__to")), none), F.when(undated, F.array(_no_day())).otherwise(none))
    asked = asked.withColumn("month", F.explode(months))
    by_month = counts.withColumn("month", F.trunc("day", "month"))
    wanted = F.array_contains("types", F.col("report_type")) & F.array_contains("categories", F.col("report_category"))
    inside = F.col("day").between(F.col("__from"), F.col("__to")) | (undated & (F.col("day") == _no_day()))
    fit = asked.join(by_month, ["ckey", "month"]).where(wanted & inside)
    per_day = fit.groupBy(*requests.columns, "day").agg(F.sum("n").alias("__n"))
    newer = Window.partitionBy("job_name").orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, -1)
    return per_day.withColumn("__before", F.coalesce(F.sum("__n").over(newer), F.lit(0))).where(F.col("__before") < F.col("lim")).drop("__n", "__before")


def listing_filter(jobs: DataFrame, companies: DataFrame, reports: DataFrame) -> DataFrame:
    """the listing request as a table filter, one request per job.

    Type set (default: the scheduled run's four types), category set (default ESPI and EBI), a day or a
    range of days, company text (case-insensitive), newest first, at most the request's
    ``report_limit`` (default 5) rows, offset 0.

    Rows are counted by company and day first. From the newest day of its range down a request needs the days that fill
    its limit, at most ``report_limit`` of them, and only those days' rows are read: each cut, in salted parts, to the
    largest limit that asks for the day, and met by company and day. So neither a company's rows nor its requests come
    together in a task, dated or not.
    """
    req = job_requests(jobs).where(F.col("lim") > 0)
    c = companies.select(F.col("id").alias("company_id"), lower_key("name").alias("ckey"))
    r = reports.select("id", "company_id", F.coalesce("date", _no_day()).alias("day"), "report_type", "report_category")
    kinds = ["report_type", "report_category", "day"]
    counts = r.groupBy("company_id", *kinds).agg(F.count(F.lit(1)).alias("n")).join(c, "company_id")
    # names that differ in case only are one company
    counts = cut_lineage(counts.groupBy("ckey", *kinds).agg(F.sum("n").alias("n")), "report-days")
    need = cut_lineage(_needed_days(req, counts), "needed-days")
    most = need.groupBy("ckey", "day").agg(F.max("lim").alias("__most"))
    most = cut_lineage(most.join(c, "ckey"), "days-read")  # by company: a day read is a day of each spelling
    rows = r.join(most, ["company_id", "day"])
    rows = top_k(rows, ["company_id", *kinds], [F.desc("id")], F.col("__most"), F.col("id"), out="__g").drop("__g", "__most")
    wanted = F.array_contains("types", F.col("report_type")) & F.array_contains("categories", F.col("report_category"))
    met = rows.join(need, ["ckey", "day"]).where(wanted).withColumn("date", F.nullif("day", _no_day()))
    out = per_request_limit(met, "job_name", [F.desc("date"), F.desc("id")], "lim")
    return out.select("job_name", "id", "date", "report_type", "report_category", "rn")


def report_limit_per_job(jobs: DataFrame, companies: DataFrame, reports: DataFrame) -> DataFrame:
    """T3 alone: each job's newest ``report_limit`` reports of its company (no other filter)."""
    req = job_requests(jobs).withColumns({"first_day": F.lit(None).cast("date"), "last_day": F.lit(None).cast("date")})
    r = _cut_to_largest(reports.select("id", "company_id", "date"), req, companies, [])
    return per_request_limit(r.join(req, "ckey"), "job_name", [F.desc("date"), F.desc("id")], "lim").select("job_name", "id", "date", "rn")


def file_type_filter(files: DataFrame, name_col="file_name") -> DataFrame:
    """names ending .pdf/.html/.htm (case-sensitive) are summarised."""
    n = F.col(name_col)
    return files.select("id", name_col, (n.endswith(".pdf") | n.endswith(".html") | n.endswith(".htm")).alias("summarisable"))


def required_field_check(requests: DataFrame, col="company") -> DataFrame:
    """blank / NULL company -> rejected (with the reference's message)."""
    ok = F.coalesce(F.length(X.ustrip(F.col(col))) > 0, F.lit(False))
    return requests.select(
        "*",
        ok.alias("accepted"),
        F.when(~ok, F.lit("Error: Company name is required")).alias("error"),
    )


# Execution status labels of the history screen.
STATUS_LABEL = {
    "success": "✅ Sukces",
    "failed": "❌ Błąd",
    "running": "⏳ W trakcie",
    "no_reports": "ℹ️ Brak raportów",
}
STATUS_UNKNOWN = "❓ Nieznany"


def execution_history(log: DataFrame, job_name=None, limit=None) -> DataFrame:
    """F16: the execution-history table as displayed (labels, duration text, cut errors)."""
    df = log
    if job_name:
        df = df.where(F.col("job_name") == job_name)
    if limit:
        df = df.orderBy(F.desc("started_at"), F.desc("id")).limit(limit)
    label = F.lit(STATUS_UNKNOWN)
    for k, v in reversed(list(STATUS_LABEL.items())):
        label = F.when(F.col("status") == k, v).otherwise(label)
    err = F.col("error_message")
    err_txt = F.when(F.length(err) > 100, F.concat(F.substring(err, 1, 97), F.lit("..."))).otherwise(err)
    docs = F.col("documents_processed")
    result = F.when(F.col("log_file_path").isNull(), F.lit("-")).when(
        docs > 0, F.concat(F.lit("📄 "), docs.cast("string"), F.lit(" doc"))
    ).otherwise(F.lit("📂 Log"))
    lf = F.col("log_file_path") if "log_file_path" in df.columns else F.lit(None).cast("string")
    df = df.withColumn("log_file_path", lf)
    return df.select(
        "id", "job_name", label.alias("status"),
        F.coalesce(F.date_format("started_at", "yyyy-MM-dd HH:mm:ss"), F.lit("N/A")).alias("started"),
        X.duration_text(F.col("started_at"), F.col("finished_at")).alias("duration"),
        "reports_found",
        result.alias("results"),
        F.coalesce(F.nullif(err_txt, F.lit("")), F.lit("-")).alias("error"),
    )
