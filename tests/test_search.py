"""Per-request limits, listing requests and company look-up on rows that the driver tables lack."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from filingflow.operators import search as S
from filingflow.operators.common import dense_ids, top_k


def test_limits_above_a_hundred(spark):
    rows = spark.range(300).select(F.col("id"), F.lit("r").alias("req"), F.lit(250).alias("lim"))
    got = S.per_request_limit(rows, "req", [F.desc("id")], "lim").collect()
    assert len(got) == 250 and min(r["id"] for r in got) == 50
    assert [r["rn"] for r in sorted(got, key=lambda r: -r["id"])] == list(range(1, 251))


def test_top_k_with_a_limit_for_each_key(spark):
    rows = spark.range(1000).select(F.col("id"), (F.col("id") % 3).alias("k"))
    got = top_k(rows, ["k"], [F.col("id")], F.col("k") * 7, F.col("id"), salts=5).groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("m")).collect()
    assert {r["k"]: (r["n"], r["m"]) for r in got} == {1: (7, 19), 2: (14, 41)}


def test_listing_requests_with_days_and_categories(spark):
    companies = spark.createDataFrame([(1, "Acme")], "id long, name string")
    day = dt.date(2024, 1, 1)
    reports = spark.createDataFrame(
        [(i, 1, day + dt.timedelta(days=i), "current", ["ESPI", "EBI", None][i % 3]) for i in range(400)],
        "id long, company_id long, date date, report_type string, report_category string",
    )
    jobs = spark.createDataFrame(
        [("all", "ACME", None, None, "", 300), ("one", "acme", None, '["EBI"]', "05-01-2024", 9), ("span", "acme", '["current"]', None, "02-01-2024 - 10-01-2024", 4), ("none", "acme", '["annual"]', None, None, 9)],
        "job_name string, company string, report_types string, report_categories string, date_request string, report_limit int",
    )
    got = {}
    for r in S.listing_filter(jobs, companies, reports).collect():
        got.setdefault(r["job_name"], []).append(r["id"])
    assert len(got["all"]) == 267 and sorted(got["one"]) == [4] and sorted(got["span"]) == [4, 6, 7, 9] and "none" not in got


def test_company_lookup_matches_like(spark):
    names = ["Acme", "ACME Polska", "Beta", "b", "", "Łódź SA", "acme_x", "xx", "Customer#1", "Customer#2"]
    companies = spark.createDataFrame([(i, n) for i, n in enumerate(names)] + [(99, None)], "id long, name string")
    patterns = ["acme", "ac%", "%polska", "_", "__", "%", "", "%b%", "%_b%", "b_", "ł%ź%", "%zz", "a%e", "____", "customer#%", "%x", "_c_e", "%_%", "nope"]
    got = {r["pattern"]: r["company_id"] for r in S.company_lookup(spark.createDataFrame([(p,) for p in patterns], "name string"), companies).collect()}
    for p in patterns:
        want = companies.where(F.lower("name").like(p)).agg(F.min("id")).first()[0]
        assert got[p] == want, p


def test_dense_ids_with_ties_and_nulls(spark):
    rows = spark.createDataFrame([(3, "a"), (1, "b"), (None, "c"), (3, "d"), (2, "e"), (None, "f")], "k int, v string")
    got = {r["v"]: r["id"] for r in dense_ids(rows, ["k"], start=10).collect()}
    assert {got["c"], got["f"]} == {11, 12} and got["b"] == 13 and got["e"] == 14 and {got["a"], got["d"]} == {15, 16}


def test_a_hot_company_with_many_dated_requests_is_spread(spark):
    """A third of all reports and 1,000 dated requests belong to one company: same rows as brute force, no task above 5 %."""
    import random

    rng, day = random.Random(2), dt.date(2020, 1, 1)
    rows = [(i, 1 if i % 3 == 0 else i % 400 + 2, day + dt.timedelta(days=rng.randrange(1500)) if i % 50 else None, rng.choice(["current", "annual"]), "ESPI") for i in range(30_000)]
    reports = spark.createDataFrame(rows, "id long, company_id long, date date, report_type string, report_category string")
    companies = spark.createDataFrame([(i, f"C{i}") for i in range(1, 402)] + [(1000, "c1")], "id long, name string")
    jobs = []
    for j in range(1000):
        a = day + dt.timedelta(days=rng.randrange(1500))
        b = a + dt.timedelta(days=rng.randrange(0, 400))
        jobs.append((f"j{j}", "c1", '["current"]' if j % 2 else None, f"{a:%d-%m-%Y} - {b:%d-%m-%Y}" if j % 10 else "", rng.randrange(1, 30)))
    requests = spark.createDataFrame(jobs, "job_name string, company string, report_types string, date_request string, report_limit int")
    got = {}
    for r in S.listing_filter(requests, companies, reports).orderBy("job_name", "rn").collect():
        got.setdefault(r["job_name"], []).append(r["id"])
    mine = sorted((r for r in rows if r[1] in (1, 1000)), key=lambda r: (r[2] is not None, r[2] or day, r[0]), reverse=True)
    for name, _, types, dates, lim in jobs:
        a, b = (dt.datetime.strptime(d, "%d-%m-%Y").date() for d in dates.split(" - ")) if dates else (None, None)
        want = [r[0] for r in mine if (r[3] == "current" or not types) and (a is None or (r[2] is not None and a <= r[2] <= b))][:lim]
        assert got.get(name, []) == want, name
    req = S.job_requests(requests)
    counts = reports.groupBy(F.lit("c1").alias("ckey"), "report_type", "report_category", F.coalesce("date", S._no_day()).alias("day")).agg(F.count("*").alias("n"))
    need = S._needed_days(req, counts)
    assert need.groupBy("job_name").count().join(req, "job_name").where(F.col("count") > F.col("lim")).count() == 0  # at most a day for each row
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        read = reports.withColumn("day", F.coalesce("date", S._no_day())).join(need.select(F.lit(1).alias("company_id"), "day").distinct(), ["company_id", "day"])
        per_task = [r["count"] for r in read.groupBy(F.spark_partition_id()).count().collect()]
        assert max(per_task) <= 0.05 * sum(per_task)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_common_pattern_reads_the_first_blocks_only(spark):
    """Names beyond the first blocks of ids raise when they are read."""
    n = S.BLOCK_IDS * S.FIRST_BLOCKS
    name = F.when(F.col("id") < n, F.concat(F.lit("Customer#"), F.col("id").cast("string"))).otherwise(F.raise_error(F.lit("read too far")).cast("string"))
    companies = spark.range(0, 40 * n).select("id", name.alias("name"))
    got = S._first_like(_patterns(spark, ["%customer%", "%#77_%", "%mer#1%3"]), companies.select("id", F.lower("name").alias("lname")))
    assert {r["pattern"]: r["company_id"] for r in got.collect()} == {"%customer%": 0, "%#77_%": 770, "%mer#1%3": 13}


def _patterns(spark, patterns):
    df = spark.createDataFrame([(p, p.lower()) for p in patterns], "pattern string, lp string")
    return df.withColumn("runs", F.filter(F.split("lp", "[%_]"), lambda r: r != ""))


def test_late_and_missing_hits_are_found_round_by_round(spark):
    names = spark.range(-3000, 300_000).select("id", F.concat(F.lit("n"), F.lpad(F.col("id").cast("string"), 7, "x")).alias("lname"))
    patterns = ["%9999_", "%299%999%", "%zz%", "%x-2_5%", "n%x7"]
    got = {r["pattern"]: r["company_id"] for r in S._first_like(_patterns(spark, patterns), names).collect()}
    assert got == {p: names.where(F.col("lname").like(p)).agg(F.min("id")).first()[0] for p in patterns} and got["%299%999%"] == 299999
    assert {r["company_id"] for r in S._first_like(_patterns(spark, ["%a%"]), names.limit(0)).collect()} == {None}
