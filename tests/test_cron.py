"""K1 / K2 goldens and K5 against a brute-force minute scan."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from filingflow.functions import cron as C


def _check(spark, expr):
    df = spark.createDataFrame([(expr,)], "c string")
    r = df.select(C.cron_check(F.col("c")).alias("r")).collect()[0]["r"]
    return r["valid"], r["message"]


def test_cron_check_goldens(spark):
    assert _check(spark, "0 9 * * 1") == (True, C.CRON_OK)
    assert _check(spark, "*/30 * * * *")[0] is True
    assert _check(spark, "0 8-17 * * 1-5")[0] is True  # non-digit parts are not range-checked
    assert _check(spark, "60 9 * * 1") == (False, "Minuta musi być między 0 a 59")
    assert _check(spark, "0 9 * *") == (False, C.CRON_FIELD_COUNT_ERROR)


def test_job_errors(spark):
    df = spark.createDataFrame([("j", "", "llama", "0 9 * * 1", "2024-01-05", "05-01-2024")], "a string, b string, c string, d string, e string, f string")
    errs = df.select(C.job_errors(*[F.col(x) for x in "abcdef"]).alias("e")).collect()[0]["e"]
    assert errs == ["company is required", "date_from must be in dd-mm-yyyy format"]


def _allowed(field: str, lo: int, hi: int) -> set[int]:
    out: set[int] = set()
    for item in field.split(","):
        base, _, step = item.partition("/")
        st = int(step) if step else 1
        if base == "*":
            a, b = lo, hi
        elif "-" in base:
            a, b = (int(x) for x in base.split("-"))
        else:
            a = int(base)
            b = hi if step else a
        out.update(range(a, b + 1, st))
    return out


def brute_next(expr: str, now: dt.datetime) -> dt.datetime:
    m, h, dom, mon, dow = expr.split()
    mins, hours = _allowed(m, 0, 59), _allowed(h, 0, 23)
    doms, mons = _allowed(dom, 1, 31), _allowed(mon, 1, 12)
    dows = {d % 7 for d in _allowed(dow, 0, 7)}
    t = now.replace(second=0, microsecond=0) + dt.timedelta(minutes=1)
    for _ in range(60 * 24 * 400):
        cron_dow = (t.weekday() + 1) % 7
        dom_ok, dow_ok = t.day in doms, cron_dow in dows
        if dom.startswith("*") and dow.startswith("*"):
            day = True
        elif dom.startswith("*"):
            day = dow_ok
        elif dow.startswith("*"):
            day = dom_ok
        else:
            day = dom_ok or dow_ok
        if t.month in mons and day and t.hour in hours and t.minute in mins:
            return t
        t += dt.timedelta(minutes=1)
    raise AssertionError("no match")


def test_next_fire_time_matches_brute_force(spark):
    exprs = ["0 9 * * 1", "*/30 * * * *", "0 8-17 * * 1-5", "15 10 1 * *", "5 4 13 * 5", "0 0 * 2 *", "10,40 22 * * 0"]
    nows = [dt.datetime(2024, 2, 1, 10, 30, 15), dt.datetime(2024, 12, 31, 23, 59, 0), dt.datetime(2024, 3, 1, 8, 0, 0)]
    data = [(e, n) for e in exprs for n in nows]
    df = spark.createDataFrame(data, "c string, now timestamp_ntz")
    got = df.select("c", "now", C.next_fire_time(F.col("c"), F.col("now")).alias("nx")).collect()
    for r in got:
        assert r["nx"] == brute_next(r["c"], r["now"]), (r["c"], r["now"])


def _next(spark, expr, now):
    df = spark.createDataFrame([(expr, now)], "c string, now timestamp_ntz")
    return df.select(C.next_fire_time(F.col("c"), F.col("now")).alias("x")).first()["x"]


def test_leap_days_across_a_century_year(spark):
    assert _next(spark, "0 0 29 2 *", dt.datetime(2096, 3, 1)) == dt.datetime(2104, 2, 29)
    assert _next(spark, "0 0 30 2 *", dt.datetime(2024, 1, 1)) is None


def test_names_in_month_and_weekday_fields(spark):
    now = dt.datetime(2024, 2, 1, 10, 30)
    for named, plain in (("0 9 * * MON", "0 9 * * 1"), ("0 9 * jan *", "0 9 * 1 *"), ("0 9 * * 1-FRI", "0 9 * * 1-5"), ("0 9 * Mar,DEC sun", "0 9 * 3,12 0")):
        assert _next(spark, named, now) == brute_next(plain, now), named


def test_malformed_fields_give_null_and_never_fail(spark):
    bad = ["*/0 * * * *", "0 9 * * FOO", "x 9 * * 1", "99999999999999999999 9 * * 1", "70 9 * * 1", "5-1 9 * * 1", "1-2-3 9 * * 1", "0 9 * *", "", None, "1/2/3 * * * *", ", * * * *"]
    df = spark.createDataFrame([(b,) for b in bad], "c string")
    got = df.select(C.next_fire_time(F.col("c"), F.lit("2024-02-01 10:30:00").cast("timestamp_ntz")).alias("n")).collect()
    assert all(r["n"] is None for r in got)
    assert _check(spark, "99999999999999999999 9 * * 1") == (False, "Minuta musi być między 0 a 59")
    assert _check(spark, "9" * 60 + " 9 * * 1") == (False, "Minuta musi być między 0 a 59")
    assert _check(spark, "0 9 * * MON")[0] is True


def test_steps_on_a_star_in_the_day_fields(spark):
    now = dt.datetime(2024, 2, 1, 10, 30)  # a Thursday
    for expr, day in (
        ("0 0 */2 * *", dt.datetime(2024, 2, 3)),  # odd days
        ("0 0 */2 * 1", dt.datetime(2024, 2, 5)),  # Mondays on odd days
        ("0 0 */2 * 2", dt.datetime(2024, 2, 13)),
        ("0 0 1 * */2", dt.datetime(2024, 6, 1)),  # a first that is a Sunday, Tuesday, Thursday or Saturday
        ("0 0 * * */3", dt.datetime(2024, 2, 3)),
        ("0 0 1-31/2 * 1", dt.datetime(2024, 2, 3)),  # no star: either field
    ):
        assert _next(spark, expr, now) == day, expr
    assert _next(spark, "0 0 29 2 */7", dt.datetime(2088, 2, 29, 12)) == dt.datetime(2128, 2, 29)  # Sundays
