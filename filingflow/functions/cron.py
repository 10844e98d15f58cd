"""Job-table checks as columns: K1 config errors, K2 cron validation, K5 next fire time.

All native: cron fields are expanded with ``split`` / ``sequence`` / ``flatten`` into arrays of
allowed values and the next fire time is found on a bounded array of candidate days, so the
whole job table is checked in one projection without a Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from filingflow.functions.text import _at, ustrip


# Cron field ranges and names (minute, hour, day of month, month, day of week).
CRON_FIELDS = [
    (0, 59, "Minuta"),
    (0, 23, "Godzina"),
    (1, 31, "Dzień"),
    (1, 12, "Miesiąc"),
    (0, 7, "Dzień tygodnia"),
]
CRON_FIELD_COUNT_ERROR = "Wyrażenie cron musi mieć 5 części: minuta godzina dzień miesiąc dzień_tygodnia"
CRON_OK = "✅ Poprawne wyrażenie cron"


def _parts(cron: Column) -> Column:
    t = ustrip(F.coalesce(cron, F.lit("")))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, r"(?U)\s+"))


def cron_check(cron: Column) -> Column:
    """K2: struct(valid, message). Five whitespace-separated parts; a purely numeric part must lie
    in its range; wildcards, steps, ranges and lists are not range-checked."""
    parts = _parts(cron)
    errs = []
    for i, (lo, hi, name) in enumerate(CRON_FIELDS):
        p = _at(parts, i + 1)
        # a number too long for a decimal is out of any range
        n = p.try_cast("decimal(38,0)")
        bad = p.rlike(r"^[0-9]+$") & (n.isNull() | (n < lo) | (n > hi))
        errs.append(F.when(bad, F.lit(f"{name} musi być między {lo} a {hi}")))
    first = _at(F.filter(F.array(*errs), lambda e: e.isNotNull()), 1)
    msg = F.when(F.size(parts) != 5, F.lit(CRON_FIELD_COUNT_ERROR)).otherwise(F.coalesce(first, F.lit(CRON_OK)))
    return F.struct((msg == CRON_OK).alias("valid"), msg.alias("message"))


def job_errors(job_name: Column, company: Column, model: Column, cron: Column, date_from: Column, date_to: Column) -> Column:
    """K1: the config's error list (empty when valid)."""

    def missing(c: Column, field: str) -> Column:
        return F.when(F.coalesce(c, F.lit("")) == "", F.lit(f"{field} is required"))

    def bad_date(c: Column, field: str) -> Column:
        return F.when(
            (F.coalesce(c, F.lit("")) != "") & F.try_to_date(c, "d-M-yyyy").isNull(), F.lit(f"{field} must be in dd-mm-yyyy format")
        )

    errs = F.array(
        missing(job_name, "job_name"), missing(company, "company"), missing(model, "model"), missing(cron, "cron_schedule"),
        bad_date(date_from, "date_from"), bad_date(date_to, "date_to"),
    )
    return F.filter(errs, lambda e: e.isNotNull())


# Names that a month or weekday field may use, from their first number on.
MONTH_NAMES = (1, "JAN FEB MAR APR MAY JUN JUL AUG SEP OCT NOV DEC".split())
DAY_NAMES = (0, "SUN MON TUE WED THU FRI SAT".split())


def _number(x: Column, names: tuple[int, list[str]] | None) -> Column:
    """A field's number or three-letter name (any case); NULL for anything else."""
    out = x.try_cast("int")
    if names:
        first, words = names
        at = F.array_position(F.array(*[F.lit(w) for w in words]), F.upper(x))
        out = F.coalesce(out, F.when(at > 0, (at - 1 + first).cast("int")))
    return F.when(x.rlike(r"^(\d+|[A-Za-z]+)$"), out)


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once: bound as the variable of a lambda over one element."""
    return F.get(F.transform(F.array(value), use), 0)


def _expand(field: Column, lo: int, hi: int, names: tuple[int, list[str]] | None = None) -> Column:
    """Allowed values of one cron field: ``*``, ``*/n``, ``a``, ``a-b``, ``a-b/n`` and comma lists; numbers or names.
    NULL if any item is malformed: not a number or name, out of range, falling, or a step below 1."""

    def bounds(x: Column) -> Column:
        rng, step = _at(x, 1), _at(x, 2)
        ends = F.split(rng, "-")
        a = F.when(rng == "*", F.lit(lo)).otherwise(_number(_at(ends, 1), names))
        b = (
            F.when(rng == "*", F.lit(hi))
            .when(F.size(ends) == 2, _number(_at(ends, 2), names))
            .when(F.size(x) == 2, F.lit(hi))
            .otherwise(a)
        )
        every = F.when(F.size(x) == 1, F.lit(1)).otherwise(_number(step, None))
        return F.struct(a.alias("a"), b.alias("b"), every.alias("every"), (F.size(ends) + F.size(x) * 10).alias("form"))

    def values(v: Column) -> Column:
        fine = v["form"].isin(11, 12, 21, 22) & (v["a"] >= lo) & (v["a"] <= v["b"]) & (v["b"] <= hi) & (v["every"] >= 1)
        return F.when(fine, F.sequence(v["a"], v["b"], F.least(v["every"], F.lit(hi + 1))))

    items = F.transform(F.split(field, ","), lambda x: _let(_let(F.split(x, "/"), bounds), values))
    return _let(items, lambda i: F.when(~F.exists(i, lambda x: x.isNull()), F.array_sort(F.array_distinct(F.flatten(i)))))


def next_fire_time(cron: Column, now: Column) -> Column:
    """K5: the first minute strictly after ``now`` that the cron expression selects.

    Day rule as in Vixie cron: a day must be in both the day-of-month and the day-of-week set if either field
    starts with ``*`` (steps like ``*/2`` count), and in one of them otherwise. NULL when the expression is malformed or no date ever
    matches. Days are listed month by month, only in months of the month set, and the fold stops
    listing once it holds two; any day that exists comes back within forty years (29 February on one
    weekday across a century year), so 481 months hold the next one or there is none.
    """
    fields = _let(
        _parts(cron),
        lambda p: F.struct(
            (F.size(p) == 5).alias("five"),
            _expand(_at(p, 1), 0, 59).alias("minutes"),
            _expand(_at(p, 2), 0, 23).alias("hours"),
            _expand(_at(p, 3), 1, 31).alias("doms"),
            _expand(_at(p, 4), 1, 12, MONTH_NAMES).alias("months"),
            F.transform(_expand(_at(p, 5), 0, 7, DAY_NAMES), lambda d: d % 7).alias("dows"),
            _at(p, 3).startswith("*").alias("any_dom"),
            _at(p, 5).startswith("*").alias("any_dow"),
        ),
    )
    today = F.to_date(now)
    first = F.trunc(today, "MM")

    def days_of(f: Column) -> Column:
        def day_ok(d: Column) -> Column:
            dom_ok, dow_ok = F.array_contains(f["doms"], F.dayofmonth(d)), F.array_contains(f["dows"], F.dayofweek(d) - 1)
            rule = F.when(f["any_dom"] | f["any_dow"], dom_ok & dow_ok).otherwise(dom_ok | dow_ok)
            return (d >= today) & rule

        def more(found: Column, m: Column) -> Column:
            days = F.filter(F.sequence(m, F.last_day(m)), day_ok)
            return F.when(F.size(found) >= 2, found).otherwise(F.concat(found, F.slice(days, 1, 2)))

        months = F.transform(F.sequence(F.lit(0), F.lit(480)), lambda i: F.add_months(first, i))
        return F.aggregate(F.filter(months, lambda m: F.array_contains(f["months"], F.month(m))), F.array().cast("array<date>"), more)

    def times_of(f: Column) -> Column:
        return F.array_sort(F.flatten(F.transform(f["hours"], lambda h: F.transform(f["minutes"], lambda m: h * 60 + m))))

    def at(d: Column, t: Column) -> Column:
        return F.make_timestamp_ntz(F.year(d), F.month(d), F.dayofmonth(d), F.floor(t / 60).cast("int"), (t % 60).cast("int"), F.lit(0))

    def choose(c: Column) -> Column:
        passed = F.hour(now) * 60 + F.minute(now)
        later = _at(F.filter(c["times"], lambda t: t > passed), 1)
        earliest, day = _at(c["times"], 1), _at(c["days"], 1)
        return F.when((day == today) & later.isNotNull(), at(day, later)).when(day == today, at(_at(c["days"], 2), earliest)).otherwise(at(day, earliest))

    def solve(f: Column) -> Column:
        fine = f["five"]
        for name in ("minutes", "hours", "doms", "months", "dows"):
            fine = fine & f[name].isNotNull()
        return F.when(fine, _let(F.struct(days_of(f).alias("days"), times_of(f).alias("times")), choose))

    return _let(fields, solve)
