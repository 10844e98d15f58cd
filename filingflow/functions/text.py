"""Column expressions for the scalar logic (N1-N16): header splitting, enum mapping, number and
date parsing, names, display formats. All native Spark functions, so they stay inside whole-stage
codegen; none is a Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _at(arr, i):
    """1-based array access that yields NULL past the end (ANSI-safe ``element_at``)."""
    return F.try_element_at(arr, F.lit(i) if isinstance(i, int) else i)


# Unicode-wide whitespace, as Python's str.strip()/split() and re's \s see it.
_WS = r"[\s\x1c-\x1f]"
_WS_RUN = r"(?U)\s+"


# Every character Python's str.strip() removes (str.isspace), derived by rule.
PY_WHITESPACE = "".join(ch for ch in map(chr, range(0x3001)) if ch.isspace())


def ustrip(c: Column) -> Column:
    """Python ``str.strip()``: Unicode whitespace removed at both ends (native btrim)."""
    return F.btrim(c, F.lit(PY_WHITESPACE))


def first_token(c: Column) -> Column:
    """Python ``s.split()[0]`` (after strip)."""
    return F.regexp_extract(ustrip(c), r"(?U)^\S+", 0)  # its pattern is compiled once, that of a split for each row


# ----------------------------------------------------------------------------- N1 header split


def split_header(h: Column) -> Column:
    """``'02-03-2021 08:00:00 | Roczny | EBI | 7/2021'`` -> ``[02-03-2021, Roczny, EBI]``.

    Split on ``|``, drop the last segment, strip each, keep the first token of the date; with
    two kept segments the third is ``unknown``. Fewer than two kept segments -> NULL (the row
    is rejected instead of failing the whole feed). The listing format keeps two or three
    segments, handled with plain element access; longer headers take the general form.
    """
    parts = F.split(h, r"\|")
    n = F.size(parts) - 1

    def seg(i: int) -> Column:
        return ustrip(_at(parts, i))

    date = _header_date(parts)
    kept = F.slice(parts, 1, F.greatest(n, F.lit(0)))
    general = F.concat(F.array(date), F.transform(F.slice(kept, 2, F.greatest(n - 1, F.lit(0))), ustrip))
    return (
        F.when(n == 2, F.array(date, seg(2), F.lit("unknown")))
        .when(n == 3, F.array(date, seg(2), seg(3)))
        .when(n > 3, general)
    )


def _header_date(parts: Column) -> Column:
    first = ustrip(_at(parts, 1))
    return F.when(first.contains(" "), first_token(first)).otherwise(first)


def header_date(h: Column) -> Column:
    """The first value of ``split_header`` by itself, without the others."""
    parts = F.split(h, r"\|")
    return F.when(F.size(parts) > 2, _header_date(parts))


# ----------------------------------------------------------------------------- N2 / N3 enums

# Report-type spellings (lower-cased, stripped) and their registry enum.
REPORT_TYPE_SPELLINGS = {
    "bieżący": "current",
    "current": "current",
    "rb": "current",
    "półroczny": "semi-annual",
    "semi-annual": "semi-annual",
    "p": "semi-annual",
    "kwartalny": "quarterly",
    "quarterly": "quarterly",
    "q": "quarterly",
    "śródroczny": "interim",
    "interim": "interim",
    "o": "interim",
    "roczny": "annual",
    "annual": "annual",
    "r": "annual",
}

# The two report categories.
CATEGORIES = ("ESPI", "EBI")


def _map_literal(d: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def report_type_enum(label: Column) -> Column:
    """Type label -> current / semi-annual / quarterly / interim / annual, else NULL."""
    return F.try_element_at(_map_literal(REPORT_TYPE_SPELLINGS), F.lower(ustrip(label)))


def report_category_enum(cat: Column) -> Column:
    """Category -> ESPI / EBI / NULL."""
    u = F.upper(ustrip(cat))
    return F.when(u.isin(*CATEGORIES), u)


# ----------------------------------------------------------------------------- N4 / N5 numbers


def _py_float(t: Column) -> Column:
    """Python ``float(text)``: surrounding whitespace allowed, nothing else; failure -> NULL."""
    s = ustrip(t)
    ok = s.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
    return F.when(ok, s.try_cast("double"))


def change_value(change_text: Column, change_class: Column) -> Column:
    """``Zmiana 0,33%`` -> 0.33; from the loss span the minus is glued to the unstripped text,
    so an inner blank (``Zmiana  0,33%``) gives NULL."""
    t = F.replace(F.replace(F.replace(change_text, F.lit("Zmiana "), F.lit("")), F.lit(","), F.lit(".")), F.lit("%"), F.lit(""))
    return F.when(change_class == "loss", _py_float(F.concat(F.lit("-"), t))).otherwise(_py_float(t))


def price_value(price_text: Column) -> Column:
    """``Kurs21,42`` -> 21.42."""
    return _py_float(F.replace(F.replace(price_text, F.lit(","), F.lit(".")), F.lit("Kurs"), F.lit("")))


# ----------------------------------------------------------------------------- N6 / N7


def title_or_untitled(title_text: Column, type_label: Column) -> Column:
    """Stripped title, or ``UNTITLED <type label> REPORT`` when blank."""
    t = ustrip(title_text)
    return F.when(t == "", F.concat(F.lit("UNTITLED "), type_label, F.lit(" REPORT"))).otherwise(t)


def absolute_link(base: str, href: Column) -> Column:
    """N7."""
    return F.concat(F.lit(base), href)


# ----------------------------------------------------------------------------- N8-N11 dates


def parse_date_text(c: Column) -> Column:
    """First token; ``d-M-yyyy`` (what strptime %d-%m-%Y accepts) or ISO ``yyyy-MM-dd``."""
    tok = first_token(c)
    return F.coalesce(F.try_to_date(tok, "d-M-yyyy"), F.try_to_date(tok, "yyyy-MM-dd"))


def format_date_input(c: Column) -> Column:
    """Epoch seconds, ISO (``Z`` allowed) or ``dd-MM-yyyy`` text -> ``dd-MM-yyyy``; else ''."""
    s = c.cast("string")
    as_num = F.when(s.rlike(r"^-?\d+(\.\d+)?$"), F.timestamp_seconds(s.try_cast("double")))
    # an ISO text is valid as a whole, but its day is the one it names, whatever its offset
    iso = F.when(
        s.rlike(r"^\d{4}-\d{2}-\d{2}") & F.try_to_timestamp(F.regexp_replace(s, "Z$", "+00:00")).isNotNull(),
        F.try_to_date(F.substring(s, 1, 10), "yyyy-MM-dd"),
    )
    keep = F.when(s.contains("-") & (F.length(s) == 10), s)
    out = F.coalesce(F.date_format(as_num, "dd-MM-yyyy"), F.date_format(iso, "dd-MM-yyyy"), keep, F.lit(""))
    return F.when(F.coalesce(s, F.lit("")) == "", F.lit("")).otherwise(out)


# Listing-request date errors.
DATE_ERROR_SINGLE = "Wrong date format (expected: DD-MM-YYYY)"
DATE_ERROR_RANGE = "Wrong date format (expected: DD-MM-YYYY - DD-MM-YYYY)"


def _strict_dmy(c: Column) -> Column:
    return F.try_to_date(c, "d-M-yyyy")


def date_request_error(d: Column) -> Column:
    """N10: '' is fine; ``a - b`` needs both parts, a single date needs one; else the error text."""
    parts = F.split(d, " - ")
    rng_ok = _strict_dmy(ustrip(_at(parts, 1))).isNotNull() & _strict_dmy(
        ustrip(F.try_element_at(parts, F.lit(2)))
    ).isNotNull()
    return (
        F.when(F.coalesce(d, F.lit("")) == "", F.lit(None).cast("string"))
        .when(d.contains(" - "), F.when(~F.coalesce(rng_ok, F.lit(False)), F.lit(DATE_ERROR_RANGE)))
        .when(_strict_dmy(d).isNull(), F.lit(DATE_ERROR_SINGLE))
    )


def range_from_to(d: Column) -> tuple[Column, Column]:
    """``a - b`` -> (a, b); single -> (d, d); empty -> (N/A, N/A)."""
    parts = F.split(d, " - ")
    empty = F.coalesce(d, F.lit("")) == ""
    is_rng = d.contains(" - ")
    dfrom = F.when(empty, F.lit("N/A")).when(is_rng, ustrip(_at(parts, 1))).otherwise(d)
    dto = F.when(empty, F.lit("N/A")).when(is_rng, ustrip(_at(parts, 2))).otherwise(d)
    return dfrom, dto


# ----------------------------------------------------------------------------- N12-N16


def standard_file_name(company: Column, report_no: Column, file_no: Column, title: Column) -> Column:
    """``<company> report <i> file <j> <title with whitespace runs collapsed>``."""
    return F.concat_ws(
        " ", company, F.lit("report"), report_no.cast("string"), F.lit("file"), file_no.cast("string"),
        F.regexp_replace(title, _WS_RUN, " "),
    )


def file_extension(name: Column) -> Column:
    """Text after the last dot, lower-cased."""
    return F.lower(F.substring_index(name, ".", -1))


def wanted_attachment(name: Column, wanted: list[str]) -> Column:
    """N13: "pdf" inside the last four characters and PDF selected, or "html" and HTML selected.
    Case-sensitive; ``.htm`` never passes."""
    tail = F.right(name, F.lit(4))
    cond = F.lit(False)
    if "PDF" in wanted:
        cond = cond | tail.contains("pdf")
    if "HTML" in wanted:
        cond = cond | tail.contains("html")
    return cond


def size_kb_text(nbytes: Column) -> Column:
    """``x.y KB`` (tenths rounded half up on the exact byte count); 0 / NULL -> N/A."""
    tenths = F.floor((nbytes.cast("bigint") * 20 + 1024) / F.lit(2048)).cast("bigint")
    txt = F.concat(F.floor(tenths / 10).cast("bigint").cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(" KB"))
    return F.when(F.coalesce(nbytes, F.lit(0)) == 0, F.lit("N/A")).otherwise(txt)


def micros_between(start: Column, end: Column) -> Column:
    return F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))


def _tenths_text(tenths: Column, unit: str) -> Column:
    sign = F.when(tenths < 0, F.lit("-")).otherwise(F.lit(""))
    a = F.abs(tenths)
    return F.concat(sign, F.floor(a / 10).cast("bigint").cast("string"), F.lit("."), (a % 10).cast("string"), F.lit(unit))


def duration_text(start: Column, end: Column) -> Column:
    """``12.3s`` under a minute, else ``4.5min``; N/A without both ends."""
    us = micros_between(start, end)
    sec_tenths = F.floor((us + 50000) / F.lit(100000)).cast("bigint")
    min_tenths = F.floor((us + 3000000) / F.lit(6000000)).cast("bigint")
    return (
        F.when(start.isNull() | end.isNull(), F.lit("N/A"))
        .when(us < 60000000, _tenths_text(sec_tenths, "s"))
        .otherwise(_tenths_text(min_tenths, "min"))
    )


def cut_error(err: Column, width: int = 100) -> Column:
    """Longer than ``width`` -> first ``width-3`` characters + ``...``."""
    return F.when(F.length(err) > width, F.concat(F.substring(err, 1, width - 3), F.lit("..."))).otherwise(err)


def json_list_decode(c: Column) -> Column:
    """JSON list text -> ARRAY<STRING>; NULL / '' -> NULL."""
    return F.when(F.coalesce(c, F.lit("")) != "", F.from_json(c, "array<string>"))


def json_list_encode(arr: Column) -> Column:
    """ARRAY<STRING> -> JSON text as the registry prints it (``["a", "b"]``); empty -> NULL."""
    quoted = F.transform(
        arr,
        lambda x: F.concat(F.lit('"'), F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')),
    )
    return F.when(F.coalesce(F.size(arr), F.lit(0)) > 0, F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]")))


# ----------------------------------------------------------------------------- extractive summary


def sentences(text: Column) -> Column:
    """Trimmed sentences of a text (white space collapsed): runs that end with ``.``, ``!`` or ``?``."""
    flat = F.regexp_replace(F.coalesce(text, F.lit("")), r"[ \t\n\r\f]+", " ")
    return F.filter(F.transform(F.regexp_extract_all(flat, F.lit(r"[^.!?]+[.!?]*"), 0), lambda x: F.btrim(x, F.lit(" "))), lambda x: x != "")


def sentence_rows(text: Column) -> Column:
    """Array of (minus the number of different words, position, number of words, sentence)."""
    words = lambda x: F.split(x, " ")
    return F.transform(
        sentences(text),
        lambda x, i: F.struct((-F.size(F.array_distinct(words(x)))).alias("score"), i.alias("pos"), F.size(words(x)).alias("n"), x.alias("s")),
    )


def fill_budget(rows: Column, budget: Column) -> Column:
    """Sentences in rank order while they fit into ``budget`` words, put back in text order. A first sentence that alone is
    too long is cut to the budget."""
    kind = "struct<used:int,full:boolean,picked:array<struct<pos:int,s:string>>>"
    start = F.struct(F.lit(0).alias("used"), F.lit(False).alias("full"), F.array().cast("array<struct<pos:int,s:string>>").alias("picked")).cast(kind)

    def step(a: Column, r: Column) -> Column:
        fits = ~a["full"] & (a["used"] + r["n"] <= budget)
        first = ~a["full"] & (a["used"] == 0) & (r["n"] > budget)
        cut = F.array_join(F.slice(F.split(r["s"], " "), F.lit(1), budget), " ")
        return (
            F.when(fits, F.struct((a["used"] + r["n"]).alias("used"), F.lit(False).alias("full"), F.concat(a["picked"], F.array(F.struct(r["pos"].alias("pos"), r["s"].alias("s")))).alias("picked")))
            .when(first, F.struct(budget.alias("used"), F.lit(True).alias("full"), F.array(F.struct(r["pos"].alias("pos"), cut.alias("s"))).alias("picked")))
            .otherwise(F.struct(a["used"].alias("used"), F.lit(True).alias("full"), a["picked"].alias("picked")))
            .cast(kind)
        )

    picked = F.aggregate(F.array_sort(rows), start, step, lambda a: F.array_sort(a["picked"]))
    return F.array_join(F.transform(picked, lambda x: x["s"]), " ")
