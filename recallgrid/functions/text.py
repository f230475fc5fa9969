"""String, number and clock formatting as Column functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from recallgrid.schema import TIME_BANDS

# What Python counts as white space and as a line end, spelled out for Java regular expressions.
_SPACE = r"[\s\x1c-\x1f]"
_LINE_END = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85  ]"
_CODE = r"(?:\([A-Z]{3}\)|[A-Z]{3})"

# Any text with a ``{query}`` mark can be passed instead.
RECORD_PROMPT = (
    "Write one flight record that would answer this search: {query}\n"
    "Form: CODE AIRLINE flight NUMBER ORIGIN CITY to DEST CITY YEAR-MONTH-DAY "
    "sched HHMM->HHMM actual HHMM->HHMM dist MILES air MINUTES\n"
    "Answer with the record only."
)


def strip(c: Column) -> Column:
    """Trim every kind of Unicode white space, not only blanks."""
    return F.regexp_replace(c, rf"(?U)^{_SPACE}+|{_SPACE}+$", "")


def text_or_none(c: Column) -> Column:
    """Text of a value, with the word ``None`` for null."""
    return F.coalesce(c.cast("string"), F.lit("None"))


def cut(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def clock(hhmm: Column, missing: str = "—") -> Column:
    """1430 -> ``14:30``."""
    v = hhmm.cast("int")
    shown = F.format_string("%02d:%02d", F.floor(v / 100), F.pmod(v, F.lit(100)))
    return F.when(v.isNull(), missing).otherwise(shown)


def miles(distance: Column, missing: str = "—") -> Column:
    return F.coalesce(F.concat(F.format_number(distance, 0), F.lit(" mi")), F.lit(missing))


def short_id(uid: Column) -> Column:
    return F.concat(F.substring(uid, 1, 8), F.lit("…"))


def ymd(year: Column, month: Column, day: Column) -> Column:
    """``2013-01-05``; an absent month or day shows as ``00``."""
    two = lambda c: F.format_string("%02d", F.coalesce(c, F.lit(0)))
    return F.concat_ws("-", text_or_none(year), two(month), two(day))


def percent(score: Column) -> Column:
    """0.874 -> ``87%``, halves to even."""
    return F.concat(F.bround(score * 100, 0).cast("long").cast("string"), F.lit("%"))


def iso_timestamp(ts: Column) -> Column:
    """ISO-8601 text with a UTC offset; fractional digits appear only when they are not all zero."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.date_format(ts, "SSSSSS")
    return F.concat(whole, F.when(fraction == "000000", "").otherwise(F.concat(F.lit("."), fraction)), F.lit("+00:00"))


def with_route(message: Column, origin: Column, dest: Column) -> Column:
    """``msg (from A to B)`` with the parts that are set."""
    parts = F.concat_ws(
        " ",
        F.concat(F.lit("from "), F.nullif(origin, F.lit(""))),
        F.concat(F.lit("to "), F.nullif(dest, F.lit(""))),
    )
    return F.when(parts == "", message).otherwise(F.concat(message, F.lit(" ("), parts, F.lit(")")))


def time_band(hhmm: Column) -> Column:
    """Name of the departure band holding a HHMM number, null outside all bands."""
    out = F.lit(None).cast("string")
    for name, (lo, hi) in TIME_BANDS.items():
        out = F.when(hhmm.between(lo, hi), name).otherwise(out)
    return out


def pick_line(raw: Column, query: Column) -> Column:
    """The line of a generated text that holds the record.

    First trimmed line with an arrow and more than 20 characters, else the last line, else the query.
    """
    lines = F.transform(F.split(strip(raw), _LINE_END), strip)
    record = F.filter(lines, lambda s: s.contains("->") & (F.length(s) > 20))
    return F.coalesce(
        F.try_element_at(record, F.lit(1)),
        F.nullif(F.try_element_at(lines, F.lit(-1)), F.lit("")),
        query,
    )


def fill_prompt(query: Column, template: str = RECORD_PROMPT) -> Column:
    return F.replace(F.lit(template), F.lit("{query}"), query)


def looks_like_record(doc: Column, spelled_out: bool = False) -> Column:
    """Does a text have a route and a number of three to five digits?

    As written in the source rules a route is CODE-CODE; ``spelled_out`` also takes the canonical
    ``LGA LaGuardia to ATL Atlanta`` form, which the strict rule misses.
    """
    route = doc.rlike(rf"(?dU){_CODE}\s*-+>?\s*.{{0,20}}{_CODE}")
    if spelled_out:
        route = route | doc.rlike(rf"(?dU){_CODE}\b.{{0,40}}? to {_CODE}")
    return route & doc.rlike(r"(?U)\d{3,5}")


def record_status(doc: Column, query: Column, spelled_out: bool = False) -> Column:
    return (
        F.when(doc == query, "FALLBACK")
        .when(looks_like_record(doc, spelled_out), "PASS")
        .otherwise("WEAK")
    )
