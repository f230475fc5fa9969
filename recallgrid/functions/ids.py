"""Deterministic identifiers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from recallgrid.functions.text import strip, text_or_none
from recallgrid.schema import ID_PARTS, NAMESPACE_DNS, NAMESPACE_URL


# The digits of a SHA-1, followed by the four variants, from which the digit in place of the variant picks one.
_UUID_VARIANTS = "89ab"
_UUID_FORM = (
    r"^(.{8})(.{4}).(.{3})(?:[048c](?=.*(8)9ab$)|[159d](?=.*8(9)ab$)|[26ae](?=.*89(a)b$)|[37bf](?=.*89a(b)$))(.{3})(.{12}).*$")


def uuid5(namespace: str, name: Column) -> Column:
    """Name-based UUID (version 5) as built-in expressions, so it stays in generated code.

    ``name`` stands in it once: Spark shares no common parts inside a condition or a filter, and would compute the name and its hash
    again for each mention.
    """
    hashed = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    return F.regexp_replace(F.concat(hashed, F.lit(_UUID_VARIANTS)), _UUID_FORM, "$1-$2-5$3-$4$5$6$7$8-$9")


def record_id(*parts: Column | str) -> Column:
    """Stable id of a row: UUID5 of its key columns joined by ``|`` (null shows as ``None``)."""
    cols = [F.col(p) if isinstance(p, str) else p for p in (parts or ID_PARTS)]
    return uuid5(NAMESPACE_URL, F.concat_ws("|", *[text_or_none(c) for c in cols]))


def booking_key(flight_id: Column, passenger: Column) -> Column:
    """Idempotency key: UUID5 of the flight and the trimmed lower-case name."""
    return uuid5(NAMESPACE_DNS, F.concat(flight_id, F.lit("|"), F.lower(strip(passenger))))
