"""JSON recovery and checks on VARIANT values."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_END = "end of text 5d0c"
# What a JSON text looks like from outside. Anything else is not tried: a failed parse raises inside the JVM, which
# costs more than parsing.
_OUTSIDE = r'(?s)^\s*(?:\{.*\}|\[.*\]|".*"|-?\d[\d.eE+-]*|true|false|null)\s*$'


def kind(v: Column) -> Column:
    """OBJECT, ARRAY, STRING, BIGINT, ... of a variant; null stays null."""
    return F.substring_index(F.substring_index(F.schema_of_variant(v), "<", 1), "(", 1)


def is_object(v: Column) -> Column:
    return F.schema_of_variant(v).startswith("OBJECT")


def parse(text: Column) -> Column:
    """Variant of a text that is one JSON value and nothing else, null otherwise.

    The built-in parser stops after the first value and ignores what follows, so the text is parsed as the first of two
    array elements and the closing mark must come right behind it. Objects with a repeated key count as invalid.
    """
    pair = F.try_parse_json(F.when(text.rlike(_OUTSIDE), F.concat(F.lit("["), text, F.lit(f',"{_END}"]'))))
    whole = (F.try_variant_get(pair, "$[1]", "string") == _END) & F.try_variant_get(pair, "$[2]", "variant").isNull()
    return F.when(whole, F.try_variant_get(pair, "$[0]", "variant"))


def parse_object(text: Column) -> Column:
    """Variant of a JSON object; anything else becomes an empty object."""
    v = parse(text)
    return F.when(is_object(v), v).otherwise(F.parse_json(F.lit("{}")))


def recover(text: Column) -> Column:
    """Arguments out of messy text: whole text, else the widest ``{...}`` in it, else an empty object."""
    braces = F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))
    return F.coalesce(parse(text), parse(braces), F.parse_json(F.lit("{}")))


def is_empty(v: Column) -> Column:
    """Would the parsed value count as "nothing given" (null, false, zero, empty text, list or object)?"""
    return F.is_variant_null(v) | F.to_json(v).isin("{}", "[]", '""', "0", "0.0", "-0.0", "false", "null")


def string_field(v: Column, name: str) -> Column:
    """A field only if it is JSON text."""
    field = F.try_variant_get(v, f"$.{name}", "variant")
    return F.when(F.schema_of_variant(field) == "STRING", F.try_variant_get(v, f"$.{name}", "string"))


def has_field(v: Column, name: str) -> Column:
    """Field present with a value other than JSON null."""
    field = F.try_variant_get(v, f"$.{name}", "variant")
    return field.isNotNull() & ~F.coalesce(F.is_variant_null(field), F.lit(False))


def int_field(v: Column, name: str) -> Column:
    """A field as integer when it is a whole number or text of one; null otherwise."""
    raw = F.try_variant_get(v, f"$.{name}", "string")
    field = F.try_variant_get(v, f"$.{name}", "variant")
    whole = F.regexp_extract(raw, r"^\s*([+-]?\d+)(\.0+)?\s*$", 1)
    return F.when(F.schema_of_variant(field) != "BOOLEAN", F.nullif(whole, F.lit("")).try_cast("int"))
