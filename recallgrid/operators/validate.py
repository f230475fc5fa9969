"""Row validation with an accepted and a rejected stream."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from recallgrid.schema import OPTIONAL_INTS, OPTIONAL_TEXTS, PAYLOAD, REQUIRED_CODES, REQUIRED_INTS

# The pattern goes before the cast: a failing try_cast raises inside the JVM, at a cost of tens of microseconds.
_NUMBER = r"`{0}` RLIKE r'^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d{{1,2}})?\s*$'"
# Plain whole numbers stay in generated code. Rarer spellings go through a lambda, which generated code only calls: spelled out for
# every column, it would grow beyond the 64 KB of a method.
_WHOLE = r"CASE WHEN `{0}` RLIKE r'^\s*[+-]?\d+(\.0*)?\s*$' THEN try_cast(trim(substring_index(`{0}`, '.', 1)) AS INT) "
_WHOLE += "WHEN " + _NUMBER + " THEN transform(array(try_cast(trim(`{0}`) AS DECIMAL(38,9))), d -> if(d % 1 = 0, try_cast(d AS INT), NULL))[0] END"
_TOO_LARGE = "exists(array(`{0}`), x -> " + _NUMBER.replace("`{0}`", "x") + " AND try_cast(trim(x) AS DOUBLE) % 1 = 0)"
_CODE = "upper(coalesce(CAST(`{0}` AS STRING), 'NAN'))"
_TEXT = "CAST(`{0}` AS STRING)"


@dataclass(frozen=True)
class Rule:
    """``kind``: integer (whole numbers, also as ``12.0``), code (upper-cased, null becomes ``NAN``) or text."""

    name: str
    kind: str
    required: bool = True


FLIGHT_RULES = (
    *[Rule(c, "integer") for c in REQUIRED_INTS],
    *[Rule(c, "code") for c in REQUIRED_CODES],
    *[Rule(c, "integer", False) for c in OPTIONAL_INTS],
    *[Rule(c, "text", False) for c in OPTIONAL_TEXTS],
)


def _typed(rule: Rule, columns: Sequence[str]) -> str:
    """SQL for the typed value: whole numbers in any spelling (``12``, ``12.0``, ``12.``, ``1e3``) as integers, null for any other
    text and for numbers beyond 32 bits, which ``rejected`` names as out of range."""
    if rule.name not in columns:
        return f"CAST(NULL AS {'INT' if rule.kind == 'integer' else 'STRING'})"
    return {"integer": _WHOLE, "code": _CODE, "text": _TEXT}[rule.kind].format(rule.name)


def _typed_columns(rules: Sequence[Rule], columns: Sequence[str]) -> list[Column]:
    return [F.expr(_typed(r, columns)).alias(r.name) for r in rules]


def _reject_nulls(null_policy: str) -> bool:
    if null_policy not in ("reject", "keep"):
        raise ValueError(f"unknown null policy {null_policy!r}")
    return null_policy == "reject"


def is_valid(columns: Sequence[str], rules: Sequence[Rule] = FLIGHT_RULES, null_policy: str = "reject") -> Column:
    """Does a row meet the rules?

    ``null_policy='reject'`` turns away a null in an optional column, which is what the service does in fact;
    ``'keep'`` accepts it, which is what it says. An optional column missing from the table is fine in both.
    """
    strict = _reject_nulls(null_policy)
    ok = ["true"]
    for rule in rules:
        if rule.name not in columns:
            ok.append("false" if rule.required else "true")
        elif rule.kind != "code":
            value = f"({_typed(rule, columns)}) IS NOT NULL"
            ok.append(value if rule.required or strict else f"({value} OR `{rule.name}` IS NULL)")
    return F.expr(" AND ".join(ok))


def typed(df: DataFrame, rules: Sequence[Rule] = FLIGHT_RULES, null_policy: str = "reject", keep: Sequence[str] = ()) -> DataFrame:
    """All rows as typed columns, with ``valid`` telling the good ones (bad values are null)."""
    valid = is_valid(df.columns, rules, null_policy).alias("valid")
    return df.select(*keep, *_typed_columns(rules, df.columns), valid)


def accepted(
    df: DataFrame, rules: Sequence[Rule] = FLIGHT_RULES, null_policy: str = "reject", keep: Sequence[str] = (),
) -> DataFrame:
    """Valid rows as typed columns (extra columns dropped unless named in ``keep``)."""
    return df.filter(is_valid(df.columns, rules, null_policy)).select(
        *keep, *_typed_columns(rules, df.columns))


def rejected(df: DataFrame, rules: Sequence[Rule] = FLIGHT_RULES, null_policy: str = "reject") -> DataFrame:
    """Invalid rows as read, with the list of reasons in ``problems``."""
    strict = _reject_nulls(null_policy)
    found = []
    for rule in rules:
        if rule.name not in df.columns:
            found += [f"'{rule.name}: missing'"] if rule.required else []
        elif rule.kind != "code":
            null = f"WHEN `{rule.name}` IS NULL THEN " + (f"'{rule.name}: null'" if rule.required or strict else "NULL")
            bad = (f"WHEN ({_typed(rule, df.columns)}) IS NULL THEN CASE WHEN {_TOO_LARGE.format(rule.name)} "
                   f"THEN '{rule.name}: out of range' ELSE '{rule.name}: not an integer' END")
            found.append(f"CASE {null} {bad if rule.kind == 'integer' else ''} END")
    problems = F.expr(f"array_compact(CAST(array({', '.join(found)}) AS ARRAY<STRING>))")
    return df.withColumn("problems", problems).filter(F.size("problems") > 0)


def payload(df: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    return df.select(*extra, *PAYLOAD)
