"""Structured record filters: one request as a Column, or a table of requests.

A term compares one field of the request with one column of the records. Unset terms (null, and the empty
string for keywords) do not constrain, all set terms must hold, and a null record value never matches.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F

from recallgrid.schema import TIME_BANDS


@dataclass(frozen=True)
class Term:
    """``kind``: keyword (upper-cased value), integer, at_least, at_most or band."""

    kind: str
    field: str
    column: str

    def wanted(self, value: Any) -> Any:
        """The normalised value, or None when the term does not constrain."""
        if value is None or (isinstance(value, float) and value != value):
            return None
        if self.kind == "keyword":
            return value.upper() or None
        if self.kind == "band":
            return TIME_BANDS.get(value)
        return int(value)

    def predicate(self, value: Any) -> Column | None:
        want = self.wanted(value)
        if want is None:
            return None
        col = F.col(self.column)
        if self.kind == "at_least":
            return col >= want
        if self.kind == "at_most":
            return col <= want
        return col.between(*want) if self.kind == "band" else col == want

    def is_set(self) -> Column:
        """The same "does it constrain" test on a request table."""
        value = F.col(self.field)
        if self.kind == "keyword":
            return F.coalesce(value, F.lit("")) != ""
        return F.coalesce(value.isin(*TIME_BANDS), F.lit(False)) if self.kind == "band" else value.isNotNull()

    def mask(self, values: pa.Array, want: Any) -> pa.Array:
        if self.kind == "at_least":
            return pc.greater_equal(values, want)
        if self.kind == "at_most":
            return pc.less_equal(values, want)
        if self.kind == "band":
            return pc.and_(pc.greater_equal(values, want[0]), pc.less_equal(values, want[1]))
        return pc.equal(values, want)


FLIGHT_TERMS = (
    Term("keyword", "origin", "origin"),
    Term("keyword", "dest", "dest"),
    Term("keyword", "carrier", "carrier"),
    Term("integer", "year", "year"),
    Term("integer", "month", "month"),
    Term("integer", "day", "day"),
    Term("integer", "flight", "flight"),
    Term("at_least", "month_min", "month"),
    Term("at_most", "month_max", "month"),
    Term("band", "time_of_day", "sched_dep_time"),
)


def filter_column(request: Mapping[str, Any], terms: Sequence[Term] = FLIGHT_TERMS) -> Column | None:
    """Conjunction of literal terms, which Parquet can push down; None when nothing constrains."""
    parts = [t.predicate(request.get(t.field)) for t in terms]
    parts = [p for p in parts if p is not None]
    return reduce(lambda a, b: a & b, parts) if parts else None


def has_filter(terms: Sequence[Term]) -> Column:
    return reduce(lambda a, b: a | b, [t.is_set() for t in terms], F.lit(False))


def common_bounds(requests: Iterable[Mapping[str, Any]], terms: Sequence[Term]) -> Column | None:
    """A condition that every record matching at least one request meets, for the scan to push down.

    Only fields that all requests constrain take part: the set of keyword or integer values wanted (at most one a request of a
    block), the least lower and the greatest upper bound.
    """
    parts = []
    for t in terms:
        wants = [t.wanted(r.get(t.field)) for r in requests]
        if not wants or any(w is None for w in wants):
            continue
        col = F.col(t.column)
        if t.kind == "at_least":
            parts.append(col >= min(wants))
        elif t.kind == "at_most":
            parts.append(col <= max(wants))
        elif t.kind == "band":
            parts.append(col.between(min(w[0] for w in wants), max(w[1] for w in wants)))
        else:
            parts.append(col.isin(*sorted(set(wants))))
    return reduce(lambda a, b: a & b, parts) if parts else None


def batch_mask(batch: pa.RecordBatch, terms: Sequence[Term], wants: Sequence[Any]) -> np.ndarray | None:
    """Rows of an Arrow batch that meet the set terms; None when nothing constrains."""
    out = None
    for term, want in zip(terms, wants):
        if want is None:
            continue
        m = pc.fill_null(term.mask(batch.column(term.column), want), False)
        out = m if out is None else pc.and_(out, m)
    return None if out is None else out.to_numpy(zero_copy_only=False)


def matches(request: Mapping[str, Column], record: Mapping[str, Column]) -> Column:
    """Case-insensitive check of a record against wanted codes, a null record value counting as empty text."""
    parts = [
        (F.coalesce(want, F.lit("")) == "") | (F.upper(F.coalesce(record[name], F.lit(""))) == F.upper(want))
        for name, want in request.items()
    ]
    return reduce(lambda a, b: a & b, parts)


def scoreable(expected_count: Column, *wanted: Column) -> Column:
    """Can a golden entry be scored: does it name ids, or set a filter?"""
    parts = [F.coalesce(expected_count, F.lit(0)) > 0] + [F.coalesce(w, F.lit("")) != "" for w in wanted]
    return reduce(lambda a, b: a | b, parts)
