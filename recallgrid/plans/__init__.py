"""Registered queries over the given tables, each with its SQL where SQL can say the same."""

from __future__ import annotations

from recallgrid.plans import dialog, evaluate, keyed, loading, retrieval, scalars, streams
from recallgrid.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "dialog", "evaluate", "keyed", "loading", "retrieval", "scalars", "streams"]
