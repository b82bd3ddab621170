"""Queries over the given tables, each with the SQL that states its result."""
from . import aggregates, features, profiles, projections, reconciliation, sources, timelines, windows, workbench  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
