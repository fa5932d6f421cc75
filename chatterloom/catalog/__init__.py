"""Registered queries: every operator run over the given tables, with SQL that must agree."""

from chatterloom.catalog.registry import ORACLES, QUERIES
from chatterloom.catalog import features, models, reports, texts  # noqa: F401  (they register)

__all__ = ["ORACLES", "QUERIES"]
