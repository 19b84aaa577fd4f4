"""All queries over the reference tables, by name, with their SQL oracles."""

from __future__ import annotations

from tallgrass.plans import admission, files, history, knowledge, ledger, providers, shelf, texts  # noqa: F401  registers the queries
from tallgrass.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
