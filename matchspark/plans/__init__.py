"""Composed jobs and the registry of named queries."""

from __future__ import annotations

import importlib

from matchspark.plans.catalog import ORACLE, QUERIES

MODULES = ("series", "prices", "lookups", "conforming", "reports", "records", "datasets", "fits", "stored", "enriched", "scoring")


def registered():
    """All queries and their SQL counterparts."""
    for module in MODULES:
        importlib.import_module(f"matchspark.plans.{module}")
    return QUERIES, ORACLE
