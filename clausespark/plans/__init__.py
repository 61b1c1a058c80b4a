"""Registered queries: each one is a DataFrame plan with, where possible, equivalent SQL."""

from __future__ import annotations

import importlib
from types import SimpleNamespace

MODULES = ("text_queries", "retrieval_queries", "answer_queries", "scope_queries", "chat_queries", "catalog_queries", "curation_queries", "ingest_queries")


def load() -> SimpleNamespace:
    """Import every query module and return the collected builders and SQL."""
    for name in MODULES:
        importlib.import_module(f"clausespark.plans.{name}")
    from clausespark.plans.registry import ORACLES, QUERIES

    return SimpleNamespace(queries=QUERIES, oracles=ORACLES)
