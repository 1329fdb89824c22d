"""Registry of runnable queries and their equivalent SQL."""

from __future__ import annotations

import importlib

QUERIES: dict = {}
SQL: dict[str, str] = {}

MODULES = ("corpus_etl", "extraction", "chunk_index", "retrieval", "evidence", "facts",
           "governance", "dialogue", "review_sets", "streams")


def query(name: str, sql: str | None = None):
    """Register ``function(spark, sf_dir)`` under a name, with its SQL twin when SQL can say it."""
    def register(function):
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function
    return register


def load_all() -> None:
    for module in MODULES:
        importlib.import_module(f"docweave.plans.{module}")
