"""Loads every operator module and with it the registered queries."""

from __future__ import annotations

import importlib

from docweave.llm.registry import QUERIES, SQL

MODULES = ("toxicity", "quality", "decontamination", "token_counts", "licenses", "packing", "jaccard_join", "language", "line_dedup", "fingerprints",
           "periodic_runs", "quality_rules", "alignment")

for _module in MODULES:
    importlib.import_module(f"docweave.llm.{_module}")

__all__ = ["QUERIES", "SQL"]
