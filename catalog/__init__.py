"""Registered queries over the driver's tables, each with its SQL counterpart where SQL can state it."""

from __future__ import annotations

import importlib

MODULES = ("cleaning_queries", "quality_queries", "eda_queries", "pairwise_queries", "routing_queries", "report_queries", "scalar_queries", "source_queries")


def load_all() -> None:
    for name in MODULES:
        importlib.import_module(f"catalog.{name}")
