"""All registered queries."""

from __future__ import annotations

import importlib

from siftline.plans import registry

MODULES = [
    "scans",
    "projections",
    "joins",
    "aggregates",
    "ordering",
    "text_functions",
    "rules",
    "dedup",
    "learning",
    "table_jobs",
    "sessions",
    "streams",
    "logs",
]

for _module in MODULES:
    importlib.import_module(f"siftline.plans.{_module}")


def queries():
    return registry.runnable()


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
