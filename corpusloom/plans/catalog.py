"""All queries of the library's own operators, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from ..registry import REGISTRY

MODULES = ("quality", "aggregates", "windows", "sampling", "scalars", "joins", "dedup", "scoring", "evaluation", "review", "gates", "reports", "ingest")


def _load() -> None:
    for module in MODULES:
        import_module(f"corpusloom.plans.{module}")


def queries() -> dict[str, Callable]:
    _load()
    return {name: op.query for name, op in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {name: op.sql for name, op in REGISTRY.items() if op.sql}
