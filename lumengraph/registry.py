"""All queries outside the training-data subpackage, gathered from the plan modules."""

from __future__ import annotations

from importlib import import_module

MODULES: tuple[str, ...] = ("text_search", "graph_reports", "resolution", "records", "package_reports", "calls", "linking", "session_sql")


def _merged(name: str) -> dict:
    out: dict = {}
    for module in MODULES:
        out |= getattr(import_module(f"lumengraph.plans.{module}"), name)
    return out


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _merged("ORACLES")
