"""Queries and SQL of this subpackage, as the entry file adds them."""

from __future__ import annotations

from importlib import import_module

MODULES = ("fingerprints", "secrets", "url_rules", "embedding_join", "ngram_join", "packing", "language_id", "mixing", "toxicity", "chat", "fill_middle", "collocations", "token_counts")


def _merged(name: str) -> dict:
    out: dict = {}
    for module in MODULES:
        out |= getattr(import_module(f"lumengraph.llm.{module}"), name)
    return out


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _merged("ORACLES")
