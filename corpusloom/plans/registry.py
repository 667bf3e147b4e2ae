"""All queries of the engine's own operators and their SQL."""

from __future__ import annotations

import importlib

MODULES = ["corpus", "audit", "tokens", "evaluation", "analytics", "packs"]


def _collect(attribute: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out |= getattr(importlib.import_module(f"corpusloom.plans.{name}"), attribute)
    return out


def queries() -> dict:
    return _collect("QUERIES")


def oracle_sql() -> dict:
    return _collect("ORACLES")
