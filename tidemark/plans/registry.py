"""Collects the named queries and their SQL oracles from the plan modules."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES: tuple[str, ...] = ("statistics", "market", "risk", "validation", "signals", "recursions", "learning", "live", "weights", "monitoring", "adaptive", "layer", "feeds", "models")


def _collect(attribute: str) -> dict:
    found: dict = {}
    for name in MODULES:
        part = getattr(importlib.import_module(f"tidemark.plans.{name}"), attribute)
        if clash := found.keys() & part.keys():
            raise ValueError(f"query names used twice: {sorted(clash)}")
        found.update(part)
    return found


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _collect("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _collect("ORACLES")
