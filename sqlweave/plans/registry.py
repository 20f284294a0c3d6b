"""All registered queries by name."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]

FAMILIES = ["denotation", "sqltext", "catalog", "retrieval", "scoring", "datasets", "correction", "sqlsubset", "roundtrips"]


def all_queries() -> dict[str, tuple[Builder, str | None]]:
    found: dict[str, tuple[Builder, str | None]] = {}
    for family in FAMILIES:
        entries = import_module(f"sqlweave.plans.{family}").QUERIES
        clash = found.keys() & entries.keys()
        if clash:
            raise ValueError(f"query names used twice: {sorted(clash)}")
        found.update(entries)
    return found
