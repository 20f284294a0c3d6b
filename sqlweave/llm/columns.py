"""The user's columns, carried through an operator under names that cannot clash with its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def carried(table: DataFrame, replaced: tuple[str, ...] = ()) -> tuple[list[Column], list[Column]]:
    """All columns of `table` but those named in `replaced`: as kept_0, kept_1, …, and those back under their names."""
    names = [c for c in table.columns if c.lower() not in replaced]
    inward = [F.col(quoted(c)).alias(f"kept_{i}") for i, c in enumerate(names)]
    outward = [F.col(f"kept_{i}").alias(c) for i, c in enumerate(names)]
    return inward, outward
