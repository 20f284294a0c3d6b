"""Array helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unnest(df: DataFrame, array: Column, out: str, *keep: str) -> DataFrame:
    """One row per array element, with the `keep` columns.

    A plain explode makes the optimiser add a filter on the array's size, which works
    out a computed array twice; the outer form with a test afterwards does not.
    """
    return df.select(*keep, F.explode_outer(array).alias(out)).filter(F.col(out).isNotNull())
