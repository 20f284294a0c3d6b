"""Seeded pseudo-random order and choice, reproducible in any engine that has md5."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# 3 hex digits of a digest: 4,096 evenly filled buckets per key.
BUCKET_DIGITS = 3


def digest(seed: str, *parts: Column) -> Column:
    """md5 of seed and parts joined by '|'. NULL parts count as empty."""
    text = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.md5(F.concat_ws("|", F.lit(seed), *text))


def digest_bucket(hex_digest: Column) -> Column:
    """Leading digits of a digest: a bucket number whose order follows the digest's."""
    return F.conv(F.substring(hex_digest, 1, BUCKET_DIGITS), 16, 10).cast("long")


def digest_int(hex_digest: Column) -> Column:
    """First 32 bits of a digest as a non-negative long."""
    return F.conv(F.substring(hex_digest, 1, 8), 16, 10).cast("long")
