"""Writers of row files and vector collections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_json(rows: DataFrame, path: str) -> None:
    """JSON lines, ASCII-escaped, one file per partition."""
    rows.write.mode("overwrite").option("writeNonAsciiCharacterAsCodePoint", True).json(path)


def write_vectors(vectors: DataFrame, path: str, group: str = "database_name", rows_per_file: int = 1_000_000) -> None:
    """Vector collection in one folder per database, so a search of few databases reads only those.

    Rows are dealt out by database and, in a large one, by a hash into parts of about
    `rows_per_file`, so the number of files does not depend on the number of tasks.
    """
    key = F.col(group)
    sizes = vectors.groupBy(key.alias("__group")).agg(F.ceil(F.count(F.lit(1)) / rows_per_file).alias("__files"))
    dealt = vectors.join(sizes, key.eqNullSafe(F.col("__group"))).withColumn(
        "__part", F.pmod(F.xxhash64(*[c for c in vectors.columns if c != group]), F.col("__files"))
    )
    dealt.repartition(key, F.col("__part")).select(*vectors.columns).write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).partitionBy(group).parquet(path)


def read_vectors(spark, path: str) -> DataFrame:
    return spark.read.parquet(path)
