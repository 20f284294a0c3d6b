"""Spark session, table loading and lineage cutting."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"

# Rows of a task whose row-wise work is costly.
SPREAD_ROWS = 50_000


def build_session(app: str = "sqlweave", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the operators rely on; `conf` overrides any of them."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(table: DataFrame, like: DataFrame | None = None) -> DataFrame:
    """Hand a freshly read table to all cores in shares of at most about SPREAD_ROWS rows.

    For row-wise work that costs far more than reading. The number of splits does not tell how
    rows are dealt: a row group is read by one task however many splits its file makes, so a file
    of a few large row groups would leave most tasks without a row. `like`, with
    as many rows, is counted instead of a table that is costly to work out twice.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(max(cores, -(-(table if like is None else like).count() // SPREAD_ROWS)))


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: the cluster's checkpoint folder.

    Where that is not set, the warehouse folder, which the driver and all executors share too.
    """
    for key in (CHECKPOINT_KEY, "spark.sql.warehouse.dir"):
        root = spark.conf.get(key, None) or spark.sparkContext.getConf().get(key)
        if root:
            return root
    raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder all executors share")


def scratch_path(spark: SparkSession) -> str:
    """A new path in the shared folder; what is written there goes when the application ends."""
    path = f"{scratch_root(spark).rstrip('/')}/sqlweave/{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def materialise(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and read it back.

    Cuts the lineage like a checkpoint but survives lost executors, computes the
    plan once, and leaves file sizes behind that join planning can use.
    """
    spark = df.sparkSession
    path = scratch_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
