"""Readers of catalogs, questions, descriptions, sessions and user tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sqlweave.operators.ranking import running

CATALOG_DDL = (
    "db_id string, table_names_original array<string>, column_names_original array<array<string>>, "
    "column_names array<array<string>>, column_types array<string>, primary_keys array<string>, "
    "foreign_keys array<array<int>>"
)
QUESTION_DDL = (
    "question_id bigint, db_id string, question string, evidence string, SQL string, difficulty string"
)
DESCRIPTION_DDL = (
    "original_column_name string, column_name string, column_description string, data_format string, "
    "value_description string"
)
TRAINING_DDL = (
    "question_id bigint, db_id string, question string, evidence string, sql_gt string, "
    "table array<string>, column string, foreign_keys array<string>, difficulty string"
)
# What a character becomes that is no valid UTF-8.
UNREADABLE = "�"


def _c1_table() -> tuple[str, str]:
    """The characters latin-1 and cp1252 read differently, in both readings."""
    latin, windows = "", ""
    for code in range(0x80, 0xA0):
        char = bytes([code]).decode("cp1252", "ignore")
        if char:
            latin, windows = latin + chr(code), windows + char
    return latin, windows


def _indexed_names(names: Column) -> Column:
    return F.transform(names, lambda n: F.struct(n[0].cast("int").alias("table_idx"), n[1].alias("name")))


def read_catalogs(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """JSON array (or JSON lines) of catalogs. Mixed single and composite keys stay texts like '3' or '[3,4]'.

    An array is one task whatever its size; files of JSON lines are split.
    """
    raw = spark.read.schema(CATALOG_DDL).option("multiLine", not lines).json(path)
    return raw.withColumns(
        {c: _indexed_names(F.col(c)) for c in ("column_names_original", "column_names")}
    )


def read_questions(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """JSON array (or JSON lines) of questions; missing evidence becomes ''."""
    raw = spark.read.schema(QUESTION_DDL).option("multiLine", not lines).json(path)
    return raw.withColumn("evidence", F.coalesce("evidence", F.lit("")))


def read_training(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Training rows; the nested `column` entry stays JSON text."""
    return spark.read.schema(TRAINING_DDL).option("multiLine", not lines).json(path)


def read_descriptions(spark: SparkSession, folder: str) -> DataFrame:
    """Per-table description CSVs `<folder>/<db_id>/database_description/<table>.csv`.

    A file that is no valid UTF-8 is taken from a second reading as cp1252, which Spark
    reads as latin-1 with 27 characters to replace. Rows without either name go. `file_status` tells the encoding used.
    """

    def reading(encoding: str) -> DataFrame:
        rows = (
            spark.read.schema(DESCRIPTION_DDL)
            .options(header=True, multiLine=True, escape='"', encoding=encoding, pathGlobFilter="*.csv")
            .option("recursiveFileLookup", True)
            .csv(folder)
        )
        return rows.withColumn("file", F.col("_metadata.file_path"))

    names = [c.split()[0] for c in DESCRIPTION_DDL.split(", ")]
    utf8 = reading("UTF-8")
    broken = F.greatest(*[F.coalesce(F.col(c).contains(UNREADABLE), F.lit(False)) for c in names])
    bad = utf8.filter(broken).select("file").distinct()
    good = utf8.join(bad, "file", "left_anti").withColumn("file_status", F.lit("utf-8"))
    latin, windows = _c1_table()
    second = reading("ISO-8859-1").join(bad, "file", "left_semi").withColumn("file_status", F.lit("cp1252"))
    second = second.withColumns({c: F.translate(c, latin, windows) for c in names})
    parts = F.split("file", "/")
    return (
        good.unionByName(second)
        .filter(F.col("original_column_name").isNotNull() | F.col("column_name").isNotNull())
        .withColumn("table_name", F.lower(F.trim(F.regexp_replace(F.url_decode(F.element_at(parts, -1)), r"\.csv$", ""))))
        .withColumn("db_id", F.url_decode(F.element_at(parts, -3)))
        .drop("file")
    )


def sessions(lines: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Number the sessions and turns of tab-separated lines (…, line_no, line).

    A blank line ends a session; the last one needs none. Both numbers come from one
    running pass in buckets, so one very long file is spread over tasks. Session
    numbers count from 0 and turns from 1.
    """
    keys = keys or []
    blank = F.length(F.trim(F.regexp_replace("line", r"\s+", " "))) == 0
    counted = running(
        lines,
        keys,
        "line_no",
        {"session_id": F.when(blank, 1).otherwise(0)},
        {"last_blank": F.when(blank, F.col("line_no"))},
    )
    start = F.coalesce(F.col("last_blank"), F.lit(-1))
    fields = F.split(F.trim("line"), "\t")
    return counted.filter(~blank).select(
        *keys,
        "session_id",
        (F.col("line_no") - start).alias("turn"),
        fields.getItem(0).alias("sql"),
        F.get(fields, F.lit(1)).alias("db_id"),
    )


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files with their number in the file from 0: (file, line_no, line).

    A large file is many splits. Only line counts per split are summed along the file; a
    split's rows follow each other in one task, so their ids there count from its first.
    """
    read = spark.read.text(path).select(
        F.col("value").alias("line"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"),
    )
    splits = read.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select(
        "file", "block", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift")
    )
    return read.join(starts, ["file", "block"]).select("file", (F.col("id") + F.col("shift")).alias("line_no"), "line")


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """Session files: tab-separated turns, a blank line after each session; numbers are per file."""
    return sessions(numbered_lines(spark, path), ["file"])


def session_count_gap(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Session counts of both files; they have to be equal before turns are scored."""

    def last(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count_distinct("session_id").alias(name))

    counts = last(gold, "gold_sessions").select("gold_sessions", F.lit(0).alias("one"))
    return counts.join(last(pred, "pred_sessions").withColumn("one", F.lit(0)), "one").select(
        "gold_sessions", "pred_sessions", (F.col("gold_sessions") == F.col("pred_sessions")).alias("equal")
    )


def introspect(spark: SparkSession, tables: dict[str, DataFrame], db_id: str) -> DataFrame:
    """Catalog rows of a set of tables, from their schemas alone."""
    rows = [
        (db_id, table, i, field.name, field.dataType.simpleString())
        for table, df in tables.items()
        for i, field in enumerate(df.schema.fields)
    ]
    return spark.createDataFrame(rows, "db_id string, table_name string, col_idx int, column_name string, type string")


def read_schema_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Per-database JSON array (or JSON lines) of tables with their columns, names lower-cased."""
    ddl = "table string, col_data array<struct<column_name:string>>"
    raw = spark.read.schema(ddl).option("multiLine", not lines).json(path)
    return raw.select(F.lower("table").alias("table_name"), F.explode("col_data").alias("c")).select(
        "table_name", F.lower("c.column_name").alias("column_name")
    )


def read_jdbc(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """Result of a query on an external database; partitioning options go to the source."""
    return spark.read.format("jdbc").options(url=url, query=query, **options).load()
