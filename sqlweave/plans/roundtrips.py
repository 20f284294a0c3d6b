"""Registered queries that write files of the engine's formats and read them back."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sqlweave.operators.catalog import flatten_columns
from sqlweave.plans.bindings import CATALOG_SQL, catalog, questions
from sqlweave.session import load, scratch_path
from sqlweave.sources import readers, writers


def catalog_round_trip(spark, sf):
    """Every database's catalog as one JSON entry; its first column is the primary key."""
    columns = F.array_sort(F.collect_list(F.struct("table_name", "column_name", "display_name", "type")))
    nested = catalog(spark, sf).groupBy("db_id").agg(columns.alias("c"))
    tables = F.array_distinct(F.transform("c", lambda c: c["table_name"]))

    def indexed(name: str):
        def entry(c):
            return F.array((F.array_position("tables", c["table_name"]) - 1).cast("string"), c[name])

        return F.concat(F.array(F.array(F.lit("-1"), F.lit("*"))), F.transform("c", entry))

    entries = nested.withColumn("tables", tables).select(
        "db_id",
        F.col("tables").alias("table_names_original"),
        indexed("column_name").alias("column_names_original"),
        indexed("display_name").alias("column_names"),
        F.concat(F.array(F.lit("text")), F.transform("c", lambda c: c["type"])).alias("column_types"),
        F.array(F.lit("1")).alias("primary_keys"),
        F.expr("cast(array() as array<array<int>>)").alias("foreign_keys"),
    )
    path = scratch_path(spark)
    writers.write_json(entries, path)
    return flatten_columns(readers.read_catalogs(spark, path, lines=True))


def training_round_trip(spark, sf):
    """Every question as a training row whose `column` entry is nested JSON."""
    asked = questions(spark, sf)
    described = F.struct(F.concat(F.lit("K"), "k").alias("name"), F.struct(F.col("k").alias("key")).alias("about"))
    rows = asked.select(
        "question_id", "db_id", "question", "evidence", F.col("sql").alias("sql_gt"),
        F.array("event_type").alias("table"), F.array(described).alias("column"),
        F.array(F.concat("event_type", F.lit(".K"), "k")).alias("foreign_keys"),
        F.when(F.col("k") % 2 == 0, "simple").alias("difficulty"),
    )
    path = scratch_path(spark)
    writers.write_json(rows, path)
    return readers.read_training(spark, path, lines=True).select(
        "question_id", "db_id", "question", "sql_gt", "column", "difficulty",
        F.col("table")[0].alias("first_table"), F.col("foreign_keys")[0].alias("first_key"),
    )


def schema_round_trip(spark, sf):
    """Tables with their columns as schema JSON: in how many databases each column stands."""
    columns = F.collect_list(F.struct("column_name"))
    tables = catalog(spark, sf).groupBy("db_id", F.col("table_name").alias("table")).agg(columns.alias("col_data"))
    path = scratch_path(spark)
    writers.write_json(tables.drop("db_id"), path)
    found = readers.read_schema_json(spark, path, lines=True)
    return found.groupBy("table_name", "column_name").agg(F.count(F.lit(1)).alias("databases"))


def session_round_trip(spark, sf):
    """Conversations as session files: a line per turn, a blank line after the last one.

    A turn's number is its place in the conversation; `turns` counts its session.
    """
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x00-\x20]+", " ")
    after = Window.partitionBy("conv_id").orderBy("turn")
    last = F.lead("turn").over(after).isNull()
    line = F.concat(F.lit("say "), text, F.lit("\t"), "conv_id", F.when(last, "\n").otherwise(""))
    lines = load(spark, sf, "conversations").withColumn("value", line)
    path = scratch_path(spark)
    lines.repartitionByRange("conv_id").sortWithinPartitions("conv_id", "turn").select("value").write.text(path)
    told = readers.read_sessions(spark, path)
    turns = F.count(F.lit(1)).over(Window.partitionBy("file", "session_id"))
    return told.select("db_id", "turn", "sql", turns.alias("turns"))


def vector_round_trip(spark, sf):
    """Vectors in one folder per label, read back label by label."""
    path = scratch_path(spark)
    writers.write_vectors(load(spark, sf, "embeddings"), path, "label")
    return writers.read_vectors(spark, path).select(
        "vec_id", "label", F.size("embedding").alias("dims"), F.get("embedding", F.lit(0)).cast("double").alias("head")
    )


QUERIES = {
    "catalog_round_trip": (
        catalog_round_trip,
        f"""with {CATALOG_SQL}, p as (select *, row_number() over (partition by db_id
        order by table_name, column_name, display_name, "type")::int col_idx from cat)
        select db_id, col_idx, table_name, column_name, display_name, "type", col_idx = 1 is_pk from p""",
    ),
    "training_round_trip": (
        training_round_trip,
        f"""with {CATALOG_SQL} select event_id question_id, 'db_' || user_id db_id,
        'How many ' || event_type || ' events have key ' || k || '?' question,
        'SELECT T1.K' || k || ', K' || (k + 1) || ' FROM ' || upper(event_type) || ' AS T1 WHERE T1.K' || k || ' > '
        || trunc(round(value))::int || ' AND name = ''K' || (k + 3) || ' from view'' ORDER BY K' || (k - 1) sql_gt,
        '[{{"name":"K' || k || '","about":{{"key":' || k || '}}}}]' "column",
        case when k % 2 = 0 then 'simple' end difficulty, event_type first_table, event_type || '.K' || k first_key from ev""",
    ),
    "schema_round_trip": (
        schema_round_trip,
        f"""with {CATALOG_SQL} select lower(table_name) table_name, lower(column_name) column_name, count(*) databases
        from cat group by 1, 2""",
    ),
    "session_round_trip": (
        session_round_trip,
        r"""select conv_id::varchar db_id, row_number() over (partition by conv_id order by turn) turn,
        'say ' || regexp_replace(coalesce(text, ''), '[\x00-\x20]+', ' ', 'g') "sql",
        count(*) over (partition by conv_id) turns from conversations""",
    ),
    "vector_round_trip": (
        vector_round_trip,
        """select vec_id, label, len(embedding)::int dims, embedding[1]::double head from embeddings""",
    ),
}
