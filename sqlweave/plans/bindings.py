"""Catalogs and questions that Spark derives from the given tables.

A user of `events` stands for a database, an event type for a table and a key of
`props` for a column; every event asks a question of its user's database.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlweave.operators.ranking import STRIDES
from sqlweave.session import load, spread


def keyed_events(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "events").select(
        "event_id", "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k")
    )


def catalog(spark: SparkSession, sf: str) -> DataFrame:
    """One row per column of every database, with its description fields."""
    seen = keyed_events(spark, sf).groupBy("user_id", "event_type", "k").agg(
        F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi")
    )
    return seen.select(
        F.concat(F.lit("db_"), "user_id").alias("db_id"),
        F.initcap("event_type").alias("table_name"),
        F.concat(F.lit("K"), "k").alias("column_name"),
        F.concat_ws(".", "user_id", "event_type", "k").alias("doc_id"),
        F.concat(F.lit("key "), "k").alias("display_name"),
        F.when(F.col("k") % 3 == 0, "text").when(F.col("k") % 3 == 1, "integer").otherwise("real").alias("type"),
        F.when(F.col("n") > 1, F.concat(F.lit("seen "), "n", F.lit(" times"))).otherwise("").alias(
            "column_description"
        ),
        F.when(F.col("k") % 2 == 0, F.concat(F.lit("Not Useful, up to key "), "k")).otherwise("").alias(
            "value_description"
        ),
        F.array_distinct(F.array(F.col("lo").cast("string"), F.col("hi").cast("string"))).alias("values"),
        "user_id",
        "event_type",
        "k",
        "n",
    )


CATALOG_SQL = """
seen as (select user_id, event_type, json_extract_string(props, '$.k')::int k, count(*) n,
                min(value) lo, max(value) hi from events group by all),
cat as (select 'db_' || user_id db_id, upper(event_type[1]) || event_type[2:] table_name, 'K' || k column_name,
               user_id || '.' || event_type || '.' || k doc_id, 'key ' || k display_name,
               case k % 3 when 0 then 'text' when 1 then 'integer' else 'real' end "type",
               case when n > 1 then 'seen ' || n || ' times' else '' end column_description,
               case when k % 2 = 0 then 'Not Useful, up to key ' || k else '' end value_description,
               case when lo = hi then [lo::varchar] else [lo::varchar, hi::varchar] end "values",
               user_id, event_type, k, n from seen),
ev as (select event_id, user_id, event_type, value, json_extract_string(props, '$.k')::int k from events)
"""


def questions(spark: SparkSession, sf: str) -> DataFrame:
    """One question per event. Its SQL names one column with an alias and two without."""
    events = spread(keyed_events(spark, sf))

    def column(shift: int):
        return F.concat(F.lit("K"), F.col("k") + shift)

    return events.select(
        F.col("event_id").alias("question_id"),
        F.concat(F.lit("db_"), "user_id").alias("db_id"),
        F.concat(F.lit("How many "), "event_type", F.lit(" events have key "), "k", F.lit("?")).alias("question"),
        F.when(F.col("k") % 2 == 0, F.concat(F.lit("key "), "k", F.lit(" means "), "event_type"))
        .otherwise("")
        .alias("evidence"),
        F.concat(
            F.lit("SELECT T1."), column(0), F.lit(", "), column(1), F.lit(" FROM "), F.upper("event_type"),
            F.lit(" AS T1 WHERE T1."), column(0), F.lit(" > "), F.round("value").cast("int"),
            F.lit(" AND name = 'K"), F.col("k") + 3, F.lit(" from view' ORDER BY "), column(-1),
        ).alias("sql"),
        "user_id",
        "event_type",
        "k",
    )


# Links of a question: its own column, and the next and previous key of the same table where they exist.
LINKS_SQL = """
links as (select e.event_id question_id, c.doc_id, c.table_name, c.column_name, c.db_id from ev e join cat c
          on c.user_id = e.user_id and c.event_type = e.event_type and c.k in (e.k - 1, e.k, e.k + 1))
"""


def stride_sql(digest: str, size: str) -> str:
    """The seeded stride of a ring sample; `digest` and `size` are SQL expressions."""
    usable = f"[p for p in {STRIDES} if {size} % p <> 0]"
    return f"({usable})[1 + ('0x' || substr({digest}, 9, 4))::bigint % len({usable})]"
