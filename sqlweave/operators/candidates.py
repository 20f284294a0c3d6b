"""Run the candidates of predicted queries until one gives the gold result, on one database or a suite of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sqlweave.functions import text as T
from sqlweave.operators import denotation as D
from sqlweave.operators import slots
from sqlweave.operators.execution import run_statements
from sqlweave.session import materialise


def first_passing(
    queries: DataFrame, databases: DataFrame | None = None, step: int = 2, widest: int = 64, ordered_family: bool = True, **options
) -> DataFrame:
    """(query_id, res, cand_idx, final_sql, tried, gold_failed) of every query.

    `queries(query_id, db_id, sql_gt, sql_pred)`. Candidates are the prediction and all fillings of its
    slots, in order. A candidate passes when its result equals the gold one on every database of
    its query; `databases(query_id, db_no, db_id)` lists these, and is the one of the query itself if not given.

    Gold statements run once per database and their results are kept. Queries without a passing candidate
    form a frontier: each round runs their next range of candidates, twice as long as the round before up
    to `widest`, on one database after the other; a candidate that fails on one is not run on the next, and
    a query leaves with its first passing candidate. So no filling is left out, and none is run once the
    answer is known. A candidate that raises an error or runs out of time does not pass. Where a gold
    statement fails, no candidate is run and `gold_failed` says so.

    `final_sql` is the passing candidate or else the prediction, `tried` the candidates run. Other options
    go to `run_statements`. The driver holds one row per statement while it runs, as there.
    """
    cleaned = materialise(queries.select(
        "query_id", "db_id",
        T.remove_distinct(T.join_operators(F.col("sql_gt"))).alias("sql_gt"),
        T.remove_distinct(T.join_operators(T.fill_placeholder(F.col("sql_pred")))).alias("sql_pred"),
    ))
    if databases is None:
        databases = cleaned.select("query_id", F.lit(0).alias("db_no"), "db_id")
    databases = materialise(databases.select("query_id", F.col("db_no").cast("int").alias("db_no"), "db_id"))
    ordered = D.order_matters(F.col("sql_gt")).alias("ordered")
    plan = materialise(slots.slot_plan(cleaned).join(cleaned.select("query_id", ordered), "query_id"))

    def run(statements: DataFrame, side: str) -> tuple[DataFrame, DataFrame]:
        """Results and status under `key`, one number per statement and database."""
        asked = statements.select(F.col("key").alias("query_id"), F.lit(side).alias("side"), "db_id", T.fix_current_year(F.col("sql")).alias("sql"))
        return run_statements(asked, **options)

    golds = materialise(
        databases.join(cleaned.select("query_id", F.col("sql_gt").alias("sql")), "query_id").withColumn("key", F.monotonically_increasing_id())
    )
    gold_results, gold_status = run(golds, D.GOLD)
    gold_results = gold_results.withColumnRenamed("query_id", "gold_key")
    sound = golds.join(gold_status.select(F.col("query_id").alias("key"), "ok"), "key").groupBy("query_id").agg(F.bool_and("ok").alias("ok"))
    sound = materialise(sound)
    numbers = [r["db_no"] for r in databases.select("db_no").distinct().orderBy("db_no").collect()]

    def matching(tried: DataFrame, number: int) -> DataFrame:
        """The candidates (query_id, cand_idx, sql) whose result on database `number` is the gold one; those without it stay."""
        here = golds.filter(F.col("db_no") == number).select("query_id", F.col("key").alias("gold_key"), "db_id")
        placed = materialise(tried.join(here, "query_id").withColumn("key", F.monotonically_increasing_id()))
        elsewhere = tried.join(here.select("query_id"), "query_id", "left_anti")
        if placed.isEmpty():
            return elsewhere
        results, status = run(placed, D.PRED)
        wanted = placed.select(F.col("key").alias("query_id"), "gold_key").join(gold_results, "gold_key").drop("gold_key")
        both = results.unionByName(wanted.select(*results.columns))
        asked = placed.join(plan.select("query_id", "ordered"), "query_id").select(F.col("key").alias("query_id"), "ordered")
        if ordered_family:
            equal = D.column_permutation_equal(both, asked).select("query_id", F.col("colperm_eq").alias("equal"))
        else:
            equal = D.set_equal(both, asked).select("query_id", F.col("set_eq").alias("equal"))
        passed = equal.join(status.filter("ok").select("query_id"), "query_id", "left_semi").filter("equal").select(F.col("query_id").alias("key"))
        return materialise(placed.join(passed, "key", "left_semi").select("query_id", "cand_idx", "sql").unionByName(elsewhere))

    found: list[DataFrame] = []
    done: list[DataFrame] = []
    first, size = 0, step
    frontier = materialise(plan.join(sound.filter("ok"), "query_id", "left_semi").select("query_id"))
    while not frontier.isEmpty():
        span = frontier.select("query_id", F.lit(first).cast("decimal(38,0)").alias("first"), F.lit(size).alias("number"))
        tried = materialise(slots.fillings_in(plan, span))
        if tried.isEmpty():
            break
        done.append(tried.groupBy("query_id").agg(F.count(F.lit(1)).alias("tried")))
        passing = reduce(matching, numbers, tried)
        best = materialise(passing.groupBy("query_id").agg(F.min(F.struct("cand_idx", "sql")).alias("best")).select("query_id", "best.*"))
        found.append(best)
        # Those asked for candidates that do not exist any more leave with what they have.
        frontier = materialise(frontier.join(tried.select("query_id").distinct(), "query_id", "left_semi").join(best, "query_id", "left_anti"))
        first, size = first + size, min(2 * size, widest)
    none = cleaned.limit(0)
    best = reduce(DataFrame.unionByName, found, none.select("query_id", F.lit(None).cast("decimal(38,0)").alias("cand_idx"), F.lit(None).cast("string").alias("sql")))
    tried = reduce(DataFrame.unionByName, done, none.select("query_id", F.lit(0).cast("long").alias("tried"))).groupBy("query_id").agg(F.sum("tried").alias("tried"))
    return cleaned.join(best, "query_id", "left").join(tried, "query_id", "left").join(sound, "query_id", "left").select(
        "query_id",
        F.col("cand_idx").isNotNull().cast("int").alias("res"),
        "cand_idx",
        F.coalesce("sql", "sql_pred").alias("final_sql"),
        F.coalesce("tried", F.lit(0)).alias("tried"),
        F.coalesce(~F.col("ok"), F.lit(False)).alias("gold_failed"),
    )
