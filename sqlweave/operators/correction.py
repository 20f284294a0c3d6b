"""Revision rounds and mining of (chosen, rejected) pairs from graded attempts."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sqlweave.functions.seeded import digest, digest_bucket
from sqlweave.operators.ranking import integer_bucket, position
from sqlweave.session import materialise

Grader = Callable[[DataFrame], DataFrame]
Generator = Callable[[DataFrame], DataFrame]


def concat_rounds(rounds: list[DataFrame]) -> DataFrame:
    """Rows of all rounds, numbered by round."""
    numbered = [df.withColumn("round", F.lit(i)) for i, df in enumerate(rounds)]
    return reduce(lambda a, b: a.unionByName(b), numbered)


def revise(attempts: DataFrame, grade: Grader, generate: Generator, rounds: int) -> DataFrame:
    """Revision history (question_id, round, sql_pred, error_msg), the last prediction included.

    `grade` adds res and error_msg; `generate` takes the wrong rows and returns new
    sql_pred for them. Only wrong rows go on to the next round, and it ends when none
    is left. Every round is written out, so the plan does not grow.
    """
    history: list[DataFrame] = []
    current = attempts
    for number in range(rounds):
        graded = materialise(grade(current))
        history.append(graded.select("question_id", F.lit(number).alias("round"), "sql_pred", "error_msg"))
        wrong = graded.filter(F.col("res") == 0)
        if wrong.isEmpty():
            break
        current = materialise(generate(wrong))
    else:
        unseen = F.lit(None).cast("string").alias("error_msg")
        history.append(current.select("question_id", F.lit(rounds).alias("round"), "sql_pred", unseen))
    return reduce(lambda a, b: a.unionByName(b), history)


def last_prediction(history: DataFrame) -> DataFrame:
    """The prediction of each question's last round."""
    return history.groupBy("question_id").agg(
        F.max_by("sql_pred", "round").alias("sql_pred"), F.max("round").alias("round")
    )


def history_lines(history: DataFrame) -> DataFrame:
    """Each question's rounds as consecutive steps with the message that led to the next one."""
    bucket = integer_bucket(F.col("round"))
    return position(history, ["question_id"], [F.col("round")], bucket, "step", total="n_steps")


def merge_revised(first: DataFrame, revised: DataFrame) -> DataFrame:
    """First-pass correct rows together with the revised ones."""
    return first.filter(F.col("res") == 1).unionByName(revised)


def mine_pairs(attempts: DataFrame, seed: str = "pairs") -> DataFrame:
    """Chosen and rejected SQL per question from graded attempts.

    `attempts(question_id, attempt_id, sql_gt, sql_pred, res)`. No wrong attempt: nothing.
    All wrong, or one wrong: the wrong ones against the gold. More wrong than right:
    min(wrong - right, right) sampled wrong ones against the first correct predictions.
    Otherwise the wrong ones in order against sampled correct predictions, the last one
    against the gold. Both sides are numbered in buckets, so a question with a huge
    number of attempts is spread over tasks; they meet by an equi-join on number.
    """
    counts = attempts.groupBy("question_id").agg(
        F.sum(F.when(F.col("res") == 0, 1).otherwise(0)).alias("w"),
        F.sum(F.when(F.col("res") == 1, 1).otherwise(0)).alias("r"),
    )
    more_wrong = (F.col("w") > F.col("r")) & (F.col("r") >= 1) & (F.col("w") > 1)
    mixed = (F.col("w") >= 2) & (F.col("w") <= F.col("r"))
    n = F.when(more_wrong, F.least(F.col("w") - F.col("r"), "r")).when(mixed, F.col("w") - 1).otherwise(0)
    staged = (
        attempts.join(counts.filter("w > 0"), "question_id")
        .withColumn("by_seed", F.when(F.col("res") == 0, more_wrong).otherwise(mixed))
        .withColumn("n", n)
        .withColumn("__digest", digest(seed, F.col("attempt_id")))
    )
    bucket = F.when(F.col("by_seed"), digest_bucket(F.col("__digest"))).otherwise(
        integer_bucket(F.col("attempt_id"))
    )
    order = [F.when(F.col("by_seed"), F.col("__digest")), F.col("attempt_id")]
    numbered = position(staged, ["question_id", "res"], order, bucket, "number")
    right = numbered.filter((F.col("res") == 1) & (F.col("number") <= F.col("n"))).select(
        "question_id", "number", F.col("sql_pred").alias("better")
    )
    wrong = numbered.filter(F.col("res") == 0).filter(~more_wrong | (F.col("number") <= F.col("n")))
    paired = wrong.join(right, ["question_id", "number"], "left")
    return (
        paired.select("question_id", F.coalesce("better", "sql_gt").alias("chosen"), F.col("sql_pred").alias("rejected"))
        .filter(F.col("chosen") != F.col("rejected"))
        .distinct()
    )


def drop_bookkeeping(attempts: DataFrame, ordered_family: bool = False, revised: bool = False) -> DataFrame:
    """Drop the columns a finished training file does not carry."""
    extra = ["pre_sql_gt", "pre_sql_pred"] if ordered_family else []
    extra += ["history_pred", "history_error"] if revised else []
    return attempts.drop("question_id", "error", "timeout", *extra)


def unwrap(attempts: DataFrame) -> DataFrame:
    """First candidate in place of a candidate list; pairs of equal texts go."""
    single = attempts.withColumn("sql_pred", F.try_element_at("sql_pred", F.lit(1)))
    return single.filter(F.col("sql_gt") != F.col("sql_pred"))
