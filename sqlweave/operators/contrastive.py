"""Positive and negative columns of a question, and the contrastive score over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sqlweave.operators.ranking import ring_sample

# Score parameters.
TEMPERATURE = 0.07
HARD_MARGIN = 0.1


def split_counts(questions: DataFrame, documents: DataFrame, links: DataFrame) -> DataFrame:
    """How many of its database's documents a question uses, and how many it does not.

    `links(question_id, doc_id)` are the used ones. Negatives are what is left of the
    database, so they are counted and never listed per question.
    """
    held = documents.groupBy("db_id").agg(F.count(F.lit(1)).alias("n_documents"))
    used = links.groupBy("question_id").agg(F.count(F.lit(1)).alias("n_positive"))
    return (
        questions.select("question_id", "db_id")
        .join(used, "question_id", "left")
        .join(held, "db_id", "left")
        .select(
            "question_id",
            "db_id",
            F.coalesce("n_positive", F.lit(0)).alias("n_positive"),
            (F.coalesce("n_documents", F.lit(0)) - F.coalesce("n_positive", F.lit(0))).alias("n_negative"),
        )
    )


def training_rows(questions: DataFrame, links: DataFrame) -> DataFrame:
    """One row per question and positive document. Negatives stay a property of the database."""
    return questions.join(links, "question_id")


def sample_negatives(
    rows: DataFrame, documents: DataFrame, links: DataFrame, limit: int, seed: str = "negatives"
) -> DataFrame:
    """At most `limit` documents of the database that the row's question does not use.

    Rows (question_id, db_id, doc_id = the positive) walk their database's seeded ring, by as
    many extra places as the question has positives, so enough are left after those are struck out.
    """
    used = links.groupBy("question_id").agg(F.count(F.lit(1)).alias("n_used"))
    keys = ["question_id", "db_id", "positive"]
    # A row that comes several times takes each negative as often, and `limit` in all.
    copies = rows.select("question_id", "db_id", F.col("doc_id").alias("positive")).groupBy(*keys).agg(F.count(F.lit(1)).alias("times"))
    asked = copies.join(used, "question_id")
    taken = ring_sample(
        asked, documents, "db_id", ["question_id", "positive"], ["doc_id"], F.lit(limit) + F.col("n_used"), seed,
        struck=links, keep=F.lit(limit),
    )
    before = (F.col("turn") - 1) * F.col("times")
    ranks = F.sequence(before + 1, F.least(F.col("turn") * F.col("times"), F.lit(limit).cast("long")))
    return taken.filter(before < limit).select(
        "question_id", "positive", F.col("doc_id").alias("negative"), F.explode(F.transform(ranks, lambda n: n.cast("int"))).alias("neg_rank")
    )


def hard_negatives(scored: DataFrame, margin: float = HARD_MARGIN) -> DataFrame:
    """Negatives at least as close as the positive minus `margin`; if a row has none,
    its closest one.

    `scored(row_id, negative, pos_sim, neg_sim)` holds the sampled negatives of a row.
    """
    hardest = F.row_number().over(
        Window.partitionBy("row_id").orderBy(F.desc("neg_sim"), "negative")
    )
    return (
        scored.withColumn("hardness", hardest)
        .filter((F.col("neg_sim") >= F.col("pos_sim") - margin) | (F.col("hardness") == 1))
        .drop("hardness")
    )


def contrastive_score(
    scored: DataFrame, hard_only: bool = False, temperature: float = TEMPERATURE, margin: float = HARD_MARGIN
) -> DataFrame:
    """Score of each row: log(1 + sum exp((neg - pos) / t)), the log-sum-exp of positive
    and negatives less the positive.

    Similarities lie in [-1, 1], so measuring from the positive keeps every exponent
    small, and one grouped sum is enough.
    """

    def pull(sim: Column) -> Column:
        return F.exp((sim - F.col("pos_sim")) / temperature)

    kept = F.col("neg_sim") >= F.col("pos_sim") - margin
    everything = F.sum(pull(F.col("neg_sim")))
    hard = F.coalesce(F.sum(F.when(kept, pull(F.col("neg_sim")))), F.max(pull(F.col("neg_sim"))))
    return scored.groupBy("row_id").agg(F.log1p(hard if hard_only else everything).alias("loss"))
