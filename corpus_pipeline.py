"""Corpus pipeline: language ID, near-dedup, decontamination, source mixing, token files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlweave.llm import decontaminate, languageid, mixture, simhash, tokenfiles
from sqlweave.llm.queries import VOCABULARY, predicted_languages
from sqlweave.session import load, materialise

# Share of a document's n-grams that its predicted language must know.
MIN_LANGUAGE_SCORE = 0.2

# Near copies share this part of their distinct shingles of so many words.
NEAR_WORDS, NEAR_SIMILARITY = 5, 0.8


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language, with `lang` set to the prediction.

    Texts that are null, have no letter, or whose n-grams are mostly in no language go.
    """
    judged = predicted_languages(docs)
    clear = (F.col("lang_pred") != languageid.UNDETERMINED) & (F.col("score") >= MIN_LANGUAGE_SCORE)
    return judged.filter(clear).withColumn("lang", F.col("lang_pred")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest doc_id.

    Texts are near-duplicates over links of NEAR_SIMILARITY or more of their distinct shingles.
    Null ids come last, and of repeated rows one stays.
    """
    return simhash.keep_first(docs, NEAR_WORDS, NEAR_SIMILARITY)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window."""
    judged = decontaminate.find_overlaps(docs, load(spark, sf_dir, "benchmark"))
    return judged.filter(~F.col("contaminated")).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice."""
    mixed = mixture.mix_sources(docs)
    times = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(F.lit(1)).cast("int")
    repeated = mixed.filter(times > 0).withColumn("__turn", F.explode(F.sequence(F.lit(1), times)))
    return repeated.select(*docs.columns)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all documents, and what reading them back gives for each."""
    return tokenfiles.tokenise(docs, VOCABULARY)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("mixture", mix),
    ("token_files", write_tokens),
]

# Language models and token ids cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES, start=1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = materialise(docs)
    return docs
