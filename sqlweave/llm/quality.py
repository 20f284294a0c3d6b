"""Quality classifier: logistic regression on hashed word n-grams, trained with FTRL."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqlweave.llm.columns import carried, quoted
from sqlweave.session import materialise

_TOKENS = re.compile(r"\w+|[^\w\s]+")


@dataclass(frozen=True)
class Settings:
    """Parameters of the model. `sample_docs` bounds the labelled rows learned from."""

    sample_docs: int = 16000
    shards: int = 4
    epochs: int = 3
    dim_bits: int = 20
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.1


def features(text: str | None, dim_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices and weights of a text's hashed words and word pairs, scaled to length 1.

    Runs of letters and digits and runs of other signs are words, case kept. Index 0 is the
    constant term, which every text has.
    """
    words = _TOKENS.findall(text or "")
    mask = (1 << dim_bits) - 1
    hashes = np.fromiter((crc32(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words))
    pairs = (hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ hashes[1:] * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(24)
    spread = (hashes * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(20)
    index, n = np.unique((np.concatenate([spread, pairs]) & np.uint64(mask)).astype(np.int64), return_counts=True)
    index, n = index[index > 0], n[index > 0].astype(float)
    weight = n / np.sqrt((n * n).sum()) if len(n) else n
    return np.concatenate([[0], index]).astype(np.int64), np.concatenate([[1.0], weight])


class Ftrl:
    """Follow-the-regularised-leader with per-coordinate rates; weights are derived when used."""

    def __init__(self, settings: Settings) -> None:
        self.s = settings
        self.z = np.zeros(1 << settings.dim_bits)
        self.n = np.zeros(1 << settings.dim_bits)

    def weights(self, index: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[index], self.n[index]
        shrunk = np.sign(z) * self.s.l1 - z
        return np.where(np.abs(z) <= self.s.l1, 0.0, shrunk / ((self.s.beta + np.sqrt(n)) / self.s.alpha + self.s.l2))

    def learn(self, index: np.ndarray, value: np.ndarray, label: float) -> None:
        w = self.weights(index)
        gradient = (logistic(w @ value) - label) * value
        n = self.n[index]
        grown = n + gradient * gradient
        self.z[index] += gradient - (np.sqrt(grown) - np.sqrt(n)) / self.s.alpha * w
        self.n[index] = grown


def logistic(x: float) -> float:
    return float(1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0))))


def _order() -> Column:
    return F.xxhash64("doc_id", "text")


def sample_labelled(documents: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, text, quality) of the `sample_docs` labelled documents whose hash is smallest.

    Hashes and labels are joined without texts; the chosen hashes, at most `sample_docs` of them, are broadcast
    to where the texts are read, so no other text moves. Null labels do not count, and of several for one
    document the largest does.
    """
    marked = labels.filter(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    hashed = documents.select("doc_id", _order().alias("h"))
    chosen = materialise(hashed.join(marked, "doc_id").groupBy("h").agg(F.min("quality").alias("quality")).orderBy("h").limit(settings.sample_docs))
    source = documents.select("doc_id", "text", _order().alias("h"))
    return source.join(F.broadcast(chosen), "h").select("doc_id", "text", "quality")


def train(labelled: DataFrame, settings: Settings = Settings()) -> np.ndarray:
    """Weights from rows (doc_id, text, quality); rows with a null quality teach nothing.

    The `sample_docs` rows whose hash is smallest are learned from, dealt to `shards` learners
    that see their rows in a fixed order `epochs` times; the learners' weights are averaged in
    Spark. The weight table has 2^dim_bits entries whatever the corpus. Repeated rows teach once, and
    no rows give weights of zero.
    """
    usable = labelled.filter(F.col("quality").isNotNull()).select(_order().alias("h"), "text", F.col("quality").cast("double").alias("label"))
    shard = F.pmod("h", F.lit(settings.shards)).alias("shard")
    once = materialise(usable.groupBy("h").agg(F.min("text").alias("text"), F.max("label").alias("label")).select("h", shard, "text", "label"))
    # One number: the largest hash of those learned from.
    last = once.select("h").orderBy("h").limit(settings.sample_docs).agg(F.max("h")).first()[0]
    sample = once.filter(F.col("h") <= F.lit(last))

    def learn(_: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        model = Ftrl(settings)
        ordered = rows.sort_values("h")
        made = [features(t, settings.dim_bits) for t in ordered["text"]]
        for _ in range(settings.epochs):
            for (index, value), label in zip(made, ordered["label"]):
                model.learn(index, value, label)
        weights = model.weights(slice(None))
        used = np.flatnonzero(weights)
        return pd.DataFrame({"at": used, "weight": weights[used]})

    parts = sample.groupBy("shard").applyInPandas(learn, "at long, weight double")
    shards = max(1, sample.select("shard").distinct().count())
    table = parts.groupBy("at").agg(F.sum("weight").alias("weight")).toPandas()
    weights = np.zeros(1 << settings.dim_bits)
    weights[table["at"].to_numpy(np.int64)] = table["weight"].to_numpy() / shards
    return weights.astype(np.float32)


def score_quality(documents: DataFrame, weights: np.ndarray, text: str = "text") -> DataFrame:
    """Add score (0 to 1) and predicted (1 from 0.5 on) to every row; only `text` is looked at.

    A null or empty text is scored by the constant term alone, and hashes that tie share one weight.
    Repeated rows are scored alike. Columns of the two names are replaced, others stay whatever they are
    called; an empty table gives an empty result.
    """
    inward, outward = carried(documents, ("score", "predicted"))
    held = documents.sparkSession.sparkContext.broadcast(weights)
    dim_bits = len(weights).bit_length() - 1

    def score(text: str | None) -> float:
        index, value = features(text, dim_bits)
        return logistic(float(held.value[index].astype(float) @ value))

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series([score(t) for t in texts], dtype=float)

    made = documents.select(*inward, scored(F.col(quoted(text)).cast("string")).alias("score"))
    return made.select(*outward, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
