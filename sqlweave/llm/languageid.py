"""Language identification with bit-sliced Bloom filters of character n-grams."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqlweave.llm.columns import carried, quoted
from sqlweave.session import materialise

UNDETERMINED = "und"
SIZES = (3, 4)
_NOT_LETTERS = regex.compile(r"\P{L}+")
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


@dataclass(frozen=True)
class Settings:
    """Parameters of the filters. `sample_docs` bounds the labelled rows learned from per language."""

    sample_docs: int = 2000
    slot_bits: int = 21
    hashes: int = 3
    #: An n-gram belongs to a language when its rate there is at least this part of its highest rate.
    rate_part: float = 0.125
    min_count: int = 2

    def slots(self, grams: np.ndarray) -> list[np.ndarray]:
        mask = np.uint64((1 << self.slot_bits) - 1)
        return [(grams >> np.uint64(k * (64 - self.slot_bits) // (self.hashes - 1)) & mask).astype(np.int64) for k in range(self.hashes)]


@dataclass(frozen=True)
class Filters:
    """Filters of all languages: bit l % 64 of `slices[l // 64][slot]` belongs to language l."""

    settings: Settings
    languages: list[str]
    slices: np.ndarray
    #: Share of n-grams in no language that each language's filter holds all the same.
    false_rates: np.ndarray

    def predict(self, text: str | None) -> tuple[str, float]:
        """The likeliest language and the share of n-grams its filter truly holds.

        The AND of a gram's slots names all languages that contain it at once. Each language's
        hits h out of n are corrected to (h/n - f) / (1 - f) for its false-positive rate f.
        """
        grams = ngrams(text)
        if not len(grams) or not self.languages:
            return UNDETERMINED, 0.0
        hits = np.zeros(len(self.languages), np.int64)
        for start in range(0, len(grams), 1 << 16):
            slots = self.settings.slots(grams[start : start + (1 << 16)])
            for word, table in enumerate(self.slices):
                masks = table[slots[0]]
                for s in slots[1:]:
                    masks = masks & table[s]
                for bit in range(min(64, len(self.languages) - 64 * word)):
                    hits[64 * word + bit] += np.count_nonzero(masks & np.uint64(1 << bit))
        rates = np.clip((hits / len(grams) - self.false_rates) / np.maximum(1 - self.false_rates, 1e-9), 0.0, 1.0)
        best = int(np.argmax(rates))  # the first of equals: languages are sorted
        return self.languages[best], float(rates[best])


def ngrams(text: str | None) -> np.ndarray:
    """64-bit hashes of all n-grams of lower-cased letters, words set apart by one space."""
    letters = _NOT_LETTERS.sub(" ", (text or "").lower()).strip()
    if not letters:
        return np.empty(0, np.uint64)
    points = np.frombuffer(f" {letters} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    found = []
    for size in SIZES:
        if len(points) >= size:
            mixed = np.full(len(points) - size + 1, size, np.uint64)
            for k in range(size):
                mixed += points[k : len(points) - size + 1 + k] * _MULTIPLIERS[k]
                mixed ^= mixed >> np.uint64(29)
            mixed *= np.uint64(0xBF58476D1CE4E5B9)
            mixed ^= mixed >> np.uint64(32)
            found.append(mixed)
    return np.concatenate(found)


def _together(texts: Iterable[str], most: int = 1 << 20) -> Iterator[list[str]]:
    """Lists of whole texts, each closed by the text that brings it to `most` characters."""
    some, size = [], 0
    for text in texts:
        some.append(text)
        size += len(text)
        if size >= most:
            yield some
            some, size = [], 0
    if some:
        yield some


def train(labelled: DataFrame, settings: Settings = Settings()) -> Filters:
    """Filters from rows (doc_id, text, lang); rows with a null in text or lang teach nothing.

    Of each language about `settings.sample_docs` rows are used, chosen by a hash of the row.
    n-grams are counted per language in Spark; slots of the filters are or-ed together there, so
    the driver holds one word per slot and 64 languages.
    """
    usable = labelled.filter(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    # One row per language, so that sampling shuffles no texts by language.
    sizes = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    shares = labelled.sparkSession.createDataFrame([(k, settings.sample_docs / n) for k, n in sizes.items()], "lang string, share double")
    place = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 11) / float(1 << 53)
    sample = (
        usable.join(shares, "lang").filter(place < F.col("share")).select("lang", "text").distinct()
    )

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                for some in _together(texts):
                    grams, n = np.unique(np.concatenate([ngrams(t) for t in some]), return_counts=True)
                    yield pd.DataFrame({"lang": lang, "gram": grams.view(np.int64), "n": n})

    counts = materialise(sample.mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    rated = counts.join(totals, "lang").withColumn("rate", F.col("n") / F.col("total"))
    peaks = rated.groupBy("gram").agg(F.max("rate").alias("peak"))
    typical = rated.join(peaks, "gram").filter((F.col("rate") >= settings.rate_part * F.col("peak")) & (F.col("n") >= settings.min_count))
    languages = sorted(sizes)
    words = max(1, -(-len(languages) // 64))
    slices = np.zeros((words, 1 << settings.slot_bits), np.uint64)
    if languages:
        numbered = typical.join(labelled.sparkSession.createDataFrame(list(zip(languages, range(len(languages)))), "lang string, number int"), "lang")
        bit = F.expr("shiftleft(1L, number % 64)")
        slots = [F.shiftrightunsigned("gram", k * (64 - settings.slot_bits) // (settings.hashes - 1)).bitwiseAND(F.lit((1 << settings.slot_bits) - 1)) for k in range(settings.hashes)]
        table = (
            numbered.select(F.floor(F.col("number") / 64).cast("int").alias("word"), bit.alias("bit"), F.explode(F.array(*slots)).alias("slot"))
            .groupBy("word", "slot").agg(F.bit_or("bit").alias("mask")).toPandas()
        )
        slices[table["word"].to_numpy(), table["slot"].to_numpy()] = table["mask"].to_numpy(np.int64).view(np.uint64)
    fill = np.array([np.count_nonzero(slices[i // 64] & np.uint64(1 << i % 64)) for i in range(len(languages))]) / slices.shape[1]
    return Filters(settings, languages, slices, fill**settings.hashes)


def identify(documents: DataFrame, filters: Filters, text: str = "text") -> DataFrame:
    """Add lang_pred and score to every row; only `text` is looked at.

    A null text, or one without a letter, is `und` with score 0; so is everything when nothing
    was learned. Equal scores go to the language that sorts first, and repeated rows are judged alike.
    Columns of the two names are replaced, others stay whatever they are called; an empty table gives
    an empty result.
    """
    inward, outward = carried(documents, ("lang_pred", "score"))
    held = documents.sparkSession.sparkContext.broadcast(filters)

    @F.pandas_udf("lang_pred string, score double")
    def predicted(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([held.value.predict(t) for t in texts], columns=["lang_pred", "score"])

    # Else a later filter on the prediction would run it a second time, in a second Python worker.
    predicted = predicted.asNondeterministic()
    return documents.select(*inward, predicted(F.col(quoted(text)).cast("string")).alias("told")).select(*outward, "told.lang_pred", "told.score")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's text, modulo `folds`; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds
