"""Benchmark decontamination: prefix-filtered set join over windows of item size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sqlweave.llm.columns import carried
from sqlweave.session import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Words in a window, and words in a shingle (fewer where a window has fewer).
WINDOW, SHINGLE = 10, 3


def words_of(text: Column) -> Column:
    """Runs of digits, letters a-z (A-Z lower-cased) and anything beyond ASCII; none for null."""
    pieces = F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), NON_WORD, -1)
    return F.filter(pieces, lambda w: w != "")


def _windows(items: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """Distinct windows (window_id, words) and which items have them (window_id, item_id)."""
    worded = items.select("item_id", words_of(F.col("text")).alias("words")).filter(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - window + 1, F.lit(1)))
    cut = worded.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("words", i, window))).alias("words"))
    cut = materialise(cut.withColumn("window_id", F.md5(F.array_join("words", " "))))
    return cut.select("window_id", "words").distinct(), cut.filter("item_id is not null").select("window_id", "item_id").distinct()


def _shingles(words: Column, size: int) -> Column:
    """(size, at, token) of all shingles of `size` words; `at` counts words from 0."""
    last = F.size(words) - size
    hashed = lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(size)])
    starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.struct(F.lit(size).alias("size"), i.alias("at"), hashed(i).alias("token")))


def find_overlaps(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """`documents` with n_words, n_hit, n_items, items_sha256 and contaminated.

    A window is `window` consecutive words of an item; an item of fewer words, but not none, is
    one window. A document word inside any occurrence of a window is hit.

    Shingles are the tokens of a set join in which a window must be contained whole, so its
    necessary prefix is its one rarest shingle, by counts over all documents. Each spot of a document at
    which such a token stands carries the words around it; the token's place in the window bounds where
    the window can start and end there, and the words are compared one by one.

    Documents are told apart by the md5 of their text, so that copies, repeated rows and null
    ids do no harm. A null text has no words. Items with a null id mark words as hit but are not
    counted or listed; equal ids count once, and of equally rare shingles any serves. Without items,
    nothing is hit and items_sha256 is that of the empty string; no documents give no rows. Columns of
    the five names above are replaced, others stay whatever they are called.
    """
    inward, outward = carried(documents, ("n_words", "n_hit", "n_items", "items_sha256", "contaminated"))
    windows, owners = _windows(benchmark, window)
    windows = windows.withColumn("n", F.size("words")).withColumn("size", F.least("n", F.lit(SHINGLE)))
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())  # at most SHINGLE rows
    tokens = None
    for size in sizes:
        part = windows.filter(F.col("size") == size).select(
            "window_id", "words", "n", F.explode(_shingles(F.col("words"), size)).alias("s")
        )
        tokens = part if tokens is None else tokens.unionByName(part)
    key = F.unhex(F.md5(F.coalesce("text", F.lit(""))))
    keyed = documents.select(*inward, key.alias("key"), F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    no_hits = [F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"), F.lit("").alias("item_ids")]
    if tokens is None:
        joined = keyed.select("*", *no_hits)
    else:
        # Written, so that Spark sees how little of it there is, and moves no text where it can do without.
        joined = keyed.join(materialise(_found(documents, tokens, owners, sizes, window, key)), "key", "left")
    return joined.select(
        *outward,
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.sha2(F.coalesce("item_ids", F.lit("")), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def _found(documents: DataFrame, tokens: DataFrame, owners: DataFrame, sizes: list[int], window: int, key: Column) -> DataFrame:
    """(key, n_hit, n_items, item_ids) of the texts in which windows occur."""
    tokens = materialise(tokens.select("window_id", "words", "n", F.col("s.size").alias("size"), F.col("s.at").alias("offset"), F.col("s.token").alias("token")))
    known = materialise(tokens.select("size", "token").distinct())
    worded = documents.filter(F.col("text").isNotNull()).select(key.alias("key"), words_of(F.col("text")).alias("words"))
    shingled = F.concat(*[_shingles(F.col("words"), size) for size in sizes])
    every = worded.select("key", "words", F.explode(shingled).alias("x")).select("key", "words", "x.size", "x.at", "x.token")
    # A window that holds the token begins at most `before` words earlier, and ends `window` words later at most.
    before = F.least(F.col("at"), F.lit(window) - F.col("size"))
    around = F.array_join(F.slice("words", F.col("at") - before + 1, before + window), " ")
    spots = materialise(every.join(known, ["size", "token"]).select("key", "size", "token", "at", before.alias("before"), around.alias("around")))
    counts = spots.groupBy("size", "token").agg(F.count(F.lit(1)).alias("seen"))
    # Rarest first; tokens in no document make their windows impossible.
    ranked = tokens.join(counts, ["size", "token"], "left").groupBy("window_id").agg(
        F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), F.col("token"), F.col("offset"), F.col("size"), F.col("n"), F.col("words"))).alias("p")
    )
    prefixes = ranked.filter("p.seen > 0").select("window_id", "p.token", "p.offset", "p.size", "p.n", F.col("p.words").alias("wanted"))
    # Spots that start too early fall out here. A text may stand in many rows: its hits count once.
    first = F.col("before") - F.col("offset")
    fits = F.slice(F.split("around", " "), first + 1, F.col("n")) == F.col("wanted")
    hits = materialise(
        spots.join(materialise(prefixes), ["size", "token"])
        .filter(F.when(first >= 0, fits).otherwise(False))
        .select("key", "window_id", (F.col("at") - F.col("offset")).alias("start"), "n")
        .distinct()
    )
    end = F.col("start") + F.col("n")
    earlier = Window.partitionBy("key").orderBy("start", "n").rowsBetween(Window.unboundedPreceding, -1)
    fresh = end - F.greatest(F.col("start"), F.least(end, F.coalesce(F.max(end).over(earlier), F.lit(0))))
    covered = hits.select("key", "start", "n").distinct().withColumn("fresh", fresh)
    covered = covered.groupBy("key").agg(F.sum("fresh").cast("long").alias("n_hit"))
    listed = (
        hits.select("key", "window_id").distinct().join(owners, "window_id").select("key", "item_id").distinct()
        .groupBy("key").agg(F.array_sort(F.collect_list(F.col("item_id").cast("string"))).alias("ids"))
        .select("key", F.size("ids").cast("long").alias("n_items"), F.array_join("ids", ",").alias("item_ids"))
    )
    return covered.join(listed, "key", "left")
