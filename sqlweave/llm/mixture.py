"""Mixing sources to target weights by nested hash-threshold histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sqlweave.llm.columns import carried
from sqlweave.session import materialise

SPACE_WORDS = r"[^\x20\x09-\x0D]+"

# Each level of the histograms reads this many more bits of the hash; five levels use all 60.
LEVEL_BITS, LEVELS = 12, 5


def count_words(text: Column) -> Column:
    """Number of runs of anything but ASCII white space; 0 for null."""
    # A word ends where a non-space is followed by a space or the end.
    squeezed = F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_WORDS, "x")
    return F.length(F.translate(squeezed, "\t\n\u000b\f\r ", "")).cast("long")


def mixing_hash(doc_id: Column, text: Column) -> Column:
    """60 bits of the md5 of id and text: the same on every run, alike only for equal rows."""
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: list[int], share: float, most: float) -> DataFrame:
    """(source, source_size, target) of every source in `sizes` (source, source_size).

    Sources take `weights` in turn, by code point, null last. All targets together are `share`
    of all sizes; none is above `most` times its source's size, and what that cuts off goes to
    the others by weight, again and again. Each round is one aggregation that returns one row.
    """
    spark = sizes.sparkSession
    order = [F.col("source").isNull(), F.col("source")]
    # Number the sources in order: by range partitions, then by the counts before each partition.
    ranged = materialise(
        sizes.repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))
    )
    place = F.col("offset") + F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    turn = F.pmod(place, F.lit(len(weights))).cast("int") + 1
    weighed = materialise(
        ranged.join(offsets, "part").select(
            "source", "source_size", F.element_at(F.array(*[F.lit(w) for w in weights]), turn).cast("long").alias("weight")
        )
    )
    whole = weighed.agg(F.sum("source_size").alias("s"), F.sum("weight").alias("w")).first()
    total = share * (whole["s"] or 0)
    rate = total / whole["w"] if whole["w"] else 0.0
    cap = F.col("source_size") * F.lit(float(most))
    while True:
        full = F.col("weight") * F.lit(rate) >= cap
        free = weighed.agg(
            F.coalesce(F.sum(F.when(full, F.col("source_size"))), F.lit(0)).alias("capped"),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)).alias("open"),
        ).first()
        if not free["open"]:
            break
        risen = (total - most * free["capped"]) / free["open"]
        if risen <= rate:
            break
        rate = risen
    target = F.when(F.col("weight") * F.lit(rate) >= cap, cap).otherwise(F.col("weight") * F.lit(rate))
    return weighed.select("source", "source_size", target.cast("double").alias("target"))


def mix_sources(
    documents: DataFrame, weights: list[int] = (5, 2, 1), share: float = 1.5, most: float = 2.0
) -> DataFrame:
    """`documents` with size, source_size, target and taken, the words the mix takes of each row.

    A source with target t and size s takes every document floor(t / s) times, and once more
    those whose hash is under its threshold. Thresholds come from histograms: sizes are summed
    by source and hash bucket, the bucket in which the remaining budget ends is found, and only
    that bucket is divided further, down to single hashes. Nothing is sorted by document. The
    document at the boundary is taken when that brings the source nearer to its target.

    Null texts have size 0 and are taken as 0 words; a null source is a source of its own, last
    in order. Rows equal in id and text share a hash and are taken alike. Columns named size,
    source_size, target or taken are replaced, others stay whatever they are called. An empty table gives
    an empty result.
    """
    made = ("size", "source_size", "target", "taken")
    inward, outward = carried(documents, made)
    sized = documents.select(*inward, "source", count_words(F.col("text")).alias("size"), mixing_hash(F.col("doc_id"), F.col("text")).alias("hash"))
    slim = materialise(sized.select("source", "size", "hash"))
    totals = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = materialise(source_targets(totals, list(weights), share, most))
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    plan = materialise(
        targets.withColumn("times", times.cast("long"))
        .withColumn("left", F.col("target") - F.col("times") * F.col("source_size"))
        .withColumn("threshold", F.lit(0).cast("long"))
    )
    for level in range(1, LEVELS + 1):
        plan = materialise(_refine(slim, plan, level))
    extra = (F.col("hash") < F.col("p.threshold")).cast("long")
    source_key = F.col("d.source").eqNullSafe(F.col("p.source"))
    return (
        sized.alias("d")
        .join(plan.alias("p"), source_key, "left")
        .select(
            *outward,
            F.col("d.size").alias("size"),
            F.col("p.source_size").alias("source_size"),
            F.col("p.target").alias("target"),
            (F.col("d.size") * (F.col("p.times") + extra)).alias("taken"),
        )
    )


def _refine(slim: DataFrame, plan: DataFrame, level: int) -> DataFrame:
    """Move each source's threshold to the bucket of this level in which its budget ends.

    The budget `left` shrinks by the whole buckets below the new threshold. At the last level the
    bucket, which then is one hash, counts as below when that brings the sum nearer to the budget.
    """
    shift = 60 - LEVEL_BITS * level
    open_from = F.shiftright(F.col("hash"), shift + LEVEL_BITS) == F.shiftright(F.col("threshold"), shift + LEVEL_BITS)
    inside = slim.alias("d").join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")))
    if level > 1:
        inside = inside.filter(open_from)
    buckets = inside.groupBy(F.col("d.source").alias("source"), F.shiftright("hash", shift).alias("bucket")).agg(
        F.sum("size").alias("n")
    )
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = buckets.withColumn("upto", F.sum("n").over(upto))
    goal = F.col("upto") - F.col("n") / 2 if shift == 0 else F.col("upto")
    fits = goal <= F.col("left")
    found = (
        summed.alias("b")
        .join(plan.alias("p"), F.col("b.source").eqNullSafe(F.col("p.source")))
        .groupBy(F.col("b.source").alias("source"))
        .agg(
            F.max(F.when(fits, F.col("upto"))).alias("taken"),
            F.min(F.when(~fits, F.col("bucket"))).alias("next"),
            F.max("bucket").alias("last"),
        )
    )
    # Where all buckets fit, the threshold stands behind the last one and nothing stays open.
    bucket = F.coalesce("next", F.col("last") + 1)
    return (
        plan.alias("p")
        .join(found.alias("f"), F.col("p.source").eqNullSafe(F.col("f.source")), "left")
        .select(
            "p.source",
            "source_size",
            "target",
            "times",
            (F.col("left") - F.coalesce("taken", F.lit(0))).alias("left"),
            F.coalesce(F.shiftleft(bucket, shift), F.col("threshold")).alias("threshold"),
        )
    )
