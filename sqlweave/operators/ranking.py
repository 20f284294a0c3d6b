"""Positions, running totals and samples inside groups of any size.

A plain window puts a whole group into one task. Here each group is first cut
into buckets whose order follows the wanted order; only bucket sizes are summed
per group, and the fine order is worked out bucket by bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sqlweave.functions.seeded import digest, digest_bucket, digest_int
from sqlweave.session import materialise

# Rows of one key that share a bucket when the order is a dense integer.
BUCKET_WIDTH = 65536

# Members of a ring that are looked up together.
RING_PAGE = 1024

# Primes: one that does not divide a ring's size leads over all its places.
STRIDES = [p for p in range(10_007, 11_000, 2) if all(p % d for d in range(3, 105, 2))][:64]


def _group_key(keys: list[str]) -> Column:
    """One struct for the group, so that NULL keys meet each other in a plain equi-join and
    rows stay partitioned as the following window wants them."""
    return F.struct(*[F.col(k) for k in keys]) if keys else F.lit(0)


def integer_bucket(order: Column, width: int = BUCKET_WIDTH) -> Column:
    return F.floor(order / F.lit(width)).cast("long")


def position(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    bucket: Column,
    out: str = "pos",
    total: str | None = None,
) -> DataFrame:
    """1-based position of every row in its group, and optionally the group size.

    `bucket` must not decrease along `order`.
    """
    bucketed = df.withColumn("__key", _group_key(keys)).withColumn("__bucket", bucket)
    sizes = bucketed.groupBy("__key", "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("__key").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("__offset", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    if total:
        offsets = offsets.withColumn(total, F.sum("__n").over(Window.partitionBy("__key")))
    local = Window.partitionBy("__key", "__bucket").orderBy(*order)
    placed = bucketed.join(offsets.drop("__n"), ["__key", "__bucket"])
    return placed.withColumn(out, F.col("__offset") + F.row_number().over(local)).drop(
        "__key", "__bucket", "__offset"
    )


def seeded_position(
    df: DataFrame, keys: list[str], seed: str, parts: list[str], out: str = "pos", total: str | None = None
) -> DataFrame:
    """Position of every row in the md5-seeded order of its group."""
    hashed = df.withColumn("__digest", digest(seed, *[F.col(p) for p in parts]))
    order = [F.col("__digest"), *[F.col(p) for p in parts]]
    return position(hashed, keys, order, digest_bucket(F.col("__digest")), out, total).drop("__digest")


def running(
    df: DataFrame,
    keys: list[str],
    order: str,
    totals: dict[str, Column],
    latest: dict[str, Column] | None = None,
    width: int = BUCKET_WIDTH,
) -> DataFrame:
    """Running sums and running maxima along an integer order, inclusive of the row itself.

    `totals` names the summed expressions, `latest` the ones whose largest value so far is kept.
    """
    latest = latest or {}
    bucketed = df.withColumn("__key", _group_key(keys)).withColumn(
        "__bucket", integer_bucket(F.col(order), width)
    )
    sums = [F.sum(e).alias(f"__s_{n}") for n, e in totals.items()]
    maxima = [F.max(e).alias(f"__m_{n}") for n, e in latest.items()]
    per_bucket = bucketed.groupBy("__key", "__bucket").agg(*sums, *maxima)
    before = Window.partitionBy("__key").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select(
        "__key",
        "__bucket",
        *[F.coalesce(F.sum(f"__s_{n}").over(before), F.lit(0)).alias(f"__s_{n}") for n in totals],
        *[F.max(f"__m_{n}").over(before).alias(f"__m_{n}") for n in latest],
    )
    upto = (
        Window.partitionBy("__key", "__bucket")
        .orderBy(order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    out = bucketed.join(offsets, ["__key", "__bucket"])
    for name, expr in totals.items():
        out = out.withColumn(name, F.col(f"__s_{name}") + F.sum(expr).over(upto))
    for name, expr in latest.items():
        out = out.withColumn(name, F.greatest(F.col(f"__m_{name}"), F.max(expr).over(upto)))
    return out.drop(
        "__key", "__bucket", *[f"__s_{n}" for n in totals], *[f"__m_{n}" for n in latest]
    )


def _stride(hex_digest: Column, size: Column) -> Column:
    """A seeded prime that does not divide `size`."""
    usable = F.filter(F.array(*[F.lit(p).cast("long") for p in STRIDES]), lambda p: size % p != 0)
    number = F.conv(F.substring(hex_digest, 9, 4), 16, 10).cast("long")
    return F.get(usable, (number % F.size(usable)).cast("int"))


def ring_sample(
    requests: DataFrame,
    members: DataFrame,
    group: str,
    request_keys: list[str],
    member_keys: list[str],
    size: int | Column,
    seed: str,
    struck: DataFrame | None = None,
    keep: Column | None = None,
) -> DataFrame:
    """`size` distinct members of its group for every request, without pairing all with all.

    Members of a group stand on a ring in md5-seeded order. A request starts at a seeded
    place and walks by a seeded stride that has no factor in common with the ring's size,
    so it meets `size` different members (a number or a column of `requests`) and the same
    members do not always come together. The work is requests x size whatever the group
    holds. Every member is equally likely to be taken. Groups smaller than `size` are
    taken whole. `pick` numbers a request's members from 1, `turn` those of them that it keeps.

    `struck(request_keys[0], *member_keys)` are members a request may not take; of the others its
    first `keep` stay, a column of `requests`. Both are settled by places, before members are looked up.
    Rings are looked up in pages of RING_PAGE members, so a request is one row per page it meets.
    """
    ring = seeded_position(members.select(group, *member_keys), [group], seed, member_keys, "__place", "__size")
    ring = materialise(ring.drop("__size"))
    sizes = ring.groupBy(group).agg(F.count(F.lit(1)).alias("__size"))
    page = lambda place: F.floor((place - 1) / F.lit(RING_PAGE)).cast("long")
    member = F.struct("__place", *member_keys)
    pages = (
        ring.groupBy(group, page(F.col("__place")).alias("__page"))
        .agg(F.array_sort(F.collect_list(member)).alias("__members"))
    )
    walking = requests
    if struck is not None:
        owner = request_keys[0]
        met = requests.select(owner, group).distinct().join(struck.select(owner, *member_keys).distinct().hint("merge"), owner)
        places = met.join(ring.hint("merge"), [group, *member_keys]).groupBy(owner, group).agg(F.collect_set("__place").alias("__struck"))
        walking = requests.join(places.hint("merge"), [owner, group], "left").withColumn("__struck", F.coalesce("__struck", F.array().cast("array<bigint>")))
    walking = (
        walking.withColumn("__count", F.lit(size).cast("long"))
        .join(sizes, group)
        .withColumn("__count", F.least("__count", "__size"))
        .withColumn("__digest", digest(seed, *[F.col(k) for k in request_keys]))
        .withColumn("__start", F.pmod(digest_int(F.col("__digest")), F.col("__size")))
        .withColumn("__stride", _stride(F.col("__digest"), F.col("__size")))
        .drop("__digest")
        .filter(F.col("__count") > 0)
    )
    picks = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("__count") - 1),
        lambda p: F.struct(
            (p + 1).cast("int").alias("pick"), (F.pmod(F.col("__start") + p * F.col("__stride"), F.col("__size")) + 1).alias("place")
        ),
    )
    if struck is not None:
        picks = F.filter(picks, lambda p: ~F.array_contains("__struck", p["place"]))
    if keep is not None:
        picks = F.slice(picks, 1, F.greatest(keep, F.lit(0)).cast("int"))
    picks = F.transform(picks, lambda p, i: F.struct(p["pick"].alias("pick"), (i + 1).cast("int").alias("turn"), p["place"].alias("place")))
    several = F.array_distinct(F.transform(picks, lambda p: page(p["place"])))
    first_page = F.array(F.lit(0).cast("long"))
    asked = walking.withColumn("__page", F.explode(F.when(F.col("__size") <= RING_PAGE, first_page).otherwise(several)))
    here = F.filter(picks, lambda p: page(p["place"]) == F.col("__page"))
    taken = F.transform(
        here,
        lambda p: F.struct(
            p["pick"].alias("pick"), p["turn"].alias("turn"), F.get("__members", F.pmod(p["place"] - 1, F.lit(RING_PAGE)).cast("int")).alias("member")
        ),
    )
    found = asked.join(pages.hint("merge"), [group, "__page"]).select(*requests.columns, F.explode(taken).alias("__taken"))
    return found.select(*requests.columns, "__taken.pick", "__taken.turn", *[f"__taken.member.{k}" for k in member_keys])


def gather_text(df: DataFrame, keys: list[str], pos: str, text: str, separator: str = "\n") -> DataFrame:
    """The lines of each group joined in order of `pos`, then of the lines, into one text.

    A text is one string whatever its length, so its lines have to meet in one row.
    """
    lines = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(text).alias("t"))))
    return (
        df.groupBy(*keys)
        .agg(lines.alias("__lines"))
        .select(*keys, F.array_join(F.transform("__lines", lambda x: x["t"]), separator).alias(text), F.size("__lines").alias("n_lines"))
    )
