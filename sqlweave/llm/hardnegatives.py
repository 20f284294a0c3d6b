"""Hard negatives by exact integer scores, computed as a matrix product in a residue number system."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import prod

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sqlweave.llm.columns import quoted
from sqlweave.session import materialise

# Residues lie within half a prime around zero. A float32 holds every whole number up to 2^24, so
# a product over INNER dimensions of residues modulo a prime up to LARGEST is exact.
EXACT, INNER, LARGEST = 1 << 24, 64, 1021
assert INNER * (LARGEST // 2) ** 2 < EXACT

_SCORES = "anchor_id long, vec_id long, score long"
_HITS = "anchor_id long, positive_score long, vec_id long, score long"


@dataclass(frozen=True)
class Settings:
    positives: int = 5
    negatives: int = 5
    #: A negative's score is at least this share of the positive's, and at most the positive's: numerator and denominator.
    share: tuple[int, int] = (80, 100)
    #: Anchors have an id that divides by this.
    every: int = 100
    #: Factor of the components before they are rounded down.
    scale: int = 256
    #: Rows and anchors in one block; blocks are compared pair by pair.
    block_rows: int = 4096
    block_anchors: int = 2048


def primes_for(bound: int) -> list[int]:
    """Primes from LARGEST down whose product tells all scores from -bound to bound apart."""
    found: list[int] = []
    n = LARGEST
    while prod(found) < 2 * bound + 1:
        if all(n % q for q in range(2, int(n**0.5) + 1)):
            found.append(n)
        n -= 1
    return found


def _centred(x: np.ndarray, p: int) -> np.ndarray:
    return (x + p // 2) % p - p // 2


def residue_product(a: np.ndarray, b: np.ndarray, primes: list[int]) -> np.ndarray:
    """a @ b.T of whole numbers, exact where it lies within half the product of the primes.

    For each prime the residues are multiplied in float32, INNER dimensions at a time. Chinese
    remaindering finds the digits of a mixed radix system, centred around zero, one prime after the other.
    """
    total, digits = np.zeros((len(a), len(b)), np.int64), []
    weight = 1
    for number, p in enumerate(primes):
        ra, rb = _centred(a, p).astype(np.float32), _centred(b, p).astype(np.float32)
        rest = np.zeros((len(a), len(b)), np.int64)
        for start in range(0, a.shape[1], INNER):
            rest += (ra[:, start : start + INNER] @ rb[:, start : start + INNER].T).astype(np.int64)
        # What the digits so far leave over, modulo p, times the inverse of their weight.
        known, step = np.zeros_like(rest), 1
        for digit, q in zip(digits, primes[:number]):
            known += digit * step
            step = step * q % p
        digit = _centred(_centred(rest - known, p) * pow(weight, -1, p) if number else rest, p)
        digits.append(digit)
        # A digit whose weight is beyond 64 bits is zero for every score within the bound.
        total += digit * (weight if weight < 1 << 63 else 0)
        weight *= p
    return total


def scaled_vectors(table: DataFrame, settings: Settings, id_column: str, vector: str, label: str) -> DataFrame:
    """(id, label, x) of the rows that take part, one per id: that with the smallest label, then vector."""
    v, name, n = F.col(quoted(vector)).cast("array<double>"), F.col(quoted(label)).cast("long"), F.col(quoted(id_column)).cast("long")
    sound = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    rows = table.select(n.alias("id"), name.alias("label"), v.alias("v")).filter(F.col("id").isNotNull() & F.col("label").isNotNull() & sound)
    moved = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    x = F.transform("v", lambda c: F.floor(c * settings.scale).cast("long"))
    one = rows.groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.label", "r.v")
    return one.select("id", moved.alias("label"), x.alias("x"))


def _first(scores: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """The `limit` best rows of each key, with `rank`; blocks hand on no more each, so keys stay small."""
    place = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return scores.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= limit)


def _best(score: np.ndarray, ids: np.ndarray, limit: int) -> np.ndarray:
    """Places of the `limit` highest scores, ties by smaller id."""
    if len(score) > limit:
        edge = np.partition(score, len(score) - limit)[len(score) - limit]
        at = np.flatnonzero(score >= edge)
    else:
        at = np.arange(len(score))
    return at[np.lexsort((ids[at], -score[at]))[:limit]]


def _together(parts: list[tuple], ddl: str) -> pd.DataFrame:
    names = [c.split()[0] for c in ddl.split(", ")]
    none = np.zeros(0, np.int64)
    return pd.DataFrame({name: np.concatenate([none, *[p[i] for p in parts]]) for i, name in enumerate(names)})


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.int64)


def mine_hard_negatives(
    table: DataFrame, settings: Settings = Settings(), id_column: str = "vec_id", vector: str = "embedding", label: str = "label"
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    An anchor's positives are its best `positives` rows of the same label. A positive's negatives are
    the best `negatives` rows of other labels whose score lies in the window that `share` opens below
    the positive's score. Scores are inner products of whole-numbered vectors, exact in 64 bits.

    Anchors and rows are dealt to blocks by a hash of their id, and every block of anchors meets every
    block of rows: once for the positives, once for the windows these open. A pair of blocks
    hands on the best few rows per anchor and window, so what is merged grows with the anchors and
    blocks and never with labels: a label that holds a third of all rows is many blocks like any other.

    Rows take part that have an id, a label and a vector whose components are all finite. Of rows
    with one id that with the smallest label (before it is moved), then vector counts. An anchor is compared with rows of
    its own vector length; vectors without components score 0. Ties go to the smaller id. An anchor
    without other rows of its label has no positive, and a positive without rows in its window no row in the
    result; a negative positive score opens no window. An empty table gives an empty
    result, and columns besides the three named are not looked at. Components so large that scores
    could leave 64 bits raise an error.
    """
    rows = materialise(scaled_vectors(table, settings, id_column, vector, label))
    square = F.aggregate("x", F.lit(0.0), lambda acc, c: acc + c.cast("double") * c.cast("double"))
    longest = rows.agg(F.max(square)).first()[0] or 0.0
    if longest >= 2.0**62:
        raise ValueError("components are too large for scores of 64 bits")
    primes = primes_for(int(longest * (1 + 1e-9)) + 1)

    anchors = materialise(rows.filter(F.col("id") % settings.every == 0))
    width = F.size("x").alias("width")
    sizes = rows.groupBy(width).agg(
        F.ceil(F.count(F.lit(1)) / settings.block_rows).cast("int").alias("row_blocks"),
        F.ceil(F.count_if(F.col("id") % settings.every == 0) / settings.block_anchors).cast("int").alias("anchor_blocks"),
    ).filter("anchor_blocks > 0")
    sizes = materialise(sizes)
    block = ["width", "anchor_block", "row_block"]

    def dealt(part: DataFrame, own: str, other: str, extra: list[str]) -> DataFrame:
        """Each row in its block, once for every block of the other side."""
        placed = part.withColumn("width", F.size("x")).join(sizes, "width")
        every = F.explode(F.sequence(F.lit(0), F.col(f"{other}_blocks") - 1))
        mine = F.pmod(F.xxhash64("id"), F.col(f"{own}_blocks")).cast("int")
        return placed.select("width", mine.alias(f"{own}_block"), every.alias(f"{other}_block"), "id", "label", "x", *extra)

    def slabs(asked: pd.DataFrame, held: pd.DataFrame) -> Iterator[tuple[int, np.ndarray]]:
        """Number of each anchor and its scores with all rows of the block; few anchors are multiplied at a time."""
        b = _matrix(held["x"])
        for start in range(0, len(asked), 256):
            score = residue_product(_matrix(asked["x"].iloc[start : start + 256]), b, primes)
            yield from enumerate(score, start)

    def positives(_: tuple, asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(asked) and len(held):
            ids, names = held["id"].to_numpy(), held["label"].to_numpy()
            for i, score in slabs(asked, held):
                anchor = asked["id"].iat[i]
                at = np.flatnonzero((names == asked["label"].iat[i]) & (ids != anchor))
                at = at[_best(score[at], ids[at], settings.positives)]
                out.append((np.full(len(at), anchor), ids[at], score[at]))
        return _together(out, _SCORES)

    def negatives(_: tuple, asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        low, high = settings.share
        if len(asked) and len(held):
            ids, names = held["id"].to_numpy(), held["label"].to_numpy()
            for i, score in slabs(asked, held):
                other = np.flatnonzero(names != asked["label"].iat[i])
                for top in asked["tops"].iat[i]:
                    # The smallest score of the window, rounded up; 64 bits could overflow in low * top.
                    least = -(-low * int(top) // high)
                    at = other[(score[other] >= least) & (score[other] <= top)]
                    at = at[_best(score[at], ids[at], settings.negatives)]
                    out.append((np.full(len(at), asked["id"].iat[i]), np.full(len(at), top), ids[at], score[at]))
        return _together(out, _HITS)

    held_rows = dealt(rows, "row", "anchor", []).groupBy(*block)
    near = dealt(anchors, "anchor", "row", []).groupBy(*block).cogroup(held_rows).applyInPandas(positives, _SCORES)
    chosen = materialise(_first(near, ["anchor_id"], settings.positives).withColumnRenamed("vec_id", "positive_id").withColumnRenamed("score", "positive_score"))
    # Positives of one score open one window.
    tops = chosen.groupBy(F.col("anchor_id").alias("id")).agg(F.collect_set("positive_score").alias("tops"))
    aimed = dealt(anchors.join(tops, "id"), "anchor", "row", ["tops"]).groupBy(*block)
    inside = aimed.cogroup(held_rows).applyInPandas(negatives, _HITS)
    best = _first(inside, ["anchor_id", "positive_score"], settings.negatives)
    return chosen.drop("rank").join(best, ["anchor_id", "positive_score"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
