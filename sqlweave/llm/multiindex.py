"""Approximate nearest neighbours with an inverted multi-index."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from math import ceil, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sqlweave.session import materialise


@dataclass(frozen=True)
class Settings:
    """Parameters of the index. `sample_rows` bounds the rows that the codebooks are fitted on."""

    sample_rows: int = 20000
    rounds: int = 12
    #: Rows that a cell (a pair of half centroids) should hold on average.
    cell_rows: int = 200
    max_centroids: int = 256
    #: Entries that the first traversal reads, as a multiple of k.
    first_reads: int = 40
    #: Neighbours per query, as a share of k, that the second traversal may be expected to miss.
    expected_miss: float = 0.02
    #: Entries or queries of a bin of cells that one task compares, at least.
    block_rows: int = 2048
    #: Numbers in the vectors of a bin, where the table is large and these are more.
    block_values: int = 1 << 19

    def bin_rows(self, n: int, dims: int) -> int:
        """Entries or queries of a bin: more of them in a large table, so that a query comes to fewer bins."""
        return max(self.block_rows, min(n // 64, self.block_values // dims))


@dataclass(frozen=True)
class Codebooks:
    left: np.ndarray
    right: np.ndarray

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cut = x.shape[1] // 2
        return x[:, :cut], x[:, cut:]

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances of both halves of every row to all half centroids."""
        return tuple(_squared(h, c) for h, c in zip(self.halves(x), (self.left, self.right)))


@dataclass(frozen=True)
class Bins:
    """Cells dealt to bins, in which entries and queries meet.

    `cells` are those that hold anything, by number. Those from place `starts[g]` on, up to the next start, are
    group g: small ones that share bin `first[g]`, or one whose entries are dealt to `count[g]` bins from there on.
    """

    cells: np.ndarray
    starts: np.ndarray
    first: np.ndarray
    count: np.ndarray

    def table(self) -> pd.DataFrame:
        """(cell, first, bins, place) of every cell: its bins and its place in its group."""
        group = np.searchsorted(self.starts, np.arange(len(self.cells)), side="right") - 1
        place = np.arange(len(self.cells)) - self.starts[group]
        return pd.DataFrame({"cell": self.cells, "first": self.first[group], "bins": self.count[group], "place": place})

    def reached(self, walked: np.ndarray) -> Iterator[tuple[int, bytes]]:
        """(bin, marks) of all bins that hold cells of those marked in `walked`; bits of marks are cells by place."""
        met = walked[self.cells]
        stops = [*self.starts[1:], len(met)]
        for g in np.flatnonzero(np.logical_or.reduceat(met, self.starts)):
            marks = np.packbits(met[self.starts[g] : stops[g]]).tobytes()
            for bin_ in range(self.first[g], self.first[g] + self.count[g]):
                yield int(bin_), marks


def _bins(n: np.ndarray, rows: int) -> Bins:
    """Bins of about `rows` entries; `n` holds those of every cell."""
    cells = np.flatnonzero(n)
    starts, count, room = [], [], 0
    for place, size in enumerate(n[cells]):
        if size > room:
            starts.append(place)
            count.append(max(1, ceil(size / rows)))
            room = rows
        room -= size
    return Bins(cells, np.array(starts), np.cumsum([0, *count[:-1]]), np.array(count))


def _squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    if not x.shape[1]:
        return np.zeros((len(x), len(c)))
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None, :], 0.0)


def _normal_tail(z: np.ndarray) -> np.ndarray:
    """Share of a normal distribution above z, by a logistic curve (within 0.0002)."""
    z = np.clip(z, -8.0, 8.0)
    return 1.0 / (1.0 + np.exp(z * (1.5976 + 0.07056 * z * z)))


def _k_means(x: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Lloyd's algorithm from evenly spaced distinct rows; an empty cluster keeps its centre."""
    distinct = np.unique(x, axis=0)
    centres = distinct[np.linspace(0, len(distinct) - 1, min(k, len(distinct))).astype(int)]
    for _ in range(rounds):
        near = _squared(x, centres).argmin(1)
        n = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def usable_vectors(table: DataFrame, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, v) of the rows that take part: v has one or more finite components, one of them not zero."""
    v = F.col(f"`{vector}`").cast("array<double>")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return table.select(F.col(f"`{id_column}`").cast("long").alias("id"), v.alias("v")).filter(
        F.col("id").isNotNull() & sound & F.exists("v", lambda x: x != 0)
    )


def fit(vectors: DataFrame, settings: Settings) -> Codebooks | None:
    """Codebooks of both halves from about `sample_rows` rows; None for an empty table."""
    n = vectors.count()
    if not n:
        return None
    place = F.shiftrightunsigned(F.xxhash64("id", F.col("v").cast("array<double>")), 11) / float(1 << 53)
    rows = vectors.filter(place < settings.sample_rows / n).select("v").distinct().toPandas()["v"]
    x = np.unique(np.stack(rows if len(rows) else vectors.agg(F.min("v").alias("v")).toPandas()["v"]).astype(float), axis=0)
    k = int(np.clip(round(sqrt(n / settings.cell_rows)), 1, settings.max_centroids))
    cut = x.shape[1] // 2
    return Codebooks(_k_means(x[:, :cut], k, settings.rounds), _k_means(x[:, cut:], k, settings.rounds))


def _traverse(left: np.ndarray, right: np.ndarray) -> Iterator[tuple[float, int, int]]:
    """Pairs of half centroids by rising summed distance, with a heap over the two sorted lists."""
    a, b = np.argsort(left, kind="stable"), np.argsort(right, kind="stable")
    heap, seen = [(left[a[0]] + right[b[0]], 0, 0)], {(0, 0)}
    while heap:
        total, i, j = heapq.heappop(heap)
        yield total, int(a[i]), int(b[j])
        for p, q in ((i + 1, j), (i, j + 1)):
            if p < len(a) and q < len(b) and (p, q) not in seen:
                seen.add((p, q))
                heapq.heappush(heap, (left[a[p]] + right[b[q]], p, q))


def search(table: DataFrame, k: int = 10, every: int = 100, settings: Settings = Settings(), id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of every row whose id divides by `every`.

    Each half of a vector is quantised on its own; a cell is a pair of half centroids and every
    row stands in one. A query walks the pairs by summed distance. Its first walk stops after
    `first_reads` * k entries, which are ranked exactly. Their k-th distance and each cell's
    spread then tell how many nearer rows a cell may be expected to hold, and the second walk,
    never shorter than the first, stops when all cells not walked hold fewer than `expected_miss` * k. Structured vectors need
    few cells; vectors without structure need most, and the walk finds out which.

    Entries and queries meet in bins of cells (`Bins`), with a query's vector once in each bin that its
    walk comes to and not once in each cell, of which a walk over vectors without structure has most. A
    cell that holds a third of all rows is many bins, the queries of a bin are many pieces, and a task has
    one of each. It hands on at most k rows per query, in the second walk only those within the k-th
    distance of the first.

    Rows take part as `usable_vectors` says; each length has an index of its own and is
    searched among its own rows. A query never finds itself, by id; of rows with one id the
    smallest vector counts.
    Ties go to the smaller id, and a query finds all candidates where they are fewer than k.
    """
    usable = usable_vectors(table, id_column, vector)
    if "float" in table.select(F.col(f"`{vector}`")).dtypes[0][1]:
        # Floats are kept as such, in half the space.
        usable = usable.withColumn("v", F.col("v").cast("array<float>"))
    sound = materialise(usable.groupBy("id").agg(F.min("v").alias("v")))
    asked = sound.filter(F.col("id") % every == 0).select(F.size("v").alias("n")).distinct().orderBy("n").collect()
    if not asked:
        return table.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = [_search_length(sound.filter(F.size("v") == r["n"]), r["n"], k, every, settings) for r in asked]
    return reduce(DataFrame.unionByName, found)


def _search_length(vectors: DataFrame, dims: int, k: int, every: int, settings: Settings) -> DataFrame:
    """`search` among (id, v) rows whose vectors all have `dims` components."""
    spark = vectors.sparkSession
    kind = dict(vectors.dtypes)["v"]
    books = fit(vectors, settings)
    held = spark.sparkContext.broadcast(books)
    width = len(books.right)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = np.stack(batch["v"].to_numpy()).astype(float)
                left, right = held.value.distances(x)
                yield batch.assign(
                    cell=left.argmin(1) * width + right.argmin(1), rest=left.min(1) + right.min(1)
                )

    placed = materialise(vectors.mapInPandas(assign, f"id long, v {kind}, cell long, rest double"))
    # One row per cell that holds anything: at most max_centroids squared.
    cells = placed.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"), F.avg("rest").alias("rest"), F.coalesce(F.var_pop("rest"), F.lit(0.0)).alias("var")
    ).toPandas()
    full = {n: np.zeros(len(books.left) * width) for n in ("n", "rest", "var")}
    for name, values in full.items():
        values[cells["cell"].to_numpy(np.int64)] = cells[name].to_numpy(float)
    rows = settings.bin_rows(int(full["n"].sum()), dims)
    bins = _bins(full["n"], rows)
    stats = spark.sparkContext.broadcast((full, bins))
    queries = placed.filter(F.col("id") % every == 0).select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    # Written, so that join planning knows its size.
    homes = materialise(spark.createDataFrame(bins.table()))
    bin_ = F.col("first") + F.pmod(F.xxhash64("id"), F.col("bins"))
    entries = placed.join(homes, "cell").select(bin_.alias("bin"), "place", "id", "v")

    def listed(walks: Iterator[tuple[int, np.ndarray, float, np.ndarray]]) -> Iterator[pd.DataFrame]:
        """Rows of all walks (query id, vector, bound, whether each cell is walked), some at a time."""
        columns, out = ["query_id", "q", "bound", "bin", "marks"], []
        for qid, q, bound, walked in walks:
            for found in stats.value[1].reached(walked):
                out.append((qid, q, bound, *found))
                if len(out) == settings.block_rows:
                    yield pd.DataFrame(out, columns=columns)
                    out = []
        if out:
            yield pd.DataFrame(out, columns=columns)

    def first_walks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, np.ndarray, float, np.ndarray]]:
        n = stats.value[0]["n"]
        for batch in batches:
            for qid, q in zip(batch["query_id"], batch["q"]):
                left, right = held.value.distances(np.asarray(q, float)[None, :])
                walked, read = np.zeros(len(n), bool), 0
                for _, i, j in _traverse(left[0], right[0]):
                    cell = i * width + j
                    walked[cell] = True
                    read += n[cell]
                    if read > settings.first_reads * k:
                        break
                yield qid, q, np.inf, walked

    def second_walks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, np.ndarray, float, np.ndarray]]:
        n, rest, var = (stats.value[0][x] for x in ("n", "rest", "var"))
        for batch in batches:
            for qid, q, bound in zip(batch["query_id"], batch["q"], batch["bound"]):
                left, right = (d[0] for d in held.value.distances(np.asarray(q, float)[None, :]))
                sums = (left[:, None] + right[None, :]).ravel()
                # Squared distances in a cell: around sums + rest, spread by the residuals' direction and length.
                spread = np.sqrt(4 * sums * rest / dims + var + 1e-18)
                nearer = n * _normal_tail((sums + rest - bound * bound) / spread)
                walked, remaining, read = np.zeros(len(n), bool), nearer.sum(), 0
                for _, i, j in _traverse(left, right):
                    if remaining < settings.expected_miss * k and read > settings.first_reads * k:
                        break
                    cell = i * width + j
                    walked[cell] = True
                    remaining -= nearer[cell]
                    read += n[cell]
                yield qid, q, bound, walked

    def compare(_: tuple, asked: pd.DataFrame, held_rows: pd.DataFrame) -> pd.DataFrame:
        parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(asked) and len(held_rows):
            ids, x, place = held_rows["id"].to_numpy(), np.stack(held_rows["v"].to_numpy()).astype(float), held_rows["place"].to_numpy()
            longest = (x * x).sum(1).max()
            step = max(1, (1 << 19) // len(ids))
            for start in range(0, len(asked), step):
                piece = asked.iloc[start : start + step]
                q, qids, bounds = np.stack(piece["q"].to_numpy()).astype(float), piece["query_id"].to_numpy(), piece["bound"].to_numpy()
                marks = np.stack([np.unpackbits(np.frombuffer(m, np.uint8)) for m in piece["marks"]]).astype(bool)
                open_ = marks[:, place] & (qids[:, None] != ids[None, :])
                rough = np.where(open_, _squared(q, x), np.inf)
                # Queries all of whose entries here are beyond the bound, by more than rounding, are done.
                far = rough.min(1) > bounds * bounds * (1 + 1e-9) + 1e-9 * ((q * q).sum(1) + longest)
                rest = np.flatnonzero(~far)
                if not len(rest):
                    continue
                take = min(k + 8, len(ids))
                near = np.partition(rough[rest], take - 1, axis=1)
                # Ties at the cut: everything as near as the last one kept, up to rounding, is looked at.
                for row, edge in zip(rest, near[:, take - 1]):
                    limit = edge if np.isfinite(edge) else np.finfo(float).max
                    at = np.flatnonzero((rough[row] <= limit * (1 + 1e-9) + 1e-12) & open_[row])
                    score = np.sqrt(((x[at] - q[row]) ** 2).sum(1))
                    at, score = at[score <= bounds[row]], score[score <= bounds[row]]
                    order = np.lexsort((ids[at], score))[:k]
                    parts.append((np.full(len(order), qids[row]), ids[at][order], score[order]))
        return pd.DataFrame({n: np.concatenate(c) for n, c in zip(("query_id", "vec_id", "score"), zip(*parts))})

    def ranked(walk: DataFrame) -> DataFrame:
        asked = materialise(walk)
        pieces = F.ceil(F.count(F.lit(1)) / rows).cast("long")
        met = materialise(asked.groupBy("bin").agg(pieces.alias("pieces")))
        piece = F.pmod(F.xxhash64("query_id"), F.col("pieces"))
        left = asked.join(met, "bin").select("query_id", "q", "bound", "marks", "bin", piece.alias("piece"))
        every_piece = F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1))
        right = entries.join(met, "bin").select("id", "v", "place", "bin", every_piece.alias("piece"))
        found = left.groupBy("bin", "piece").cogroup(right.groupBy("bin", "piece")).applyInPandas(compare, "query_id long, vec_id long, score double")
        place = Window.partitionBy("query_id").orderBy("score", "vec_id")
        return found.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)

    walk_ddl = f"query_id long, q {kind}, bound double, bin long, marks binary"
    near = materialise(ranked(queries.mapInPandas(lambda batches: listed(first_walks(batches)), walk_ddl)))
    reach = near.groupBy("query_id").agg(F.max(F.when(F.col("rank") == k, F.col("score"))).alias("bound"))
    bounded = queries.join(reach, "query_id", "left").select("query_id", "q", F.coalesce("bound", F.lit(float("inf"))).alias("bound"))
    found = ranked(bounded.mapInPandas(lambda batches: listed(second_walks(batches)), walk_ddl))
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
