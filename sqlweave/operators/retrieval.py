"""Which columns belong to a question: query text, vectors, exact and approximate top-k."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sqlweave.functions.arrays import unnest
from sqlweave.session import materialise

# The instruction put before every question.
INSTRUCTION = (
    "Instruct:Given a natural language question, retrieve database column information "
    "passages used to generate SQL.\nQuery:"
)

# Questions and documents per side of one scoring cell: 2,048 x 2,048 doubles are 32 MB.
CELL_ROWS = 2048
# Differences beyond this many digits are noise of the summation order: such scores tie.
SCORE_DIGITS = 9


def query_text(question: Column, evidence: Column, gap: str = " ") -> Column:
    """Instruction, question and, where there is one, the evidence."""
    extra = F.when(F.coalesce(evidence, F.lit("")) != "", F.concat(F.lit(gap), evidence)).otherwise("")
    return F.concat(F.lit(INSTRUCTION), question, extra)


def _score_cell(names: tuple[str, str, str], k: int) -> Callable:
    group, question, document = names

    def unit(vectors: pd.Series) -> np.ndarray:
        matrix = np.stack(vectors.to_numpy()).astype(np.float64)
        sizes = np.linalg.norm(matrix, axis=1, keepdims=True)
        return matrix / np.where(sizes == 0, 1.0, sizes)

    def best(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        held = held.sort_values(document)
        scores = np.round(unit(asked["vector"]) @ unit(held["vector"]).T, SCORE_DIGITS)
        if scores.shape[1] > k:
            kth = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
            rows, cols = np.nonzero(scores >= kth)
        else:
            rows, cols = np.nonzero(np.ones(scores.shape, dtype=bool))
        kept = scores[rows, cols]
        order = np.lexsort((cols, -kept, rows))
        rows, cols, kept = rows[order], cols[order], kept[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left")
        top = place < k
        return pd.DataFrame(
            {
                question: asked[question].to_numpy()[rows[top]],
                document: held[document].to_numpy()[cols[top]],
                "score": kept[top],
            }
        )

    def score(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        documents_of = dict(tuple(held.groupby(group, sort=False)))
        parts = [
            best(part, documents_of[key])
            for key, part in asked.groupby(group, sort=False)
            if key in documents_of
        ]
        if not parts:
            return pd.DataFrame({question: [], document: [], "score": []})
        return pd.concat(parts, ignore_index=True)

    return score


def _cell_winners(
    questions: DataFrame, documents: DataFrame, k: int, group: str, question: str, document: str
) -> DataFrame:
    """At most k scored documents per question and cell.

    A group's questions x documents rectangle is cut into cells of about CELL_ROWS on
    each side, so no task ever holds a whole hot group and only k rows per question
    leave a cell. Groups that fit one cell share bins, to keep Python calls few.
    """
    asked_n = questions.groupBy(group).agg(F.count(F.lit(1)).alias("q"))
    held_n = documents.groupBy(group).agg(F.count(F.lit(1)).alias("d"))
    # Written out, the grid is seen as the small table it is. Unwritten, its estimate is a product, and
    # the side with the vectors, small in its files and large in memory, was broadcast instead.
    grid = materialise(
        asked_n.join(held_n.hint("merge"), group).withColumns(
            {"q_cells": F.ceil(F.col("q") / CELL_ROWS), "d_cells": F.ceil(F.col("d") / CELL_ROWS)}
        )
    )
    # Small groups share bins of about one cell's rows on both sides, as many as the rows ask for.
    rows = grid.agg(F.sum(F.least("q", F.lit(CELL_ROWS))), F.sum(F.least("d", F.lit(CELL_ROWS)))).first()
    grid = grid.drop("q", "d")
    bins = max(1, *[-(-(n or 0) // CELL_ROWS) for n in rows])
    single = (F.col("q_cells") == 1) & (F.col("d_cells") == 1)
    home = F.when(single, F.pmod(F.xxhash64(group), F.lit(bins))).otherwise(F.xxhash64(group))

    def spread(side: DataFrame, key: str, own: str, other: str) -> DataFrame:
        return (
            side.join(grid, group)
            .withColumn("home", home)
            .withColumn(own, F.pmod(F.xxhash64(key), F.col(f"{own}s")))
            .withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"{other}s") - 1)))
            .select("home", "q_cell", "d_cell", group, key, "vector")
        )

    asked = spread(questions.select(group, question, "vector"), question, "q_cell", "d_cell")
    held = spread(documents.select(group, document, "vector"), document, "d_cell", "q_cell")
    keys = ["home", "q_cell", "d_cell"]
    types = dict(questions.dtypes) | dict(documents.dtypes)
    schema = f"{question} {types[question]}, {document} {types[document]}, score double"
    return (
        asked.groupBy(*keys)
        .cogroup(held.groupBy(*keys))
        .applyInPandas(_score_cell((group, question, document), k), schema)
    )


def _rank(scored: DataFrame, k: int, question: str, document: str) -> DataFrame:
    best_first = Window.partitionBy(question).orderBy(F.desc("score"), document)
    return scored.withColumn("rank", F.row_number().over(best_first)).filter(F.col("rank") <= k)


def top_k_cosine(
    questions: DataFrame,
    documents: DataFrame,
    k: int = 25,
    group: str = "db_id",
    question: str = "question_id",
    document: str = "doc_id",
) -> DataFrame:
    """Exact k nearest documents by cosine among those of the question's own group.

    Both inputs carry `group`, their id and `vector`. Fewer than k documents are all
    returned. Ties go to the smaller document id.
    """
    return _rank(_cell_winners(questions, documents, k, group, question, document), k, question, document)


def random_planes(dims: int, n_planes: int, seed: int) -> np.ndarray:
    return np.round(np.random.default_rng(seed).standard_normal((n_planes, dims)), 3)


def plane_bands(vector: Column, planes: np.ndarray, bands: int) -> Column:
    """One integer per band: on which side of each of the band's planes the vector lies."""
    per_band = len(planes) // bands
    weights = 2 ** np.arange(per_band)

    @F.pandas_udf("array<bigint>")
    def signs(vectors: pd.Series) -> pd.Series:
        if vectors.empty:
            return pd.Series([], dtype=object)
        above = np.stack(vectors.to_numpy()).astype(np.float64) @ planes.T > 0
        codes = above.reshape(len(vectors), bands, per_band).astype(np.int64) @ weights
        return pd.Series(list(codes))

    return signs(vector)


def approximate_top_k(
    questions: DataFrame,
    documents: DataFrame,
    k: int = 25,
    group: str = "db_id",
    question: str = "question_id",
    document: str = "doc_id",
    dims: int = 64,
    bands: int = 12,
    band_planes: int = 4,
    seed: int = 7,
) -> DataFrame:
    """k nearest documents among those that share a sign-projection band with the question.

    Candidates of a band are scored in the same bounded cells as the exact search, so
    a crowded band is split like any hot group and no candidate pair is ever a row.
    """
    planes = random_planes(dims, bands * band_planes, seed)

    def banded(side: DataFrame, key: str) -> DataFrame:
        return side.select(
            key,
            "vector",
            F.posexplode(plane_bands(F.col("vector"), planes, bands)).alias("band", "code"),
            F.col(group).alias("of"),
        ).select(key, "vector", F.concat_ws("/", F.col("of").cast("string"), "band", "code").alias("bucket"))

    winners = _cell_winners(
        banded(questions, question), banded(documents, document), k, "bucket", question, document
    )
    distinct = winners.groupBy(question, document).agg(F.max("score").alias("score"))
    return _rank(distinct, k, question, document)


def recall_at_k(exact: DataFrame, approximate: DataFrame, question: str, document: str) -> DataFrame:
    """Share of each question's exact hits the approximate search also found."""
    found = approximate.select(question, document).withColumn("found", F.lit(1))
    return (
        exact.join(found, [question, document], "left")
        .groupBy(question)
        .agg((F.sum(F.coalesce("found", F.lit(0))) / F.count(F.lit(1))).alias("recall"))
    )


def group_hits(hits: DataFrame, question: str = "question_id") -> DataFrame:
    """Hits (rank, table_name, column_name) of each question by table, best rank first.

    A question has at most k hits, so the lists are small. `table_rank` is the place of
    a table by its best hit.
    """
    ranked = F.array_sort(F.collect_list(F.struct("rank", "column_name")))
    by_table = hits.groupBy(question, "table_name").agg(
        F.min("rank").alias("best"), F.transform(ranked, lambda x: x["column_name"]).alias("columns")
    )
    order = Window.partitionBy(question).orderBy("best")
    return by_table.withColumn("table_rank", F.row_number().over(order)).drop("best")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), 1)


def token_dims(text: Column, dims: int) -> Column:
    """Hashed dimension of every token of the text."""

    def hashed(token: Column) -> Column:
        return F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("long")

    return F.transform(tokens(text), lambda t: F.pmod(hashed(t), F.lit(dims)).cast("int"))


class HashedVectoriser:
    """Default text vectoriser: hashed token counts x inverse document frequency, unit length.

    `fit` learns one weight per dimension (`dims` numbers, whatever the corpus size).
    A model of the user's own goes in wherever a `Column -> Column` is taken.
    """

    def __init__(self, dims: int = 256):
        self.dims = dims
        self.weights: np.ndarray | None = None

    def fit(self, texts: DataFrame, column: str) -> HashedVectoriser:
        present = unnest(texts, F.array_distinct(token_dims(F.col(column), self.dims)), "dim")
        counts = present.groupBy("dim").agg(F.count(F.lit(1)).alias("n"))
        total = texts.count()
        frequency = np.zeros(self.dims)
        for row in counts.collect():  # at most `dims` rows
            frequency[row["dim"]] = row["n"]
        self.weights = np.log((1.0 + total) / (1.0 + frequency)) + 1.0
        return self

    def transform(self, text: Column) -> Column:
        if self.weights is None:
            raise ValueError("fit the vectoriser first")
        dims, weights = self.dims, self.weights

        @F.pandas_udf("array<double>")
        def embed(batches: pd.Series) -> pd.Series:
            def one(codes: np.ndarray) -> np.ndarray:
                vector = np.bincount(codes, minlength=dims) * weights if len(codes) else np.zeros(dims)
                size = np.linalg.norm(vector)
                return vector / size if size else vector

            return batches.map(one)

        return embed(token_dims(text, dims))


def mean_pool(token_vectors: DataFrame, key: str, vector: str = "vector") -> DataFrame:
    """Mean of a text's token vectors; partial means combine before the shuffle."""
    dense = token_vectors.select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("__v"))
    return dense.groupBy(key).agg(vector_to_array(Summarizer.mean(F.col("__v"))).alias(vector))


def last_token_pool(token_vectors: DataFrame, key: str, position: str, mask: str, vector: str = "vector") -> DataFrame:
    """Vector of a text's last unmasked token, whichever side is padded."""
    return token_vectors.filter(F.col(mask)).groupBy(key).agg(F.max_by(vector, position).alias(vector))
