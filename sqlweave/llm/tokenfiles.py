"""Token-ID output: documents in id order as frames of range-coded blocks, and back."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sqlweave.llm import rangecoder
from sqlweave.session import scratch_path

# Ids that a frame holds at least, but for the last of a partition; frames in one file at most.
FRAME_IDS = 2048 * rangecoder.BLOCK_IDS
FRAMES_PER_FILE = 8
# Words in each of the two generations of a worker's store of ids.
KEPT_WORDS = 300_000

FRAME_DDL = "part int, frame int, n_ids long, doc_id array<long>, n_tokens array<long>, blocks binary"
_ODD_SPACE = re.compile(r"^ |\s | \s| $")
_BETWEEN = re.compile(r"(?<=\S)(?= \S)")


class Encoder:
    """A tokenizer with a store of the ids of words it has met.

    Byte-level BPE never merges across a single space between two other characters, so the
    ids of a text are those of its pieces there, each piece but the first with its space.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    @staticmethod
    def pieces(text: str) -> list[str]:
        if _ODD_SPACE.search(text):
            return _BETWEEN.split(text)
        if "\0" in text:
            return _BETWEEN.split(text)
        return text.replace(" ", "\0 ").split("\0")

    def forget(self) -> None:
        """Drop the store, so that an idle worker does not hold it while other jobs run."""
        self.known, self.older = {}, {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of every text as little-endian unsigned 32-bit integers."""
        cut = [self.pieces(t) for t in texts]
        met = set().union(*cut)
        new = list(met - self.known.keys())
        if len(self.known) + len(new) > KEPT_WORDS:
            self.known, self.older = {}, self.known
            new = list(met)
        self.known.update((p, self.older[p]) for p in new if p in self.older)
        new = [p for p in new if p not in self.known]
        for start in range(0, len(new), 10000):
            some = new[start : start + 10000]
            # The same ids as `encode_batch`, without the places in the text that they come from.
            for piece, found in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False)):
                self.known[piece] = np.array(found.ids, "<u4").tobytes()
        return [b"".join(map(self.known.__getitem__, pieces)) for pieces in cut]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def write_tokens(documents: DataFrame, path: str, vocabulary: str, end_id: int = 0) -> None:
    """Write the ids of all texts in ascending doc_id order, each with `end_id` behind it.

    A row of the Parquet files at `path` is a frame: the doc_ids and token counts of some
    documents, and their ids in blocks that can be decoded one by one. Frames stand in the order
    of (part, frame). Documents are dealt out by ranges of doc_id, so that each task sorts, encodes
    and writes one range. Null ids come last; rows with one doc_id are ordered by text and may be
    split over ranges. A null text has no ids but the end id.
    """
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text"), F.col("text")]
    ranged = (
        documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
        .repartitionByRange(*order[:2])
        .sortWithinPartitions(*order)
        .withColumn("part", F.spark_partition_id())
    )
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(vocabulary)
        ids, held, size, frame, part = [], [], 0, 0, 0

        def close() -> pa.RecordBatch:
            stream = np.frombuffer(b"".join(held), "<u4")
            blocks = b"".join(rangecoder.encode(stream, words.vocabulary))
            row = [[part], [frame], [len(stream)], [ids], [[len(h) // 4 for h in held]], [blocks]]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            names = ["part", "frame", "n_ids", "doc_id", "n_tokens", "blocks"]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types)], names)

        for batch in batches:
            doc_ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            if len(doc_ids):
                part = batch.column("part")[0].as_py()
            for start in range(0, len(doc_ids), 500):
                for doc_id, code in zip(doc_ids[start : start + 500], words.encode(texts[start : start + 500].to_pylist())):
                    ids.append(doc_id)
                    held.append(code + end)
                    size += len(code) // 4 + 1
                    if size >= FRAME_IDS:
                        yield close()
                        ids, held, size, frame = [], [], 0, frame + 1
        words.forget()
        if ids:
            yield close()

    ranged.mapInArrow(run, FRAME_DDL).write.option("maxRecordsPerFile", FRAMES_PER_FILE).option("compression", "none").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files at `path`.

    All blocks are decoded and checked against their checksums. `start` counts the ids of all
    documents before; it comes from the frames' sizes, summed per part and then over parts.
    """
    frames = spark.read.schema(FRAME_DDL).parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                part, frame, n_ids, doc_ids, sizes, blocks = (batch.column(c)[row] for c in range(6))
                ids = rangecoder.decode(rangecoder.split(blocks.as_py())).astype("<u4")
                if len(ids) != n_ids.as_py():
                    raise ValueError(f"frame {frame} of part {part} has {len(ids)} ids, not {n_ids}")
                counts = np.array(sizes.as_py(), np.int64)
                ends = np.cumsum(counts)
                sums = [crc32(ids[e - c : e].tobytes()) for e, c in zip(ends, counts)]
                n = len(counts)
                yield pa.RecordBatch.from_arrays(
                    [doc_ids.values, pa.array([part.as_py()] * n, pa.int32()), pa.array([frame.as_py()] * n, pa.int32()), pa.array(ends - counts), pa.array(counts), pa.array(sums, pa.int64())],
                    ["doc_id", "part", "frame", "place", "n_tokens", "ids_crc32"],
                )

    decoded = frames.mapInArrow(run, "doc_id long, part int, frame int, place long, n_tokens long, ids_crc32 long")
    sizes = frames.select("part", "frame", "n_ids")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    within = Window.partitionBy("part").orderBy("frame").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.join(parts, "part").select(
        "part", "frame", (F.col("part_start") + F.coalesce(F.sum("n_ids").over(within), F.lit(0))).alias("frame_start")
    )
    return decoded.join(starts, ["part", "frame"]).select(
        "doc_id", (F.col("frame_start") + F.col("place")).alias("start"), "n_tokens", "ids_crc32"
    )


def tokenise(documents: DataFrame, vocabulary: str, path: str | None = None, end_id: int = 0) -> DataFrame:
    """Write the token files of `documents` to `path` (else to the shared folder) and read them back."""
    spark = documents.sparkSession
    path = path or scratch_path(spark)
    write_tokens(documents, path, vocabulary, end_id)
    return read_tokens(spark, path)
