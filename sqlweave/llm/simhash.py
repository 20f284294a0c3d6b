"""SimHash near-de-duplication by anchor-point covering."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import repeat
from operator import add

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sqlweave.llm.columns import carried
from sqlweave.llm.components import smallest_reachable
from sqlweave.session import materialise

SEED = 42
HALF_BITS = 32

# Anchors are the words of the (31, 26) Hamming code, which is perfect: every 31-bit word is
# within RADIUS of exactly one anchor. Two fingerprints that differ in THRESHOLD bits or fewer
# differ in at most THRESHOLD // 2 bits of one of their halves.
CODE_BITS, RADIUS, THRESHOLD = 31, 1, 2

# For links confirmed by similarity: SimHash sums of WIDE bits, of which each of WORDS words takes
# WORD_BITS. A word's anchor is the nearest code word of the first-order Reed-Muller code of that
# length, of which there are 2 * WORD_BITS. Each of PARTS parts is the anchors of PART_WORDS words.
WIDE, WORDS, WORD_BITS, PARTS, PART_WORDS = 1024, 64, 256, 96, 3
# Texts that share a part are compared by SKETCH_BITS of their bits first: similarity 0.8 makes about 10
# of 64 differ, unrelated texts 32. Then all bits are, of which 0.15 and 0.5 differ (0.27 at similarity 0.5).
SKETCH_BITS, SKETCH_DIFFERENT = 64, 20
MAX_DIFFERENT = 0.25
# Marks are MARK_BITS parities, each of how many of a text's shingles fall on it. Shared shingles leave no
# trace in the XOR of two texts' marks, so its ones are at most the shingles that only one of them holds.
MARK_BITS = 1024
# Among texts that ask, a shingle of at most RARE_TEXTS of them is rare.
RARE_TEXTS = 64


def fingerprint(text: str | None, words: int = 3) -> int:
    """64-bit SimHash over shingles of `words` words, repeats included; 0 without words.

    Words are runs of anything but ASCII white space, with A-Z lower-cased.
    """
    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    if len(parts) <= words:
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(parts), SEED)], "<u8")
    else:
        digest, join = xxhash.xxh64_intdigest, b" ".join
        shingles = zip(*[parts[i:] for i in range(words)])
        hashes = np.fromiter((digest(join(s), SEED) for s in shingles), "<u8", len(parts) - words + 1)
    # Bits are counted in slices, so a very long text needs no more memory than its hashes.
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 65536):
        piece = hashes[start : start + 65536]
        ones += np.unpackbits(piece.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def _text_hash() -> Column:
    return F.xxhash64(F.lit("text"), F.col("text"))


def with_fingerprints(documents: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, text_hash, fp) of every row; fp holds the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(t.as_py(), words) for t in batch.column("text")]
            signed = np.array(prints, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(signed)], ["doc_id", "text_hash", "fp"])

    slim = documents.select(F.col("doc_id").cast("long"), _text_hash().alias("text_hash"), F.col("text").cast("string"))
    return slim.mapInArrow(run, "doc_id long, text_hash long, fp long")


def _anchors_by_syndrome() -> list[list[int]]:
    """For each syndrome s, what to XOR to reach every anchor within RADIUS + 1 of a word.

    A word with syndrome s has its home anchor at bit s flipped (none for 0), and further anchors
    where two bits i and j with i xor j = s are flipped.
    """
    flips = []
    for s in range(CODE_BITS + 1):
        home = 1 << (s - 1) if s else 0
        pairs = [(1 << (i - 1)) ^ (1 << ((i ^ s) - 1)) for i in range(1, CODE_BITS + 1) if i < i ^ s <= CODE_BITS] if s else []
        flips.append([home, *pairs])
    return flips


def _syndrome(word: Column) -> Column:
    """XOR of the numbers (from 1) of all bits that are set."""
    total = F.lit(0)
    for k in range(5):
        mask = sum(1 << (i - 1) for i in range(1, CODE_BITS + 1) if i >> k & 1)
        total = total + F.bit_count(word.bitwiseAND(F.lit(mask))) % 2 * (1 << k)
    return total.cast("int")


def close_pairs(prints: DataFrame) -> DataFrame:
    """(u, v), u < v: all pairs of the distinct longs `fp` that differ in THRESHOLD bits or fewer.

    Each half of a fingerprint is assigned to its home anchor, and replicated to every anchor
    within RADIUS + THRESHOLD // 2. If two halves differ in at most THRESHOLD // 2 bits, the
    home of one is among the anchors of the other; there whole fingerprints are compared.
    """
    halves = F.array(*[
        F.struct(F.lit(h).alias("half"), F.shiftrightunsigned("fp", h * HALF_BITS).bitwiseAND(F.lit((1 << CODE_BITS) - 1)).alias("word"))
        for h in (0, 1)
    ])
    flips = F.array(*[F.array(*[F.lit(x).cast("long") for x in row]) for row in _anchors_by_syndrome()])
    cut = prints.select("fp", F.explode(halves).alias("x")).select(
        "fp", F.col("x.half").cast("long").alias("half"), F.col("x.word").alias("word"), F.element_at(flips, _syndrome(F.col("x.word")) + 1).alias("flips")
    )
    anchor = lambda flip: F.shiftleft("half", HALF_BITS).bitwiseXOR(F.col("word")).bitwiseXOR(flip)
    home = cut.select(F.col("fp").alias("u"), anchor(F.element_at("flips", 1)).alias("anchor"))
    guest = cut.select(F.col("fp").alias("v"), "half", "word", F.explode("flips").alias("flip")).select("v", anchor(F.col("flip")).alias("anchor"))
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= THRESHOLD
    # Spark takes the size of either side from before its rows were listed, and would broadcast all of them.
    met = home.hint("merge").join(guest, (home["anchor"] == guest["anchor"]) & (F.col("u") < F.col("v")) & near)
    return met.select("u", "v").distinct()


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles, words as in `fingerprint`; empty without words."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    shingles = zip(*[parts[i:] for i in range(words)]) if len(parts) > words else [parts]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, shingles), repeat(SEED)), np.uint64))


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two shingle sets share `similarity` or more of their union; empty sets are alike."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared + 1e-9 >= similarity * (len(a) + len(b) - shared)


_MIXERS = (np.random.default_rng(SEED).integers(0, 1 << 63, WIDE // 64, np.uint64) << np.uint64(1)) | np.uint64(1)


def wide_sums(hashes: np.ndarray) -> np.ndarray:
    """SimHash sums of WIDE bits, set less unset, over a set of shingle hashes, each mixed anew for every 64 bits."""
    counts = np.zeros(WIDE, np.int64)
    # Slices of 255, whose counts fit one byte.
    for start in range(0, len(hashes), 255):
        mixed = hashes[start : start + 255, None] * _MIXERS[None, :]
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
        bits = np.unpackbits(mixed.view(np.uint8), axis=1, bitorder="little")
        counts += np.add.reduce(bits, axis=0, dtype=np.uint8)
    return 2 * counts - len(hashes)


def parity_marks(hashes: np.ndarray) -> np.ndarray:
    """MARK_BITS parities of a set of shingle hashes, as longs."""
    odd = np.bincount((hashes % np.uint64(MARK_BITS)).astype(np.int64), minlength=MARK_BITS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _hadamard(size: int) -> np.ndarray:
    """Signs of the first-order Reed-Muller code's words, but for their complements."""
    n = np.arange(size)
    return (1 - 2 * (np.bitwise_count(n[:, None] & n[None, :]) & 1)).astype(np.float32)


_SIDE = int(WORD_BITS**0.5)
_SQUARE = _hadamard(_SIDE)
_draw = np.random.default_rng([SEED, WIDE])
_PLACES = np.stack([_draw.permutation(WIDE)[:WORD_BITS] for _ in range(WORDS)])
_SIGNS = (1 - 2 * _draw.integers(0, 2, (WORDS, WORD_BITS))).astype(np.float32)
PART_PLACES = [sorted(_draw.permutation(WORDS)[:PART_WORDS].tolist()) for _ in range(PARTS)]


def home_anchors(sums: np.ndarray) -> np.ndarray:
    """The anchor of each of WORDS words for each row of sums: number and sign of the nearest code word.

    The products with all code words are one Hadamard transform, here as two products with its square root.
    """
    found = [np.zeros((0, WORDS), np.int64)]
    # A few rows at a time, which stay in the cache.
    for start in range(0, len(sums), 8):
        words = np.take(sums[start : start + 8].astype(np.float32), _PLACES, axis=1) * _SIGNS
        rows = words.reshape(-1, _SIDE) @ _SQUARE
        fit = (rows.reshape(-1, _SIDE, _SIDE).swapaxes(1, 2).reshape(-1, _SIDE) @ _SQUARE).reshape(-1, WORD_BITS)
        best = np.abs(fit).argmax(1)
        found.append((2 * best + (fit[np.arange(len(best)), best] < 0)).reshape(-1, WORDS))
    return np.concatenate(found)


def with_wide_fingerprints(documents: DataFrame, words: int) -> DataFrame:
    """(doc_id, text_hash, fp, n, bits, marks, anchors) of every row; fp is a hash of the set of its n shingles.

    A text without words has fp zero and no anchors.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 128):
                batch = whole.slice(start, 128)
                sets = [shingle_hashes(t.as_py(), words) for t in batch.column("text")]
                prints = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) if len(s) else 0 for s in sets], np.uint64).view(np.int64)
                sums = np.stack([wide_sums(s) for s in sets])
                packed = np.packbits((sums > 0).astype(np.uint8), axis=1, bitorder="little").view(np.int64)
                anchors = [a if len(s) else [] for a, s in zip(home_anchors(sums).astype(np.int16), sets)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"), batch.column("text_hash"), pa.array(prints), pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(list(packed), pa.list_(pa.int64())), pa.array([parity_marks(s) for s in sets], pa.list_(pa.int64())),
                        pa.array(anchors, pa.list_(pa.int16())),
                    ],
                    ["doc_id", "text_hash", "fp", "n", "bits", "marks", "anchors"],
                )

    slim = documents.select(F.col("doc_id").cast("long"), _text_hash().alias("text_hash"), F.col("text").cast("string"))
    return slim.mapInArrow(run, "doc_id long, text_hash long, fp long, n long, bits array<bigint>, marks array<bigint>, anchors array<smallint>")


def _different(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _may_be_similar(similarity: float) -> Column:
    """Whether the marks of u and v leave it open that they are similar; no similar pair fails."""
    ones = reduce(add, (F.bit_count(F.get("u_marks", F.lit(i)).bitwiseXOR(F.get("v_marks", F.lit(i)))) for i in range(MARK_BITS // 64)))
    return ones <= (1 - similarity) / (1 + similarity) * (F.col("u_n") + F.col("v_n")) + 1e-6


def _texts(asked: DataFrame, documents: DataFrame) -> DataFrame:
    """(h, t): the text of every asked text hash."""
    hashed = documents.select(_text_hash().alias("h"), F.col("text").cast("string").alias("t"))
    return hashed.join(materialise(asked), "h", "left_semi").groupBy("h").agg(F.min("t").alias("t"))


def _rarities(asking: DataFrame, documents: DataFrame, words: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """What shingles tell about the texts `asking` (fp, text_hash): sizes and rare shingles.

    First (fp, n, common): how many distinct shingles a text has, and how many of them are in more than
    RARE_TEXTS of the texts. Then (h, fp): its rarest shingles, no more than a similar text can lack and
    one, less those that are not rare or in no other text. Similar texts share one of these rows, or
    else no rare shingle at all.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for fp, text in zip(batch.column("fp"), batch.column("t")):
                found = shingle_hashes(text.as_py(), words)
                own = pa.array(np.full(len(found), fp.as_py(), np.int64))
                size = pa.array(np.full(len(found), len(found), np.int64))
                yield pa.RecordBatch.from_arrays([own, size, pa.array(found.view(np.int64))], ["fp", "n", "h"])

    texts = asking.join(_texts(asking.select(F.col("text_hash").alias("h")).distinct(), documents), F.col("text_hash") == F.col("h"))
    shingles = materialise(texts.select("fp", "t").mapInArrow(cut, "fp long, n long, h long"))
    rare = shingles.groupBy("h").agg(F.count(F.lit(1)).alias("texts")).filter(F.col("texts") <= RARE_TEXTS)
    held = materialise(shingles.join(rare, "h"))
    counts = held.groupBy("fp").agg(F.count(F.lit(1)).alias("n_rare"))
    sizes = shingles.select("fp", "n").distinct().join(counts, "fp", "left").select("fp", "n", (F.col("n") - F.coalesce("n_rare", F.lit(0))).alias("common"))
    place = F.row_number().over(Window.partitionBy("fp").orderBy("texts", "h"))
    lacking = F.floor((1 - similarity) * F.col("n") + 1e-6) + 1
    return sizes, held.withColumn("place", place).filter((F.col("place") <= lacking) & (F.col("texts") > 1)).select("h", "fp")


def _confirmed(pairs: DataFrame, classes: DataFrame, documents: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs (u, v) of classes whose texts are similar enough."""

    @F.pandas_udf("boolean")
    def alike(left: pd.Series, right: pd.Series) -> pd.Series:
        # A text meets several others, and rows of one text mostly stand together.
        hashes = lru_cache(128)(lambda text: shingle_hashes(text, words))
        return pd.Series([similar(hashes(a), hashes(b), similarity) for a, b in zip(left, right)], dtype=bool)

    side = lambda n: classes.select(F.col("fp").alias(n), *[F.col(c).alias(f"{n}_{c.removeprefix('text_')}") for c in ("text_hash", "n", "bits", "marks")])
    apart = F.aggregate(F.zip_with("u_bits", "v_bits", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda n, x: n + x)
    near = _may_be_similar(similarity) & (apart <= int(MAX_DIFFERENT * WIDE))
    close = materialise(pairs.join(side("u"), "u").join(side("v"), "v").filter(near).select("u", "v", "u_hash", "v_hash"))
    texts = materialise(_texts(close.select(F.explode(F.array("u_hash", "v_hash")).alias("h")).distinct(), documents))
    text = lambda n: texts.select(F.col("h").alias(f"{n}_hash"), F.col("t").alias(f"{n}_text"))
    return materialise(close.join(text("u"), "u_hash").join(text("v"), "v_hash").filter(alike("u_text", "v_text")).select("u", "v"))


def similar_roots(prints: DataFrame, documents: DataFrame, words: int, similarity: float) -> DataFrame:
    """(fp, root) of every class: classes linked over texts of `similarity` or more have one root.

    Each part of a fingerprint is assigned to its home anchors; texts that share those of one part
    are compared there. At first each meets one text of its anchor only, its lead; where an anchor then
    holds several roots, the texts of all roots but its commonest meet those texts of other roots whose
    shingles leave it open whether they are similar (`_rarities`). So neither a group of copies of one
    text is paired with itself, however large, nor a group of near copies with the like that are not linked.
    """
    classes = materialise(prints.groupBy("fp").agg(F.min("text_hash").alias("text_hash"), *[F.first(c).alias(c) for c in ("n", "bits", "marks", "anchors")]))
    parts = F.array(*[F.xxhash64(F.lit(i), *[F.get("anchors", F.lit(w)) for w in part]) for i, part in enumerate(PART_PLACES)])
    sketch = F.element_at("bits", 1).alias("sketch")
    placed = classes.filter(F.size("anchors") > 0).select("fp", sketch, F.explode(parts).alias("anchor"))
    lead = F.min(F.struct("fp", "sketch"))
    shared = placed.groupBy("anchor").agg(lead.alias("lead"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = materialise(shared.select("anchor", F.col("lead.fp").alias("lead"), F.col("lead.sketch").alias("lead_sketch"), "n"))
    near_lead = _different("sketch", "lead_sketch") <= SKETCH_DIFFERENT
    # Of an anchor with two texts nothing is left once these have met.
    met = materialise(placed.join(shared, "anchor").filter((F.col("n") > 2) | (near_lead & (F.col("fp") != F.col("lead")))))
    leads = materialise(met.filter((F.col("fp") != F.col("lead")) & near_lead).select(F.col("lead").alias("u"), F.col("fp").alias("v")).distinct())
    links = _confirmed(leads, classes, documents, words, similarity)
    roots = materialise(smallest_reachable(links).select(F.col("node").alias("fp"), "root"))
    rooted = materialise(
        met.filter("n > 2").select("anchor", "fp", "sketch").join(roots, "fp", "left").select("anchor", "fp", "sketch", F.coalesce("root", "fp").alias("root"))
    )
    sizes = rooted.groupBy("anchor", "root").agg(F.count(F.lit(1)).alias("n"))
    mixed = sizes.groupBy("anchor").agg(F.max_by("root", F.struct("n", "root")).alias("common"), F.count(F.lit(1)).alias("roots")).filter("roots > 1")
    open_rows = materialise(rooted.join(mixed.select("anchor", "common"), "anchor"))
    left = open_rows.filter("root != common").select("anchor", F.col("fp").alias("u"), F.col("root").alias("u_root"), F.col("sketch").alias("u_sketch"))
    right = open_rows.select(
        F.col("anchor").alias("at"), F.col("fp").alias("v"), F.col("root").alias("v_root"), F.col("sketch").alias("v_sketch"), (F.col("root") == F.col("common")).alias("in_common")
    )
    near = (F.col("anchor") == F.col("at")) & (F.col("u_root") != F.col("v_root")) & (_different("u_sketch", "v_sketch") <= SKETCH_DIFFERENT)
    # Most of these pairs are not similar, and in a group of near copies they are its square. So they are not
    # listed: only the texts that are in one, then the pairs that share a rare shingle, then those in which
    # both texts have enough common ones and marks that differ in few enough places.
    asking = left.join(right, near, "left_semi").select("u").unionByName(right.join(left, near, "left_semi").select(F.col("v").alias("u"))).distinct()
    asking = materialise(asking.join(classes, F.col("u") == F.col("fp")).select("fp", "text_hash", sketch, "marks"))
    sizes, rare = (materialise(x) for x in _rarities(asking.select("fp", "text_hash"), documents, words, similarity))
    known = asking.join(roots, "fp", "left").select("fp", "sketch", F.coalesce("root", "fp").alias("root"))
    holders = materialise(rare.join(known, "fp"))
    side = lambda n: holders.select("h", F.col("fp").alias(n), F.col("root").alias(f"{n}_root"), F.col("sketch").alias(f"{n}_sketch"))
    apart = (F.col("u_root") != F.col("v_root")) & (F.col("u") < F.col("v")) & (_different("u_sketch", "v_sketch") <= SKETCH_DIFFERENT)
    a, b = side("u"), side("v").withColumnRenamed("h", "v_h")
    sharing = a.join(b, (F.col("h") == F.col("v_h")) & apart).select("u", "v").distinct()
    # Pairs of two uncommon roots meet twice and count once.
    once = F.col("in_common") | (F.col("u") < F.col("v"))
    enough = materialise(sizes.filter(F.col("common") + 1e-6 >= similarity * F.col("n")).join(asking.select("fp", "marks"), "fp"))
    count = lambda n: enough.select(F.col("fp").alias(n), *[F.col(c).alias(f"{n}_{c}") for c in ("n", "common", "marks")])
    shared = similarity / (1 + similarity) * (F.col("u_n") + F.col("v_n"))
    plain = left.join(count("u"), "u").join(
        right.join(count("v"), "v"), near & once & (F.least("u_common", "v_common") + 1e-6 >= shared) & _may_be_similar(similarity)
    )
    plain = plain.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    rest = sharing.unionByName(plain).distinct()
    more = _confirmed(materialise(rest.join(leads, ["u", "v"], "left_anti")), classes, documents, words, similarity)
    final = smallest_reachable(links.unionByName(more)).select(F.col("node").alias("fp"), "root")
    return classes.select("fp").join(final, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def _components(prints: DataFrame) -> DataFrame:
    """(fp, root, component_id, n_links) of every fingerprint; root tells components apart."""
    classes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    links = materialise(close_pairs(classes.select("fp")))
    roots = materialise(smallest_reachable(links))
    degrees = links.select(F.explode(F.array("u", "v")).alias("fp")).groupBy("fp").agg(F.count(F.lit(1)).alias("n_links"))
    rooted = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return materialise(
        rooted.join(least, "root").join(degrees, "fp", "left").select("fp", "root", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    )


def near_duplicates(documents: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id, n_links) of every document.

    component_id is the smallest doc_id among all documents reachable over fingerprints that
    differ in at most THRESHOLD bits; n_links counts the other fingerprints linked to this one.

    Equal fingerprints are one class: classes are compared and linked, copies never are. A null
    or blank text has fingerprint zero and is linked like any other. Rows with a null doc_id get
    the component of their fingerprint, null if it has no doc_id at all. Repeated rows stay. An
    empty table gives an empty result.
    """
    prints = materialise(with_fingerprints(documents, words))
    return prints.join(_components(prints), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_links"
    )


def keep_first(documents: DataFrame, words: int = 3, similarity: float | None = None) -> DataFrame:
    """One row of each near-duplicate component: that with the smallest doc_id, unchanged.

    Without `similarity` components are those of `near_duplicates`. With it, texts are linked that
    share at least that part of their distinct shingles, found by `similar_roots` and confirmed.
    Null ids come last. Rows with one doc_id are told apart by a hash of their text, and rows alike
    in both by their other columns, of which the smallest stay.
    """
    if similarity is None:
        prints = materialise(with_fingerprints(documents, words))
        roots = _components(prints).select("fp", "root")
    else:
        prints = materialise(with_wide_fingerprints(documents, words))
        roots = materialise(similar_roots(prints, documents, words, similarity))
    place = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_hash", "fp")
    winners = (
        prints.select("doc_id", "text_hash", "fp").join(roots, "fp").groupBy("root").agg(F.min(place).alias("w"))
        .select(F.col("w.doc_id").alias("w_id"), F.col("w.text_hash").alias("w_hash"))
    )
    inward, outward = carried(documents)
    hashed = documents.select(*inward, F.col("doc_id").cast("long").alias("id"), _text_hash().alias("hash"))
    won = hashed.join(materialise(winners), F.col("id").eqNullSafe(F.col("w_id")) & (F.col("hash") == F.col("w_hash")), "left_semi")
    kept = [f"kept_{i}" for i in range(len(inward))]
    sortable = F.struct(*[name for name, (_, kind) in zip(kept, documents.dtypes) if "map<" not in kind and "variant" not in kind])
    return won.groupBy("id", "hash").agg(F.min_by(F.struct(*kept), sortable).alias("first")).select("first.*").select(*outward)
