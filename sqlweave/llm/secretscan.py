"""Secret scans: fixed patterns, and sliding-window entropy of candidate strings by character class.

Everything here is built-in functions on one row: nothing is shuffled, and texts never leave the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import floor, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqlweave.llm.columns import carried, quoted

# Kinds in their listed order, their patterns, and the least length of what counts.
# A run of AKIA or of hexadecimal digits ends where its characters end, so a shorter run can be left
# out by the pattern; a short value of an assignment still uses up its text.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
BASE_KINDS = ("assign", "access", "hex")

# Candidate strings are maximal runs of these characters, of WINDOW or more.
ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/_=-"
WINDOW = 20
CANDIDATE = rf"[0-9A-Za-z+/_=-]{{{WINDOW},}}"


@dataclass(frozen=True)
class CharacterClass:
    """A candidate belongs to the first class whose pattern it matches whole; `bits` is its least entropy."""

    kind: str
    pattern: str
    bits: float


# Random strings have about 3.4 (16 characters) and 4.1 bits (64) in windows of 20, whose limit is 4.32.
CLASSES = (CharacterClass("entropy_hex", r"^[0-9A-Fa-f]+$", 3.0), CharacterClass("entropy_base64", r"^[0-9A-Za-z+/_=-]+$", 3.85))

# Candidates that are known not to be secrets: words without digits, numbers without letters, UUIDs,
# paths and names of words, and placeholders.
ALLOWED = (
    r"^[A-Za-z+/_=-]+$",
    r"^[0-9+/_=-]+$",
    r"^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$",
    r"^/?[A-Za-z]*[0-9]{0,4}([/_=-]+([A-Za-z]+[0-9]{0,2}|[0-9]{1,4}))+[/_=-]*$",
    r"(?i)example|placeholder|x{6}|0123456789|abcdefghij",
)

# Sums of c * log2(c) are kept as whole numbers of this unit, so that they never drift.
UNIT = 1 << 20
WEIGHTS = [round(c * log2(c) * UNIT) if c else 0 for c in range(WINDOW + 1)]
# Windows of a long candidate are walked in pieces of so many starts.
PIECE = 512
# Running positions are summed in chunks of so many matches.
CHUNK = 256


def largest_sum(bits: float) -> int:
    """The largest sum of c * log2(c), in units, of a window that has `bits` of entropy or more."""
    return floor((log2(WINDOW) - bits) * WINDOW * UNIT)


def _positions(skips: Column, widths: Column) -> Column:
    """(start, end) of every match; skips[i] characters lie before match i, widths[i] in it.

    Sums run inside chunks first and then over chunks, so the work stays near the number of matches.
    """
    none = F.array().cast("array<struct<start:int,end:int>>")
    state = lambda at, spans: F.struct(at.alias("at"), spans.alias("spans"))

    def step(acc: Column, i: Column) -> Column:
        start = acc["at"] + F.get(skips, i)
        end = start + F.get(widths, i)
        return state(end, F.concat(acc["spans"], F.array(F.struct(start.alias("start"), end.alias("end")))))

    def join(acc: Column, part: Column) -> Column:
        moved = F.transform(part["spans"], lambda s: F.struct((s["start"] + acc["at"]).alias("start"), (s["end"] + acc["at"]).alias("end")))
        return state(acc["at"] + part["at"], F.concat(acc["spans"], moved))

    empty = state(F.lit(0), none)
    chunk = lambda c: F.aggregate(F.sequence(c * CHUNK, F.least((c + 1) * CHUNK, F.size(widths)) - 1), empty, step)
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(widths) - 1) / CHUNK).cast("int")), chunk)
    return F.when(F.size(widths) == 0, none).otherwise(F.aggregate(chunks, empty, join)["spans"])


def _flags() -> list[Column]:
    """Whether `body` has a match of each pattern; what cannot match by plain words is not searched by pattern."""
    plain = F.lower("body")
    named = plain.contains("passw") | plain.contains("secret") | plain.contains("token") | plain.contains("apikey") | plain.contains("api_key")
    # Every run of HEX digits or AKIA is part of a candidate string.
    return [(named & F.col("body").rlike(ASSIGN)).alias("assign_any"), F.col("body").rlike(CANDIDATE).alias("candidate_any")]


def _matches(pattern: str, any_match: Column, group: int = 0) -> Column:
    return F.when(any_match, F.regexp_extract_all("body", F.lit(pattern), F.lit(group))).otherwise(F.array().cast("array<string>"))


def _skips(pattern: str, any_match: Column) -> Column:
    """Characters before each match and behind the last."""
    return F.when(any_match, F.transform(F.split("body", pattern, -1), F.char_length)).otherwise(F.array().cast("array<int>"))


def least_sum(candidate: Column) -> Column:
    """The smallest sum of c * log2(c), in units, over all windows of a candidate string.

    The counts of a window are those of the one before, one character in and one out; the sum
    changes by what these two add. The smallest sum belongs to the window of most entropy.
    """
    weights = F.array(*[F.lit(w) for w in WEIGHTS])
    zeros = F.array(*[F.lit(0)] * len(ALPHABET))

    def walk(piece: Column) -> Column:
        codes = F.transform(F.regexp_extract_all(piece, F.lit("(?s)."), F.lit(0)), lambda c: F.instr(F.lit(ALPHABET), c) - 1)

        def step(acc: Column, x: Column) -> Column:
            # The window's own characters come along as `held`, oldest first.
            full = F.size(acc["held"]) == WINDOW
            old = F.when(full, F.get(acc["held"], F.lit(0))).otherwise(-1)
            n_old = F.when(full, F.get(acc["counts"], old)).otherwise(0)
            n_new = F.get(acc["counts"], x) - F.when(old == x, 1).otherwise(0)
            gone = F.when(full, F.get(weights, n_old - 1) - F.get(weights, n_old)).otherwise(0)
            total = acc["total"] + gone + F.get(weights, n_new + 1) - F.get(weights, n_new)
            counts = F.transform(acc["counts"], lambda n, j: n + F.when(j == x, 1).otherwise(0) - F.when(j == old, 1).otherwise(0))
            held = F.concat(F.when(full, F.slice(acc["held"], 2, WINDOW - 1)).otherwise(acc["held"]), F.array(x))
            done = F.size(acc["held"]) >= WINDOW - 1
            return F.struct(
                counts.alias("counts"), held.alias("held"), total.alias("total"),
                F.when(done, F.least(acc["least"], total)).otherwise(acc["least"]).alias("least"),
            )

        start = F.struct(zeros.alias("counts"), F.array().cast("array<int>").alias("held"), F.lit(0).alias("total"), F.lit(2**31 - 1).alias("least"))
        return F.aggregate(codes, start, step, lambda acc: acc["least"])

    cut = rf"(.{{1,{PIECE}}})(?=(.{{0,{WINDOW - 1}}}))"
    heads, tails = (F.regexp_extract_all(candidate, F.lit(cut), F.lit(g)) for g in (1, 2))
    return F.array_min(F.transform(F.zip_with(heads, tails, lambda a, b: F.concat(a, b)), walk))


def kind_of(candidate: Column, classes: tuple[CharacterClass, ...], allowed: tuple[str, ...]) -> Column:
    """The kind of a candidate whose window of most entropy reaches its class's limit; null for others and for allowed ones."""
    least = least_sum(candidate)
    told = F.lit(None).cast("string")
    for c in reversed(classes):
        told = F.when(candidate.rlike(c.pattern), F.when(least <= largest_sum(c.bits), F.lit(c.kind))).otherwise(told)
    known = F.lit(False)
    for pattern in allowed:
        known = known | candidate.rlike(pattern)
    return F.when(~known, told)


def find_secrets(
    documents: DataFrame, text: str = "text", classes: tuple[CharacterClass, ...] = CLASSES, allowed: tuple[str, ...] = ALLOWED
) -> DataFrame:
    """`documents` with n_assign, n_access, n_hex, base_sha256, spans and found.

    Three kinds of base spans come from patterns, leftmost and non-overlapping per kind: assignments
    (with a value of ASSIGN_VALUE or more characters), access keys and long runs of hexadecimal
    digits. Further spans are candidate strings, long runs of the ALPHABET, in which some window of
    WINDOW characters has at least the entropy of the candidate's character class; candidates that
    match a pattern of `allowed` add nothing. Base spans stay whatever is allowed.

    `found` lists (kind, start, end, value) in code points, end exclusive, by start, then by kind as
    listed (assign, access, hex, then the classes). `spans` is the same as kind:start:end joined by
    commas, and base_sha256 the SHA-256 of that text of the base spans alone.

    Each row is judged for itself: repeated rows and null ids make no difference, and of spans
    that start together the listed kind comes first. A null or empty text has no span, so base_sha256
    is that of the empty string. Texts of any length are scanned whole. Columns of the six names
    are replaced, others stay whatever they are called. An empty table gives an empty result.
    """
    inward, outward = carried(documents, ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "found"))
    body = F.coalesce(F.col(quoted(text)).cast("string"), F.lit("")).alias("body")
    widths = lambda c: F.transform(c, F.char_length)
    kept = [f"kept_{i}" for i in range(len(inward))]
    assign, candidate = F.col("assign_any"), F.col("candidate_any")
    matched = documents.select(*inward, body).select(*kept, "body", *_flags()).select(
        *kept,
        _matches(ASSIGN, assign).alias("assign_text"),
        _matches(ASSIGN, assign, 2).alias("assign_value"),
        _skips(ASSIGN, assign).alias("assign_skips"),
        *[f(p, candidate).alias(f"{k}_{n}") for k, p in (("access", ACCESS), ("hex", HEX), ("candidate", CANDIDATE)) for f, n in ((_matches, "text"), (_skips, "skips"))],
    )
    placed = matched.select(
        *kept,
        *[F.col(f"{k}_text") for k in ("assign", "access", "hex", "candidate")],
        widths("assign_value").alias("value_widths"),
        F.transform("candidate_text", lambda s: kind_of(s, classes, allowed)).alias("candidate_kinds"),
        *[_positions(F.col(f"{k}_skips"), widths(f"{k}_text")).alias(f"{k}_at") for k in ("assign", "access", "hex", "candidate")],
    )
    order = [*BASE_KINDS, *[c.kind for c in classes]]
    rank = F.array(*[F.lit(k) for k in order])

    def spans(name: str, kind) -> Column:
        at = lambda i: F.get(F.col(f"{name}_at"), i)
        made = lambda s, i: F.struct(
            at(i)["start"].alias("start"), F.array_position(rank, kind(i)).alias("place"), kind(i).alias("kind"), at(i)["end"].alias("end"), s.alias("value")
        )
        return F.transform(f"{name}_text", made)

    listed = placed.select(
        *kept,
        F.filter(spans("assign", lambda i: F.when(F.get("value_widths", i) >= ASSIGN_VALUE, F.lit("assign"))), lambda s: s["kind"].isNotNull()).alias("assign"),
        spans("access", lambda i: F.lit("access")).alias("access"),
        spans("hex", lambda i: F.lit("hex")).alias("hex"),
        F.filter(spans("candidate", lambda i: F.get("candidate_kinds", i)), lambda s: s["kind"].isNotNull()).alias("more"),
    )
    joined = lambda found: F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.array_sort(F.concat("assign", "access", "hex"))
    every = F.array_sort(F.concat("assign", "access", "hex", "more"))
    return listed.select(
        *outward,
        *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(every).alias("spans"),
        F.transform(every, lambda s: F.struct(s["kind"], s["start"], s["end"], s["value"])).alias("found"),
    )
