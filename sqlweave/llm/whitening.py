"""Embedding whitening by exact spectra: the characteristic polynomial of the integer scatter matrix."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction
from math import comb, gcd, isqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqlweave.llm.columns import quoted
from sqlweave.session import materialise

# Residues of the polynomial are worked out modulo primes below 2^31, so that products fit 64 bits;
# PRIMES_AT_ONCE of them make one task.
PRIMES_AT_ONCE = 32
# Eigenvalues are known to this share of themselves before vectors are looked for; a group of
# eigenvalues nearer to each other than that counts as one eigenvalue of that multiplicity.
ROOT_BITS = 120
# Binary digits of the numbers that null vectors are worked out in.
VECTOR_BITS = 320


@dataclass(frozen=True)
class Settings:
    components: int = 8
    #: Components become floor(scale * c) + offset.
    scale: int = 1024
    offset: int = 100000
    #: Rows whose products one step of the scatter sums up.
    block_rows: int = 1024


# --- characteristic polynomial -------------------------------------------------------------------


def primes_below(limit: int, count: int) -> list[int]:
    """The `count` largest primes below `limit`, in falling order."""
    small = [q for q in range(3, isqrt(limit) + 1, 2) if all(q % r for r in range(3, isqrt(q) + 1, 2))] if count else []
    small = np.array(small)
    found, n = [], limit - 1 - limit % 2
    while len(found) < count:
        if (n % small).all():
            found.append(n)
        n -= 2
    return found


def hessenberg(matrix: np.ndarray, primes: np.ndarray) -> np.ndarray:
    """Upper Hessenberg matrices similar to `matrix` [prime, row, column] modulo each prime."""
    h, p = matrix.copy(), primes[:, None]
    each, d = np.arange(len(primes)), matrix.shape[1]
    for k in range(d - 2):
        # A row below the diagonal whose entry is not zero, where there is one, takes the place k + 1.
        pivot = k + 1 + np.argmax(h[:, k + 1 :, k] != 0, axis=1)
        h[each, k + 1], h[each, pivot] = h[each, pivot], h[each, k + 1].copy()
        h[each, :, k + 1], h[each, :, pivot] = h[each, :, pivot], h[each, :, k + 1].copy()
        inverse = np.array([pow(int(v), -1, int(q)) if v else 0 for v, q in zip(h[:, k + 1, k], primes)])
        factor = h[:, k + 2 :, k] * inverse[:, None] % p
        for start in range(0, factor.shape[1], 64):
            rows = slice(k + 2 + start, min(k + 2 + start + 64, d))
            h[:, rows] = (h[:, rows] - factor[:, start : start + 64, None] * h[:, None, k + 1] % p[:, :, None]) % p[:, :, None]
        # The inverse steps on the columns: column k + 1 gains factor times each column behind it.
        for i in range(factor.shape[1]):
            h[:, :, k + 1] = (h[:, :, k + 1] + factor[:, i, None] * h[:, :, k + 2 + i]) % p
    return h


def polynomial_residues(matrix: np.ndarray, primes: np.ndarray) -> np.ndarray:
    """Coefficients of det(xI - matrix), lowest first, modulo each prime: [prime, degree]."""
    h, p, d = hessenberg(matrix, primes), primes[:, None], matrix.shape[1]
    leading = np.zeros((d + 1, len(primes), d + 1), np.int64)
    leading[0, :, 0] = 1
    for k in range(1, d + 1):
        now = -h[:, k - 1, k - 1, None] * leading[k - 1]
        now[:, 1:] += leading[k - 1][:, :-1]
        now %= p
        below = np.ones((len(primes), 1), np.int64)
        for i in range(k - 1, 0, -1):
            below = below * h[:, i, i - 1, None] % p
            now = (now - below * h[:, i - 1, k - 1, None] % p * leading[i - 1]) % p
        leading[k] = now
    return leading[d]


def coefficient_bits(dims: int, trace: int) -> int:
    """Bits that every coefficient fits: of eigenvalues that are not negative and sum up to `trace`."""
    if not dims or not trace:
        return 1
    return max((comb(dims, k) * -(-(trace**k) // dims**k)).bit_length() for k in range(1, dims + 1)) + 1


def remaindered(residues: list[int], primes: list[int]) -> int:
    """The whole number around zero with these residues, by Chinese remaindering."""
    value, product = 0, 1
    for r, p in zip(residues, primes):
        value += product * ((r - value) * pow(product, -1, p) % p)
        product *= p
    return value if 2 * value < product else value - product


# --- roots ---------------------------------------------------------------------------------------


def roots_above(coefficients: list[int], at: Fraction) -> int:
    """Roots above `at`, each as often as it occurs, of a polynomial all of whose roots are real.

    By the rule of signs on the coefficients of p(x + at), exact for such polynomials.
    """
    d, q = len(coefficients) - 1, at.denominator
    shifted = [c * q ** (d - i) for i, c in enumerate(coefficients)]
    for i in range(d):
        for j in range(d - 1, i - 1, -1):
            shifted[j] += at.numerator * shifted[j + 1]
    signs = [c > 0 for c in shifted if c]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def _sign(coefficients: list[int], at: Fraction) -> int:
    total, power = 0, 1
    for c in reversed(coefficients):
        total = total * at.numerator + c * power
        power *= at.denominator
    return (total > 0) - (total < 0)


def largest_roots(coefficients: list[int], trace: int, wanted: int) -> list[tuple[Fraction, int]]:
    """(root, number) of the largest positive roots, falling, until `wanted` are found.

    Intervals are halved, and counted exactly, until they hold one root or are narrower than
    2^-ROOT_BITS of their place; one root alone is then narrowed by signs. All roots are real, not
    negative, and sum up to `trace`.
    """
    found: list[tuple[Fraction, int]] = []
    top = Fraction(1 << trace.bit_length())
    open_ones = [(Fraction(0), top, roots_above(coefficients, Fraction(0)), 0)]
    while open_ones and sum(n for _, n in found) < wanted:
        low, high, above_low, above_high = open_ones.pop()
        number = above_low - above_high
        if not number:
            continue
        middle = (low + high) / 2
        if (high - low) * (1 << ROOT_BITS) <= low:
            found.append((middle, number))
        elif number == 1 and low:
            # Half-open (low, high]: the root is at high, or signs differ around it.
            upper = _sign(coefficients, high)
            while upper and (high - low) * (1 << ROOT_BITS) > low:
                middle = (low + high) / 2
                here = _sign(coefficients, middle)
                if here == upper:
                    high = middle
                elif here:
                    low = middle
                else:
                    low, high, upper = middle, middle, 0
            found.append((high if not upper else (low + high) / 2, 1))
        else:
            above = roots_above(coefficients, middle)
            open_ones += [(low, middle, above_low, above), (middle, high, above, above_high)]
    return found


# --- vectors -------------------------------------------------------------------------------------


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * b) >> VECTOR_BITS


def _unit(v: np.ndarray) -> np.ndarray:
    """The vector at length one, in units of 2^-VECTOR_BITS."""
    # Its largest entry is brought to about one first, so that no digits are lost in the squares.
    most = max(abs(int(x)) for x in v).bit_length() - VECTOR_BITS
    v = v >> most if most > 0 else v << -most
    length = isqrt(sum(int(x) * int(x) for x in v))
    return np.array([(int(x) << VECTOR_BITS) // length for x in v], dtype=object)


def null_vectors(matrix: np.ndarray, root: Fraction, number: int, others: list[np.ndarray]) -> list[np.ndarray]:
    """`number` orthonormal eigenvectors of an integer matrix to the eigenvalue near `root`.

    Inverse iteration in fixed-point numbers: matrix - root * I is taken apart once, and every
    vector is kept at right angles to those found before it.
    """
    d, one = len(matrix), 1 << VECTOR_BITS
    size = max(1, max(abs(int(x)) for x in matrix.ravel()))
    lu = np.array([[(int(x) << VECTOR_BITS) // size for x in row] for row in matrix], dtype=object)
    shift = (root.numerator << VECTOR_BITS) // (root.denominator * size)
    for i in range(d):
        lu[i, i] -= shift
    order = list(range(d))
    for k in range(d):
        best = k + int(np.argmax([abs(int(x)) for x in lu[k:, k]]))
        if best != k:
            lu[[k, best]] = lu[[best, k]]
            order[k], order[best] = order[best], order[k]
        if not lu[k, k]:
            lu[k, k] = 1
        if k + 1 < d:
            lu[k + 1 :, k] = (lu[k + 1 :, k] << VECTOR_BITS) // lu[k, k]
            lu[k + 1 :, k + 1 :] = lu[k + 1 :, k + 1 :] - _times(lu[k + 1 :, k : k + 1], lu[k : k + 1, k + 1 :])

    def solve(v: np.ndarray) -> np.ndarray:
        x = v[order]
        for k in range(d - 1):
            x[k + 1 :] = x[k + 1 :] - _times(lu[k + 1 :, k], x[k])
        for k in range(d - 1, -1, -1):
            x[k] = (x[k] << VECTOR_BITS) // lu[k, k]
            if k:
                x[:k] = x[:k] - _times(lu[:k, k], x[k])
        return x

    def upright(v: np.ndarray, known: list[np.ndarray]) -> np.ndarray:
        for _ in range(2):
            for w in known:
                v = v - _times(np.array([sum(_times(v, w))] * d, dtype=object), w)
        return v

    found: list[np.ndarray] = []
    draw = np.random.default_rng(d)
    for _ in range(number):
        v = _unit(np.array([int(x) * one >> 20 for x in draw.integers(1 << 18, 1 << 20, d)], dtype=object))
        for _ in range(4):
            v = _unit(upright(solve(_unit(upright(v, others + found))), others + found))
        found.append(v)
    return found


def eigenpairs(matrix: np.ndarray, coefficients: list[int], wanted: int) -> list[tuple[Fraction, list[float]]]:
    """The `wanted` largest positive eigenvalues with unit vectors, largest first, the vector's largest entry positive."""
    trace = sum(int(matrix[i, i]) for i in range(len(matrix)))
    pairs: list[tuple[Fraction, np.ndarray]] = []
    for root, number in largest_roots(coefficients, trace, wanted) if trace else []:
        pairs += [(root, v) for v in null_vectors(matrix, root, number, [w for _, w in pairs])]
    signed = lambda v: v if v[int(np.argmax([abs(int(x)) for x in v]))] > 0 else -v
    return [(root, [float(Fraction(int(x), 1 << VECTOR_BITS)) for x in signed(v)]) for root, v in pairs[:wanted]]


# --- Spark ---------------------------------------------------------------------------------------


def scaled_rows(table: DataFrame, settings: Settings, id_column: str, vector: str) -> DataFrame:
    """(vec_id, dims, x) of the rows whose vector is whole and finite, with x in whole numbers."""
    v = F.col(quoted(vector)).cast("array<double>")
    sound = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    x = F.transform(v, lambda c: F.floor(c * settings.scale).cast("long") + settings.offset)
    return table.filter(v.isNotNull() & (F.size(v) > 0) & sound).select(F.col(quoted(id_column)).alias("vec_id"), F.size(v).alias("dims"), x.alias("x"))


def scatter_sums(rows: DataFrame, settings: Settings) -> DataFrame:
    """(dims, i, j, value) for each vector length: i = j = -1 the number of rows, j = -1 the sum of
    dimension i, and else the sum of products of dimensions i <= j, all after the offset is taken off.

    Sums are exact: rows are multiplied as doubles while products and sums stay below 2^53, else as
    whole numbers of any size. A task sums up its rows, and Spark the tasks.
    """

    def products(z: np.ndarray) -> np.ndarray:
        most = int(np.abs(z).max(initial=0))
        if most * most * settings.block_rows < 1 << 53:
            f = z.astype(np.float64)
            return (f.T @ f).astype(np.int64).astype(object)
        whole = z.astype(object)
        return whole.T @ whole

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list] = {}

        def rows_of() -> pd.DataFrame:
            out = []
            for dims, (n, sums, square) in held.items():
                out.append((dims, -1, -1, Decimal(n)))
                for i in range(dims):
                    out.append((dims, i, -1, Decimal(int(sums[i]))))
                    out += [(dims, i, j, Decimal(int(square[i, j]))) for j in range(i, dims)]
            held.clear()
            return pd.DataFrame(out, columns=["dims", "i", "j", "value"])

        for batch in batches:
            for dims, part in batch.groupby("dims"):
                x = np.stack(part["x"].to_numpy()).astype(np.int64) - settings.offset
                for start in range(0, len(x), settings.block_rows):
                    z = x[start : start + settings.block_rows]
                    n, sums, square = held.get(dims, (0, 0, 0))
                    held[dims] = (n + len(z), sums + z.astype(object).sum(0), square + products(z))
            # A task holds a few lengths at a time, however many there are.
            if sum(d * d for d in held) > 1 << 22:
                yield rows_of()
        if held:
            yield rows_of()

    parts = rows.select("dims", "x").mapInPandas(run, "dims int, i int, j int, value decimal(38,0)")
    return parts.groupBy("dims", "i", "j").agg(F.sum("value").cast("decimal(38,0)").alias("value"))


def _scatter(sums: pd.DataFrame) -> tuple[int, np.ndarray, np.ndarray, int]:
    """Number of rows n, sums s, and n * products - s s', divided by the greatest common divisor of its entries, with that."""
    dims = int(sums["dims"].iat[0])
    s, square, n = np.zeros(dims, dtype=object), np.zeros((dims, dims), dtype=object), 0
    for i, j, value in zip(sums["i"], sums["j"], sums["value"]):
        if i < 0:
            n = int(value)
        elif j < 0:
            s[i] = int(value)
        else:
            square[i, j] = square[j, i] = int(value)
    whole = n * square - s[:, None] * s[None, :]
    common = gcd(*[int(x) for x in whole.ravel()]) or 1
    return n, s, whole // common, common


def fit(rows: DataFrame, settings: Settings) -> DataFrame:
    """(dims, n, sums, component, e, explained, vector) of each vector length; component from 1.

    Covariance is scatter / n^2. Its characteristic polynomial is worked out modulo enough primes,
    a few of them a task, and put together by Chinese remaindering where the roots are looked for.
    """
    sums = materialise(scatter_sums(rows, settings))

    def plan(_: tuple, part: pd.DataFrame) -> pd.DataFrame:
        _, _, matrix, _ = _scatter(part)
        dims = len(matrix)
        bits = coefficient_bits(dims, sum(int(matrix[i, i]) for i in range(dims))) + 1
        return pd.DataFrame({"dims": [dims], "chunks": [-(-(bits // 30 + 1) // PRIMES_AT_ONCE)]})

    def residues(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        _, _, matrix, _ = _scatter(part)
        number = int(key[1])
        primes = primes_below(1 << 31, (number + 1) * PRIMES_AT_ONCE)[number * PRIMES_AT_ONCE :]
        moduli = np.array(primes, np.int64)
        reduced = np.stack([(matrix % p).astype(np.int64) for p in primes])
        return pd.DataFrame({"dims": len(matrix), "prime": moduli, "coefficients": list(polynomial_residues(reduced, moduli))})

    def solve(_: tuple, part: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        n, s, matrix, common = _scatter(part)
        dims, primes = len(matrix), [int(p) for p in found["prime"]]
        table = [[int(c) for c in row] for row in found["coefficients"]]
        coefficients = [remaindered([row[i] for row in table], primes) for i in range(dims + 1)]
        trace = sum(int(matrix[i, i]) for i in range(dims))
        out = defaultdict(list)
        for number, (root, v) in enumerate(eigenpairs(matrix, coefficients, settings.components), start=1):
            for name, value in (
                ("dims", dims), ("n", n), ("sums", [int(x) + n * settings.offset for x in s]), ("component", number),
                ("e", float(root * common / (n * n))), ("explained", float(root / trace)), ("vector", v),
            ):
                out[name].append(value)
        return pd.DataFrame(out, columns=["dims", "n", "sums", "component", "e", "explained", "vector"])

    chunks = sums.groupBy("dims").applyInPandas(plan, "dims int, chunks int")
    dealt = sums.join(chunks, "dims").select("dims", "i", "j", "value", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    polynomials = materialise(dealt.groupBy("dims", "chunk").applyInPandas(residues, "dims int, prime long, coefficients array<long>"))
    return materialise(
        sums.groupBy("dims").cogroup(polynomials.groupBy("dims"))
        .applyInPandas(solve, "dims int, n long, sums array<long>, component int, e double, explained double, vector array<double>")
    )


def _identity_error(whitened: DataFrame, components: int) -> DataFrame:
    """(dims, identity_error): the largest entry of the covariance of `w` less the identity, by vector length."""
    w = lambda i: F.get("w", F.lit(i))
    entries = [
        F.abs(F.covar_pop(w(i), w(j)) - float(i == j)) for i in range(components) for j in range(i, components)
    ]
    return whitened.groupBy("dims").agg(F.array_max(F.array(*entries)).alias("identity_error"))


def whiten(table: DataFrame, settings: Settings = Settings(), id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error, e, deviation_digits).

    The rows whose vector is neither null nor empty and whose entries are all finite are the fit list
    and are whitened: one row for each of them and component, the components being the eigenvectors of
    the covariance to its largest eigenvalues e, `components` at most. Vectors become whole numbers first,
    so that sums, scatter and characteristic polynomial are exact, and eigenvalues and vectors are right to the last
    digits of a double; of a multiple eigenvalue any orthonormal vectors are taken.
    `deviation` is the exact sum of squares of n * x - sums, null where that exceeds 64 bits; its digits
    are always in `deviation_digits`.

    Each vector length is a fit list of its own. Components whose eigenvalue is zero do not exist: a
    length with r such dimensions of variance has r components, and rows all alike have none and are not in the result.
    Null ids and repeated rows count and come out like any other; ties of eigenvalues are numbered in the
    order they are found. Other columns are not looked at, and an empty table gives an empty result.
    Components beyond 64 bits once scaled raise an error.
    """
    rows = materialise(scaled_rows(table, settings, id_column, vector))
    model = fit(rows, settings)
    ordered = F.array_sort(F.collect_list(F.struct("component", "e", "explained", "vector")))
    models = materialise(model.groupBy("dims", "n", "sums").agg(ordered.alias("found")))
    off = F.zip_with("x", "sums", lambda x, s: F.col("n") * x - s)
    centred = rows.join(models, "dims").select("vec_id", "dims", "n", "found", off.alias("off"))
    near = F.transform("off", lambda d: d / F.col("n"))
    square = F.aggregate("off", F.lit(0.0), lambda acc, d: acc + d.cast("double") * d.cast("double"))
    dot: Column = F.transform("found", lambda c: F.aggregate(F.zip_with("near", c["vector"], lambda a, b: a * b), F.lit(0.0), lambda acc, y: acc + y) / F.sqrt(c["e"]))
    whole = F.aggregate("off", F.lit(0).cast("long"), lambda acc, d: acc + d * d)
    wide = F.aggregate("off", F.lit(0).cast("decimal(38,0)"), lambda acc, d: (acc + d.cast("decimal(19,0)") * d.cast("decimal(19,0)")).cast("decimal(38,0)"))
    fits = F.col("square") < 9.2e18
    measured = centred.select("vec_id", "dims", "n", "found", "off", near.alias("near"), square.alias("square")).select(
        "vec_id", "dims", "n", dot.alias("w"), F.when(fits, whole).alias("deviation"), F.when(~fits, wide).cast("string").alias("digits")
    )
    whitened = materialise(measured)
    error = _identity_error(whitened, settings.components)
    told = F.explode(F.transform("found", lambda c: F.struct(c["component"], c["e"], c["explained"])))
    facts = models.select("dims", told.alias("c")).select("dims", "c.component", "c.e", "c.explained").join(error, "dims")
    listed = whitened.select("vec_id", "dims", "n", "deviation", F.coalesce("digits", F.col("deviation").cast("string")).alias("deviation_digits"), F.posexplode("w").alias("at", "whitened"))
    return listed.join(facts, (listed["dims"] == facts["dims"]) & (listed["at"] + 1 == facts["component"])).select(
        "vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "e", "deviation_digits"
    )
