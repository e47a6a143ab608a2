"""Embedding whitening by the exact characteristic polynomial of the scatter (operator 12).

Entries become integers, so the sums and products of the whole table are integers and exact: tasks add up their rows'
products, Spark adds up the tasks' sums, and the driver gets one number per pair of dimensions.  M = n * sum(x x') - S S'
is n * n times the covariance.

- M's characteristic polynomial: reduction to Hessenberg form modulo primes below 2**31, as many as its coefficients
  need by Maclaurin's inequality, and Chinese remaindering.  The primes are shared out to tasks.
- Its roots are all real, so the sign changes of the polynomial shifted by a are exactly its roots above a (Descartes).
  Bisection on these counts isolates the largest roots, bisection on exact signs narrows each to PRECISION bits.
- Components: inverse iteration with M - root, a matrix all but singular, in fixed-point integers of DIGITS bits.  Roots
  not apart at PRECISION bits are one eigenvalue of that multiplicity, whose components are made orthogonal.

The matrix has d * d entries for d dimensions and the driver holds it; d is the length of the vectors, not of the table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.common import in_arrow, stored

SCALE, OFFSET = 64, 1_000_000
MOST = 2**62  # a scaled entry beyond is cut to it
COMPONENTS = 32
PRECISION, DIGITS, ROUNDS = 160, 512, 3
LIMB, ROWS = 20, 8192  # products of limbs, summed over ROWS rows, are exact in doubles
PART = 31  # bits of a part of a sum on its way through Spark
TASKS = 32

RESULT = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


# --- exact sums ------------------------------------------------------------------------------------------------------


def scaled(batch: pa.RecordBatch, dimension: int) -> np.ndarray:
    """floor(SCALE * entry) of the vectors of a batch, a line each."""
    entries = batch.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimension)
    with np.errstate(over="ignore"):
        return np.clip(np.floor(SCALE * entries), -float(MOST), float(MOST)).astype(np.int64)


def products(values: np.ndarray) -> np.ndarray:
    """Sum over the lines of their products, as Python integers."""
    dimension = values.shape[1]
    total = np.zeros((dimension, dimension), object)
    for at in range(0, len(values), ROWS):
        rest, limbs = values[at : at + ROWS], []
        while True:
            low = rest & ((1 << LIMB) - 1) if np.abs(rest).max(initial=0) >= 1 << LIMB else rest
            limbs.append(low.astype(np.float64))
            if low is rest:
                break
            rest = (rest - low) >> LIMB
        for i, a in enumerate(limbs):
            for j, b in enumerate(limbs):
                total += (a.T @ b).astype(np.int64).astype(object) << (LIMB * (i + j))
    return total


def in_parts(value: int) -> list[int]:
    """Base 2**PART digits, the last one signed."""
    parts = []
    while not -(1 << PART) < value < 1 << PART:
        parts.append(value & ((1 << PART) - 1))
        value >>= PART
    return [*parts, value]


def moments(rows: DataFrame, dimension: int) -> tuple[int, list[int], np.ndarray]:
    """(number of vectors, sums of the scaled entries, sums of their products)."""
    upper = np.triu_indices(dimension)

    def summed(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums, squares = 0, np.zeros(dimension, object), np.zeros((dimension, dimension), object)
        for batch in stream:
            values = scaled(batch, dimension)
            count += len(values)
            sums = sums + (values >> 31).sum(axis=0, dtype=np.int64).astype(object) * 2**31 + (values & (2**31 - 1)).sum(axis=0, dtype=np.int64).astype(object)
            squares = squares + products(values)
        numbers = [int(v) for v in [count, *sums, *squares[upper]]]
        lines = [(cell, k, part) for cell, value in enumerate(numbers) for k, part in enumerate(in_parts(value))]
        cells, ks, parts = zip(*lines, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array(ks, pa.int32()), pa.array(parts, pa.int64())], names=["cell", "k", "part"])

    found = in_arrow(rows.select("vector"), summed, "cell int, k int, part long").groupBy("cell", "k").agg(F.sum("part").alias("part"))
    numbers = [0] * (1 + dimension + len(upper[0]))
    for cell, k, part in found.collect():
        numbers[cell] += int(part) << (PART * k)
    squares = np.zeros((dimension, dimension), object)
    squares[upper] = numbers[1 + dimension :]
    squares.T[upper] = numbers[1 + dimension :]
    return numbers[0], numbers[1 : 1 + dimension], squares


# --- characteristic polynomial ---------------------------------------------------------------------------------------


def is_prime(n: int) -> bool:
    """Miller-Rabin; these bases decide it for all n below 3.2e9."""
    if n < 11 or n % 2 == 0:
        return n in (2, 3, 5, 7)
    twos = ((n - 1) & -(n - 1)).bit_length() - 1
    for base in (2, 3, 5, 7):
        x = pow(base, (n - 1) >> twos, n)
        if x not in (1, n - 1) and not any((x := x * x % n) == n - 1 for _ in range(twos - 1)):
            return False
    return True


def primes_beyond(bound: int) -> list[int]:
    """Primes below 2**31 whose product is beyond ``bound``."""
    found, product, n = [], 1, 2**31 - 1
    while product <= bound:
        if is_prime(n):
            found.append(n)
            product *= n
        n -= 2
    return found


def polynomial_modulo(matrix: np.ndarray, p: int) -> np.ndarray:
    """Coefficients of det(x - matrix) modulo ``p``, the constant first; ``matrix`` has entries below p < 2**31."""
    h, d = matrix.astype(np.int64), len(matrix)
    for j in range(d - 2):
        below = np.nonzero(h[j + 1 :, j])[0]
        if not len(below):
            continue
        pivot = j + 1 + below[0]
        h[[j + 1, pivot]] = h[[pivot, j + 1]]
        h[:, [j + 1, pivot]] = h[:, [pivot, j + 1]]
        factors = h[j + 2 :, j] * pow(int(h[j + 1, j]), -1, p) % p
        h[j + 2 :] = (h[j + 2 :] - factors[:, None] * h[j + 1][None, :]) % p
        h[:, j + 1] = (h[:, j + 1] + (h[:, j + 2 :] * factors[None, :] % p).sum(axis=1)) % p
    # The polynomials of the leading blocks, each from those before it along the subdiagonal.
    leading = np.zeros((d + 1, d + 1), np.int64)
    leading[0, 0] = 1
    for k in range(d):
        leading[k + 1, 1:] = leading[k, :-1]
        leading[k + 1] = (leading[k + 1] - h[k, k] * leading[k]) % p
        weight, weights = 1, np.zeros(k, np.int64)
        for i in range(k - 1, -1, -1):
            weight = weight * int(h[i + 1, i]) % p
            weights[i] = weight * int(h[i, k]) % p
        if k:
            leading[k + 1] = (leading[k + 1] - (weights[:, None] * leading[:k] % p).sum(axis=0)) % p
    return leading[d]


def characteristic_polynomial(spark: SparkSession, matrix: np.ndarray) -> list[int]:
    """Coefficients of det(x - matrix), the constant first, of a symmetric ``matrix`` without negative eigenvalues."""
    d, trace = len(matrix), int(np.trace(matrix))
    # The k-th elementary symmetric sum of the eigenvalues is at most C(d, k) (trace / d) ** k.
    bound = max(math.comb(d, k) * (trace // d + 1) ** k for k in range(d + 1))
    primes = primes_beyond(bound)

    def reduced(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            lines = [polynomial_modulo(matrix % p, p).tolist() for p in batch.column("prime").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("prime"), pa.array(lines, pa.list_(pa.int64()))], names=["prime", "coefficients"])

    asked = spark.createDataFrame([(p,) for p in primes], "prime long").repartition(min(TASKS, len(primes)))
    found = {r["prime"]: r["coefficients"] for r in asked.mapInArrow(reduced, "prime long, coefficients array<long>").collect()}
    product = math.prod(primes)
    weights = {p: product // p * pow(product // p, -1, p) for p in primes}
    signless = [sum(weights[p] * (found[p][k] if (d - k) % 2 == 0 else -found[p][k]) for p in primes) % product for k in range(d + 1)]
    return [c if (d - k) % 2 == 0 else -c for k, c in enumerate(signless)]


# --- roots -----------------------------------------------------------------------------------------------------------


def stretched(coefficients: list[int], s: int) -> list[int]:
    """The polynomial whose roots are 2**s times as large."""
    d = len(coefficients) - 1
    return [c << (s * (d - k)) for k, c in enumerate(coefficients)]


def roots_above(coefficients: list[int], place: int, s: int) -> int:
    """How many roots, by multiplicity, lie above place / 2**s; all roots are real."""
    shifted = stretched(coefficients, s)[::-1]
    for upto in range(len(shifted), 1, -1):
        for k in range(1, upto):
            shifted[k] += place * shifted[k - 1]
    signs = [c > 0 for c in shifted if c]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def sign_at(coefficients: list[int], place: int, s: int) -> int:
    total = 0
    for k, c in enumerate(reversed(coefficients)):
        total = total * place + (c << (s * k))
    return (total > 0) - (total < 0)


def largest_roots(coefficients: list[int], most: int, precision: int = PRECISION) -> list[tuple[Fraction, int]]:
    """(root, multiplicity), falling, until ``most`` roots above zero are known; each to ``precision`` bits."""
    top = max(1, -coefficients[-2]).bit_length()
    found: list[tuple[Fraction, int]] = []
    # Open to the left: roots in (low, high] / 2**s, and how many lie above each end.
    waiting = [(0, 1 << top, 0, roots_above(coefficients, 0, 0), 0)]
    while waiting:
        low, high, s, above_low, above_high = waiting.pop()
        if above_low == above_high or above_high >= most:
            continue
        if above_low - above_high == 1:
            found.append((_narrowed(coefficients, low, high, s, above_high, precision), 1))
        elif (high - low) << precision <= high:
            found.append((Fraction(low + high, 2 << s), above_low - above_high))
        else:
            middle = low + high
            above = roots_above(coefficients, middle, s + 1)
            waiting += [(2 * low, middle, s + 1, above_low, above), (middle, 2 * high, s + 1, above, above_high)]
    return found


def _narrowed(coefficients: list[int], low: int, high: int, s: int, above: int, precision: int) -> Fraction:
    """The one root in (low, high] / 2**s: right of it the sign is that of ``above`` roots to the right."""
    right = -1 if above % 2 else 1
    if sign_at(coefficients, high, s) == 0:
        return Fraction(high, 1 << s)
    while (high - low) << precision > high:
        low, high, s = 2 * low, 2 * high, s + 1
        middle = (low + high) // 2
        sign = sign_at(coefficients, middle, s)
        if sign == 0:
            return Fraction(middle, 1 << s)
        if sign == right:
            high = middle
        else:
            low = middle
    return Fraction(low + high, 2 << s)


# --- components ------------------------------------------------------------------------------------------------------


def _unit(vector: np.ndarray) -> np.ndarray:
    """``vector`` of length 1 in fixed point."""
    length = math.isqrt(sum(int(v) ** 2 for v in vector))
    return np.array([(int(v) << DIGITS) // length for v in vector], object)


def null_space(matrix: np.ndarray, root: Fraction, count: int) -> np.ndarray:
    """``count`` unit vectors that ``matrix`` - ``root`` sends to about zero, orthogonal, a line each."""
    d, shift = len(matrix), int(np.trace(matrix)).bit_length()
    a = np.array([[(int(v) << DIGITS) >> shift for v in line] for line in matrix], object)
    level = (root.numerator << DIGITS) // (root.denominator << shift)
    for i in range(d):
        a[i, i] -= level
    order = np.arange(d)
    for k in range(d):
        pivot = k + max(range(d - k), key=lambda i: abs(a[k + i, k]))
        a[[k, pivot]], order[[k, pivot]] = a[[pivot, k]], order[[pivot, k]]
        a[k, k] = a[k, k] or 1
        a[k + 1 :, k] = (a[k + 1 :, k] << DIGITS) // a[k, k]
        a[k + 1 :, k + 1 :] -= (a[k + 1 :, k][:, None] * a[k, k + 1 :][None, :]) >> DIGITS

    def solved(vector: np.ndarray) -> np.ndarray:
        x = vector[order]
        for k in range(1, d):
            x[k] -= int((a[k, :k] * x[:k]).sum()) >> DIGITS
        for k in range(d - 1, -1, -1):
            x[k] = ((int(x[k]) << DIGITS) - (int((a[k, k + 1 :] * x[k + 1 :]).sum()) if k + 1 < d else 0)) // a[k, k]
        return x

    rng = np.random.default_rng(12)
    lines: list[np.ndarray] = []
    for _ in range(count):
        vector = _unit(np.array([int(v) << DIGITS for v in rng.integers(1, 1 << 20, d)], object))
        for _ in range(ROUNDS):
            vector = _unit(solved(vector))
            for other in lines:
                vector = vector - ((int((vector * other).sum()) >> DIGITS) * other >> DIGITS)
            vector = _unit(vector)
        lines.append(vector)
    return np.stack(lines)


def components(spark: SparkSession, matrix: np.ndarray, most: int) -> tuple[list[Fraction], np.ndarray]:
    """(eigenvalues above zero, falling, at most ``most``; their unit eigenvectors as doubles, a line each).

    The largest entry of each eigenvector is positive.
    """
    divisor = math.gcd(*(int(v) for v in matrix.flat))
    d = len(matrix)
    if not divisor:
        return [], np.zeros((0, d))
    reduced = matrix // divisor
    roots = largest_roots(characteristic_polynomial(spark, reduced), most)

    def solve(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            place, lines = [], []
            for i in batch.column("place").to_pylist():
                for vector in null_space(reduced, *roots[i]):
                    place.append(i)
                    lines.append([float(Fraction(int(v), 1 << DIGITS)) for v in vector])
            yield pa.RecordBatch.from_arrays([pa.array(place, pa.int64()), pa.array(lines, pa.list_(pa.float64()))], names=["place", "line"])

    asked = spark.range(len(roots)).select(F.col("id").alias("place")).repartition(min(TASKS, len(roots)), "place")
    found = sorted((r["place"], i, r["line"]) for i, r in enumerate(asked.mapInArrow(solve, "place long, line array<double>").collect()))[:most]
    vectors = np.array([line for _, _, line in found])
    signs = np.sign(vectors[np.arange(len(vectors)), np.abs(vectors).argmax(axis=1)])
    return [roots[place][0] * divisor for place, _, _ in found], vectors * signs[:, None]


# --- whitening -------------------------------------------------------------------------------------------------------


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> tuple[DataFrame, int]:
    """(rows (vec_id, vector) without null or non-finite entries, of the commonest length; that length)."""
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda e: F.coalesce(F.abs(e) < float("inf"), F.lit(False)))
    rows = rows.filter(F.col("vector").isNotNull() & (F.size("vector") > 0)).filter(finite & ~F.exists("vector", F.isnan))
    lengths = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    dimension = lengths["d"] if lengths else 0
    return rows.filter(F.size("vector") == dimension), dimension


class Whitening:
    """The transform fitted on all usable ``rows``; tasks get a copy of it."""

    def __init__(self, rows: DataFrame, dimension: int, most: int = COMPONENTS):
        self.dimension = dimension
        self.n, self.sums, squares = moments(rows, dimension)
        scatter = np.array([[self.n * int(squares[i, j]) - a * b for j, b in enumerate(self.sums)] for i, a in enumerate(self.sums)], object)
        self.trace = int(np.trace(scatter))
        self.eigenvalues, self.vectors = components(rows.sparkSession, scatter, most)
        self.scales = np.array([math.sqrt(Fraction(e) / self.n**2) for e in self.eigenvalues])
        self.explained = [float(Fraction(e) / self.trace) for e in self.eigenvalues]

    def transform(self, values: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """(whitened coordinates of the lines of ``values``, their exact deviations)."""
        sums = np.array(self.sums, object)
        largest = self.n * int(np.abs(values).max(initial=0)) + max(abs(int(s)) for s in self.sums)
        if self.dimension * largest**2 < 2**63:
            away = self.n * values - sums.astype(np.int64)
        else:
            away = self.n * values.astype(object) - sums
        centred = (away / self.n).astype(np.float64)
        return centred @ self.vectors.T / self.scales, (away * away).sum(axis=1).tolist()

    def identity_error(self, rows: DataFrame) -> float:
        """Largest entry of the covariance of the whitened ``rows`` minus the identity, from the rows themselves."""
        k, upper = len(self.vectors), np.triu_indices(len(self.vectors))

        def summed(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums, squares = np.zeros(k), np.zeros((k, k))
            for batch in stream:
                white = self.transform(scaled(batch, self.dimension))[0]
                sums += white.sum(axis=0)
                squares += white.T @ white
            values = np.concatenate([sums, squares[upper]])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values)], names=["cell", "value"])

        found = in_arrow(rows.select("vector"), summed, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value"))
        numbers = np.array([v for _, v in sorted(tuple(r) for r in found.collect())]) / self.n
        covariance = np.zeros((k, k))
        covariance[upper] = numbers[k:]
        return float(np.abs(covariance - np.triu(np.outer(numbers[:k], numbers[:k])) - np.eye(k)).max())

    def apply(self, rows: DataFrame) -> DataFrame:
        error = self.identity_error(rows)

        def whitened(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in stream:
                white, deviations = self.transform(scaled(batch, self.dimension))
                texts = [str(d) for d in deviations]
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(texts, pa.string()), pa.array(list(white), pa.list_(pa.float64()))], names=["vec_id", "deviation", "white"])

        found = in_arrow(rows, whitened, "vec_id long, deviation string, white array<double>")
        spread = found.select("vec_id", F.col("deviation").try_cast("decimal(38,0)").alias("deviation"), F.posexplode("white").alias("place", "whitened"))
        explained = F.element_at(F.array(*[F.lit(e) for e in self.explained]), F.col("place") + 1)
        return spread.select(
            "vec_id", (F.col("place") + 1).alias("component"), F.lit(self.n).cast("long").alias("n"), "deviation", "whitened",
            explained.alias("explained"), F.lit(error).alias("identity_error"),
        )


def whiten(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """A row per usable row of ``vectors`` and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Usable are rows whose vector has no null, infinite or NaN entry and the commonest length (of equally common ones the
    longest); all others are left out, also empty vectors.  Entries are worked on as floor(64 * entry) + 1 000 000, those
    beyond 2**62 as 2**62.  ``n`` is the number of usable rows, ``deviation`` the exact sum of (n x - S) ** 2, null if it
    has more than 38 digits.  Eigenvalues of zero have no component, so vectors that are all alike, a single one, and an
    empty table give no rows.  Components of an eigenvalue that occurs more than once are some orthogonal basis.  Repeated
    rows and null ids stay.  Further columns are ignored.
    """
    spark = vectors.sparkSession
    rows, dimension = usable(vectors, id_column, vector_column)
    if dimension:
        rows = stored(rows, "vectors")
        fitted = Whitening(rows, dimension, most)
        if fitted.eigenvalues:
            return fitted.apply(rows)
    return spark.createDataFrame([], RESULT)
