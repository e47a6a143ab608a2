import math
import random
from fractions import Fraction

import numpy as np
import pytest

from marginalia.llm import whitening
from marginalia.llm.whitening import characteristic_polynomial, components, largest_roots, null_space, primes_beyond, products, roots_above, whiten

SCHEMA = "vec_id long, embedding array<float>, label int, vector string, component string, n long"


def table(spark, vectors):
    return spark.createDataFrame([(i, v, 1, "v", "c", 9) for i, v in vectors], SCHEMA)


def vectors(seed, count, dimension, rank=None):
    rng = np.random.default_rng(seed)
    mix = rng.normal(size=(rank or dimension, dimension))
    return [[float(np.float32(x)) for x in line] for line in rng.normal(size=(count, rank or dimension)) @ mix]


def polynomial(matrix):
    """By Faddeev and LeVerrier, in fractions."""
    d = len(matrix)
    m, c = [[Fraction(0)] * d for _ in range(d)], [Fraction(1)]
    for k in range(1, d + 1):
        m = [[sum(matrix[i][t] * m[t][j] for t in range(d)) + (c[-1] if i == j else 0) for j in range(d)] for i in range(d)]
        c.append(-sum(matrix[i][t] * m[t][i] for i in range(d) for t in range(d)) / k)
    return [int(v) for v in reversed(c)]


def check(got, rows, most=32):
    """All columns against the definition, with numpy's eigenvectors."""
    good = [(i, [math.floor(64 * float(np.float32(e))) + 1_000_000 for e in v]) for i, v in rows]
    x = np.array([v for _, v in good], object)
    n, d = x.shape
    sums = x.sum(axis=0)
    away = n * x - sums
    centred = (away / n).astype(float)
    covariance = centred.T @ centred / n
    values, lines = np.linalg.eigh(covariance)
    values, lines = values[::-1], lines[:, ::-1]
    per = {}
    for r in got:
        per.setdefault(r["component"], []).append(r)
        assert r["n"] == n and abs(r["identity_error"]) < 1e-9
    assert sorted(per) == list(range(1, min(most, int((values > 1e-9 * values[0]).sum())) + 1))
    for k, own in per.items():
        assert abs(own[0]["explained"] - values[k - 1] / np.trace(covariance)) < 1e-12
        want = centred @ lines[:, k - 1] / np.sqrt(values[k - 1])
        known = sorted((str(r["vec_id"]), int(r["deviation"]), r["whitened"]) for r in own)
        sign = 1 if sum(a * w for a, w in zip([r["whitened"] for r in sorted(own, key=lambda r: (str(r["vec_id"]), int(r["deviation"])))], [w for _, w in sorted(zip([(str(i), int((a * a).sum())) for (i, _), a in zip(good, away)], want))])) > 0 else -1
        expected = sorted((str(i), int((a * a).sum()), sign * w) for (i, _), a, w in zip(good, away, want))
        assert [(a, b) for a, b, _ in known] == [(a, b) for a, b, _ in expected]
        assert np.allclose([c for *_, c in known], [c for *_, c in expected], atol=1e-7)


def test_against_numpy(spark):
    rows = list(enumerate(vectors(1, 300, 12))) + [(None, vectors(2, 1, 12)[0]), (3, vectors(3, 1, 12)[0])]
    odd = [(900, None), (901, []), (902, [1.0] * 11 + [None]), (903, [float("nan")] * 12), (904, [float("inf")] + [0.0] * 11), (905, [1.0] * 5)]
    check(whiten(table(spark, rows + odd).repartition(5)).collect(), rows)


def test_more_dimensions_than_components(spark):
    rows = list(enumerate(vectors(4, 120, 40)))
    check(whiten(table(spark, rows)).collect(), rows)


def test_without_rank(spark):
    """Five directions in nine dimensions would round to full rank, so entries are multiples of 1/64."""
    rng = np.random.default_rng(5)
    mix = rng.integers(-3, 4, (5, 9))
    rows = [(i, [float(x) / 64 for x in line]) for i, line in enumerate(rng.integers(-20, 20, (80, 5)) @ mix)]
    check(whiten(table(spark, rows)).collect(), rows)


def test_degenerate(spark):
    assert whiten(table(spark, [])).collect() == []
    assert whiten(table(spark, [(1, None), (2, [])])).collect() == []
    assert whiten(table(spark, [(1, [1.0, 2.0])])).collect() == []
    assert whiten(table(spark, [(i, [1.0, 2.0]) for i in range(5)])).collect() == []
    line = whiten(table(spark, [(1, [0.0, 5.0]), (2, [1.0, 5.0])])).collect()
    assert sorted((r["vec_id"], r["component"], int(r["deviation"]), r["whitened"], r["explained"]) for r in line) == [(1, 1, 4096, -1.0, 1.0), (2, 1, 4096, 1.0, 1.0)]
    huge = whiten(table(spark, [(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (3, [0.0, 2.0])])).collect()
    assert len(huge) == 6 and all(r["identity_error"] < 1e-9 for r in huge)


def test_equal_eigenvalues(spark):
    """A cross of six vectors: all three eigenvalues are one, any basis whitens."""
    rows = [(2 * i + k, [s * float(i == j) for j in range(3)]) for i in range(3) for k, s in enumerate((1.0, -1.0))]
    got = whiten(table(spark, rows)).collect()
    assert len(got) == 18 and all(abs(r["explained"] - 1 / 3) < 1e-12 and r["identity_error"] < 1e-12 for r in got)


@pytest.mark.parametrize("largest", [50, 10**9, 10**15])
def test_products_are_exact(largest, monkeypatch):
    monkeypatch.setattr(whitening, "ROWS", 16)
    values = np.array([[random.Random(largest + 7 * i + j).randrange(-largest, largest) for j in range(4)] for i in range(70)])
    want = values.astype(object).T @ values.astype(object)
    assert (products(values) == want).all()


@pytest.mark.parametrize("seed", range(4))
def test_polynomial_and_roots(spark, seed):
    rng = np.random.default_rng(seed)
    half = rng.integers(-40, 40, (8, 8 if seed else 5)).astype(object)
    if seed == 1:
        half[:, 3] = 0
    matrix = half @ half.T
    found = characteristic_polynomial(spark, matrix)
    assert found == polynomial([[Fraction(int(v)) for v in line] for line in matrix])
    values = np.linalg.eigvalsh(matrix.astype(float))[::-1]
    positive = [v for v in values if v > 1e-6]
    roots = largest_roots(found, 8)
    assert np.allclose([float(r) for r, k in roots for _ in range(k)], positive, rtol=1e-9)
    assert roots_above(found, 0, 0) == len(positive)
    exact, lines = components(spark, matrix, 8)
    for root, line in zip(exact, lines):
        assert np.abs(matrix.astype(float) @ line - float(root) * line).max() < 1e-9 * float(exact[0])


def test_repeated_roots():
    """(x - 2) ** 3 (x - 5) (x - 7) ** 2 x: counted with their multiplicity."""
    poly = [1]
    for root in (2, 2, 2, 5, 7, 7, 0):
        poly = [a - root * b for a, b in zip([0, *poly], [*poly, 0])]
    assert [(round(float(r), 12), k) for r, k in largest_roots(poly, 10)] == [(7, 2), (5, 1), (2, 3)]
    assert [k for _, k in largest_roots(poly, 3)] == [2, 1]


def test_close_roots():
    """Eigenvalues that doubles cannot tell apart have vectors of their own."""
    big = 10**40
    matrix = np.array([[big, 1, 0], [1, big, 0], [0, 0, 3]], object)
    poly = polynomial([[Fraction(int(v)) for v in line] for line in matrix])
    roots = largest_roots(poly, 3)
    assert [(r, k) for r, k in roots[2:]] == [(3, 1)] or abs(float(roots[2][0]) - 3) < 1e-12
    assert float(roots[0][0] - roots[1][0]) == 2.0
    first, second = (null_space(matrix, r, 1)[0] for r, _ in roots[:2])
    assert (first[0] > 0) == (first[1] > 0) and (second[0] > 0) != (second[1] > 0)


def test_primes():
    found = primes_beyond(10**40)
    assert math.prod(found) > 10**40 and all(p < 2**31 and all(p % q for q in range(2, 2000)) for p in found)
