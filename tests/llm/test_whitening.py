"""Whitening against dense eigenvectors, plain exact polynomials and awkward spectra."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from quire.llm import whitening as W


def plain_characteristic(m):
    """Faddeev-LeVerrier over fractions, constant term first."""
    d = len(m)
    b, out = [[Fraction(0)] * d for _ in range(d)], [Fraction(1)]
    for k in range(1, d + 1):
        b = [[sum(m[i][x] * b[x][j] for x in range(d)) + (out[-1] if i == j else 0) for j in range(d)] for i in range(d)]
        out.append(-sum(m[i][x] * b[x][i] for i in range(d) for x in range(d)) / k)
    return [int(c) for c in reversed(out)]


def scatter_of(rows):
    n, d = len(rows), len(rows[0])
    s = [sum(r[i] for r in rows) for i in range(d)]
    return s, [[n * sum(r[i] * r[j] for r in rows) - s[i] * s[j] for j in range(d)] for i in range(d)]


@pytest.mark.parametrize("seed", range(4))
def test_polynomial(seed):
    r = random.Random(seed)
    d = r.randint(1, 7)
    # Zeros in the matrix make pivots fail.
    _, m = scatter_of([[r.choice([0, 0, r.randint(-50, 50)]) for _ in range(d)] for _ in range(6)])
    of_prime = {p: W.polynomial_modulo(m, p) for p in W.primes(2 * math.prod(1 + m[i][i] for i in range(d)))}
    assert W.join_residues(of_prime) == plain_characteristic(m)


def polynomial_of(roots):
    out = [1]
    for r in roots:
        out = [a - r * b for a, b in zip([0, *out], [*out, 0])]
    return out


def test_roots_close_repeated_and_on_the_grid():
    roots = [7, 7, 7, 10**12, 10**12 + 1, 5, 1, 64]
    poly = polynomial_of(roots)
    simple = W.simple_part(poly)
    assert simple == polynomial_of(sorted(set(roots)))
    found = W.largest_roots(poly, simple, 100)
    near = [r.narrow(simple, 40) for r in found]
    assert [(r.high / 2**40, r.times) for r in near] == [(10**12 + 1, 1), (10**12, 1), (64, 1), (7, 3), (5, 1), (1, 1)]
    assert sum(r.times for r in W.largest_roots(poly, simple, 4)) >= 4
    # x^2 - 3x + 1: irrational roots to 100 bits.
    root = W.largest_roots([1, -3, 1], [1, -3, 1], 1)[0].narrow([1, -3, 1], 100)
    assert abs(Fraction(root.high, 2**100) - Fraction(3 * 2**120 + math.isqrt(5 * 2**240), 2**121)) < Fraction(1, 2**99)


def covered(spark, vectors, most=32):
    table = spark.createDataFrame(vectors, "vec_id bigint, embedding array<double>, y string")
    rows = W.integral(table)
    model = W.fit_whitening(rows, most)
    return model, W.whiten(rows, model).collect(), W.identity_error(rows, model)


def test_equal_eigenvalues(spark):
    vectors = [(i, [float(s if i // 2 == k else 0) for k in range(4)] + [0.0], "x") for i in range(8) for s in [(-1) ** i]]
    model, rows, error = covered(spark, vectors)
    # Four directions of one eigenvalue, one of none.
    assert len(model.roots) == 4 and len(set(model.roots)) == 1 and all(abs(e - 0.25) < 1e-15 for e in model.explained)
    axes = np.array(model.axes)
    assert np.abs(axes @ axes.T - np.eye(4)).max() < 1e-15 and error < 1e-14


def test_fewer_rows_than_dimensions_and_huge_entries(spark):
    r = random.Random(5)
    vectors = [(i, [r.uniform(-1, 1) * 10.0 ** r.choice([0, 3, 12]) for _ in range(9)], "x") for i in range(5)]
    model, rows, error = covered(spark, [*vectors, (None, vectors[0][1], "x"), (4, vectors[4][1], "x")])
    full = [v for _, v, _ in vectors] + [vectors[0][1], vectors[4][1]]
    y = [[math.floor(64 * x) for x in v] for v in full]
    s, m = scatter_of(y)
    # Seven rows, five of them different: four directions.
    assert len(model.roots) == 4 and model.sums == s and error < 1e-9
    deviation = sorted(str(sum((7 * a - b) ** 2 for a, b in zip(v, s))) for v in y)
    assert sorted(str(x["deviation"]) for x in rows) == deviation
    exact = np.array([[float(v) for v in row] for row in m])
    for root, axis in zip(model.roots, model.axes):
        assert np.abs(exact @ np.array(axis) - root * np.array(axis)).max() < 1e-9 * model.roots[0]


def test_large_values_are_held(spark):
    model, rows, error = covered(spark, [(1, [1e300, 1.0], ""), (2, [-1e300, 2.0], ""), (3, [0.5, 3.0], "")])
    assert model.n == 3 and len(model.roots) == 2 and all(np.isfinite(x) for r in rows for x in r["whitened"])


def test_query(spark, tmp_path):
    r = random.Random(1)
    vectors = [(i, [r.gauss(0, 1 + k) for k in range(40)], "q") for i in range(120)]
    odd = [(200, None, "q"), (201, [None] * 40, "q"), (202, [float("nan")] * 40, "q"), (203, [float("inf")] * 40, "q"), (204, [1.0] * 3, "q"), (205, [], "q"), (7, vectors[7][1], "q")]
    spark.createDataFrame([*vectors, *odd], "vec_id bigint, embedding array<double>, component string").write.parquet(f"{tmp_path}/embeddings.parquet")
    out = W.op11_whiten(spark, str(tmp_path))
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    found = sorted(tuple(x) for x in out.collect())
    used = [*vectors, odd[-1]]
    x = np.array([[math.floor(64 * e) for e in v] for _, v, _ in used])
    c = x - x.mean(axis=0)
    e, a = np.linalg.eigh(c.T @ c / len(x))
    e, a = e[::-1][:32], a[:, ::-1][:, :32]
    z = c @ a / np.sqrt(e)
    ids = [i for i, _, _ in used]
    assert len(found) == 121 * 32
    sums = x.sum(axis=0)
    for k in range(32):
        mine = sorted((i, d, w) for i, comp, n, d, w, share, error in found if comp == k + 1)
        sign = np.sign(sum(w * z[ids.index(i), k] for i, _, w in mine))
        assert max(abs(w * sign - z[ids.index(i), k]) for i, _, w in mine) < 1e-9
        assert all(d == int(((121 * x[ids.index(i)] - sums) ** 2).sum()) for i, d, _ in mine)
    total = ((x * 121 - sums) ** 2).sum() / 121
    for _, comp, n, _, _, share, error in found:
        assert n == 121 and error < 1e-12 and abs(share / (e[comp - 1] * 121**2 / total) - 1) < 1e-9
    one = spark.createDataFrame(vectors[:1] * 2, "vec_id bigint, embedding array<double>, c string")
    one.write.parquet(f"{tmp_path}/one/embeddings.parquet")
    assert W.op11_whiten(spark, f"{tmp_path}/one").count() == 0
