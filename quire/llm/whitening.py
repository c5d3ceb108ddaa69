"""Embedding whitening by the exact characteristic polynomial of the vectors' integer scatter.

Vectors become integers, so their scatter M = n * sum(x x') - S S' (n^2 times the covariance) is an exact integer
matrix, summed by Spark out of the tasks' parts. Its characteristic polynomial comes from as many
primes as its coefficients need: a task brings the matrix to Hessenberg form modulo its prime, and the Chinese
remainder theorem joins the residues. All roots of it are real, so the sign changes of a Taylor shift
count those beyond a point exactly; bisection isolates the largest ones, multiple ones told by the count, and
narrows them to any precision. A component is the null space of M less its root, by inverse iteration in
integers of that precision. What the driver and one task hold depends on the dimensions alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick

MOST = 32
#: Rows multiplied at once: sums of so many products of two 20-bit numbers are exact in doubles.
ROWS = 4096
_LIMB = 20
#: Entries beyond this, scaled, are held at it, so that x fits 64 bits.
LARGEST = 2**62


def integral(vectors: DataFrame, scale: float = 64.0) -> DataFrame:
    """vec_id, y = floor(scale * entry) as bigints of (vec_id, embedding).

    A vector that is null or holds a null or non-finite entry is left out. All must have one length: of several
    lengths the commonest stays (the longer of equally common ones), and vectors without entries go.
    Repeated rows and null vec_ids stay; scaled entries beyond LARGEST are held there.
    """
    x = pick(vectors, "vec_id", "embedding").where("embedding is not null and size(embedding) > 0")
    x = x.where(F.forall("embedding", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))))
    common = x.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    held = lambda e: F.greatest(F.least(F.floor(e.cast("double") * scale), F.lit(LARGEST)), F.lit(-LARGEST))
    return x.where(F.size("embedding") == (common["d"] if common else 0)).select(F.col("vec_id").cast("bigint").alias("vec_id"), F.transform("embedding", held).alias("y"))


def _matrix(batch: pa.RecordBatch, column: str) -> np.ndarray:
    return np.asarray(batch.column(column).flatten()).reshape(batch.num_rows, -1)


def gram(y: np.ndarray) -> np.ndarray:
    """y' y of at most ROWS rows of integers, exact, as Python integers."""
    limbs, rest = [], y
    while True:
        last = -(1 << _LIMB) < rest.min() and rest.max() < 1 << _LIMB
        limbs.append((rest if last else rest & ((1 << _LIMB) - 1)).astype(np.float64))
        if last:
            break
        rest = rest >> _LIMB
    out = np.zeros((y.shape[1],) * 2, object)
    for i, a in enumerate(limbs):
        for j, b in enumerate(limbs):
            out += (a.T @ b).astype(np.int64).astype(object) << (_LIMB * (i + j))
    return out


def scatter(rows: DataFrame) -> tuple[int, list[int], list[list[int]]]:
    """n, the sums S by dimension and M = n * sum(y y') - S S' of the rows' y; (0, [], []) of none.

    Each task sends one part a pair of dimensions, in limbs of 32 bits; Spark adds them.
    """

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            y = _matrix(batch, "y") if batch.num_rows else np.empty((0, 0), np.int64)
            for at in range(0, len(y), ROWS):
                some = gram(np.hstack((np.ones((len(y[at : at + ROWS]), 1), np.int64), y[at : at + ROWS])))
                total = some if total is None else total + some
        if total is None:
            return
        out = []
        for i in range(len(total)):
            for j in range(i, len(total)):
                v, k = abs(total[i, j]), 0
                while v or not k:
                    out.append((i, j, k, (v & 0xFFFFFFFF) * (1 if total[i, j] > 0 else -1)))
                    v, k = v >> 32, k + 1
        i, j, k, part = zip(*out)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(k, pa.int32()), pa.array(part, pa.int64())], names=["i", "j", "k", "part"])

    summed = rows.select("y").mapInArrow(parts, "i int, j int, k int, part bigint").groupBy("i", "j", "k").agg(F.sum("part").alias("part")).collect()
    if not summed:
        return 0, [], []
    d = max(r["j"] for r in summed)
    t = [[0] * (d + 1) for _ in range(d + 1)]
    for i, j, k, part in summed:
        t[i][j] += part << (32 * k)
        if i != j:
            t[j][i] += part << (32 * k)
    n, s = t[0][0], t[0][1:]
    return n, s, [[n * t[i + 1][j + 1] - s[i] * s[j] for j in range(d)] for i in range(d)]


# The characteristic polynomial: coefficients from the constant term up.


def _is_prime(n: int) -> bool:
    """For odd n below 3 * 10^9."""
    r = ((n - 1) & (1 - n)).bit_length() - 1
    for a in (2, 3, 5, 7):
        x = pow(a, n >> r, n)
        if x not in (1, n - 1) and not any((x := x * x % n) == n - 1 for _ in range(r - 1)):
            return False
    return True


def primes(product_over: int) -> list[int]:
    """The largest primes below 2^31 whose product exceeds a number."""
    out, product, p = [], 1, 2**31 - 1
    while product <= product_over:
        if _is_prime(p):
            out.append(p)
            product *= p
        p -= 2
    return out


def polynomial_modulo(m: list[list[int]], p: int) -> list[int]:
    """The coefficients of det(x - m) modulo p, by reduction to Hessenberg form."""
    d = len(m)
    a = np.array([[v % p for v in row] for row in m], np.int64)
    for k in range(1, d - 1):
        found = np.flatnonzero(a[k:, k - 1])
        if not len(found):
            continue
        if i := int(found[0]):
            a[[k, k + i]] = a[[k + i, k]]
            a[:, [k, k + i]] = a[:, [k + i, k]]
        u = a[k + 1 :, k - 1] * pow(int(a[k, k - 1]), -1, p) % p
        a[k + 1 :] = (a[k + 1 :] - u[:, None] * a[k] % p) % p
        a[:, k] = (a[:, k] + (a[:, k + 1 :] * u % p).sum(axis=1)) % p
    # The polynomials of the leading minors, one after another.
    made = np.zeros((d + 1, d + 1), np.int64)
    made[0, 0] = 1
    below = np.ones(0, np.int64)
    for k in range(d):
        now = np.roll(made[k], 1)
        weights = np.concatenate((below * a[:k, k] % p, a[k : k + 1, k]))
        made[k + 1] = (now - (weights[:, None] * made[: k + 1] % p).sum(axis=0)) % p
        if k + 1 < d:
            below = np.concatenate((below, np.ones(1, np.int64))) * a[k + 1, k] % p
    return made[d].tolist()


def join_residues(of_prime: dict[int, list[int]]) -> list[int]:
    """The integers of least absolute value that leave the residues."""
    product = math.prod(of_prime)
    out = [0] * len(next(iter(of_prime.values())))
    for p, residues in of_prime.items():
        rest = product // p
        weight = rest * pow(rest, -1, p)
        out = [o + weight * r for o, r in zip(out, residues)]
    return [(o + product // 2) % product - product // 2 for o in out]


def characteristic(spark: SparkSession, m: list[list[int]]) -> list[int]:
    """The coefficients of det(x - m) of a positive semidefinite integer matrix, primes dealt over the tasks.

    By Hadamard none exceeds the product of the diagonal entries, each and one.
    """
    wanted = primes(2 * math.prod(1 + m[i][i] for i in range(len(m))))
    held = spark.sparkContext.broadcast(m)

    def residues(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([polynomial_modulo(held.value, p) for p in at], pa.list_(pa.int64()))], names=["p", "residues"])

    table = spark.createDataFrame([(p,) for p in wanted], "p bigint").repartition(min(len(wanted), 2 * spark.sparkContext.defaultParallelism))
    return join_residues(dict(table.mapInArrow(residues, "p bigint, residues array<bigint>").collect()))


# Real roots: all of these polynomials are real.


def value_sign(poly: list[int], m: int, b: int) -> int:
    """The sign of the polynomial at m / 2^b."""
    out = 0
    for k, c in enumerate(reversed(poly)):
        out = out * m + (c << (b * k))
    return (out > 0) - (out < 0)


def roots_beyond(poly: list[int], m: int, b: int) -> int:
    """How many roots exceed m / 2^b, by multiplicity: the sign changes of the polynomial shifted there."""
    d = len(poly) - 1
    c = [v << (b * (d - k)) for k, v in enumerate(poly)]
    for i in range(d):
        for k in range(d - 1, i - 1, -1):
            c[k] += m * c[k + 1]
    signs = [v > 0 for v in c if v]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def _divide(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    """Quotient and rest by a polynomial with leading coefficient 1."""
    rest, out = list(a), [0] * (len(a) - len(b) + 1)
    for k in range(len(out) - 1, -1, -1):
        out[k] = f = rest[k + len(b) - 1]
        for i, v in enumerate(b):
            rest[k + i] -= f * v
    return out, rest[: len(b) - 1]


def _common_modulo(a: list[int], b: list[int], p: int) -> list[int]:
    """The greatest common divisor modulo p, with leading coefficient 1."""
    a, b = [v % p for v in a], [v % p for v in b]
    while True:
        while b and not b[-1]:
            b.pop()
        if not b:
            return a
        inverse = pow(b[-1], -1, p)
        b = [v * inverse % p for v in b]
        a, b = b, [v % p for v in _divide(a, b)[1]] if len(a) >= len(b) else a


def simple_part(poly: list[int]) -> list[int]:
    """The polynomial of the same roots, each once."""
    slope = [k * c for k, c in enumerate(poly)][1:]
    some, product = {}, 1
    p = 2**31 - 1
    while True:
        if _is_prime(p):
            g = _common_modulo(poly, slope, p)
            # Few primes leave too large a divisor, none too small a one.
            if some and len(g) < len(next(iter(some.values()))):
                some = {}
            if not some or len(g) == len(next(iter(some.values()))):
                some[p] = g
            if len(g) == 1:
                return poly
            if math.prod(some) > product:
                out, rest = _divide(poly, join_residues(some))
                if not any(rest):
                    return out
                product = math.prod(some) ** 2
        p -= 2


@dataclass
class Root:
    """A root in (low, high] / 2^bits, alone there, and how often it counts."""

    low: int
    high: int
    bits: int
    times: int

    def narrow(self, poly: list[int], bits: int) -> Root:
        """The same root between neighbours on the grid of 2^-bits; high is the root where it lies on the grid."""
        shift = bits - self.bits
        low, high = self.low << shift, self.high << shift
        above = value_sign(poly, high, bits)
        if not above:
            return Root(high - 1, high, bits, self.times)
        while high - low > 1:
            mid = (low + high) >> 1
            sign = value_sign(poly, mid, bits)
            if not sign:
                return Root(mid - 1, mid, bits, self.times)
            low, high = (low, mid) if sign == above else (mid, high)
        return Root(low, high, bits, self.times)


def largest_roots(poly: list[int], simple: list[int], most: int) -> list[Root]:
    """The largest positive roots in falling order, until they count `most` together or none is left."""
    top = -poly[-2] + 1
    full = {(0, 0): roots_beyond(simple, 0, 0), (top, 0): 0}

    def beyond(m: int, b: int) -> int:
        while b and not m & 1:
            m, b = m >> 1, b - 1
        if (m, b) not in full:
            full[m, b] = roots_beyond(simple, m, b)
        return full[m, b]

    found, count, left = [], 0, [(0, top, 0)]
    while left and count < most:
        low, high, b = left.pop()
        inside = beyond(low, b) - beyond(high, b)
        if inside == 1:
            times = 1 if len(simple) == len(poly) else roots_beyond(poly, low, b) - roots_beyond(poly, high, b)
            found.append(Root(low, high, b, times))
            count += times
        elif inside:
            if high - low == 1:
                low, high, b = 2 * low, 2 * high, b + 1
            mid = (low + high) >> 1
            left += [(low, mid, b), (mid, high, b)]
    return found


# Components.


def null_vectors(m: list[list[int]], root: int, bits: int, times: int) -> list[list[float]]:
    """`times` orthonormal vectors that m less root / 2^bits takes to almost nothing, by inverse iteration in steps of 2^-bits.

    The largest entry of each is positive.
    """
    d = len(m)
    a = np.array([[v << bits for v in row] for row in m], object)
    for i in range(d):
        a[i, i] -= root
    rows, columns = list(range(d)), list(range(d))
    for k in range(d):
        at = int(np.argmax(np.abs(a[k:, k:]).reshape(-1)))
        i, j = k + at // (d - k), k + at % (d - k)
        a[[k, i]], rows[k], rows[i] = a[[i, k]], rows[i], rows[k]
        a[:, [k, j]], columns[k], columns[j] = a[:, [j, k]], columns[j], columns[k]
        # The last pivots are as good as nothing.
        a[k, k] = a[k, k] or 1
        a[k + 1 :, k] = (a[k + 1 :, k] << bits) // a[k, k]
        a[k + 1 :, k + 1 :] -= (a[k + 1 :, k : k + 1] * a[k : k + 1, k + 1 :]) >> bits

    def upper(y: np.ndarray) -> np.ndarray:
        x = np.zeros(d, object)
        for k in range(d - 1, -1, -1):
            x[k] = ((y[k] << bits) - int((a[k, k + 1 :] * x[k + 1 :]).sum())) // a[k, k]
        out = np.zeros(d, object)
        out[columns] = x
        return out

    def lower(x: np.ndarray) -> np.ndarray:
        y = x[rows]
        for k in range(d):
            y[k] -= int((a[k, :k] * y[:k]).sum()) >> bits
        return y

    def unit(x: np.ndarray) -> np.ndarray:
        return (x << bits) // max(1, math.isqrt(int((x * x).sum())))

    def apart(vectors: list[np.ndarray]) -> list[np.ndarray]:
        out = []
        for v in vectors:
            v = unit(v)
            for _ in range(2):
                for o in out:
                    v = v - ((o * (int((o * v).sum()) >> bits)) >> bits)
                v = unit(v)
            out.append(v)
        return out

    starts = []
    for k in range(times):
        y = np.zeros(d, object)
        y[d - 1 - k] = 1 << bits
        starts.append(upper(y))
    vectors = apart(starts)
    for _ in range(2):
        vectors = apart([upper(lower(v)) for v in vectors])
    made = [[int(x) / (1 << bits) for x in v] for v in vectors]
    return [[-x for x in v] if v[int(np.argmax(np.abs(v)))] < 0 else v for v in made]


@dataclass
class Whitening:
    """Fitted on n rows with sums S: component k has eigenvalue roots[k] / n^2, unit vector axes[k] and a share of the trace."""

    n: int
    sums: list[int]
    roots: list[float]
    axes: list[list[float]]
    explained: list[float]


def fit_whitening(rows: DataFrame, most: int = MOST) -> Whitening:
    """The first components of the rows' covariance (divisor n), from rows of integers y as `integral` makes them.

    Components of eigenvalue 0 are left out, as nothing can be divided by it; rows that are all
    alike, or no rows, have none. Equal eigenvalues have any orthonormal vectors of their space.
    """
    spark = rows.sparkSession
    n, sums, m = scatter(rows)
    trace = sum(m[i][i] for i in range(len(m)))
    if not trace:
        return Whitening(n, sums, [], [], [])
    poly = characteristic(spark, m)
    while not poly[0]:
        poly = poly[1:]
    simple = simple_part(poly)
    # One root more than asked for, so that each has a neighbour below it to be told from.
    found = largest_roots(poly, simple, most + 1)
    size = trace.bit_length()
    rough = size + 64
    near = [r.narrow(simple, max(rough, r.bits)) for r in found]
    grid = max(r.bits for r in near)
    places = [r.high << (grid - r.bits) for r in near] + [0]
    gap = max(1, min(a - b for a, b in zip(places, places[1:])))
    # Roots are told to 2^-80 of the least gap between two of them, and worked with beyond that.
    bits = max(grid, grid - gap.bit_length() + 80 + size)
    held = spark.sparkContext.broadcast((m, simple, near))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, simple, near = held.value
        for batch in batches:
            out = []
            for k in batch.column(0).to_pylist():
                root = near[k].narrow(simple, bits)
                out.append((root.high / (1 << bits), root.high / (trace << bits), null_vectors(m, root.high, bits, root.times)))
            value, share, axes = zip(*out)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(value), pa.array(share), pa.array(axes, pa.list_(pa.list_(pa.float64())))], names=["k", "value", "share", "axes"])

    table = spark.createDataFrame([(k,) for k in range(len(near))], "k int").repartition(min(len(near), 2 * spark.sparkContext.defaultParallelism))
    solved = sorted(table.mapInArrow(solve, "k int, value double, share double, axes array<array<double>>").collect())
    every = [(r["value"], r["share"], list(axis)) for r in solved for axis in r["axes"]][:most]
    return Whitening(n, sums, [r[0] for r in every], [r[2] for r in every], [r[1] for r in every])


def _centred(y: np.ndarray, model: Whitening) -> np.ndarray:
    """n * y - S, in Python integers where 64 bits don't hold it."""
    largest = max(abs(int(y.min())), abs(int(y.max())), 1)
    wide = model.n * largest + max(map(abs, model.sums)) >= 2**63
    return y.astype(object) * model.n - np.array(model.sums, object) if wide else y * model.n - np.array(model.sums, np.int64)


def _projected(centred: np.ndarray, model: Whitening) -> np.ndarray:
    return centred.astype(np.float64) @ np.array(model.axes).T / np.sqrt(np.array(model.roots))


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the covariance of the rows' whitened values less the identity; 0 without components."""
    if not model.roots:
        return 0.0
    width = len(model.roots) + 1

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            if batch.num_rows:
                z = _projected(_centred(_matrix(batch, "y"), model), model)
                z = np.hstack((np.ones((len(z), 1)), z))
                total += z.T @ z
        i, j = np.indices(total.shape).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total.reshape(-1))], names=["i", "j", "part"])

    t = np.zeros((width, width))
    for i, j, part in rows.select("y").mapInArrow(parts, "i int, j int, part double").groupBy("i", "j").agg(F.sum("part")).collect():
        t[i, j] = part
    mean = t[0, 1:] / model.n
    return float(np.abs(t[1:, 1:] / model.n - np.outer(mean, mean) - np.eye(width - 1)).max())


def whiten(rows: DataFrame, model: Whitening) -> DataFrame:
    """vec_id, deviation (decimal: the sum of (n * y - S)^2; null beyond 38 digits), whitened (array<double>, one a component) of every row."""
    most = 10**38

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            centred = _centred(_matrix(batch, "y"), model)
            # Squares beyond 64 bits are rare but must be right.
            safe = centred.dtype != object and int(np.abs(centred).max()) < math.isqrt(2**63 // centred.shape[1])
            squares = (centred * centred).sum(axis=1).tolist() if safe else (centred.astype(object) ** 2).sum(axis=1).tolist()
            squares = pa.array([None if s >= most else str(s) for s in squares]).cast(pa.decimal128(38, 0))
            z = _projected(centred, model) if model.roots else np.empty((batch.num_rows, 0))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * z.shape[1], pa.int32()), pa.array(z.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), squares, flat], names=["vec_id", "deviation", "whitened"])

    return rows.select("vec_id", "y").mapInArrow(made, "vec_id bigint, deviation decimal(38,0), whitened array<double>")


def op11_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of every usable vector and its first 32 components.

    x = y + 1000000 deviates as y does, so the offset cancels out everywhere. deviation is null where it does not fit a bigint.
    """
    rows = integral(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    model = fit_whitening(rows)
    error = identity_error(rows, model)
    out = whiten(rows, model).select("vec_id", F.expr("try_cast(deviation as bigint)").alias("deviation"), F.posexplode("whitened").alias("at", "whitened"))
    share = F.array(*[F.lit(x) for x in model.explained]).cast("array<double>")
    return out.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("bigint").alias("n"), "deviation", "whitened", F.get(share, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))
