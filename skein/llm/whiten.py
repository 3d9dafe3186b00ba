"""Whitening of quantised vectors by the exact characteristic polynomial of their integer scatter.

Entries c become the long floor(256 * c). Over the distinct vectors x the tasks sum n, S and the
products exactly; n * sum(x x') - S S' is an integer matrix, n squared times the covariance. Its
characteristic polynomial comes from Hessenberg forms modulo primes, a task for some primes each,
put together by Chinese remainders. As all roots are real, Descartes' rule counts the roots above
any number exactly, so bisection isolates the largest ones; inverse iteration in decimals finds
the null space at each.
"""

from __future__ import annotations

import decimal
import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.shared import bounded
from skein.llm.words import lean

#: Components at most, entries' scale, relative bits of a root, digits of the inverse iteration.
COMPONENTS, SCALE, ROOT_BITS, DIGITS = 4, 256.0, 96, 90
#: Rows of one product: with limbs of 20 bits all its sums stay below 2^53, where doubles are exact.
ROWS, LIMB = 8192, 20


def longs(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(whether each row counts, entries of those that do as longs, their first entries, one more than rows)."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # null entries become NaN
    ends = np.cumsum(size)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    ok = lists.is_valid().to_numpy(zero_copy_only=False) & (bad[ends] == bad[ends - size])
    with np.errstate(over="ignore", invalid="ignore"):
        x = np.clip(np.floor(values[np.repeat(ok, size)] * SCALE), -(2.0**63), 2.0**63 - 1024).astype(np.int64)
    return ok, x, np.concatenate([[0], np.cumsum(size[ok])])


def keys(x: np.ndarray, first: np.ndarray) -> pa.Array:
    """Each row's longs as bytes, without zeros at the end: vectors equal but for those are one key."""
    size = np.diff(first)
    row = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(x)) - np.repeat(first[:-1], size)
    length = np.zeros(len(size), np.int64)
    np.maximum.at(length, row, np.where(x != 0, place + 1, 0))
    at = np.concatenate([[0], np.cumsum(length * 8)]).astype(np.int64)
    data = x[place < length[row]].astype("<i8").tobytes()
    return pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(at), pa.py_buffer(data)]).cast(pa.binary())


def matrix(x: np.ndarray, first: np.ndarray, width: int = 0) -> np.ndarray:
    """Rows of longs as a matrix of ``width`` columns at least, short rows filled with zeros."""
    size = np.diff(first)
    width = max(width, int(size.max(initial=0)))
    if len(size) and (size == width).all():
        return x.reshape(len(size), width)
    out = np.zeros((len(size), width), np.int64)
    out[np.repeat(np.arange(len(size)), size), np.arange(len(x)) - np.repeat(first[:-1], size)] = x
    return out


def products(m: np.ndarray) -> np.ndarray:
    """Exact m' m of longs as Python integers, for ROWS rows at most."""
    limbs, rest = [], m
    while np.abs(rest.astype(np.float64)).max(initial=0) > 1 << LIMB:
        limbs.append((rest & ((1 << LIMB) - 1)).astype(np.float64))
        rest = rest >> LIMB
    limbs.append(rest.astype(np.float64))
    total = np.zeros((m.shape[1],) * 2, object)
    for (i, a), (j, b) in itertools.product(enumerate(limbs), repeat=2):
        total += (a.T @ b).astype(np.int64).astype(object) << (LIMB * (i + j))
    return total


@lean
def _distinct_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        _, x, first = longs(b.column(0))
        yield pa.record_batch({"x": keys(x, first)})


@lean
def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of products over a task's vectors, each with a 1 before it: rows (i, j, s) with i <= j, 0 the 1's place."""
    total = np.zeros((1, 1), object)
    for b in batches:
        column = b.column(0).cast(pa.large_binary())
        for at in range(0, len(column), ROWS):
            part = column.slice(at, ROWS)
            _, offs, data = part.buffers()
            offs = np.frombuffer(offs, np.int64)[part.offset : part.offset + len(part) + 1] // 8
            x = np.frombuffer(data, "<i8")[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.int64)
            m = matrix(x, offs - offs[0], len(total) - 1)
            p = products(np.hstack([np.ones((len(m), 1), np.int64), m]))
            p[: len(total), : len(total)] += total
            total = p
    i, j = np.triu_indices(len(total))
    yield pa.record_batch({"i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "s": pa.array([decimal.Decimal(int(v)) for v in total[i, j]], pa.decimal128(38, 0))})


def scatter(spark: SparkSession, vectors: DataFrame, column: str) -> tuple[int, list[int], np.ndarray]:
    """(n, S, n * sum(x x') - S S') over the distinct vectors; one shuffle of vectors, counted before it.

    What reaches the driver has the square of the dimensions, whatever the rows.
    """
    bounded(spark)
    distinct = vectors.select(F.col(f"`{column}`")).mapInArrow(_distinct_keys, "x binary").distinct()
    rows = distinct.mapInArrow(_sums, "i int, j int, s decimal(38,0)").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    width = max((r.j for r in rows), default=0) + 1
    g = np.zeros((width, width), object)
    for r in rows:
        g[r.i, r.j] = g[r.j, r.i] = int(r.s)
    n, s = g[0, 0], g[0, 1:]
    return n, list(s), g[1:, 1:] * n - np.outer(s, s)


def primes(count: int, below: int = 1 << 31) -> list[int]:
    """The ``count`` largest primes below 2^31: products of two residues fit a long. Tested with four Miller-Rabin bases, enough below 3.2 * 10^9."""
    found, p = [], below - 1

    def is_prime(q: int) -> bool:
        d, r = q - 1, 0
        while d % 2 == 0:
            d, r = d // 2, r + 1
        for base in (2, 3, 5, 7):
            y = pow(base, d, q)
            if y not in (1, q - 1) and all((y := y * y % q) != q - 1 for _ in range(r - 1)):
                return False
        return True

    while len(found) < count:
        if is_prime(p):
            found.append(p)
        p -= 2
    return found


def hessenberg(a: np.ndarray, p: int) -> np.ndarray:
    """A matrix similar to ``a`` modulo ``p`` with zeros below the first subdiagonal."""
    for j in range(len(a) - 2):
        below = np.flatnonzero(a[j + 1 :, j])
        if not len(below):
            continue
        r = j + 1 + int(below[0])
        if r != j + 1:
            a[[r, j + 1]] = a[[j + 1, r]]
            a[:, [r, j + 1]] = a[:, [j + 1, r]]
        f = a[j + 2 :, j] * pow(int(a[j + 1, j]), -1, p) % p
        a[j + 2 :] = (a[j + 2 :] - np.outer(f, a[j + 1])) % p
        a[:, j + 1] = (a[:, j + 1] + (a[:, j + 2 :] * f % p).sum(axis=1)) % p
    return a


def polynomial_mod(m: np.ndarray, p: int) -> np.ndarray:
    """Coefficients of det(t - m) modulo ``p``, constant first, by the recurrence over a Hessenberg form's leading minors."""
    h = hessenberg((m % p).astype(np.int64), p)
    d = len(h)
    q = np.zeros((d + 1, d + 1), np.int64)
    q[0, 0] = 1
    for k in range(1, d + 1):
        q[k, 1:] = q[k - 1, :-1]
        q[k] -= h[k - 1, k - 1] * q[k - 1] % p
        chain, minus = 1, np.zeros(k - 1, np.int64)
        for i in range(k - 2, -1, -1):
            chain = chain * int(h[i + 1, i]) % p
            minus[i] = chain * int(h[i, k - 1]) % p
        q[k] = (q[k] - (minus[:, None] * q[: k - 1] % p).sum(axis=0)) % p
    return q[d]


def polynomial(spark: SparkSession, m: np.ndarray) -> list[int]:
    """Coefficients of det(t - m), constant first, of a symmetric integer matrix without negative eigenvalues.

    A coefficient is a sum of products of eigenvalues, so it is at most C(d, k) * (trace / d)^k;
    there are as many primes as tell all such integers apart.
    """
    d, trace = len(m), sum(int(m[i, i]) for i in range(len(m)))
    largest = max((math.comb(d, k) * trace**k // d**k + 1 for k in range(1, d + 1)), default=1)
    ps = primes(math.ceil((largest.bit_length() + 2) / 30.9) + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.column(0).to_pylist()
            yield pa.record_batch({"at": pa.array(at, pa.int64()), "residues": pa.array([polynomial_mod(m, ps[i]).tolist() for i in at], pa.list_(pa.int64()))})

    rows = spark.range(0, len(ps), 1, min(len(ps), 4 * spark.sparkContext.defaultParallelism)).mapInArrow(run, "at long, residues array<long>").collect()
    value, modulus = np.zeros(d + 1, object), 1
    for r in rows:
        p = ps[r.at]
        value = value + (np.array(r.residues, object) - value) * pow(modulus, -1, p) % p * modulus
        modulus *= p
    return [int(v) if 2 * v <= modulus else int(v) - modulus for v in value]


def roots_above(poly: list[int], t: int, s: int) -> int:
    """How many roots of a polynomial with real roots only, with multiplicity, are over t / 2^s > 0.

    The roots of poly(t / 2^s * (1 + x)) over 0 are counted by their coefficients' changes of sign.
    """
    d = len(poly) - 1
    c, power = [], 1
    for k, a in enumerate(poly):
        c.append(a * power << (s * (d - k)))
        power *= t
    c.reverse()
    for i in range(d):
        c[: d + 1 - i] = itertools.accumulate(c[: d + 1 - i])
    return changes(c)


def changes(c: list[int]) -> int:
    signs = [v > 0 for v in c if v]
    return sum(a != b for a, b in itertools.pairwise(signs))


def largest_roots(poly: list[int], k: int) -> list[tuple[int, int]]:
    """The ``k`` largest positive roots, or all if fewer, falling: each as (t, s), t / 2^s within 2^-ROOT_BITS of the root itself."""
    found = []
    for i in range(1, min(k, changes(poly)) + 1):
        e = max(1, abs(poly[-2]).bit_length())  # all roots together are -poly[-2]
        while roots_above(poly, 1 << max(e - 1, 0), max(1 - e, 0)) < i:
            e -= 1
        lo, s = 1, 1 - e  # the root lies in (lo, lo + 1] / 2^s
        for _ in range(ROOT_BITS):
            lo, s = 2 * lo, s + 1
            mid = (lo + 1 << max(-s, 0), max(s, 0))
            lo += roots_above(poly, *mid) >= i
        found.append((2 * lo + 1 << max(-s - 1, 0), max(s + 1, 0)))
    return found


def _solver(a: np.ndarray):
    """LU of decimals with row exchanges; a pivot that vanishes becomes the smallest that counts."""
    a, d = a.copy(), len(a)
    order = np.arange(d)
    least = max(abs(v) for v in a.flat) * decimal.Decimal(10) ** (5 - DIGITS)
    for j in range(d):
        r = j + max(range(d - j), key=lambda i: abs(a[j + i, j]))
        a[[r, j]], order[[r, j]] = a[[j, r]], order[[j, r]]
        if abs(a[j, j]) < least:
            a[j, j] = least
        a[j + 1 :, j] = a[j + 1 :, j] / a[j, j]
        a[j + 1 :, j + 1 :] -= np.outer(a[j + 1 :, j], a[j, j + 1 :])

    def solve(b: np.ndarray) -> np.ndarray:
        y = b[order].copy()
        for j in range(d):
            y[j + 1 :] -= a[j + 1 :, j] * y[j]
        for j in range(d - 1, -1, -1):
            y[j] /= a[j, j]
            y[:j] -= a[:j, j] * y[j]
        return y

    return solve


def null_vectors(m: np.ndarray, roots: list[tuple[int, int]]) -> list[np.ndarray]:
    """A unit vector of decimals for each root; vectors of equal roots are orthogonal."""
    found: list[np.ndarray] = []
    with decimal.localcontext(prec=DIGITS):
        exact = np.array([[decimal.Decimal(int(v)) for v in row] for row in m], object).reshape(m.shape)
        for i, (t, s) in enumerate(roots):
            shift = decimal.Decimal(t) / decimal.Decimal(1 << s)
            solve = _solver(exact - np.diag([shift] * len(m)))
            v = np.array([decimal.Decimal((j * 7919 + 31 * i) % 101 + 1) for j in range(len(m))], object)
            for _ in range(4):
                for _ in range(2):
                    for u in found:
                        v = v - u * (u @ v)
                v = solve(v / abs(v).max())
            for u in found:
                v = v - u * (u @ v)
            found.append(v / (v @ v).sqrt())
    return found


@dataclass
class Whitening:
    """n and S of the distinct vectors; rows of ``axes`` are the components, each over the root of its eigenvalue of the scatter."""

    n: int
    sums: list[int]
    axes: np.ndarray
    explained: list[float]
    identity_error: float


def fit(spark: SparkSession, vectors: DataFrame, column: str = "embedding", k: int = COMPONENTS) -> Whitening:
    """The ``k`` components of the largest eigenvalues that aren't 0, or all of those if fewer.

    The time on the driver grows with the cube of the dimensions, not with the rows. The
    identity's error is that of the covariance, exact, projected on the components as doubles.
    """
    n, sums, m = scatter(spark, vectors, column)
    roots = largest_roots(polynomial(spark, m), k) if len(m) else []
    with decimal.localcontext(prec=DIGITS):
        values = [decimal.Decimal(t) / decimal.Decimal(1 << s) for t, s in roots]
        trace = decimal.Decimal(sum(int(m[i, i]) for i in range(len(m))))
        axes = [v / e.sqrt() for v, e in zip(null_vectors(m, roots), values, strict=True)]
        rounded = [[float(x) for x in a] for a in axes]
        if not axes:
            return Whitening(n, sums, np.zeros((0, len(sums))), [], 0.0)
        a = np.array([[decimal.Decimal(x) for x in row] for row in rounded], object)
        cov = a @ np.array([[decimal.Decimal(int(v)) for v in row] for row in m], object) @ a.T
        error = max(abs(cov[i, j] - (i == j)) for i in range(len(a)) for j in range(len(a)))
        return Whitening(n, sums, np.array(rounded), [float(e / trace) for e in values], float(error))


def apply(vectors: DataFrame, w: Whitening, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): a row for each vector and component; no shuffle."""
    sums = np.array(w.sums, object)
    limit = (1 << 62) // max(1, w.n)
    narrow = w.n < 1 << 62 and max((abs(s) for s in w.sums), default=0) < 1 << 62

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(w.axes)
        for b in batches:
            ok, x, first = longs(b.column(1))
            ids = b.column(0).filter(pa.array(ok))
            m = matrix(x, first, len(sums))[:, : len(sums)]
            exact = narrow and len(m) > 0 and np.abs(m.astype(np.float64)).max(initial=0) < limit
            z = m * w.n - sums.astype(np.int64) if exact else m.astype(object) * w.n - sums
            f = z.astype(np.float64)
            if exact and (f * f).sum(axis=1).max(initial=0) < 2.0**62:
                deviation = pa.array((z * z).sum(axis=1)).cast(pa.decimal128(38, 0))
            else:
                deviation = pa.array([decimal.Decimal(sum(int(v) ** 2 for v in row)) for row in z], pa.decimal128(38, 0))
            white, take = f @ w.axes.T, np.repeat(np.arange(len(f)), k)
            yield pa.record_batch({
                id_column: ids.take(pa.array(take)), "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(f))), "n": pa.array(np.full(len(take), w.n, np.int64)),
                "deviation": deviation.take(pa.array(take)), "whitened": pa.array(white.reshape(-1)), "explained": pa.array(np.tile(np.array(w.explained), len(f))), "identity_error": pa.array(np.full(len(take), w.identity_error)),
            })

    kind = vectors.schema[id_column].dataType.simpleString()
    return vectors.select(f"`{id_column}`", f"`{column}`").mapInArrow(run, f"`{id_column}` {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")


def whiten(spark: SparkSession, vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", k: int = COMPONENTS) -> DataFrame:
    """apply() of fit() over the same vectors.

    Vectors that are null or hold null or non-finite entries have no rows. Repeated rows and ids
    each have theirs, and count once in the fit; a null id stays. Shorter vectors, empty ones too, count as filled
    up with zeros. Components of eigenvalue 0 are left out: an empty table, or one with a single
    distinct vector, gives no rows. Entries beyond a long are cut to its range; sums
    of products beyond 38 digits are an error. Other columns are not looked at.
    """
    return apply(vectors, fit(spark, vectors, column, k), id_column, column)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumn("deviation", F.col("deviation").cast("long"))
