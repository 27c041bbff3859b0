"""Embedding whitening: principal axes of the covariance by contour integration, found interval by interval and counted by inertia.

1. Vectors become integers floor(scale * x). The fit list is each distinct vector once; its count and sums are exact. The covariance is a sum of products of centred
   vectors, made block by block in tasks and added up by entry; only this one matrix (dimension squared, whatever the rows) comes to the driver.
2. Inertia: the pivots of a symmetric factorisation of V - s*I (in tridiagonal form) count the eigenvalues above s. Bisection on s finds intervals that hold the wanted
   largest ones, with their ends in gaps.
3. Contour integration: solves with V shifted to the complex nodes of a quadrature around the interval project a block of vectors onto its eigenvectors; the
   Rayleigh-Ritz step on the projected block gives eigenvalues and vectors. Repeated until the residuals are at rounding level, and held against the inertia count, so
   none is missed.
4. Rows are projected on the axes and divided by the roots of the eigenvalues.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_folder
from .topk import usable

SCALE, COMPONENTS = 256, 4
#: Quadrature nodes on the half circle, vectors of the block beyond those in the interval, steps of the iteration, and vectors whose products a task adds at a time.
NODES, SPARE, ROUNDS, ROWS_AT_ONCE = 12, 8, 60, 4096
#: Eigenvalues under this share of the largest, times the dimension, count as zero: no direction is left to whiten.
ZERO = 2.0 ** -50
#: Eigenvalues that differ by less than this share share an interval.
CLOSE = 0.02
_LIMIT = float(1 << 62)


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of a tridiagonal matrix with the eigenvalues of a symmetric one, by reflections."""
    a = np.array(matrix, float)
    for k in range(len(a) - 2):
        v = a[k + 1:, k].copy()
        size = np.linalg.norm(v)
        if not size:
            continue
        v[0] += np.copysign(size, v[0])
        v /= np.linalg.norm(v)
        a[k + 1:, k:] -= 2 * np.outer(v, v @ a[k + 1:, k:])
        a[k:, k + 1:] -= 2 * np.outer(a[k:, k + 1:] @ v, v)
    return np.diag(a).copy(), np.diag(a, -1).copy()


def inertia_above(tri: tuple[np.ndarray, np.ndarray], shift: float) -> int:
    """How many eigenvalues of a tridiagonal matrix lie above ``shift``: the positive pivots of the factorisation L D L' of the shifted matrix."""
    diagonal, off = tri
    tiny = np.finfo(float).tiny / np.finfo(float).eps
    pivot, positive = np.inf, 0
    for d, e in zip((diagonal - shift).tolist(), [0.0, *(off * off).tolist()], strict=True):
        pivot = d - e / pivot
        if abs(pivot) < tiny:
            pivot = -tiny
        positive += pivot > 0
    return positive


def _place(tri, rank: int, low: float, high: float, width: float) -> tuple[float, float]:
    """A bracket of about ``width`` around the eigenvalue of this rank (1 is the largest), by counting."""
    while high - low > width:
        middle = (low + high) / 2
        if not low < middle < high:
            break
        low, high = (middle, high) if inertia_above(tri, middle) >= rank else (low, middle)
    return low, high


def intervals(matrix: np.ndarray, count: int) -> list[tuple[float, float, int]]:
    """(low, high, held) from above: intervals that hold the ``count`` largest eigenvalues, ends in gaps of the spectrum, ``held`` by inertia.

    Values close to each other share an interval, so that their vectors come out orthogonal; equal ones that ``count`` would cut through come along.
    """
    n, tri = len(matrix), tridiagonal(matrix)
    norm = (float(np.abs(matrix).sum(axis=1).max()) or 1.0) * (1 + 2.0 ** -20)
    count, equal = min(count, n), norm * 2.0 ** -40
    found: list[tuple[float, float]] = []
    while len(found) < n and (len(found) <= count or found[-2][0] - found[-1][1] < equal):  # one more than wanted, and on through a cluster
        found.append(_place(tri, len(found) + 1, -norm, norm, norm * 2.0 ** -44))
    out, first = [], 0
    for last in range(len(found)):
        gap = found[last][0] - found[last + 1][1] if last + 1 < len(found) else np.inf
        if gap < equal or (last + 1 < count and gap < CLOSE * abs(found[last][1])):
            continue
        above = found[first - 1][0] - found[first][1] if first else np.inf
        room = min(above, gap, max(abs(found[first][1]), norm * 2.0 ** -30)) / 2
        low, high = found[last][0] - room, found[first][1] + room
        out.append((low, high, inertia_above(tri, low) - inertia_above(tri, high)))
        first = last + 1
        if first >= count:
            break
    return out


def contour_eigenpairs(matrix: np.ndarray, low: float, high: float, held: int, nodes: int = NODES) -> tuple[np.ndarray, np.ndarray]:
    """All ``held`` eigenvalues in (low, high), falling, and their unit vectors as columns, to double precision. The matrix is symmetric and real."""
    n = len(matrix)
    center, radius, norm = (low + high) / 2, (high - low) / 2, float(np.abs(matrix).sum(axis=1).max()) or 1.0
    x, w = np.polynomial.legendre.leggauss(nodes)
    turns = np.pi * (x + 1) / 2  # the lower half circle follows by conjugation
    shifted = [(center + radius * np.exp(1j * t)) * np.eye(n) - matrix for t in turns]
    block = np.random.default_rng(7).standard_normal((n, min(n, held + SPARE)))
    worst, inside = np.inf, np.zeros(0, bool)
    for _ in range(ROUNDS):
        projected = np.zeros(block.shape)
        for m, turn, weight in zip(shifted, turns, w, strict=True):
            projected += (weight / 2) * (radius * np.exp(1j * turn) * np.linalg.solve(m, block.astype(complex))).real
        basis, _ = np.linalg.qr(projected)
        ritz, turn = np.linalg.eigh(basis.T @ matrix @ basis)
        block = basis @ turn
        inside = (ritz > low) & (ritz < high)
        if inside.sum() == held:
            now = np.linalg.norm(matrix @ block[:, inside] - block[:, inside] * ritz[inside], axis=0).max()
            if now <= norm * 2.0 ** -50 or (now <= norm * n * 2.0 ** -46 and now > worst / 2):
                order = np.flatnonzero(inside)[::-1]
                return ritz[order], block[:, order] / np.linalg.norm(block[:, order], axis=0)
            worst = now
    if nodes < 16 * NODES:
        return contour_eigenpairs(matrix, low, high, held, nodes * 4)
    raise ArithmeticError(f"{int(inside.sum())} of {held} eigenvalues settled between {low} and {high}")


def principal_axes(matrix: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` largest eigenvalues of a covariance, falling, and their vectors as columns; those that are zero to rounding are left out.

    Each vector's sign makes its largest entry positive, so reruns agree.
    """
    n = len(matrix)
    scale = float(np.abs(matrix).max()) if n else 0.0
    if not scale:
        return np.zeros(0), np.zeros((n, 0))
    parts = [contour_eigenpairs(matrix / scale, *one) for one in intervals(matrix / scale, count)]
    values, vectors = np.concatenate([v for v, _ in parts]), np.concatenate([u for _, u in parts], axis=1)
    keep = (values > values[0] * n * ZERO)[:count]
    values, vectors = values[:count][keep] * scale, vectors[:, :count][:, keep]
    lead = np.abs(vectors).argmax(axis=0)
    return values, vectors * np.sign(vectors[lead, np.arange(len(values))])


# the same in tasks


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as a matrix of whole numbers; shorter rows are padded with zeros."""
    sizes = np.asarray(lists.value_lengths())
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = np.asarray(lists.flatten())
    return out


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, exact: in 64 bits where it fits, else in Python's integers."""
    if (int(np.abs(x).max(initial=0)) + 1) * n + max(map(abs, sums), default=0) < _LIMIT:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, ROWS_AT_ONCE):
            yield b.slice(i, ROWS_AT_ONCE)


def _entries(total: np.ndarray, name: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["k", name])


def _sum_by_entry(fit: DataFrame, width: int, per_block, size: int) -> np.ndarray:
    """Sum over the fit list of what ``per_block`` gives for blocks of rows: each task adds its own, Spark adds the tasks entry by entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in _rows(batches):
            part = per_block(_matrix(b.column(0), width))
            total = part if total is None else total + part
        if total is not None:
            yield _entries(total, "v")

    out = np.zeros(size)
    got = fit.mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).toArrow()
    out[got["k"].to_numpy()] = got["v"].to_numpy()
    return out


def whiten(vectors: DataFrame, key: str = "vec_id", vec: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error): a row for each usable vector and component, from 1 by falling eigenvalue.

    Vectors that are null or hold nulls or non-finite numbers take no part; a shorter one counts as padded with zeros; repeated rows are kept and count once in the
    fit. Components whose eigenvalue is zero to rounding are not given, so a table of equal vectors, one vector or none gives no rows. ``deviation`` is exact, a
    decimal of 38 digits (null beyond). Entries beyond the range of long are held to it. A null key is a key.
    """
    spark = vectors.sparkSession
    x = F.transform(F.col(vec).cast("array<double>"), lambda c: F.floor(c * scale))
    rows = vectors.where(usable(F.col(vec))).select(F.col(key).alias("key"), x.alias("x"))
    width = rows.agg(F.max(F.size("x"))).first()[0] or 0
    empty = f"{key} {vectors.schema[key].dataType.simpleString()}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if not width:
        return spark.createDataFrame([], empty)
    padded = F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("x")))
    # read three times: written once. Equal vectors meet in a partial aggregation before they are shuffled
    folder = f"{shared_folder(spark)}/whitening/{uuid.uuid4().hex}"
    rows.select(padded.alias("x")).groupBy("x").agg(F.lit(1).alias("one")).select("x").write.parquet(folder)
    fit = spark.read.parquet(folder)
    each = fit.select(F.posexplode("x").alias("k", "v")).groupBy("k").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s"), F.count("*").alias("n")).toArrow()
    n = int(each["n"][0].as_py())
    sums = [0] * width
    for k, s in zip(each["k"].to_pylist(), each["s"].to_pylist(), strict=True):
        sums[k] = int(s)
    mean_free = lambda m: _centred(m, n, sums).astype(np.float64) / n
    products = lambda m: m.T @ m
    cov = _sum_by_entry(fit, width, lambda m: products(mean_free(m)), width * width).reshape(width, width) / n
    values, axes = principal_axes((cov + cov.T) / 2, components)
    if not len(values):
        return spark.createDataFrame([], empty)
    to_white = axes / np.sqrt(values)
    k = len(values)
    center = _sum_by_entry(fit, width, lambda m: (mean_free(m) @ to_white).sum(axis=0), k) / n
    got = _sum_by_entry(fit, width, lambda m: products(mean_free(m) @ to_white - center), k * k).reshape(k, k) / n
    error, explained = float(np.abs(got - np.eye(k)).max()), values / np.trace(cov)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _rows(batches):
            m = _centred(_matrix(b.column("x"), width), n, sums)
            white = (m.astype(np.float64) / n) @ to_white
            exact = m if m.dtype == object or int(np.abs(m).max(initial=0)) ** 2 * width < _LIMIT else m.astype(object)
            apart = [int(v) if v < 10 ** 38 else None for v in (exact * exact).sum(axis=1).tolist()]
            at = np.repeat(np.arange(b.num_rows), k)
            r = b.num_rows
            yield pa.RecordBatch.from_arrays([
                b.column("key").take(pa.array(at)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), r)), pa.array(np.full(r * k, n)),
                pa.array(apart, pa.decimal128(38, 0)).take(pa.array(at)), pa.array(white.ravel()), pa.array(np.tile(explained, r)), pa.array(np.full(r * k, error))],
                [key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, empty)
