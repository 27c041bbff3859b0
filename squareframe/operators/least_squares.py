"""Linear least squares from sums: one pass over a table gives the moments of every group of rows, and any union of groups is fitted from them.

A task keeps count, means and centred products of each group it meets, made block by block by matrix products; they are merged pairwise in a tree, so neither large means
nor many rows cost digits. Folds, ranges, penalties and errors of held-out groups then follow without reading the rows again: one matrix of
(features + 1) squared for each of a few groups comes to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Partial results that one task merges.
FAN = 64


@dataclass(frozen=True)
class Moments:
    """Weight, means and centred sums of products of (features, target) of some rows."""

    n: float
    mean: np.ndarray
    products: np.ndarray

    def __add__(self, other: Moments) -> Moments:
        if not other.n:
            return self
        if not self.n:
            return other
        n, apart = self.n + other.n, other.mean - self.mean
        return Moments(n, self.mean + apart * (other.n / n), self.products + other.products + np.outer(apart, apart) * (self.n * other.n / n))

    @staticmethod
    def none(width: int) -> Moments:
        return Moments(0.0, np.zeros(width), np.zeros((width, width)))

    def mapped(self, matrix: np.ndarray, shift: np.ndarray) -> Moments:
        """Moments of ``matrix @ row + shift`` for the same rows."""
        return Moments(self.n, matrix @ self.mean + shift if self.n else np.zeros(len(matrix)), matrix @ self.products @ matrix.T)

    def fit(self, penalty: float = 0.0, lasso: float = 0.0, steps: int = 1000) -> Line:
        """Coefficients of the penalised least squares: squared error over 2n plus ``penalty`` times ((1 - lasso) / 2 squares + lasso absolutes) of the coefficients of
        features scaled to deviation 1. A feature without spread gets 0. Rows fewer than features get the smallest solution."""
        p = len(self.mean) - 1
        spread = np.sqrt(np.maximum(np.diag(self.products), 0) / max(self.n, 1e-300))
        live = np.flatnonzero(spread[:p] > 1e-12 * np.maximum(1.0, np.abs(self.mean[:p])))
        coef = np.zeros(p)
        if len(live) and spread[p] > 0:
            scale = np.outer(spread[live], spread[live]) * self.n
            r, c = self.products[np.ix_(live, live)] / scale, self.products[live, p] / (spread[live] * spread[p] * self.n)
            ridge, limit = penalty * (1 - lasso) / spread[p], penalty * lasso / spread[p]
            if limit:
                b = np.zeros(len(live))
                for _ in range(steps):  # coordinate descent on the sums
                    before = b.copy()
                    for j in range(len(live)):
                        pull = c[j] - r[j] @ b + r[j, j] * b[j]
                        b[j] = np.sign(pull) * max(abs(pull) - limit, 0.0) / (r[j, j] + ridge)
                    if np.abs(b - before).max() < 1e-12:
                        break
            else:
                b = np.linalg.lstsq(r + ridge * np.eye(len(live)), c, rcond=1e-13)[0]
            coef[live] = b * spread[p] / spread[live]
        return Line(coef, float(self.mean[p] - coef @ self.mean[:p]) if self.n else 0.0)

    def squared_error(self, line: Line) -> float:
        """Sum of squared errors of a line over these rows."""
        if not self.n:
            return 0.0
        d = np.append(-line.coef, 1.0)
        off = d @ self.mean - line.intercept
        return max(0.0, float(d @ self.products @ d + self.n * off * off))


@dataclass(frozen=True)
class Line:
    """A linear forecast; :meth:`column` computes it row by row inside generated code."""

    coef: np.ndarray
    intercept: float

    def column(self, features: list[str]) -> Column:
        out = F.lit(self.intercept)
        for name, c in zip(features, self.coef.tolist(), strict=True):
            out = out + F.col(name) * F.lit(c)
        return out


def _row(group: int, m: Moments) -> dict:
    return {"g": group, "n": m.n, "mean": m.mean.tobytes(), "products": m.products.tobytes()}


_SCHEMA = "g int, n double, mean binary, products binary"


def _batch(sums: dict[int, Moments]) -> pa.RecordBatch:
    rows = [_row(g, m) for g, m in sorted(sums.items())]
    return pa.RecordBatch.from_pylist(rows, pa.schema([("g", pa.int32()), ("n", pa.float64()), ("mean", pa.binary()), ("products", pa.binary())]))


def _sums(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Moments] = {}
        for b in batches:
            x = np.stack([b.column(i + 2).to_numpy(zero_copy_only=False) for i in range(width)], 1)
            lists, w = b.column(0), b.column(1).to_numpy()
            at = np.repeat(np.arange(b.num_rows), lists.value_lengths().to_numpy())
            groups = lists.flatten().to_numpy()
            for g in np.unique(groups).tolist():
                own = at[groups == g]
                v, weight = x[own], w[own]
                n = weight.sum()
                if n > 0:
                    mean = weight @ v / n
                    c = v - mean
                    held[g] = held.get(g, Moments.none(width)) + Moments(float(n), mean, (c * weight[:, None]).T @ c)
        if held:
            yield _batch(held)
    return run


def _merge(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Moments] = {}
        for b in batches:
            for r in b.to_pylist():
                held[r["g"]] = held.get(r["g"], Moments.none(width)) + _read(r, width)
        if held:
            yield _batch(held)
    return run


def _read(r, width: int) -> Moments:
    return Moments(r["n"], np.frombuffer(r["mean"]), np.frombuffer(r["products"]).reshape(width, width))


def moments(df: DataFrame, features: list[str], target: str, groups: Column, weight: str | None = None) -> dict[int, Moments]:
    """Moments of each group, in one pass over ``df``. ``groups`` is an array of int: a row may stand in several groups, or in none.

    Rows with a null or non-finite feature or target, or without a positive weight, take no part. A group without rows is absent; an empty table gives none.
    """
    width = len(features) + 1
    values = [F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate([*features, target])]
    rows = df.select(groups.cast("array<int>").alias("g"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"), *values)
    sound = F.lit(True)
    for i in range(width):
        sound = sound & F.col(f"v{i}").isNotNull() & ~F.isnan(f"v{i}") & (F.abs(f"v{i}") < float("inf"))
    part = rows.where(sound & F.col("g").isNotNull() & (F.col("w") > 0)).mapInArrow(_sums(width), _SCHEMA)
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism)
    while tasks > FAN:  # more partial results than this are merged on the way
        tasks = -(-tasks // FAN)
        part = part.repartition(tasks).mapInArrow(_merge(width), _SCHEMA)
    out: dict[int, Moments] = {}
    for r in part.collect():  # a row per group and task of the last level
        out[r["g"]] = out.get(r["g"], Moments.none(width)) + _read(r, width)
    return out


def left_out(parts: list[Moments]) -> list[Moments]:
    """For each part, the sum of all others: running sums from both ends."""
    width = len(parts[0].mean)
    before, after = [Moments.none(width)], [Moments.none(width)]
    for p, q in zip(parts, reversed(parts), strict=True):
        before.append(before[-1] + p)
        after.append(q + after[-1])
    return [before[i] + after[len(parts) - 1 - i] for i in range(len(parts))]


def stacked(parts: list[Moments], lines: list[Line], keep_features: bool) -> Moments:
    """Moments of (forecast of a row by its part's line, features if asked for, target) over all parts: what a meta learner is fitted on."""
    width = len(parts[0].mean)
    total = None
    for m, line in zip(parts, lines, strict=True):
        top = np.append(line.coef, 0.0)[None]
        rest = np.eye(width) if keep_features else np.eye(width)[-1:]
        shift = np.concatenate([[line.intercept], np.zeros(len(rest))])
        mapped = m.mapped(np.concatenate([top, rest]), shift)
        total = mapped if total is None else total + mapped
    return total


def by_fold(lines: list[Line], features: list[str], fold: Column) -> Column:
    """The forecast of the line of each row's fold."""
    out = F.lit(None).cast("double")
    for i, line in enumerate(lines):
        out = F.when(fold == i, line.column(features)).otherwise(out)
    return out
