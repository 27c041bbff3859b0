"""Logistic regression on hashed word and character n-grams: features, fit on a bounded labelled sample, calibrated scores in Arrow batches.

A text's feature vector has four families: byte n-grams of sizes 3 and 4, words, and pairs of words next to each other. Each family holds shares that sum to 1,
hashed into ``DIMS`` buckets, so a score doesn't depend on the length of the text and a text of any length is read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .flat import Prefix, flat, mixed, slices, words

BITS = 15
DIMS = 1 << BITS
#: Rows of each class that a fit reads at most, chosen by a hash of the key. Only the fit is bounded; counts and scores cover all rows.
SAMPLE_ROWS = 600
#: Bytes of whole texts that are scored at a time.
SLICE = 1 << 18
FAMILIES = ("char3", "char4", "word", "pair")
STEPS = 150
_GRAM = {3: np.uint32(0x9E3779B1), 4: np.uint32(0x85EBCA77)}


def family_buckets(data: np.ndarray, off: np.ndarray, with_words: bool = True):
    """For each family: the bucket of each n-gram, and the first and last + 1 n-gram of each text."""
    out, wide = [], data.astype(np.uint32)
    for n, k in _GRAM.items():
        m = max(0, len(data) - n + 1)
        code = wide[:m].copy()
        for i in range(1, n):
            code |= wide[i:m + i] << np.uint32(8 * i)
        code *= k
        code >>= np.uint32(32 - BITS)
        begin = np.minimum(off[:-1], m)
        out.append((code, begin, np.clip(off[1:] - n + 1, begin, m)))
    if not with_words:
        return out
    starts, ends, of = words(data, off)
    h = Prefix(data).hash(starts, ends)
    out.append(((mixed(h) >> np.uint64(64 - BITS)).astype(np.uint32), of[:-1], of[1:]))
    pair = mixed(h[:-1] * np.uint64(3) + h[1:]) >> np.uint64(64 - BITS)
    out.append((pair.astype(np.uint32), np.minimum(of[:-1], len(pair)), np.clip(of[1:] - 1, np.minimum(of[:-1], len(pair)), len(pair))))
    return out


@dataclass(frozen=True)
class Model:
    """Weights per family and bucket, bias, and the two numbers of the calibration. A few hundred kilobytes whatever the input."""

    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0
    with_words: bool = True

    def raw(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        score = np.full(len(off) - 1, self.bias)
        for w, (bucket, begin, end) in zip(self.weights, family_buckets(data, off, self.with_words), strict=False):
            total = np.zeros(len(bucket) + 1)
            np.cumsum(w[bucket], out=total[1:])
            score += (total[end] - total[begin]) / np.maximum(end - begin, 1)
        return score

    def logit(self, column: pa.Array) -> np.ndarray:
        """Calibrated log-odds of each row of a string column, whole texts, a slice at a time."""
        data, off = flat(column)
        out = np.zeros(len(column))
        for i, j in slices(off, SLICE):
            out[i:j] = self.raw(data[off[i]:off[j]], off[i:j + 1] - off[i])
        return out * self.slope + self.shift


def _rows(with_words: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = flat(b.column("text"))
            for i, j in slices(off, 1 << 16):
                d, o = data[off[i]:off[j]], off[i:j + 1] - off[i]
                index, value = [], []
                fams = family_buckets(d, o, with_words)
                for r in range(j - i):
                    parts = [np.unique(bucket[begin[r]:end[r]], return_counts=True) for bucket, begin, end in fams]
                    index.append(np.concatenate([u.astype(np.int64) + f * DIMS for f, (u, _) in enumerate(parts)]).astype(np.int32))
                    value.append(np.concatenate([c / max(1, c.sum()) for _, c in parts]).astype(np.float32))
                yield pa.RecordBatch.from_arrays([
                    b.column("y").slice(i, j - i), b.column("held").slice(i, j - i),
                    pa.array(index, pa.list_(pa.int32())), pa.array(value, pa.list_(pa.float32()))], ["y", "held", "idx", "val"])
    return run


def _descend(y, rows, idx, val, dims, l2=1e-5):
    """Full-batch Adam on the mean log loss: the same figures on every run."""
    w, b = np.zeros(dims), 0.0
    m1, m2, c1, c2 = np.zeros(dims), np.zeros(dims), 0.0, 0.0
    n, edges = len(y), np.searchsorted(rows, np.arange(len(y) + 1))
    for t in range(1, STEPS + 1):
        total = np.concatenate([[0.0], np.cumsum(w[idx] * val)])
        p = 1 / (1 + np.exp(-np.clip(total[edges[1:]] - total[edges[:-1]] + b, -40, 40)))
        e = (p - y) / n
        g = np.bincount(idx, weights=val * e[rows], minlength=dims) + l2 * w / n
        gb = e.sum()
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        c1, c2 = 0.9 * c1 + 0.1 * gb, 0.999 * c2 + 0.001 * gb * gb
        fix1, fix2 = 1 - 0.9 ** t, 1 - 0.999 ** t
        w -= 0.5 * (m1 / fix1) / (np.sqrt(m2 / fix2) + 1e-9)
        b -= 0.05 * (c1 / fix1) / (np.sqrt(c2 / fix2) + 1e-9)
    return w, b


def _calibrate(s, y):
    """Slope and shift of Platt's method by Newton's steps, with his softened targets; identity where one class is missing."""
    pos, neg = (y > 0.5).sum(), (y <= 0.5).sum()
    if not pos or not neg:
        return 1.0, 0.0
    t = np.where(y > 0.5, (pos + 1) / (pos + 2), 1 / (neg + 2))
    scale = max(1e-9, float(np.abs(s).max()))
    x, a = np.stack([s / scale, np.ones(len(s))], 1), np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ a, -40, 40)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        a = a - np.clip(np.linalg.solve(h, x.T @ (p - t) + 1e-6 * a), -5, 5)
    return (float(a[0] / scale), float(a[1])) if a[0] > 0 else (1.0 / scale, 0.0)


def fit(labelled: DataFrame, key: str, text: str, label: Column, sample_rows: int = SAMPLE_ROWS, with_words: bool = True) -> Model:
    """A calibrated model from rows with a 0/1 ``label``; null labels don't count.

    The fit reads at most ``sample_rows`` rows of each class, those with the smallest hash of ``key``; a fifth of them is held out for the calibration.
    The share of each class is counted over all labelled rows and corrects the balanced sample. Without labelled rows, or with one class only, the model
    gives the share (softened) for every text.
    """
    rows = labelled.select(F.col(key).alias("k"), F.col(text).alias("text"), label.cast("int").alias("y")).where("y in (0, 1)")
    rows = rows.withColumn("h", F.xxhash64(F.lit("sample"), F.col("k").cast("string")))
    share = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}  # two rows at most
    n1, n0 = share.get(1, 0), share.get(0, 0)
    prior = np.log((n1 + 1) / (n0 + 1))
    families = len(FAMILIES) if with_words else len(_GRAM)
    if not n1 or not n0:
        return Model(np.zeros((families, DIMS)), 0.0, 1.0, float(prior), with_words)
    first = lambda df, y, *order: df.where(F.col("y") == y).orderBy(*order).limit(sample_rows)
    keys = {r.h for y in (0, 1) for r in first(rows.select("h", "y"), y, "h").collect()}  # found without the texts, so only theirs are moved
    few = rows.where(F.xxhash64(F.lit("sample"), F.col("k").cast("string")).isin(sorted(keys))).withColumn("t", F.xxhash64("text"))
    chosen = first(few, 1, "h", "k", "t").unionByName(first(few, 0, "h", "k", "t"))
    got = (chosen.select("y", "text", (F.pmod("h", F.lit(5)) == 0).alias("held"))
           .mapInArrow(_rows(with_words), "y int, held boolean, idx array<int>, val array<float>").toArrow().combine_chunks())
    y, held = got["y"].to_numpy().astype(float), got["held"].to_numpy(zero_copy_only=False)
    lists, vals = got["idx"].combine_chunks(), got["val"].combine_chunks()
    idx, val, cut = lists.flatten().to_numpy(), vals.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
    row = np.repeat(np.arange(len(y)), cut)
    train = ~held if len(set(y[~held])) == 2 else np.ones(len(y), bool)
    take, number = train[row], np.cumsum(train) - 1
    w, b = _descend(y[train], number[row[take]], idx[take], val[take].astype(float), families * DIMS)
    total = np.concatenate([[0.0], np.cumsum(w[idx] * val)])
    edge = np.concatenate([[0], np.cumsum(cut)])
    score = total[edge[1:]] - total[edge[:-1]] + b
    test = held if len(set(y[held])) == 2 else train
    slope, shift = _calibrate(score[test], y[test])
    balanced = np.log((y[test] > 0.5).sum() / (y[test] <= 0.5).sum())
    return Model(w.reshape(families, DIMS), float(b), slope, float(shift + prior - balanced), with_words)
