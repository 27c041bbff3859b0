"""Logistic regressions for many labels from shared passes: each pass over the rows adds up the gradients and curvatures of all labels at once.

Newton's steps with a ridge on standardised features settle in about ten passes, whatever the number of labels. A task holds one matrix of (features + 1) squared for each
label; Spark adds the tasks entry by entry, and only these sums come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .evaluate import label_scores
from .splits import in_test

PASSES, SETTLED = 30, 1e-8


@dataclass(frozen=True)
class LabelLine:
    """Log-odds of a label as a line in the features."""

    features: tuple[str, ...]
    coef: np.ndarray
    intercept: float

    def probability(self) -> Column:
        odds = F.lit(self.intercept)
        for name, c in zip(self.features, self.coef.tolist(), strict=True):
            odds = odds + F.col(name).cast("double") * F.lit(c)
        return 1 / (1 + F.exp(-odds))


def _sound(features: list[str]) -> Column:
    ok = F.lit(True)
    for f in features:
        c = F.col(f).cast("double")
        ok = ok & c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return ok


def _summed(rows: DataFrame, make, size: int) -> np.ndarray:
    """Sum over all rows of what ``make`` gives for each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            total += make(b)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["k", "v"])

    out = np.zeros(size)
    got = rows.mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).toArrow()
    out[got["k"].to_numpy()] = got["v"].to_numpy()
    return out


def fit_labels(rows: DataFrame, labels: list[str], features: list[str], ridge: float = 0.01) -> dict[str, LabelLine]:
    """A line for each 0/1 column of ``rows``: mean log loss plus ``ridge`` / 2 times the squared coefficients of features scaled to deviation 1 (no penalty on the intercept).

    A null label leaves its row out for that label only; a row with a null or non-finite feature takes no part. A label without both classes gets its share of positives
    (softened) for every row.
    """
    p, m = len(features), len(labels)
    made = cut_lineage(rows.where(_sound(features)).select(*[F.col(f).cast("double").alias(f"f{i}") for i, f in enumerate(features)],
                                                           *[F.col(n).cast("double").alias(f"y{i}") for i, n in enumerate(labels)]))

    def matrix(b: pa.RecordBatch) -> np.ndarray:
        return np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(p)], 1) if p else np.zeros((b.num_rows, 0))

    def target(b: pa.RecordBatch, k: int) -> np.ndarray:
        return b.column(p + k).to_numpy(zero_copy_only=False)  # null is NaN

    def first(b):
        x = matrix(b)
        y = np.stack([target(b, k) for k in range(m)], 1)
        return np.concatenate([[len(x)], x.sum(axis=0), np.nansum(y, axis=0), (~np.isnan(y)).sum(axis=0)])

    sums = _summed(made, first, 1 + p + 2 * m)
    mean = sums[1:1 + p] / max(sums[0], 1)
    spread = np.sqrt(_summed(made, lambda b: ((matrix(b) - mean) ** 2).sum(axis=0), p) / max(sums[0] - 1, 1))
    live = spread > 1e-12 * np.maximum(1.0, np.abs(mean))
    scale = np.where(live, spread, 1.0)
    positives, known = sums[1 + p:1 + p + m], sums[1 + p + m:]
    open_ = np.array([0 < a < n for a, n in zip(positives, known, strict=True)], bool)
    w = np.zeros((m, p + 1))
    w[:, p] = np.log((positives + 1) / (known - positives + 1))
    w[open_, p] = np.log(positives[open_] / (known - positives)[open_])
    d = p + 1
    for _ in range(PASSES):
        now = np.flatnonzero(open_)
        if not len(now):
            break

        def gradients(b, w=w, now=now):
            x = np.concatenate([np.where(live, (matrix(b) - mean) / scale, 0.0), np.ones((b.num_rows, 1))], axis=1)
            out = np.zeros((len(now), d + d * d))
            for at, k in enumerate(now.tolist()):
                y = target(b, k)
                has = ~np.isnan(y)
                v = x[has]
                prob = 1 / (1 + np.exp(-np.clip(v @ w[k], -500, 500)))
                out[at, :d] = v.T @ (prob - y[has])
                out[at, d:] = ((v * (prob * (1 - prob))[:, None]).T @ v).ravel()
            return out.ravel()

        got = _summed(made, gradients, len(now) * (d + d * d)).reshape(len(now), -1)
        penalty = np.append(np.full(p, ridge), 0.0)
        for at, k in enumerate(now.tolist()):
            slope = got[at, :d] / known[k] + penalty * w[k]
            bend = got[at, d:].reshape(d, d) / known[k] + np.diag(penalty) + 1e-12 * np.eye(d)
            step = np.linalg.lstsq(bend, slope, rcond=None)[0]
            length = np.abs(step).max()
            w[k] -= step * min(1.0, 4.0 / max(length, 1e-300))  # far from the end a full step may overshoot
            open_[k] = length > SETTLED
    out = {}
    for k, name in enumerate(labels):
        coef = np.where(live, w[k, :p] / scale, 0.0)
        out[name] = LabelLine(tuple(features), coef, float(w[k, p] - coef @ mean))
    return out


def fit_label_lines(df: DataFrame, key: str, labels: list[str], features: list[str], least_positives: int = 10, least_auc: float = 0.7, ridge: float = 0.01,
                    seed: int = 42) -> tuple[dict[str, LabelLine], list[tuple]]:
    """Lines of all labels, and (label, area, verdict) of each: rare labels are skipped, those under ``least_auc`` on the held-out rows dropped.

    Fits share their passes, and the areas of all labels come from one exact ranking.
    """
    positives = df.agg(*[F.sum(F.coalesce(F.col(n), F.lit(0))).alias(n) for n in labels]).first()
    common = [n for n in labels if (positives[n] or 0) >= least_positives]
    scores = {n: (n, None, "skipped") for n in labels if n not in common}
    models: dict[str, LabelLine] = {}
    if common:
        test = in_test(F.col(key), 0.2, seed)
        lines = fit_labels(df.filter(~test), common, features, ridge)
        each = F.explode(F.array(*[F.struct(F.lit(n).alias("label"), F.col(n).cast("double").alias("y"), lines[n].probability().alias("score")) for n in common])).alias("e")
        held = df.filter(test & _sound(features)).select(each).select("e.label", "e.y", "e.score").where("y is not null")
        areas = {r.label: r.auc for r in label_scores(held, "label", "y", "score").select("label", "auc").collect()}  # a row per label
        for n in common:
            auc = areas.get(n)
            auc = 0.5 if auc is None else float(auc)
            scores[n] = (n, auc, "kept" if auc >= least_auc else "dropped")
            if auc >= least_auc:
                models[n] = lines[n]
    return models, [scores[n] for n in labels]


def label_texts(models: dict[str, LabelLine], rows: DataFrame, key: str, threshold: float = 0.5) -> DataFrame:
    """(key, labels, confidences): labels at or above the threshold, most confident first, joined to text. Row-local; a row with a null feature has no labels."""
    pairs = F.array(*[F.struct((-m.probability()).alias("m"), F.lit(n).alias("label")) for n, m in models.items()]) if models else F.expr(
        "cast(array() as array<struct<m:double,label:string>>)")
    hits = F.array_sort(F.filter(pairs, lambda x: -x["m"] >= threshold))
    return rows.select(key, F.array_join(F.transform(hits, lambda x: x["label"]), " ").alias("labels"), F.transform(hits, lambda x: -x["m"]).alias("confidences"))
