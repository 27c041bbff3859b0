"""A classifier for each of any number of families, fitted together: linear discriminants from grouped sums.

One aggregation by (family, class) gives counts, sums and products of the features; one by family pools them. No list of families is collected, and the plan is the same for
two families and for a million. A family that holds a third of all rows meets partial aggregation first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .tables import has_text

#: Share of the mean variance that is added to each feature's variance, so that features without spread or copies of each other do no harm.
RIDGE = 1e-6


def _inverse(p: int):
    """(family, n, products) to the inverse of the pooled covariance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.column(1).to_numpy()
            s = np.asarray(b.column(2).flatten()).reshape(-1, p, p) / np.maximum(n, 1)[:, None, None]
            level = np.trace(s, axis1=1, axis2=2) / p
            s = s + (np.where(level > 0, level * RIDGE, 1.0) + 1e-300)[:, None, None] * np.eye(p)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(np.linalg.pinv(s, hermitian=True).reshape(len(n), -1)), pa.list_(pa.float64()))], ["family", "n", "inverse"])
    return run


def _weights(p: int):
    """(family, variation, share, mean, inverse) to the line of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            mean = np.asarray(b.column(3).flatten()).reshape(-1, p)
            inverse = np.asarray(b.column(4).flatten()).reshape(-1, p, p)
            w = np.einsum("nij,nj->ni", inverse, mean)
            at = np.log(b.column(2).to_numpy()) - 0.5 * (w * mean).sum(axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(w), pa.list_(pa.float64())), pa.array(at)], ["family", "variation", "w", "b"])
    return run


def fit_families(train: DataFrame, family: str, variation: str, features: list[str], least_rows: int = 10) -> DataFrame:
    """(family, lines): for each family with ``least_rows`` rows and two variations its classes' names, weights and offsets, as one array.

    Rows without a family or variation, or with a null or non-finite feature, take no part. The array of a family is as long as its number of variations.
    """
    p = len(features)
    ok = has_text(F.col(family)) & has_text(F.col(variation))
    for f in features:
        c = F.col(f).cast("double")
        ok = ok & c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    rows = train.where(ok).select(F.col(family).cast("string").alias("family"), F.col(variation).alias("variation"), *[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)])
    center = rows.agg(*[F.coalesce(F.avg(f"x{i}"), F.lit(0.0)).alias(f"x{i}") for i in range(p)]).first()  # one row; differences from it keep digits
    x = [F.col(f"x{i}") - F.lit(center[i]) for i in range(p)]
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    sums = rows.groupBy("family", "variation").agg(F.count("*").alias("n"), *[F.sum(c).alias(f"s{i}") for i, c in enumerate(x)], *[F.sum(x[i] * x[j]).alias(f"q{i}_{j}") for i, j in pairs])
    sums = cut_lineage(sums)
    within = [F.sum(F.col(f"q{i}_{j}") - F.col(f"s{i}") * F.col(f"s{j}") / F.col("n")).alias(f"q{i}_{j}") for i, j in pairs]
    pooled = sums.groupBy("family").agg(F.sum("n").alias("n"), F.count("*").alias("classes"), *within).where((F.col("n") >= least_rows) & (F.col("classes") >= 2))
    products = F.array(*[F.col(f"q{min(i, j)}_{max(i, j)}") for i in range(p) for j in range(p)])
    inverse = pooled.select("family", "n", products.alias("q")).mapInArrow(_inverse(p), "family string, n long, inverse array<double>")
    means = sums.select("family", "variation", F.col("n").alias("own"), F.array(*[F.col(f"s{i}") / F.col("n") for i in range(p)]).alias("mean"))
    lines = means.join(inverse, "family").select("family", "variation", (F.col("own") / F.col("n")).alias("share"), "mean", "inverse").mapInArrow(
        _weights(p), "family string, variation string, w array<double>, b double")
    shift = F.aggregate(F.zip_with("w", F.array(*[F.lit(float(c)) for c in center]), lambda w, c: w * c), F.lit(0.0), lambda a, v: a + v)
    lines = lines.select("family", F.struct("variation", "w", (F.col("b") - shift).alias("b")).alias("line"))
    return cut_lineage(lines.groupBy("family").agg(F.array_sort(F.collect_list("line")).alias("lines")))


def classify_families(models: DataFrame, rows: DataFrame, key: str, family: str, features: list[str]) -> DataFrame:
    """(key, variation, variation_conf) for rows whose family has a model: the likeliest class (ties to the smaller name) and its probability. One join; Spark chooses its kind by
    size and splits hot families. A null feature counts as 0."""
    x = F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features])
    known = rows.select(key, F.col(family).cast("string").alias("family"), x.alias("x")).join(models, "family")
    dot = lambda w: F.aggregate(F.zip_with(w, "x", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    scored = known.select(key, F.transform("lines", lambda m: F.struct((dot(m["w"]) + m["b"]).alias("s"), m["variation"].alias("v"))).alias("c"))
    scored = scored.withColumn("top", F.array_max(F.transform("c", lambda m: m["s"])))
    best = F.element_at(F.filter("c", lambda m: m["s"] == F.col("top")), 1)["v"]
    total = F.aggregate(F.transform("c", lambda m: F.exp(m["s"] - F.col("top"))), F.lit(0.0), lambda s, v: s + v)
    return scored.select(key, best.alias("variation"), (1 / total).alias("variation_conf"))
