"""Classifiers of many families from grouped sums against numpy, and ten thousand of them in one plan."""

import numpy as np
from pyspark.sql import functions as F

from squareframe.operators import discriminants as DA


def test_probabilities_against_plain_sums(spark):
    rng = np.random.default_rng(4)
    data = []
    for f in ("p", "q"):
        for c, name in enumerate("xyz"):
            data += [(f, name, *map(float, rng.normal([1000 + 3 * c, -2 * c, 5], 1))) for _ in range(40 + 10 * c)]
    rows = [(i, *r) for i, r in enumerate(data)]
    df = spark.createDataFrame(rows, "k int, family string, variation string, a double, b double, c double").repartition(3)
    feats = ["a", "b", "c"]
    got = {r.k: r for r in DA.classify_families(DA.fit_families(df, "family", "variation", feats), df, "k", "family", feats).collect()}
    for f in ("p", "q"):
        own = [r for r in rows if r[1] == f]
        x, y = np.array([r[3:] for r in own]), np.array([r[2] for r in own])
        mean = {n: x[y == n].mean(axis=0) for n in "xyz"}
        inverse = np.linalg.inv(sum((x[y == n] - mean[n]).T @ (x[y == n] - mean[n]) for n in "xyz") / len(x))
        score = np.stack([np.log((y == n).mean()) - 0.5 * np.einsum("ni,ij,nj->n", x - mean[n], inverse, x - mean[n]) for n in "xyz"], 1)
        prob = np.exp(score - score.max(axis=1, keepdims=True))
        prob /= prob.sum(axis=1, keepdims=True)
        for r, p in zip(own, prob, strict=True):
            assert got[r[0]].variation == "xyz"[p.argmax()] and abs(got[r[0]].variation_conf - p.max()) < 1e-3


def test_poor_families(spark):
    rows = [(1, "one", "a", 1.0), (2, "one", "a", 2.0), (3, None, "a", 1.0), (4, "few", "a", 1.0), (5, "few", "b", 2.0)] + [(10 + i, "flat", "ab"[i % 2], 7.0) for i in range(20)] + [(40, "flat", "a", None)]
    df = spark.createDataFrame(rows, "k int, family string, variation string, x double")
    models = DA.fit_families(df, "family", "variation", ["x"])
    assert [r.family for r in models.collect()] == ["flat"]
    got = DA.classify_families(models, df, "k", "family", ["x"]).collect()
    assert len(got) == 21 and all(abs(r.variation_conf - 0.5) < 1e-6 for r in got if r.k != 40)
    assert DA.fit_families(df.limit(0), "family", "variation", ["x"]).count() == 0


def test_ten_thousand_families_in_one_plan(spark):
    rows = spark.range(120_000).select("id", (F.col("id") % 10_000).cast("string").alias("family"), F.when(F.col("id") % 20_000 < 10_000, "low").otherwise("high").alias("variation"),
                                       (F.when(F.col("id") % 20_000 < 10_000, 0.0).otherwise(8.0) + F.rand(3)).alias("x"))
    spark.sparkContext.setJobGroup("families", "")
    models = DA.fit_families(rows, "family", "variation", ["x"])
    out = DA.classify_families(models, rows, "id", "family", ["x"])
    assert models.count() == 10_000
    assert out.join(rows.withColumnRenamed("variation", "want"), "id").where("variation != want").count() == 0
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("families")) < 40
