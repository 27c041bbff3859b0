"""Many labels from shared passes against separate fits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from squareframe.operators import logistic as LL
from squareframe.operators import models as M

X = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(2)
    a, b = rng.normal(100, 5, 900), rng.normal(0, 1, 900)
    odds = (a - 100) / 5 - 2 * b
    y = {f"l{k}": (rng.random(900) < 1 / (1 + np.exp(-(odds * (k + 1) / 3 - k)))).astype(int) for k in range(4)}
    data = [(i, float(a[i]), float(b[i]), 3.0, *[int(v[i]) if k == 0 or (i + k) % 7 else None for k, v in enumerate(y.values())], 0, 1) for i in range(900)]
    return spark.createDataFrame(data, "k int, a double, b double, c double, l0 int, l1 int, l2 int, l3 int, none int, all int").repartition(4).cache()


def test_lines_are_those_of_separate_fits(rows):
    got = LL.fit_labels(rows, ["l0", "l1", "l2", "l3", "none", "all"], X, 0.01)
    for n in ("l0", "l1", "l2", "l3"):
        own = rows.where(F.col(n).isNotNull())
        want = M.LogisticRegression(labelCol=n, featuresCol="_x", regParam=0.01, tol=1e-12, maxIter=500).fit(M.assembler(X).transform(own))
        near = 1e-5 if n == "l0" else 1e-2  # the deviations that scale the penalty are those of all rows, also where a label is null
        assert got[n].coef == pytest.approx(want.coefficients.toArray(), rel=near, abs=near) and got[n].intercept == pytest.approx(want.intercept, rel=near, abs=near)
    assert got["none"].coef.tolist() == [0, 0, 0] and got["none"].intercept < -5 < 5 < got["all"].intercept


def test_scores_and_texts(spark, rows):
    wide = rows.withColumn("sure", (F.col("b") > 0).cast("int"))
    models, scores = LL.fit_label_lines(wide, "k", ["none", "l3", "sure"], X, ridge=1e-4)
    assert [s[2] for s in scores] == ["skipped", "kept", "kept"] and scores[2][1] > 0.999
    odd = spark.createDataFrame([(1, None, 1.0, 1.0), (2, 100.0, 3.0, 1.0), (3, 100.0, -3.0, float("nan"))], "k int, a double, b double, c double")
    got = {r.k: (r.labels, r.confidences) for r in LL.label_texts({"sure": models["sure"]}, odd, "k").collect()}
    assert got[1][0] == "" and got[2][0] == "sure" and got[2][1][0] > 0.9
    assert LL.label_texts({}, odd, "k").where("labels != ''").count() == 0


def test_passes_do_not_grow_with_labels(spark, rows):
    def jobs(n):
        wide = rows.select("*", *[(F.col("b") + F.col("a") * 0.01 * i > 1).cast("int").alias(f"m{i}") for i in range(n)])
        spark.sparkContext.setJobGroup(f"labels{n}", "")
        LL.fit_labels(wide, [f"m{i}" for i in range(n)], X)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"labels{n}"))

    one, many = jobs(1), jobs(50)
    assert many <= 1.5 * one + 6  # a label that settles late costs passes, not its number
