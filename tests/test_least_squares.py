"""Linear fits from one pass against separate fits and plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from squareframe.operators import least_squares as LS
from squareframe.operators import models as M
from squareframe.operators.splits import fold_of

X = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    n = 600
    a, b = rng.normal(5000, 3, n), rng.normal(0, 1, n)
    y = 3 * a - 2 * b + rng.normal(0, 4, n) - 13000
    data = [(i, float(p), float(q), 7.0, float(v)) for i, (p, q, v) in enumerate(zip(a, b, y))]
    return spark.createDataFrame(data, "k int, a double, b double, c double, y double").repartition(5).cache()


def _plain(df):
    t = df.toPandas()
    return t[X].to_numpy(), t.y.to_numpy()


@pytest.mark.parametrize("penalty, lasso", [(0.0, 0.0), (0.01, 0.0), (5.0, 0.0), (0.5, 0.5), (0.3, 1.0)])
def test_a_fit_is_that_of_the_library(rows, penalty, lasso):
    line = LS.moments(rows, X, "y", F.array(F.lit(0)))[0].fit(penalty, lasso)
    model = M.fit_regressor(rows, "linear", X, "y", regParam=penalty, elasticNetParam=lasso, tol=1e-12, maxIter=500)
    want = model.stages[-1]
    assert line.coef == pytest.approx(want.coefficients.toArray(), abs=1e-5) and line.coef[2] == 0
    x, _ = _plain(rows)
    assert x @ line.coef + line.intercept == pytest.approx(x @ want.coefficients.toArray() + want.intercept, abs=1e-4)


def test_errors_and_groups(spark, rows):
    parts = LS.moments(rows, X, "y", F.array("k", F.lit(-1)).cast("array<int>"))
    assert len(parts) == 601
    line, (x, y) = parts[-1].fit(), _plain(rows)
    assert parts[-1].squared_error(line) == pytest.approx(((y - x @ line.coef - line.intercept) ** 2).sum(), rel=1e-9)
    odd = rows.limit(3).union(spark.createDataFrame([(1, None, 1.0, 1.0, 1.0), (2, float("nan"), 1.0, 1.0, 1.0), (3, 1.0, 1.0, 1.0, None)], rows.schema))
    assert LS.moments(odd, X, "y", F.array(F.lit(0)))[0].n == 3 and LS.moments(rows.limit(0), X, "y", F.array(F.lit(0))) == {}
    assert LS.moments(rows.limit(1), X, "y", F.array(F.lit(0)))[0].fit().coef.tolist() == [0, 0, 0]
    weighted = LS.moments(rows.withColumn("w", 1 + F.col("k") % 3), X, "y", F.array(F.lit(0)), "w")[0].fit()
    k = rows.toPandas().k.to_numpy()
    design, w = np.c_[x[:, :2] - x[:, :2].mean(axis=0), np.ones(len(x))], np.sqrt(1 + k % 3)
    assert weighted.coef[:2] == pytest.approx(np.linalg.lstsq(design * w[:, None], y * w, rcond=None)[0][:2], rel=1e-8)


def test_merging_by_a_tree(rows, monkeypatch):
    whole = LS.moments(rows, X, "y", F.array(F.lit(0)))[0]
    monkeypatch.setattr(LS, "FAN", 2)
    tree = LS.moments(rows, X, "y", F.array(F.lit(0)))[0]
    assert tree.n == whole.n and tree.products == pytest.approx(whole.products, rel=1e-10, abs=1e-9)


def _jobs(spark, tag, work):
    spark.sparkContext.setJobGroup(tag, tag)
    try:
        out = work()
        return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(tag))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_folds_from_one_pass(spark, rows):
    (out, models), jobs = _jobs(spark, "folds", lambda: M.out_of_fold(rows, "k", "linear", X, "y", 5))
    assert jobs <= 2  # one query for all folds
    folded = rows.withColumn("fold", fold_of(F.col("k"), 5, 42))
    got = {r.k: r.prediction for r in out.collect()}
    for i in range(5):
        want = M.with_prediction(M.fit_regressor(folded.where(F.col("fold") != i), "linear", X, "y"), folded.where(F.col("fold") == i), "p")
        assert all(abs(r.p - got[r.k]) < 1e-5 for r in want.collect())
    assert len(M.averaged(models, rows).select("prediction").collect()) == 600


@pytest.mark.parametrize("use_features", [False, True])
def test_stack_from_one_pass(spark, rows, use_features):
    kw = {"bases": ["linear"], "meta": "linear", "features": X, "use_features": use_features}
    stack, jobs = _jobs(spark, f"stack{use_features}", lambda: M.Stack(**kw).fit(rows, "k", "y"))
    assert jobs <= 2
    oof, _ = M.out_of_fold(rows, "k", "linear", X, "y")
    meta = M.fit_regressor(rows.join(oof.select("k", F.col("prediction").alias("linear_pred")), "k"), "linear", ["linear_pred", *(X if use_features else [])], "y")
    base = M.with_prediction(M.fit_regressor(rows, "linear", X, "y"), rows, "linear_pred")
    want = {r.k: r.p for r in M.with_prediction(meta, base, "p").collect()}
    assert all(abs(r.prediction - want[r.k]) < 1e-4 for r in stack.predict(rows).collect())


@pytest.mark.parametrize("meta", [None, "linear"])
def test_ranges_from_one_pass(spark, rows, meta, monkeypatch):
    shifted = rows.withColumn("y", F.col("y") + 0.0)
    kw = {"ranges": [(1950, 1990), (1990, 2010), (2010, 2100), (5000, 6000)], "overlap": 5, "least_rows": 20, "meta": meta}
    model, jobs = _jobs(spark, f"ranges{meta}", lambda: M.RangeModels("linear", X, **kw).fit(shifted, "y"))
    assert jobs <= 2 and (5000, 6000) not in model.models
    got = {r.k: r.prediction for r in model.predict(shifted).collect()}
    monkeypatch.setattr(M, "linear_settings", lambda kw: None)
    apart = M.RangeModels("linear", X, **kw).fit(shifted, "y")
    assert list(apart.models) == list(model.models)
    assert all(abs(r.prediction - got[r.k]) < 1e-3 for r in apart.predict(shifted).collect())
