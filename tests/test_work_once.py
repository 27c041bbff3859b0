"""Searches from one pass, weighted text vectors, forests over one vector column."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from squareframe.operators import least_squares as LS
from squareframe.operators import models as M
from squareframe.operators import text as X
from squareframe.operators.splits import in_test


def _rated(spark, n=4000):
    return spark.range(n).select("id", (F.col("id") % 17).cast("double").alias("a"), (F.col("id") % 5 * 3.0).alias("b"), (F.col("id") % 17 * 2.0 - F.col("id") % 5 + F.col("id") % 3).alias("y"))


def test_a_linear_search_reads_the_rows_once(spark, monkeypatch):
    calls, plain = [], LS.moments
    monkeypatch.setattr(LS, "moments", lambda *a, **k: calls.append(1) or plain(*a, **k))
    rows, grid = _rated(spark), {"regParam": [0.0, 0.3, 5.0], "elasticNetParam": [0.0, 0.5]}
    best, scores = M.search_regressor(rows, "linear", ["a", "b"], "y", grid, "id")
    assert len(calls) == 1 and len(scores) == 6 and isinstance(best, M.LineModel)
    test = in_test(F.col("id"), 0.2, 42)
    for picks, score in scores:
        model = M.fit_regressor(rows.filter(~test), "linear", ["a", "b"], "y", **picks)
        assert score == pytest.approx(M.log_rmse(model.transform(rows.filter(test)), "y"), rel=2e-3)
    held = M.with_prediction(best, rows.filter(test), "prediction")
    assert M.log_rmse(held, "y") == pytest.approx(min(s for _, s in scores), rel=1e-9)


def test_a_search_without_held_rows(spark):
    _, scores = M.search_regressor(_rated(spark, 3).withColumn("id", F.lit(0)), "linear", ["a"], "y", {"regParam": [0.0]}, "id")
    assert np.isfinite(scores[0][1])


def test_a_text_that_stands_for_many_counts_as_many(spark):
    texts = [("a b c", 7), ("b c d d", 3), ("e f", 1), ("a f g", 4), ("", 2)]
    once = spark.createDataFrame([(i, t, n) for i, (t, n) in enumerate(texts)], "id int, t string, n long")
    many = spark.createDataFrame([(i, t) for i, (t, n) in enumerate(texts) for _ in range(n)], "id int, t string")
    few = {r.id: list(r)[1:] for r in X.svd_features(once, "id", F.col("t"), k=2, weight="n").collect()}
    for r in X.svd_features(many, "id", F.col("t"), k=2).collect():
        assert list(r)[1:] == pytest.approx(few[r.id], abs=1e-5)
    shares = X.topic_features(once, "id", F.col("t"), k=2, iterations=3, weight="n").collect()
    assert len(shares) == 5 and all(r.topic_0 + r.topic_1 == pytest.approx(1) or r.id == 4 for r in shares)


def test_topics_cut_a_text_into_terms_a_few_times_only(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(t):
        seen.add(1)
        return t
    rows = spark.createDataFrame([(i, f"w{i % 7} w{i % 3}") for i in range(100)], "id int, t string")
    X.topic_features(rows, "id", F.udf(counted, "string").asNondeterministic()(F.col("t")), k=2).collect()
    assert seen.value <= 400  # two for the terms, one for the counts; ten passes of the fit read those


def test_forests_of_families_read_one_vector_column(spark, monkeypatch):
    columns, plain = [], M.split_rows
    monkeypatch.setattr(M, "split_rows", lambda rows, *a: columns.append(rows.columns) or plain(rows, *a))
    rows = spark.range(200).select("id", F.when(F.col("id") % 2 == 0, "f").otherwise("g").alias("fam"), F.when(F.col("id") % 4 < 2, "a").otherwise("b").alias("var"), (F.col("id") % 4).cast("double").alias("x"))
    got = M.classify_variations(M.variation_models(rows, "fam", "var", ["x"], trees=5), rows, "id", "fam").collect()
    assert columns == [["fam", "var", "_x"], ["id", "fam", "_x"]]
    assert len(got) == 200 and all(r.variation == ("a" if r.id % 4 < 2 else "b") for r in got)
