"""Trees are fitted on cells of equal bins: all rows count, and the fit is that of the rows."""

import pytest
from pyspark.sql import functions as F

from squareframe.operators import models as M


def rows_of(spark, n=4000):
    x, z = (F.col("id") * 7 % 40).cast("double"), (F.col("id") % 11).cast("double")
    return spark.range(n).select("id", x.alias("x"), z.alias("z"), (F.sin(x) * 4 + z % 3 + F.col("id") % 13 / 10).alias("y"))


def test_cells_count_every_row_and_keep_its_deviation(spark):
    rows = rows_of(spark)
    bounds = M.bin_bounds(rows, ["x", "z"])
    got = M.cells(rows, bounds, "y")
    assert got.count() <= 440 and got.agg(F.sum("_n"), F.sum("_rows")).first()[:] == (4000.0, 4000)
    assert got.agg(F.sum(F.col("_n") * F.col("_y"))).first()[0] == pytest.approx(rows.agg(F.sum("y")).first()[0])
    odd = spark.createDataFrame([(1.0, 2.0), (None, 3.0), (float("nan"), 5.0), (float("inf"), 1.0)], "x double, y double")
    kept = M.cells(odd, M.bin_bounds(odd, ["x"]), "y")
    missing = kept.where("_bin_0 = 2").first()  # null and not-a-number
    assert kept.agg(F.sum("_n")).first()[0] == 4 and (missing._n, missing._y) == (2.0, 4.0)
    assert missing._within == pytest.approx(2.0)


def test_boosted_trees_on_cells_are_those_on_rows(spark):
    rows = rows_of(spark)
    model = M.fit_regressor(rows, "gbt", ["x", "z"], "y", maxIter=5, maxDepth=3)
    bins = model.stages[0].getOutputCols()
    binned = model.stages[1].transform(model.stages[0].transform(rows).withColumns({c: F.col(c).cast("int") for c in bins}))  # numbers, not categories
    plain = M.REGRESSORS["gbt"](labelCol="y", maxIter=5, maxDepth=3).fit(binned)
    both = plain.transform(binned).select("id", F.col("prediction").alias("p")).join(M.with_prediction(model, rows, "q"), "id")
    assert both.agg(F.max(F.abs(F.col("p") - F.col("q")))).first()[0] < 1e-9


def test_search_errors_are_those_of_the_rows(spark):
    rows = rows_of(spark)
    choices = {"maxDepth": [2], "stepSize": [0.3], "maxIter": [4]}
    _, done = M.search_boosted(rows, ["x", "z"], "y", "id", 1, choices)
    held = M.in_test(F.col("id"), 0.2, 42)
    plain = M.fit_regressor(rows.where(~held), "gbt", ["x", "z"], "y", maxDepth=2, stepSize=0.3, maxIter=4)
    assert done[0][1] == pytest.approx(M.log_rmse(plain.transform(rows.where(held)), "y"), abs=1e-9)


def test_null_target_is_refused_and_forest_counts_all_rows(spark):
    rows = rows_of(spark, 600)
    with pytest.raises(Exception, match="(?i)null|nan"):
        M.fit_regressor(rows.withColumn("y", F.when(F.col("id") != 5, F.col("y"))), "gbt", ["x", "z"], "y", maxIter=1)
    forest = M.fit_regressor(rows, "forest", ["x", "z"], "y", numTrees=10)
    plain = M.Pipeline(stages=[M.assembler(["x", "z"]), M.REGRESSORS["forest"](labelCol="y", numTrees=10)]).fit(rows)
    assert M.log_rmse(forest.transform(rows), "y") < 1.1 * M.log_rmse(plain.transform(rows), "y")


def test_stack_predicts_out_of_fold_without_a_join(spark):
    rows = rows_of(spark, 600)
    models, _ = M.fold_models(rows.withColumn("_fold", M.fold_of(F.col("id"), 3)), "_fold", "gbt", ["x", "z"], "y", 3, maxIter=2)
    got = M.with_fold_prediction(rows.withColumn("_fold", M.fold_of(F.col("id"), 3)), "_fold", models, ["x", "z"], "p")
    assert got.count() == 600 and "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
