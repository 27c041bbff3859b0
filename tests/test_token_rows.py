"""Token rows are those of the token lists, made without a lambda; the long side of the joins of TF-IDF isn't sorted."""

from pyspark.sql import functions as F

from squareframe.operators import tags as T
from squareframe.operators import text as X
from squareframe.operators.moves import tokens


def test_token_rows_are_those_of_the_lists(spark):
    texts = [None, "", "  ", "a", " A  b\ta\n", " x y z", "\n\x0bone\x0c two\r\n", "İ ß B b"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    for lower in (True, False):
        got = T.token_rows(df, "k", F.col("t"), lower)
        want = df.select("k", F.explode(tokens(F.lower("t") if lower else F.col("t"))).alias("token"))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
        assert "lambda" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_long_side_of_tf_idf_is_not_sorted(spark):
    df = spark.createDataFrame([(i, f"a b{i % 3} c{i}") for i in range(30)], "k int, t string")
    got = X.tf_idf(df, "k", F.col("t"), least=2)
    assert "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()
    norms = got.groupBy("k").agg(F.sum(F.col("weight") ** 2).alias("n")).collect()
    assert len(norms) == 30 and all(abs(r.n - 1) < 1e-9 for r in norms)
