"""Equal rows of a fit are shared, with their number as weight; boards are written without a step per square."""

from pyspark.sql import functions as F

from squareframe.functions import squares as S
from squareframe.operators import boards as B
from squareframe.operators import models as M


def test_equal_rows_are_few_and_all_of_them_count(spark):
    rows = spark.range(3000).select((F.col("id") % 3 == 0).cast("string").alias("label"), (F.col("id") % 5).cast("double").alias("x"))
    got = M.shared_rows(rows, ["label", "x"], shares=16)
    assert got.count() == 160 and got.agg(F.sum("_n")).first()[0] == 3000
    plain = {(r.label, r._w) for r in M.balanced_weights(rows, "label").select("label", "_w").distinct().collect()}
    sums = M.balanced_weights(got, "label", count="_n").groupBy("label").agg(F.sum("_w").alias("w")).collect()
    assert {r.label: round(r.w, 6) for r in sums} == {"true": 1500.0, "false": 1500.0} and len(plain) == 2
    odd = spark.createDataFrame([("a", 1.0), ("a", None), ("b", float("nan"))], "label string, x double")
    assert M.shared_rows(odd, ["label", "x"]).count() == 3


def test_cells_are_written_without_a_lambda(spark):
    import random

    rng, rows, want = random.Random(5), [], []
    for n in range(60):
        cells = "".join(rng.choice("." * (n % 4 * 6) + S.LETTERS) for _ in range(64))
        rows.append((n, *[S.signed(sum(1 << i for i, c in enumerate(cells) if c == letter)) for letter in S.LETTERS]))
        want.append(cells)
    rows += [(60, *[0] * 12), (61, S.signed(S.FULL), *[0] * 11), (62, *[0] * 11, S.signed(1 << 63))]
    want += ["." * 64, "P" * 64, "." * 63 + "k"]
    got = B.cells_from_sets(spark.createDataFrame(rows, ["n", *S.SETS]))
    assert [r.cells for r in got.orderBy("n").collect()] == want
    assert "lambda" not in got._jdf.queryExecution().optimizedPlan().toString()
