"""TF-IDF moves lists of a token by part: one exchange behind what is written, the plain weights, keys dealt to all tasks."""

import math
from collections import Counter

from pyspark.sql import functions as F

from squareframe.operators import text as X


def test_weights_are_the_plain_ones(spark):
    rows = [(1, "a b a"), (1, "b c"), (2, "A  d"), (3, None), (4, "   "), (None, "a z"), (5, "a b c d e"), (6, "e")]
    got = X.tf_idf(spark.createDataFrame(rows, "k int, t string"), "k", F.col("t"), least=2)
    counts = {}
    for k, t in rows:
        counts.setdefault(k, Counter()).update((t or "").lower().split())
    df = Counter(token for c in counts.values() for token in c)
    want = {}
    for k, c in counts.items():
        w = {token: n * (math.log((1 + len(rows)) / (1 + df[token])) + 1) for token, n in c.items() if df[token] >= 2}
        want |= {(k, token): x / math.sqrt(sum(y * y for y in w.values())) for token, x in w.items() if k is not None}
    found = {(r.k, r.token): r.weight for r in got.collect()}
    assert found.keys() == want.keys() and all(abs(found[at] - w) < 1e-9 for at, w in want.items())
    assert {r.token for r in X.tf_idf(spark.createDataFrame(rows, "k int, t string"), "k", F.col("t"), most=2).collect()} == {"a", "b"}


def test_weights_are_moved_once(spark):
    df = spark.createDataFrame([(i, f"a b{i % 3} c{i}") for i in range(30)], "k int, t string")
    plan = X.tf_idf(df, "k", F.col("t"), least=2)._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning") == 1


def test_keys_go_to_every_task(spark):
    at = X._part_of(spark.range(1), "id", 8)
    seen = spark.range(4000).select(at.alias("_part")).repartition(8, "_part").groupBy(F.spark_partition_id().alias("p")).agg(F.countDistinct("_part").alias("parts"), F.count("*").alias("n")).collect()
    assert len(seen) == 8 and all(r.parts == 1 and r.n > 300 for r in seen)
