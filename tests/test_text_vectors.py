"""Truncated SVD and topics against numpy and planted answers."""

import random

import numpy as np
import pytest
from pyspark.ml.linalg import SparseVector, Vectors
from pyspark.sql import functions as F

from squareframe.operators import text as X


def _sparse_rows(spark, a):
    rows = [(i, Vectors.sparse(a.shape[1], [(j, float(v)) for j, v in enumerate(r) if v])) for i, r in enumerate(a)]
    return spark.createDataFrame(rows, ["k", "features"]).repartition(4)


@pytest.mark.parametrize("seed", range(3))
def test_singular_values_and_reconstruction(spark, seed):
    rng = np.random.default_rng(seed)
    a = np.where(rng.random((300, 120)) < 0.08, rng.random((300, 120)), 0.0) @ np.diag(rng.uniform(0.2, 2, 120))
    values, right = X.truncated_svd(_sparse_rows(spark, a), 120, 8)
    want = np.linalg.svd(a, compute_uv=False)
    assert values == pytest.approx(want[:8], rel=1e-4)
    assert np.abs(right.T @ right - np.eye(8)).max() < 1e-9
    left = np.linalg.norm(a - a @ right @ right.T)
    assert left == pytest.approx(np.sqrt((want[8:] ** 2).sum()), rel=1e-4)


def test_fewer_terms_than_directions_and_low_rank(spark):
    a = np.outer(np.arange(1, 9), [1.0, 0, 2])
    values, right = X.truncated_svd(_sparse_rows(spark, a), 3, 3)
    assert values == pytest.approx([np.linalg.norm(a), 0, 0], abs=1e-6)


def test_text_vectors_of_the_parts_are_those_of_numpy(spark):
    """Not centred: against the singular directions of the same weights on sf0.01."""
    part = spark.read.parquet("/root/testdata/sf0.01/part.parquet")
    got = X.svd_features(part, "p_partkey", F.col("p_name"), k=5).toPandas().set_index("p_partkey").sort_index()
    model, vectors = X.term_vectors(part, "p_partkey", F.col("p_name"))
    rows = {r.p_partkey: r.features for r in vectors.collect()}
    a = np.array([(rows[i] if isinstance(rows[i], SparseVector) else rows[i]).toArray() for i in got.index])
    _, s, vt = np.linalg.svd(a, full_matrices=False)
    assert np.linalg.norm(got.to_numpy(), axis=0) == pytest.approx(s[:5], rel=1e-4)
    apart = s[:4] - s[1:5] > 1e-3 * s[0]  # only directions that are told apart have an answer
    for c in np.flatnonzero(apart & np.r_[True, apart[:-1]]):
        assert min(np.abs(got.to_numpy()[:, c] - sign * a @ vt[c]).max() for sign in (1, -1)) < 1e-3


def test_many_terms(spark):
    """A hundred thousand terms: memory is terms x directions, never terms x terms."""
    docs = spark.range(3000).select("id", F.concat_ws(" ", *[F.concat(F.lit("t"), F.pmod(F.xxhash64("id", F.lit(j)), F.lit(100_000)).cast("string")) for j in range(60)], F.lit("all")).alias("t"))
    out = X.svd_features(docs, "id", F.col("t"), k=3, least=1, most=100_000)
    first = out.agg(F.sum(F.col("svd_0") ** 2), F.count("*")).first()
    assert first[1] == 3000 and first[0] > 0


def test_topics_find_planted_groups(spark):
    rnd = random.Random(3)
    words = [[f"{g}{i}" for i in range(12)] for g in "abc"]
    rows = [(i, " ".join(rnd.choice(words[i % 3]) for _ in range(40))) for i in range(240)]
    got = X.topic_features(spark.createDataFrame(rows, "id int, t string"), "id", F.col("t"), k=3, iterations=40).toPandas()
    table = got.groupby([got.id % 3, "dominant_topic"]).size().unstack(fill_value=0).to_numpy()
    assert table.max(axis=1).sum() >= 0.95 * len(rows) and len(set(table.argmax(axis=1))) == 3
