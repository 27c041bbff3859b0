"""Curve embeddings: neighbours in sixteen directions against those of the exact kernel."""

import numpy as np

from squareframe.operators import models as M


def test_neighbours_are_those_of_the_kernel(spark):
    rng = np.random.default_rng(1)
    middle, slope = rng.uniform(-2, 2, 700), rng.uniform(0.5, 3, 700)
    levels = np.linspace(-3, 3, 11)
    curves = 1 / (1 + np.exp(-slope[:, None] * (levels - middle[:, None]))) + rng.normal(0, 0.01, (700, 11))
    names = [f"level_{i}" for i in range(11)]
    rows = [(i, *map(float, c)) for i, c in enumerate(curves)] + [(1000, None, *[0.5] * 10), (1001, float("nan"), *[0.5] * 10)]
    df = spark.createDataFrame(rows, "k int, " + ", ".join(f"{n} double" for n in names)).repartition(4)
    got = M.kernel_embeddings(df, "k", {"rapid": names}).toPandas().set_index("k")
    assert got.shape == (702, 16) and got.loc[[1000, 1001]].isna().all().all()
    e = got.loc[range(700)].to_numpy()
    assert np.linalg.matrix_rank(e, tol=1e-6) > 11  # more directions than levels
    def near(x):
        d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
        np.fill_diagonal(d, np.inf)
        return np.argsort(d, axis=1)[:, :10]
    recall = np.mean([len(set(a) & set(b)) / 10 for a, b in zip(near(e), near(curves), strict=True)])  # a Gaussian kernel orders by distance
    assert recall >= 0.9, recall


def test_few_curves(spark):
    df = spark.createDataFrame([(1, 0.1, 0.2), (2, 0.1, 0.2), (3, None, 0.4)], "k int, a double, b double")
    got = {r.k: tuple(r)[1:] for r in M.kernel_embeddings(df, "k", {"m": ["a", "b"]}, k=4).collect()}
    assert got[1] == got[2] and got[3] == (None,) * 4
    assert all(x is None for r in M.kernel_embeddings(df.where("k = 3"), "k", {"m": ["a", "b"]}, k=4).collect() for x in tuple(r)[1:])
