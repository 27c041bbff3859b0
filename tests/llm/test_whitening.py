"""Whitening against numpy's eigenvalues, and its figures against plain sums."""

import numpy as np
import pytest

from squareframe.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, n int"


def _plain(rows):
    x = {i: np.floor(256 * np.array(v, np.float32).astype(float)).astype(np.int64) for i, v in rows}
    fit = np.array(sorted({tuple(v) for v in x.values()}))
    n, total = len(fit), fit.sum(axis=0)
    c = fit - total / n
    e, u = np.linalg.eigh(c.T @ c / n)
    return x, n, total, e[::-1], u[:, ::-1]


def test_figures_against_plain_sums(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((300, 12)) * np.array([3, 2, 1.5, 1.2, *[0.3] * 8]) + 1
    rows = [(i, v.tolist()) for i, v in enumerate(base)] + [(1000 + i, base[i % 5].tolist()) for i in range(40)]
    odd = [(2000, None), (2001, [1.0, None, *[0.0] * 10]), (2002, [float("nan"), *[0.0] * 11]), (2003, [float("inf"), *[0.0] * 11])]
    df = spark.createDataFrame([(i, v, 7) for i, v in rows + odd], SCHEMA).repartition(4)
    got = W.whiten(df).toPandas()
    x, n, total, e, u = _plain(rows)
    assert len(got) == len(rows) * 4 and set(got.n) == {n} and got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9
    table = {(r.vec_id, r.component): r for r in got.itertuples()}
    for k in range(1, 5):
        assert {round(r.explained / (e[k - 1] / e.sum()), 9) for r in got.itertuples() if r.component == k} == {1.0}
        want = {i: (v - total / n) @ u[:, k - 1] / np.sqrt(e[k - 1]) for i, v in x.items()}
        sign = np.sign(want[0] * table[0, k].whitened)
        assert max(abs(sign * want[i] - table[i, k].whitened) for i in x) < 1e-9
    assert all(int(table[i, 1].deviation) == int(((n * v - total) ** 2).sum()) for i, v in x.items())


def test_poor_tables(spark):
    rows = lambda *v: spark.createDataFrame([(i, list(x), 1) for i, x in enumerate(v)], SCHEMA)
    assert W.whiten(rows([1.0, 2.0]).where("false")).count() == 0
    assert W.whiten(rows([1.0, 2.0], [1.0, 2.0])).count() == 0  # nothing varies
    assert W.whiten(rows([], [])).count() == 0
    two = W.whiten(rows([1.0, 0.0], [0.0, 0.0], [0.0])).collect()  # the shorter one is padded; one direction is left
    assert len(two) == 3 and {r.component for r in two} == {1} and {r.n for r in two} == {2} and all(abs(abs(r.whitened) - 1) < 1e-12 and abs(r.explained - 1) < 1e-12 for r in two)
    huge = W.whiten(rows([3e38, 1.0], [-3e38, 0.0], [0.0, 5.0])).collect()
    assert len(huge) in (3, 6) and all(np.isfinite(r.whitened) for r in huge)


@pytest.mark.parametrize("seed", range(6))
def test_axes_of_hard_spectra(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(2, 48))
    spectra = [10.0 ** rng.uniform(-9, 3, n), np.full(n, 2.0), np.r_[np.full(n // 2, 1.0), rng.uniform(0, 1, n - n // 2)], 1 + rng.uniform(0, 1e-3, n), np.r_[5.0, np.zeros(n - 1)]]
    for values in spectra:
        q, _ = np.linalg.qr(rng.standard_normal((n, n)))
        v = q * values @ q.T
        v = (v + v.T) / 2
        want = np.linalg.eigvalsh(v)[::-1]
        tri = W.tridiagonal(v)
        for shift in rng.uniform(-1, values.max() * 1.1, 8):
            if np.abs(want - shift).min() > 1e-9 * values.max():
                assert W.inertia_above(tri, shift) == (want > shift).sum()
        got, axes = W.principal_axes(v, 4)
        kept = int((want[:4] > want[0] * n * W.ZERO * 4).sum())
        assert min(kept, len(got)) == kept and len(got) <= 4
        assert np.abs(got - want[:len(got)]).max() < 1e-12 * values.max() * n
        assert np.abs(v @ axes - axes * got).max() < 1e-12 * values.max() * n and np.abs(axes.T @ axes - np.eye(len(got))).max() < 1e-7
