"""The classifier's scores and the hierarchical shrinkage in plain loops."""

import math
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from squareframe.llm import flat, hashed_lr, quality_bayes

MASK = (1 << 64) - 1


def _mixed(h):
    h ^= h >> 33
    h = h * flat.MIX & MASK
    return h ^ (h >> 29)


def _word_hash(word):
    return sum(int(flat.BYTE_VALUE[b]) * pow(flat.BASE, i, 1 << 64) for i, b in enumerate(word)) & MASK


def plain_logit(model, text):
    b, bits = (text or "").encode(), hashed_lr.BITS
    grams = [[(int.from_bytes(b[i:i + n], "little") * int(k) & 0xFFFFFFFF) >> (32 - bits) for i in range(len(b) - n + 1)] for n, k in hashed_lr._GRAM.items()]
    h = [_word_hash(w) for w in b.split()]
    grams += [[_mixed(x) >> (64 - bits) for x in h], [_mixed((x * 3 + y) & MASK) >> (64 - bits) for x, y in zip(h, h[1:])]]
    score = model.bias
    for w, buckets in zip(model.weights, grams):
        if buckets:
            score += sum(float(w[k]) for k in buckets) / len(buckets)
    return score * model.slope + model.shift


def _texts():
    rnd = random.Random(6)
    return [None, "", "a", "ab cd", " \n ", "é漢😀 é"] + [" ".join("".join(rnd.choice("abcdé \n") for _ in range(rnd.randint(1, 9))) for _ in range(rnd.randint(1, 60))) for _ in range(60)]


def test_scores_are_those_of_plain_loops(monkeypatch):
    rng = np.random.default_rng(1)
    model = hashed_lr.Model(rng.normal(0, 1, (4, hashed_lr.DIMS)), 0.3, 1.7, -0.2)
    texts = _texts()
    for piece in (1 << 18, 50):  # the slices don't matter
        monkeypatch.setattr(hashed_lr, "SLICE", piece)
        assert model.logit(pa.array(texts, pa.string())) == pytest.approx([plain_logit(model, t) for t in texts], rel=1e-9, abs=1e-9)


def test_descent_lowers_the_loss_and_calibration_is_its_minimum():
    rng = np.random.default_rng(2)
    x = (rng.random((80, 12)) < 0.3).astype(float)
    y = (x[:, 0] + 0.5 * x[:, 1] + rng.normal(0, 0.2, 80) > 0.5).astype(float)
    rows, idx = np.nonzero(x)
    w, b = hashed_lr._descend(y, rows, idx, x[rows, idx], 12)
    loss = lambda w, b: float(np.mean(np.logaddexp(0, np.where(y > 0.5, -1, 1) * (x @ w + b))))
    assert loss(w, b) < 0.5 * loss(np.zeros(12), 0.0) and w[0] == max(w)
    s = x @ w + b + rng.normal(0, 2, 80)
    slope, shift = hashed_lr._calibrate(s, y)
    pos, neg = y.sum(), (1 - y).sum()
    goal = np.where(y > 0.5, (pos + 1) / (pos + 2), 1 / (neg + 2))
    fit = lambda a, c: float(-np.mean(goal * -np.logaddexp(0, -(a * s + c)) + (1 - goal) * -np.logaddexp(0, a * s + c)))
    assert all(fit(slope, shift) <= fit(slope + d, shift + e) + 1e-6 for d in (-0.05, 0, 0.05) for e in (-0.05, 0, 0.05))


def plain_bayes(rows, threshold=0.5):
    """(site, path, p) rows to (site quality, path quality, quality, kept) of each."""
    sites, paths = defaultdict(list), defaultdict(list)
    for s, q, p in rows:
        sites[s].append(p)
        paths[s, q].append(p)
    clip = lambda v, a, b: max(a, min(b, v))
    m0 = clip((sum(p for *_, p in rows) + 1) / (len(rows) + 2), 1e-6, 1 - 1e-6)

    def strength(groups, prior):
        many = {g: v for g, v in groups.items() if len(v) >= 2}
        if not many:
            return 1000.0
        mean = {g: sum(v) / len(v) for g, v in many.items()}
        between = sum((mean[g] - prior(g)) ** 2 for g in many) / len(many)
        within = sum(max(sum(p * p for p in v) / len(v) - mean[g] ** 2, 0) / len(v) for g, v in many.items()) / len(many)
        spread = sum(prior(g) * (1 - prior(g)) for g in many) / len(many)
        return clip(spread / max(between - within, 1e-9) - 1, 1.0, 1000.0)

    k_site = strength(sites, lambda g: m0)
    k_path = strength(paths, lambda g: (k_site * m0 + sum(sites[g[0]])) / (k_site + len(sites[g[0]])))
    logit = lambda v: math.log(v / (1 - v))
    out = []
    for s, q, p in rows:
        site = clip((k_site * m0 + sum(sites[s]) - p) / (k_site + len(sites[s]) - 1), 1e-6, 1 - 1e-6)
        path = clip((k_path * site + sum(paths[s, q]) - p) / (k_path + len(paths[s, q]) - 1), 1e-6, 1 - 1e-6)
        quality = 1 / (1 + math.exp(-(logit(p) + logit(path) - logit(m0))))
        out.append((site, path, quality, quality >= threshold))
    return out


@pytest.mark.parametrize("small", [20_000, 0])
def test_shrinkage_against_plain_sums(spark, small, monkeypatch):
    """With the groups broadcast and with the groups joined, with and without the text."""
    monkeypatch.setattr(quality_bayes, "SMALL", small)
    rnd, rng = random.Random(3), np.random.default_rng(3)
    model = hashed_lr.Model(rng.normal(0, 2, (4, hashed_lr.DIMS)), 0.1)
    texts = _texts()
    rows = [(i, t, rnd.choice(["a", "b", None, "hot", "hot", f"s{i}"]), rnd.choice(["x", None, "y"]), i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, _n int").repartition(3)
    p = [1 / (1 + math.exp(-max(-12, min(12, plain_logit(model, t))))) for t in texts]
    want = plain_bayes([(r[2], r[3], v) for r, v in zip(rows, p, strict=True)])
    for with_text in (True, False):
        out = quality_bayes.hierarchical_quality(docs, model, with_text=with_text)
        assert ("text" in out.columns) == with_text
        for r in out.collect():
            assert (r.text_quality, r.site_quality, r.path_quality, r.quality) == pytest.approx((p[r.doc_id], *want[r.doc_id][:3]), rel=1e-7, abs=1e-9)
            assert r.kept == want[r.doc_id][3] and r._n == r.doc_id
