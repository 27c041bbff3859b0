"""Adaptive search against random picks, and the boosted meta learner it chooses."""

import math
import random

from pyspark.sql import functions as F

from squareframe.operators import models as M
from squareframe.operators import search as S

CHOICES = {"depth": list(range(1, 13)), "rounds": list(range(1, 41)), "step": [0.01 * 1.4 ** i for i in range(16)]}


def valley(p):
    """A narrow valley: depth 5, rounds and step traded against each other."""
    return (p["depth"] - 5) ** 2 / 4 + (math.log(p["rounds"] * p["step"] / 2.0)) ** 2 * 3 + abs(p["step"] - 0.1)


def test_beats_random_picks_of_equal_number():
    adaptive, chance = [], []
    for seed in range(20):
        best, done = S.adaptive_search(valley, CHOICES, 100, seed)
        assert len({tuple(p.values()) for p, _ in done}) == len(done) == 100 and valley(best) == min(e for _, e in done)
        adaptive.append(valley(best))
        rng = random.Random(seed)
        chance.append(min(valley({n: rng.choice(v) for n, v in CHOICES.items()}) for _ in range(100)))
    assert sum(adaptive) < 0.6 * sum(chance) and sum(a <= c for a, c in zip(adaptive, chance, strict=True)) >= 15
    assert S.adaptive_search(valley, CHOICES, 30, 1) == S.adaptive_search(valley, CHOICES, 30, 1)


def test_small_choices_are_tried_once():
    _, done = S.adaptive_search(lambda p: p["a"], {"a": [1, 2, 3], "b": [0]}, 100)
    assert sorted(p["a"] for p, _ in done) == [1, 2, 3]


def test_boosted_search(spark):
    rnd = random.Random(4)
    made = [(i, rnd.random() * 6, rnd.random() * 3) for i in range(1500)]
    rows = spark.createDataFrame([(i, x, z, math.sin(x) * 4 + int(z)) for i, x, z in made], "id int, x double, z double, y double")
    choices = {"maxDepth": [1, 3], "stepSize": [0.1, 0.3], "maxIter": [1, 2, 4, 6]}
    model, done = M.search_boosted(rows, ["x", "z"], "y", "id", 100, choices)
    assert len(done) == 16
    best = min(done, key=lambda d: d[1])
    assert best[0]["maxDepth"] == 3 and best[0]["maxIter"] == 6
    assert model.stages[-1].getNumTrees == best[0]["maxIter"]
    held = M.in_test(F.col("id"), 0.2, 42)
    for p, e in random.Random(1).sample(done, 2):  # the error of a prefix is that of a model of so many rounds
        fewer = M.fit_regressor(rows.where(~held), "gbt", ["x", "z"], "y", **p)
        assert abs(M.log_rmse(fewer.transform(rows.where(held)), "y") - e) < 1e-9


def test_stack_with_a_searched_boosted_meta(spark):
    rows = spark.createDataFrame([(i, float(i % 50), (i % 50 - 25) ** 2 / 10.0) for i in range(600)], "k int, x double, y double")
    search = {"trials": 6, "maxDepth": [2, 3], "stepSize": [0.3], "maxIter": [2, 6]}
    stack = M.build_stack(rows, "k", "y", ["x"], bases=("linear",), meta="gbt", search=search)
    line = M.build_stack(rows, "k", "y", ["x"], bases=("linear",), meta="linear")
    assert len(stack.trials) == 4
    assert M.log_rmse(stack.predict(rows), "y") < 0.5 * M.log_rmse(line.predict(rows), "y")
