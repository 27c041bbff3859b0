"""Adaptive search over listed settings: each proposal comes from the densities of good and bad trials so far."""

from __future__ import annotations

import random
from collections.abc import Callable

import numpy as np

#: Random trials before the densities are asked, share of trials that count as good, and draws from the good density that compete for a proposal.
FIRST, GOOD, DRAWS = 8, 0.2, 32


def _density(places: list[int], size: int) -> np.ndarray:
    """Chance of each of ``size`` ordered choices: a kernel around each trial that narrows as trials grow, and an even part worth one trial."""
    width = max(0.6, size / (2 + len(places)))
    at = np.arange(size)
    total = np.full(size, 1.0 / size)
    for p in places:
        kernel = np.exp(-0.5 * ((at - p) / width) ** 2)
        total += kernel / kernel.sum()
    return total / total.sum()


def propose(done: list[tuple[dict, float]], choices: dict[str, list], rng: random.Random) -> dict:
    """The next settings to try: new ones where any are left. Smaller scores are better; ties count as found."""
    tried = {tuple(p[n] for n in choices) for p, _ in done}
    total = int(np.prod([len(v) for v in choices.values()]))

    def some() -> dict:
        return {n: rng.choice(v) for n, v in choices.items()}

    def fresh(p: dict) -> bool:
        return len(tried) >= total or tuple(p[n] for n in choices) not in tried

    if len(done) >= FIRST:
        ranked = [p for p, _ in sorted(done, key=lambda d: d[1])]
        cut = max(2, int(GOOD * len(ranked)))
        good, bad = ({n: _density([v.index(p[n]) for p in part], len(v)) for n, v in choices.items()} for part in (ranked[:cut], ranked[cut:]))
        drawn = [{n: v[rng.choices(range(len(v)), good[n])[0]] for n, v in choices.items()} for _ in range(DRAWS)]
        drawn = [p for p in drawn if fresh(p)]
        if drawn:
            return max(drawn, key=lambda p: sum(np.log(good[n][v.index(p[n])] / bad[n][v.index(p[n])]) for n, v in choices.items()))
    for _ in range(1000):
        p = some()
        if fresh(p):
            return p
    return some()


def adaptive_search(objective: Callable[[dict], float], choices: dict[str, list], trials: int = 100, seed: int = 42) -> tuple[dict, list[tuple[dict, float]]]:
    """(best settings, all trials in order). ``choices`` lists the values of each setting in rising order; the same seed gives the same trials."""
    rng, done = random.Random(seed), []
    for _ in range(min(trials, int(np.prod([len(v) for v in choices.values()])))):
        p = propose(done, choices, rng)
        done.append((p, float(objective(p))))
    return min(done, key=lambda d: d[1])[0], done
