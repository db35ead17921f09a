from __future__ import annotations

import math
import threading

import numpy as np
import pytest

from fieldloom.models.search import Setting, best, density, propose, search

SPACE = {"x": Setting(-5, 5), "y": Setting(1e-4, 1.0, log=True), "n": Setting(1, 30, whole=True)}


def bowl(t):
    return (t["x"] - 2) ** 2 + (math.log10(t["y"]) + 2) ** 2 + ((t["n"] - 7) / 5) ** 2


def test_better_than_random_draws():
    found = [min(e for _, e in search(bowl, SPACE, 50, seed=s)) for s in range(12)]
    drawn = [min(e for _, e in search(bowl, SPACE, 50, first=50, seed=s)) for s in range(12)]
    assert np.median(found) < 0.5 * np.median(drawn)


def test_values_keep_their_bounds_and_kinds():
    done = search(bowl, SPACE, 30, seed=3)
    assert len(done) == 30 and done == search(bowl, SPACE, 30, seed=3)
    for t, e in done:
        assert -5 <= t["x"] <= 5 and 1e-4 <= t["y"] <= 1 and 1 <= t["n"] <= 30 and isinstance(t["n"], int) and e == bowl(t)
    assert bowl(best(done)) == min(e for _, e in done)
    s = SPACE["y"]
    assert s.value(s.place(0.03)) == pytest.approx(0.03)


def test_densities_are_densities():
    grid = np.linspace(0, 1, 20_001)
    for at in ([], [0.5], [0.0, 1.0], [0.2, 0.21, 0.22, 0.9], [0.3] * 5):
        assert np.trapezoid(density(grid, np.array(at)), grid) == pytest.approx(1, abs=1e-3)


def test_proposals_are_near_the_better_trials():
    tried = [({"x": x, "y": 0.01, "n": 7}, (x - 2) ** 2) for x in np.linspace(-5, 5, 40)]
    rng = np.random.default_rng(1)
    assert abs(np.median([propose(rng, SPACE, tried)["x"] for _ in range(50)]) - 2) < 1


def test_trials_run_side_by_side():
    gate = threading.Barrier(3, timeout=20)

    def error(t):
        gate.wait()
        return float("nan") if t["x"] < 0 else bowl(t)

    done = search(error, SPACE, 9, first=3, at_once=3)
    assert len(done) == 9 and all(e == math.inf or t["x"] >= 0 for t, e in done)
