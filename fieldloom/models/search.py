"""Search for settings by tree-structured Parzen estimators.

Trials are split into the better ones and the rest. For each setting, either part is a density: a mixture of normals around its trials,
as wide as their neighbours are far, and a flat part. Candidates are drawn from the better ones' density, and the one whose ratio of
both densities is largest is tried next. Settings count as independent. Trials can run side by side: then several candidates are
drawn from what is known, and each runs in a thread of its own, so that Spark shares its cores among their jobs; or one function takes
them all (`together`), where their models can share the passes over the rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Setting:
    """A number between low and high; `log`: by its logarithm; `whole`: rounded."""

    low: float
    high: float
    log: bool = False
    whole: bool = False

    def place(self, value: float) -> float:
        """0 to 1."""
        f = math.log if self.log else float
        return (f(value) - f(self.low)) / (f(self.high) - f(self.low)) if self.high > self.low else 0.5

    def value(self, place: float) -> float | int:
        if self.log:
            v = math.exp(math.log(self.low) + place * (math.log(self.high) - math.log(self.low)))
        else:
            v = self.low + place * (self.high - self.low)
        return int(min(max(round(v), self.low), self.high)) if self.whole else float(min(max(v, self.low), self.high))


def _widths(at: np.ndarray) -> np.ndarray:
    """How far the neighbours of each point are, within bounds."""
    order = np.argsort(at, kind="stable")
    wide = np.concatenate([[0.0], at[order], [1.0]])
    far = np.maximum(wide[1:-1] - wide[:-2], wide[2:] - wide[1:-1])
    out = np.empty(len(at))
    out[order] = np.clip(far, 1 / (1 + len(at)) / 2, 1.0)
    return out


def density(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of the mixture around `at`, cut off at 0 and 1, with a flat part as heavy as one point."""
    out = np.ones(len(x))
    if len(at):
        w = _widths(at)
        erf = np.vectorize(math.erf)
        inside = 0.5 * (erf((1 - at) / w / math.sqrt(2)) - erf(-at / w / math.sqrt(2)))
        each = np.exp(-0.5 * ((x[:, None] - at) / w) ** 2) / (w * math.sqrt(2 * math.pi) * inside)
        out = out + each.sum(1)
    return out / (1 + len(at))


def _draw(rng: np.random.Generator, at: np.ndarray, n: int) -> np.ndarray:
    pick, w = rng.integers(0, len(at) + 1, n), _widths(at)
    out = rng.uniform(0, 1, n)
    for i in np.flatnonzero(pick < len(at)):
        while not 0 <= (v := rng.normal(at[pick[i]], w[pick[i]])) <= 1:
            pass
        out[i] = v
    return out


def propose(rng: np.random.Generator, space: dict[str, Setting], tried: list[tuple[dict, float]], better: float = 0.25, candidates: int = 24) -> dict:
    """The candidate for which the better trials' density is highest against that of the rest."""
    ranked = sorted(tried, key=lambda t: t[1])
    n = max(1, math.ceil(better * len(ranked)))
    score, drawn = np.zeros(candidates), {}
    for name, s in space.items():
        good, rest = (np.array([s.place(t[0][name]) for t in part]) for part in (ranked[:n], ranked[n:]))
        drawn[name] = _draw(rng, good, candidates)
        score += np.log(density(drawn[name], good)) - np.log(density(drawn[name], rest))
    i = int(score.argmax())
    return {name: s.value(float(drawn[name][i])) for name, s in space.items()}


def search(error: Callable, space: dict[str, Setting], trials: int = 30, first: int = 8, at_once: int = 1, seed: int = 42, better: float = 0.25, together: bool = False) -> list[tuple[dict, float]]:
    """All trials in their order: settings and error. The first ones are drawn evenly. A trial whose error isn't a number comes last of all.
    error: from one trial's settings to its error; with `together`, from a list of settings to the list of their errors."""
    rng = np.random.default_rng(seed)
    done: list[tuple[dict, float]] = []
    with ThreadPoolExecutor(max(1, at_once)) as pool:
        while len(done) < trials:
            n = min(max(1, at_once), trials - len(done))
            if len(done) < first:
                n = min(n, first - len(done))
                todo = [{name: s.value(float(rng.uniform())) for name, s in space.items()} for _ in range(n)]
            else:
                todo = [propose(rng, space, done, better) for _ in range(n)]
            errors = [e if math.isfinite(e) else math.inf for e in (error(todo) if together else pool.map(error, todo))]
            done += list(zip(todo, errors, strict=True))
    return done


def best(done: list[tuple[dict, float]]) -> dict:
    return min(done, key=lambda t: t[1])[0]
