from __future__ import annotations

import itertools
import math

import numpy as np
import pytest

from fieldloom.models import boosting
from fieldloom.models.boosting import How, Loss

NAMES = ["a", "b", "c", "d"]


def made(n=400, seed=1):
    """y rises with a, interacts in b and c, and has values that are missing."""
    rng = np.random.default_rng(seed)
    x = np.round(rng.uniform(0, 1, (n, 4)), 2)
    x[rng.random(n) < 0.1, 1] = np.nan
    y = 2 * x[:, 0] + np.where((np.nan_to_num(x[:, 1]) > 0.5) & (x[:, 2] > 0.5), 1.0, 0.0) + rng.normal(0, 0.2, n)
    return x, np.maximum(y, 0), rng.integers(1, 4, n), np.where(y > 1.5, 5.0, 1.0)


def table(spark, x, y, fold, w):
    rows = [(i, *[None if math.isnan(v) else float(v) for v in r], float(t), int(f), float(q)) for i, (r, t, f, q) in enumerate(zip(x, y, fold, w, strict=True))]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, d double, y double, fold int, w double").repartition(3)


@pytest.fixture(scope="module")
def data(spark):
    x, y, fold, w = made()
    return x, y, fold, w, table(spark, x, y, fold, w).cache()


def plain_tree(bins, g, h, how, signs, groups):
    """A tree by trying all splits of each node: (feature, bin, below) or a value."""

    def value(rows, low, high):
        return min(max(-g[rows].sum() / (h[rows].sum() + how.ridge), low), high)

    def fall(rows, v):
        return -(g[rows].sum() * v + 0.5 * (h[rows].sum() + how.ridge) * v * v)

    def grow(rows, depth, low, high, used):
        v = value(rows, low, high)
        best = (how.least_gain, None)
        if depth:
            for f, b in itertools.product(range(bins.shape[1]), range(how.bins + 2)):
                if groups is not None and not any(used | {f} <= set(gr) for gr in groups):
                    continue
                left, right = rows[bins[rows, f] <= b], rows[bins[rows, f] > b]
                if len(left) < how.least_rows or len(right) < how.least_rows:
                    continue
                p, q = value(left, low, high), value(right, low, high)
                gain = fall(left, p) + fall(right, q) - fall(rows, v)
                if signs[f] * (q - p) >= 0 and gain > best[0] + 1e-12:
                    best = (gain, (f, b, left, right, p, q))
        if best[1] is None:
            return v
        f, b, left, right, p, q = best[1]
        m = (p + q) / 2
        bounds = {0: ((low, high), (low, high)), 1: ((low, m), (m, high)), -1: ((m, high), (low, m))}[signs[f]]
        return f, b, grow(left, depth - 1, *bounds[0], used | {f}), grow(right, depth - 1, *bounds[1], used | {f})

    return grow(np.arange(len(bins)), how.depth, -math.inf, math.inf, frozenset())


def plain_value(tree, bins):
    while isinstance(tree, tuple):
        tree = tree[3] if bins[tree[0]] > tree[1] else tree[2]
    return tree


@pytest.mark.parametrize(("monotone", "groups"), [({}, None), ({"a": 1, "d": -1}, None), ({}, [["a", "d"], ["b", "c"]]), ({"b": 1}, [["a", "b"]])])
def test_rounds_equal_a_plain_search(spark, data, monotone, groups):
    x, y, fold, w, df = data
    how = How(rounds=3, depth=3, rate=0.5, bins=8, least_rows=10, monotone=monotone, groups=groups)
    model = boosting.fit(df, NAMES, "y", (1, 2, 3), ("id",), how=how, weight="w")
    bins = boosting._binned(x, model.edges)
    signs = [monotone.get(n, 0) for n in NAMES]
    sets = None if groups is None else [[NAMES.index(n) for n in g] for g in groups] + [[i] for i, n in enumerate(NAMES) if not any(n in g for g in groups)]
    for k, f in enumerate((1, 2, 3)):
        train = fold != f
        m = np.full(len(y), (y * w)[train].sum() / w[train].sum())
        assert m[0] == pytest.approx(model.starts[k])
        for _ in range(3):
            g, h = -2 * w * (y - m), 2 * w
            tree = plain_tree(bins[train], g[train], h[train], how, signs, sets)
            m = m + 0.5 * np.array([plain_value(tree, b) for b in bins])
        assert model.margins(bins)[:, k] == pytest.approx(m, abs=1e-9)


def test_monotone_in_every_fold(spark, data):
    x, _, _, _, df = data
    model = boosting.fit(df, NAMES, "y", (1, 2, 3), ("id",), how=How(rounds=12, depth=4, rate=0.3, bins=16, least_rows=5, monotone={"a": 1, "b": -1}), weight="w")
    for column, sign in ((0, 1), (1, -1)):
        lines = np.repeat(x[:60], 21, axis=0)
        lines[:, column] = np.tile(np.linspace(-0.1, 1.1, 21), 60)
        steps = np.diff(model.scores(lines).reshape(60, 21, 3), axis=1) * sign
        assert steps.min() >= -1e-12
    free = boosting.fit(df, NAMES, "y", (1, 2, 3), ("id",), how=How(rounds=12, depth=4, rate=0.3, bins=16, least_rows=5), weight="w")
    lines = np.repeat(x[:60], 21, axis=0)
    lines[:, 1] = np.tile(np.linspace(-0.1, 1.1, 21), 60)
    assert (np.diff(free.scores(lines).reshape(60, 21, 3), axis=1) > 0).any()  # without the constraint it does rise


def test_no_path_joins_two_groups(spark, data):
    groups = [["a", "b"], ["b", "c"]]
    model = boosting.fit(data[4], NAMES, "y", (1, 2, 3), ("id",), how=How(rounds=8, depth=4, least_rows=5, groups=groups), weight="w")
    seen = {frozenset(NAMES[i] for i in p) for trees in model.trees for t in trees for p in t.paths()}
    assert all(any(p <= set(g) for g in [*groups, ["d"]]) for p in seen)
    assert any(len(p) == 2 for p in seen)


@pytest.mark.parametrize("loss", [Loss("squared"), Loss("tweedie", 1.3), Loss("tweedie", 1.8), Loss("logistic")])
def test_gradients_numerically(loss):
    rng = np.random.default_rng(1)
    y, m, w = rng.uniform(0, 1, 200), rng.normal(0, 1, 200), rng.uniform(0.5, 5, 200)
    g, h = loss.gradient(y, m, w)
    e = 1e-5
    assert g == pytest.approx((loss.value(y, m + e, w) - loss.value(y, m - e, w)) / (2 * e), abs=1e-5)
    assert h == pytest.approx((loss.gradient(y, m + e, w)[0] - loss.gradient(y, m - e, w)[0]) / (2 * e), abs=1e-4)


def test_quantiles_cover_their_share(spark):
    x, y, fold, w = made(900, 4)
    y = y * (1 + x[:, 0])
    df = table(spark, x, y, fold, w).cache()
    for share in (0.6, 0.9):
        model = boosting.fit(df, NAMES, "y", (1, 2, 3), ("id",), Loss("quantile", share), How(rounds=15, depth=2, rate=0.3, bins=16))
        got = model.predict(df).select("y", "prediction").collect()
        assert abs(np.mean([r["y"] <= r["prediction"] for r in got]) - share) < 0.06
        first = model.trees[0][0]
        bins, train = boosting._binned(x, model.edges), fold != 1
        leaf = first.place(bins[train])
        for i in np.unique(leaf):
            assert first.value[i] == pytest.approx(0.3 * np.quantile(y[train][leaf == i] - model.starts[0], share))


def test_stops_at_the_best_round(spark):
    rng = np.random.default_rng(5)
    x = rng.uniform(0, 1, (240, 4))
    y, fold = np.maximum(x[:, 0] + rng.normal(0, 0.5, 240), 0), rng.integers(1, 4, 240)
    df = table(spark, x, y, fold, np.ones(240)).cache()
    model = boosting.fit(df, NAMES, "y", (1, 2, 3), ("id",), how=How(rounds=40, depth=3, rate=0.4, least_rows=2, patience=4))
    assert all(0 < b < len(t) <= 40 for b, t in zip(model.best, model.trees, strict=True))
    for k, errors in enumerate(model.errors):
        assert model.best[k] == int(np.argmin(errors)) and len(errors) - 1 - model.best[k] <= 4
        own = fold == k + 1
        m = boosting._margins(boosting._binned(x[own], model.edges), np.full((own.sum(), 1), model.starts[k]), [model.trees[k][: model.best[k]]])
        assert errors[model.best[k]] == pytest.approx(np.mean((y[own] - m[:, 0]) ** 2))
    top = sorted(model.importance(), key=lambda r: -r[2])[0]
    assert top[1] == "a" and {r[0] for r in model.importance()} == {1, 2, 3}


def test_new_rows_and_odd_tables(spark, data):
    x, y, fold, w, df = data
    model = boosting.fit(df, NAMES, "y", (1, 2, 3), ("id",), how=How(rounds=2, depth=2, row_share=0.7, feature_share=0.5), weight="w")
    from pyspark.sql import functions as F

    new = model.predict(df.withColumn("fold", F.lit(None).cast("int"))).orderBy("id").select("prediction").toPandas()["prediction"]
    assert new.to_numpy() == pytest.approx(model.scores(x).mean(1))
    own = model.predict(df).orderBy("id").select("prediction").toPandas()["prediction"]
    assert own.to_numpy() == pytest.approx(model.scores(x)[np.arange(len(x)), fold - 1])
    empty = boosting.fit(df.where("id < 0"), NAMES, "y", (1, 2, 3), ("id",), how=How(rounds=2, depth=2, patience=1))
    assert [r["prediction"] for r in empty.predict(df.limit(3)).collect()] == [0.0] * 3
    with pytest.raises(ValueError):
        boosting.fit(df, NAMES, "y", (1, 2, 3), ("id",), how=How(monotone={"z": 1}))
