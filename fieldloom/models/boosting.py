"""Gradient boosting on histograms, all folds' models at once: monotone and interaction constraints, any loss, early stopping.

Features become bins once, at exact percentiles. A row is then its bins (a byte each), its labels and its margin in each model; rows are
written in blocks of about a megabyte, so that a pass moves few large values. A level of
the trees of all models, of several fits too (fit_all), is one pass: tasks add up gradients, second derivatives and rows by (model, node,
feature, bin), one shuffle sums these by (model, node), and the best split is found where they are summed. The driver sees one row a model
and node and hands bounds and permitted features down to its children. What moves depends on models, nodes, features and bins, not on
the number of rows; rows stay where they are, and margins are written again every few rounds.

* Monotone: values left and right of a split on such a feature must be in order, and their middle bounds all that lies below on
  either side, so the whole tree rises (or falls) with the feature.
* Interactions: a path may only use features that some group holds together. A feature in no group is a group of its own.
* Losses: gradient and second derivative by margin; for quantiles the leaves get exact quantiles of what is left over.
* Early stopping: the error of each model on its own held-out fold comes along with the next round's first pass. A model whose
  error hasn't fallen for `patience` rounds grows no more, and its rounds after the best one don't count.

Missing values are smaller than all others. Ties go to the feature that comes first, then to the smaller bin. A model without rows
predicts its start. New rows (fold null) teach nothing and get the mean of all models.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.operators.selection import exact_percentiles
from fieldloom.sources.staging import staged

#: Rounds after which margins are written again.
KEEP = 8
#: Bytes of a block of rows, the most that one row of the written table holds.
BLOCK = 1 << 20
#: Cells of a joint histogram of several features, and rows that are counted at a time.
CELLS, ROWS = 1100, 1 << 16
#: Whole second derivatives under this sum are added up together with the number of rows, as a row's part of one number.
WHOLE = float(1 << 26)


@dataclass(frozen=True)
class Loss:
    """`squared`, `tweedie` (parameter: the variance power, over 1 and under 2), `quantile` (the share below) or `logistic`."""

    name: str = "squared"
    parameter: float = 0.0

    def gradient(self, y: np.ndarray, m: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and second derivative of value() by the margin m."""
        a = self.parameter
        if self.name == "squared":
            return -2 * w * (y - m), 2 * w
        if self.name == "tweedie":
            down, up = np.exp((1 - a) * m), np.exp((2 - a) * m)
            return w * (up - y * down), w * ((2 - a) * up - (1 - a) * y * down)
        if self.name == "quantile":
            return w * np.where(y < m, 1 - a, -a), w
        if self.name == "logistic":
            p = 1 / (1 + np.exp(-m))
            return w * (p - y), w * p * (1 - p)
        raise ValueError(f"unknown loss: {self.name}")

    def value(self, y: np.ndarray, m: np.ndarray, w: np.ndarray) -> np.ndarray:
        a = self.parameter
        if self.name == "squared":
            return w * (y - m) ** 2
        if self.name == "tweedie":
            return w * (np.exp((2 - a) * m) / (2 - a) - y * np.exp((1 - a) * m) / (1 - a))
        if self.name == "quantile":
            return w * np.where(y < m, (1 - a) * (m - y), a * (y - m))
        return w * (np.logaddexp(0, m) - y * m)

    def predicted(self, m: np.ndarray) -> np.ndarray:
        if self.name == "tweedie":
            return np.exp(m)
        return 1 / (1 + np.exp(-m)) if self.name == "logistic" else m

    def start(self, mean: float) -> float:
        if self.name == "tweedie":
            return math.log(max(mean, 1e-9))
        if self.name == "logistic":
            p = min(max(mean, 1e-6), 1 - 1e-6)
            return math.log(p / (1 - p))
        return mean


@dataclass(frozen=True)
class How:
    """monotone: 1 or -1 by feature. groups: features that may meet on a path (None: all may)."""

    rounds: int = 50
    depth: int = 4
    rate: float = 0.1
    bins: int = 32
    ridge: float = 1.0
    least_rows: int = 20
    least_gain: float = 1e-9
    monotone: dict[str, int] = field(default_factory=dict)
    groups: Sequence[Sequence[str]] | None = None
    patience: int | None = None
    row_share: float = 1.0
    feature_share: float = 1.0
    seed: int = 42


@dataclass
class Tree:
    """Nodes by place: those below i are 2 i + 1 and 2 i + 2. feature -1: a leaf. A row goes right where its bin is over the node's."""

    feature: np.ndarray
    bin: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        n = (1 << (depth + 1)) - 1
        return cls(np.full(n, -1, np.int32), np.zeros(n, np.int32), np.zeros(n), np.zeros(n))

    def place(self, bins: np.ndarray) -> np.ndarray:
        return self.place_by_column(np.ascontiguousarray(bins.T), len(bins))

    def place_by_column(self, columns: np.ndarray, n: int) -> np.ndarray:
        """columns: features x rows. Nodes from the top, each moving its own rows down."""
        at = np.zeros(n, np.int16)
        for i in np.flatnonzero(self.feature >= 0).tolist():
            right = columns[self.feature[i]] > self.bin[i]
            step = right.astype(np.int16)
            step += i + 1
            at += step if i == 0 else step * (at == i)
        return at

    def paths(self) -> Iterator[list[int]]:
        """The features on the way to each leaf."""
        todo = [(0, [])]
        while todo:
            i, path = todo.pop()
            if self.feature[i] < 0:
                yield path
            else:
                todo += [(j, [*path, int(self.feature[i])]) for j in (2 * i + 1, 2 * i + 2)]


# ---- bins ----


def bin_edges(rows: DataFrame, features: Sequence[str], bins: int) -> list[np.ndarray]:
    """By feature, its distinct percentiles: a value's bin is one more than the number of edges below it, 0 is for missing ones."""
    width = len(features)

    def values(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        x = np.ascontiguousarray(_doubles(batch.column(0), width).T)
        for i in range(width):
            yield i, x[i][~np.isnan(x[i])]

    found = exact_percentiles(rows.select(_vector(features)), values, [i / bins for i in range(1, bins)])
    return [np.unique(np.array(found.get(i, []), float)) for i in range(width)]


def _vector(features: Sequence[str]) -> Column:
    return F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(float("nan"))) for f in features])


def _binned(values: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    out = np.zeros(values.shape, np.uint8)
    for i, e in enumerate(edges):
        v = values[:, i]
        out[:, i] = np.where(np.isnan(v), 0, 1 + np.searchsorted(e, v, "left"))
    return out


def _doubles(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


#: A block of rows: ids (eight bytes each), folds (four), bins (features x rows, a byte each) and numbers (the labels, the weights and a margin a
#: model, each x rows, eight bytes). Spark moves a few large values many times as fast as one a row.
_BLOCK = ("ids", "folds", "bins", "numbers")
_BLOCKS = ", ".join(f"{c} binary" for c in _BLOCK)


def _block(*parts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(p).tobytes()], pa.binary()) for p in parts], names=list(_BLOCK))


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """ids, folds, bins (features x rows) and numbers (numbers x rows) of each block."""
    for ids, folds, bins, numbers in zip(*batch.columns, strict=True):
        at = np.frombuffer(ids.as_buffer(), np.int64)
        yield at, np.frombuffer(folds.as_buffer(), np.int32), np.frombuffer(bins.as_buffer(), np.uint8).reshape(-1, len(at)), np.frombuffer(numbers.as_buffer()).reshape(-1, len(at))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks side by side, about ROWS rows of them."""
    held: list[tuple[np.ndarray, ...]] = []
    for block in (block for batch in batches for block in _blocks(batch)):
        held.append(block)
        if sum(len(b[0]) for b in held) >= ROWS:
            yield tuple(np.concatenate(x, axis=-1) for x in zip(*held, strict=True))
            held = []
    if held:
        yield tuple(np.concatenate(x, axis=-1) for x in zip(*held, strict=True))


def joint(of: Sequence[tuple[int, tuple[int, ...]]], sizes: Sequence[int]) -> list[tuple[tuple[int, ...], list[int]]]:
    """(models, features) whose bins are counted at once, at most CELLS cells together unless one feature has more: features that the same
    models ask for. of: features and their models; sizes: bins by feature."""
    out: list[tuple[tuple[int, ...], list[int]]] = []
    last: dict[tuple[int, ...], tuple[list[int], int]] = {}
    for f, models in of:
        if not models:
            continue
        features, cells = last.get(models, ([], 0))
        if features and cells * sizes[f] <= CELLS:
            features.append(f)
            last[models] = features, cells * sizes[f]
        else:
            last[models] = [f], sizes[f]
            out.append((models, last[models][0]))
    return out


def _table(rows: DataFrame, features: Sequence[str], edges: list[np.ndarray], labels: Sequence[str], weights: Sequence[str | None], key: Sequence[str], starts: Sequence[float]) -> DataFrame:
    """Blocks of rows, as _blocks() reads them, with the starts as margins."""
    width, given = len(features), np.array(starts, float)[:, None]
    most = max(1, BLOCK // (12 + width + 8 * (len(labels) + len(weights) + len(starts))))
    own = F.array(*[F.col(c).cast("double") for c in labels], *[F.col(c).cast("double") if c else F.lit(1.0) for c in weights])
    wide = rows.select(F.xxhash64(*key).alias("id"), "fold", own.alias("numbers"), _vector(features).alias("bins"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(i, most) for i in range(0, len(whole), most)):
                numbers = np.vstack([_doubles(batch.column(2), len(labels) + len(weights)).T, np.tile(given, (1, len(batch)))])
                yield _block(*(batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1)), _binned(_doubles(batch.column(3), width), edges).T, numbers)

    return wide.mapInArrow(run, _BLOCKS)


# ---- splits ----


def leaf_value(g: float, h: float, ridge: float, low: float, high: float) -> float:
    return float(np.clip(-g / (h + ridge), low, high))


def best_split(hist: np.ndarray, ridge: float, least_rows: int, low: float, high: float, signs: np.ndarray) -> tuple[int, float, int, np.ndarray]:
    """(feature, gain, last bin on the left, sums on the left) of histograms (features x bins x (gradient, second derivative, rows)).
    Values of children are kept within low and high, and in the order of signs; gain is how far the second-order loss falls."""
    left = np.cumsum(hist, axis=1)[:, :-1]
    total = hist.sum(1, keepdims=True)
    right = total - left

    def fitted(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        v = np.clip(-s[..., 0] / (s[..., 1] + ridge), low, high)
        return v, -(s[..., 0] * v + 0.5 * (s[..., 1] + ridge) * v * v)

    (a, gain_a), (b, gain_b), (_, whole) = fitted(left), fitted(right), fitted(total)
    gain = gain_a + gain_b - whole
    allowed = (left[..., 2] >= least_rows) & (right[..., 2] >= least_rows) & (signs[:, None] * (b - a) >= 0)
    gain = np.where(allowed, gain, -np.inf)
    f, i = np.unravel_index(int(gain.argmax()), gain.shape)
    return int(f), float(gain[f, i]), int(i), left[f, i]


@dataclass
class _Node:
    low: float = -math.inf
    high: float = math.inf
    used: frozenset[int] = frozenset()


def permitted(used: frozenset[int], groups: Sequence[frozenset[int]] | None, features: int) -> frozenset[int]:
    """Features that may follow those used on the path."""
    if groups is None:
        return frozenset(range(features))
    return frozenset().union(*(g for g in groups if used <= g))


# ---- passes ----


@dataclass(frozen=True)
class Wanted:
    """One fit of several: its label, loss, settings, weight, and the features it may use (None: all)."""

    y: str
    loss: Loss = Loss()
    how: How = field(default_factory=How)
    weight: str | None = None
    features: Sequence[str] | None = None


@dataclass(frozen=True)
class _Model:
    """One fold's model of a fit. label, weight: places in the rows' lists; k: the fold's place."""

    loss: Loss
    how: How
    fold: int
    k: int
    label: int
    weight: int


@dataclass
class _State:
    """What tasks know in one pass: by model, the trees since the margins were written, and the one that grows with its open nodes."""

    pending: list[list[Tree]]
    growing: list[Tree | None]
    open: list[dict[int, _Node]]
    allowed: list[dict[int, frozenset[int]]]
    errors: list[bool]
    round: int = 0


def _added(columns: np.ndarray, margin: np.ndarray, pending: list[list[Tree]]) -> np.ndarray:
    """Margins (rows x models) with the pending trees. columns: features x rows."""
    out = margin.copy("K")
    for k, trees in enumerate(pending):
        for t in trees:
            out[:, k] += t.value[t.place_by_column(columns, len(out))]
    return out


def _margins(bins: np.ndarray, margin: np.ndarray, pending: list[list[Tree]]) -> np.ndarray:
    return _added(np.ascontiguousarray(bins.T), margin, pending)


def _drawn(ids: np.ndarray, seed: int, share: float) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (ids.view(np.uint64) ^ np.uint64(seed * 2 + 1)) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (h >> np.uint64(11)).astype(np.float64) / 2.0**53 < share


_HIST = "model int, node int, hist binary"
_SPLIT = "model int, node int, feature int, gain double, bin int, g double, h double, n double, all_g double, all_h double, all_n double"


class _Fit:
    def __init__(self, table: DataFrame, width: int, edges: list[np.ndarray], models: list[_Model], signs: list[list[int]], labels: int, weights: int):
        self.table, self.width, self.models, self.signs, self.labels, self.weights = table, width, models, signs, labels, weights
        self.sizes = [2 + len(e) for e in edges]
        self.begin = np.cumsum([0, *self.sizes])  # a histogram has the features' bins one after the other
        self.places = np.full((width, max(self.sizes, default=2)), self.begin[-1])
        for f, n in enumerate(self.sizes):
            self.places[f, :n] = self.begin[f] + np.arange(n)

    def histograms(self, state: _State) -> DataFrame:
        """Sums by model and open node (all features' bins x 3), one row a task each; node -1 holds a held-out fold's error and rows.
        Several features of few bins are counted at once, by their joint bins, of which each feature's are sums."""
        width, sizes, begin, models, labels, weights = self.width, self.sizes, self.begin, self.models, self.labels, self.weights

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nodes = [list(o) for o in state.open]
            sums = [np.zeros((len(o), begin[-1], 3)) for o in nodes]
            wanted = [frozenset().union(*a.values()) if a else frozenset() for a in state.allowed]
            counted = []
            for of, features in joint([(f, tuple(m for m in range(len(models)) if f in wanted[m])) for f in range(width)], sizes):
                steps = np.cumprod([1, *[sizes[f] for f in features]]).tolist()
                at = np.arange(steps[-1])
                apart = np.concatenate([at // step % sizes[f] == np.arange(sizes[f])[:, None] for f, step in zip(features, steps, strict=False)]).astype(float)  # which joint bins a feature's bin has
                counted.append((of, features, steps, apart, np.concatenate([np.arange(begin[f], begin[f + 1]) for f in features])))
            none = max(map(len, nodes))  # the place of rows that don't count
            spots = []
            for m, o in enumerate(nodes):
                p = np.full((1 << (models[m].how.depth + 1)) - 1, none, np.int64)
                p[o] = np.arange(len(o))
                spots.append(p)
            errors = np.zeros((len(models), 2))
            for ids, fold, columns, numbers in _chunks(batches):
                ys, ws = numbers[:labels], numbers[labels : labels + weights]
                margin = _added(columns, numbers[labels + weights :].T, state.pending)
                held: list = [None] * len(models)
                side = (np.arange(len(ids)) & 1) * (none + 1)  # neighbours are added up apart, as they often share a cell
                for m, model in enumerate(models):
                    y, w, at = ys[model.label], ws[model.weight], np.ascontiguousarray(margin[:, m])
                    own = fold == model.fold
                    if state.errors[m]:
                        errors[m] += model.loss.value(y[own], at[own], w[own]).sum(), own.sum()
                    if not nodes[m]:
                        continue
                    use = ~own
                    if model.how.row_share < 1:
                        use &= _drawn(ids, model.how.seed + 1000 * state.round + model.k, model.how.row_share)
                    spot = spots[m][state.growing[m].place_by_column(columns, len(y))]
                    spot[~use] = none
                    spot += side
                    g, h = model.loss.gradient(y, at, w)
                    whole = len(h) * h.max() < WHOLE and h.min() >= 0 and bool((h == np.floor(h)).all())
                    held[m] = (spot, g, h + WHOLE) if whole else (spot, g, h, None)
                for of, features, steps, apart, place in counted:
                    code = np.zeros(len(ids), np.int64)
                    for f, step in zip(features, steps, strict=False):
                        code += columns[f].astype(np.int64) * (step * 2 * (none + 1))
                    cells = steps[-1] * 2 * (none + 1)
                    for m in of:
                        spot, *values = held[m]
                        cell = code + spot
                        found = [apart @ np.bincount(cell, v, cells).reshape(steps[-1], -1) for v in values]
                        found = [(x[:, : none + 1] + x[:, none + 1 :])[:, : len(nodes[m])].T for x in found]
                        if len(found) == 2:
                            rows = np.floor(found[1] / WHOLE)
                            found = [found[0], found[1] - rows * WHOLE, rows]
                        for c, x in enumerate(found):
                            sums[m][:, place, c] += x
            rows = [(m, -1, np.array([*e, 0.0]).tobytes()) for m, e in enumerate(errors) if state.errors[m]]
            rows += [(m, node, sums[m][i].tobytes()) for m, o in enumerate(nodes) for i, node in enumerate(o)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["model", "node", "hist"])

        return self.table.mapInArrow(run, _HIST)

    def splits(self, state: _State) -> DataFrame:
        """The best split of each model and open node; for node -1 the error and the rows as g and h."""
        models, signs, places = self.models, self.signs, self.places

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, total, out = None, None, []

            def done() -> None:
                m, node = key
                if node < 0:
                    out.append((m, node, -1, 0.0, 0, *total[:2], 0.0, 0.0, 0.0, 0.0))
                    return
                bound, how, some = state.open[m][node], models[m].how, sorted(state.allowed[m][node])
                hist = np.append(total.reshape(-1, 3), np.zeros((1, 3)), 0)[places[some]]
                f, gain, at, left = best_split(hist, how.ridge, how.least_rows, bound.low, bound.high, np.array(signs[m])[some])
                out.append((m, node, some[f], gain, at, *left, *hist[f].sum(0)))

            for batch in batches:
                for *new, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    hist = np.frombuffer(packed)
                    if new != key:
                        if key is not None:
                            done()
                        key, total = new, hist.copy()
                    else:
                        total += hist
            if key is not None:
                done()
            if out:
                kinds = (pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.int32(), *[pa.float64()] * 6)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=[c.split()[0] for c in _SPLIT.split(", ")])

        by, parts = ("model", "node"), min(24, sum(map(len, state.open)) + sum(state.errors))
        return self.histograms(state).repartition(parts, *by).sortWithinPartitions(*by).mapInArrow(run, _SPLIT)

    def renewed(self, state: _State, grown: list[Tree | None], leaves: list[dict[int, _Node]]) -> None:
        """Leaf values of a quantile loss: the exact quantile of y less margin in each leaf, of all models in one pass."""
        models, labels, given = self.models, self.labels, self.labels + self.weights
        mine = [m for m, model in enumerate(models) if grown[m] is not None and model.loss.name == "quantile"]
        stride = 1 << (1 + max(model.how.depth for model in models))

        def values(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
            for _, fold, columns, numbers in _blocks(batch):
                ys, margin = numbers[:labels], _added(columns, numbers[given:].T, state.pending)
                for m in mine:
                    use = fold != models[m].fold
                    at, rest = grown[m].place_by_column(columns, len(fold))[use], ys[models[m].label, use] - margin[use, m]
                    for node in np.unique(at).tolist():
                        yield m * stride + node, rest[at == node]

        for share in sorted({models[m].loss.parameter for m in mine}):
            one = [m for m in mine if models[m].loss.parameter == share]
            found = exact_percentiles(self.table, lambda batch, one=frozenset(one): ((g, v) for g, v in values(batch) if g // stride in one), (share,))
            for g, (q,) in found.items():
                m, node = divmod(g, stride)
                bound = leaves[m][node]
                grown[m].value[node] = models[m].how.rate * float(np.clip(q, bound.low, bound.high))

    def written(self, pending: list[list[Tree]]) -> None:
        """Margins with the pending trees, as a table."""
        given = self.labels + self.weights

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for ids, folds, columns, numbers in (block for batch in batches for block in _blocks(batch)):
                yield _block(ids, folds, columns, np.vstack([numbers[:given], _added(columns, numbers[given:].T, pending).T]))

        self.table = staged(self.table.mapInArrow(run, self.table.schema), "margins")


@dataclass
class Boosted:
    """features, edges, folds, starts, trees by fold's model, rounds that count, and the held-out error by round (None: not asked)."""

    features: list[str]
    edges: list[np.ndarray]
    folds: list[int]
    starts: list[float]
    trees: list[list[Tree]]
    best: list[int]
    errors: list[list[float]]
    loss: Loss

    def margins(self, bins: np.ndarray) -> np.ndarray:
        """Rows x models."""
        return _margins(bins, np.tile(np.array(self.starts), (len(bins), 1)), [t[:n] for t, n in zip(self.trees, self.best, strict=True)])

    def scores(self, values: np.ndarray) -> np.ndarray:
        """Predictions of all models for rows of feature values."""
        return self.loss.predicted(self.margins(_binned(values, self.edges)))

    def predict(self, rows: DataFrame, out: str = "prediction", fold: str = "fold") -> DataFrame:
        """Rows with a fold by the model that hasn't seen it, others by the mean of all."""
        return predict_all([self], rows, [out], fold)

    def importance(self) -> list[tuple[int, str, float]]:
        """(fold, feature, gain) of the splits that count."""
        out = []
        for f, trees, n in zip(self.folds, self.trees, self.best, strict=True):
            gain = np.zeros(len(self.features))
            for t in trees[:n]:
                np.add.at(gain, t.feature[t.feature >= 0], t.gain[t.feature >= 0])
            out += [(f, name, float(g)) for name, g in zip(self.features, gain, strict=True)]
        return out

    def history(self) -> list[tuple[int, int, float, bool]]:
        """(fold, round from 0: before the first tree, held-out error, whether it is the round that counts)."""
        return [(f, i, e, i == n) for f, es, n in zip(self.folds, self.errors, self.best, strict=True) for i, e in enumerate(es)]


def predict_all(fits: Sequence[Boosted], rows: DataFrame, outs: Sequence[str], fold: str = "fold", keep: Sequence[str] | None = None) -> DataFrame:
    """rows (the columns `keep`, or all) with the predictions of several fits, in one pass: rows with a fold by the model that hasn't seen it, others by the mean of all."""
    keep = [c for c in (rows.columns if keep is None else keep) if c not in outs]
    features = list(dict.fromkeys(f for fit in fits for f in fit.features))
    at = {f: i for i, f in enumerate(features)}
    ways = [(fit.scores, [at[f] for f in fit.features], np.array(fit.folds)) for fit in fits]
    wide = rows.select(*keep, F.coalesce(F.col(fold).cast("int"), F.lit(-(1 << 30))).alias("_at"), _vector(features).alias("_x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own_fold, x, done = batch.column(len(keep)).to_numpy(), _doubles(batch.column(len(keep) + 1), len(features)), []
            for scores, of, folds in ways:
                own, p = own_fold[:, None] == folds[None, :], scores(x[:, of])
                done.append(pa.array(np.where(own.any(1), (p * own).sum(1), p.mean(1))))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *done], names=[*keep, *outs])

    return wide.mapInArrow(run, ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep) + "".join(f", `{o}` double" for o in outs))


def _starts(known: DataFrame, wanted: Sequence[Wanted], folds: Sequence[int]) -> list[list[float]]:
    """What each fit's models predict before their first trees, from the other folds. The sums of all fits come from one pass."""
    one = lambda want: F.col(want.weight).cast("double") if want.weight else F.lit(1.0)
    y = lambda want: F.col(want.y).cast("double")
    sums = {r["fold"]: r for r in known.groupBy("fold").agg(*[c for i, want in enumerate(wanted) for c in (F.sum(y(want) * one(want)).alias(f"a{i}"), F.sum(one(want)).alias(f"b{i}"))]).collect()}  # one row a fold
    out = []
    for i, want in enumerate(wanted):
        if want.loss.name == "quantile":

            def values(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
                v, own = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy()
                for k, f in enumerate(folds):
                    yield k, v[own != f]

            found = exact_percentiles(known.select(y(want).alias("v"), "fold"), values, (want.loss.parameter,))
            out.append([float(found[k][0]) if k in found else 0.0 for k in range(len(folds))])
            continue
        starts = []
        for f in folds:
            a, b = (sum(r[f"{c}{i}"] for k, r in sums.items() if k != f) for c in "ab")
            starts.append(want.loss.start(a / b if b else 0.0))
        out.append(starts)
    return out


def fit(rows: DataFrame, features: Sequence[str], y: str, folds: Sequence[int], key: Sequence[str], loss: Loss = Loss(), how: How = How(), weight: str | None = None, edges: list[np.ndarray] | None = None) -> Boosted:  # noqa: B008
    """A model for each fold from the rows of the others. edges: those of another fit to the same rows. rows: a written table with key, y, fold, features and the weight; rows without a fold or a y teach nothing."""
    return fit_all(rows, features, folds, key, [Wanted(y, loss, how, weight)], edges)[0]


def fit_all(rows: DataFrame, features: Sequence[str], folds: Sequence[int], key: Sequence[str], wanted: Sequence[Wanted], edges: list[np.ndarray] | None = None) -> list[Boosted]:
    """Several fits to the same rows side by side: each pass over the rows serves the models of all. Rows without a fold or any of the labels teach nothing."""
    if any(not 2 <= want.how.bins <= 254 for want in wanted):
        raise ValueError("between 2 and 254 bins")
    if len({want.how.bins for want in wanted}) != 1:
        raise ValueError("fits side by side share their bins")
    features, folds = list(features), list(folds)
    at = {f: i for i, f in enumerate(features)}
    own = [[at[f] for f in want.features] if want.features is not None else list(range(len(features))) for want in wanted]
    signs, groups = [], []
    for want, of in zip(wanted, own, strict=True):
        if unknown := [f for f in want.how.monotone if f not in at]:
            raise ValueError(f"no such feature: {', '.join(unknown)}")
        signs.append([want.how.monotone.get(f, 0) for f in features])
        groups.append([frozenset(of)])
        if want.how.groups is not None:
            listed = [frozenset(at[f] for f in g if f in at) for g in want.how.groups]
            groups[-1] = listed + [frozenset([i]) for i in of if not any(i in g for g in listed)]
    labels, weights = (list(dict.fromkeys(x)) for x in ([want.y for want in wanted], [want.weight for want in wanted]))
    known = rows.where(reduce(and_, [F.col(c).isNotNull() for c in ("fold", *labels)])).withColumn("fold", F.col("fold").cast("int"))
    edges = bin_edges(known, features, wanted[0].how.bins) if edges is None else edges
    starts = _starts(known, wanted, folds)
    models = [_Model(want.loss, want.how, f, k, labels.index(want.y), weights.index(want.weight)) for want in wanted for k, f in enumerate(folds)]
    of_fit = [i for i in range(len(wanted)) for _ in folds]
    table = _table(known, features, edges, labels, weights, key, [float(x) for part in starts for x in part])
    work = _Fit(staged(table, "bins"), len(features), edges, models, [signs[i] for i in of_fit], len(labels), len(weights))
    n, rngs = len(models), [np.random.default_rng(want.how.seed) for want in wanted]
    trees: list[list[Tree]] = [[] for _ in models]
    pending: list[list[Tree]] = [[] for _ in models]
    errors: list[list[float]] = [[] for _ in models]
    stopped = [False] * n

    def judge(found: list) -> None:
        for r in found:
            if r["node"] < 0:
                es = errors[r["model"]]
                es.append(r["g"] / r["h"] if r["h"] else 0.0)
                stopped[r["model"]] = len(es) - 1 - int(np.argmin(es)) >= models[r["model"]].how.patience

    for r in range(max(want.how.rounds for want in wanted) + 1):
        drawn = []
        for want, of, rng in zip(wanted, own, rngs, strict=True):
            some = np.sort(rng.choice(len(of), max(1, round(want.how.feature_share * len(of))), replace=False)).tolist() if r < want.how.rounds else []
            drawn.append(frozenset(of[i] for i in some))
        ask = [model.how.patience is not None and not s and r <= model.how.rounds for model, s in zip(models, stopped, strict=True)]
        grows = [r < model.how.rounds and not s for model, s in zip(models, stopped, strict=True)]
        if not any(grows) and not any(ask):
            break
        growing: list[Tree | None] = [Tree.empty(model.how.depth) if g else None for model, g in zip(models, grows, strict=True)]
        leaves: list[dict[int, _Node]] = [{} for _ in models]
        open_: list[dict[int, _Node]] = [{0: _Node()} if g else {} for g in grows]
        for level in range(max(model.how.depth for model in models)):
            for m, model in enumerate(models):
                if level >= model.how.depth:
                    leaves[m].update(open_[m])
                    open_[m] = {}
            allowed = [{i: permitted(node.used, groups[of_fit[m]], len(features)) & drawn[of_fit[m]] for i, node in o.items()} for m, o in enumerate(open_)]
            for m in range(n):  # nodes that nothing may split are leaves
                for i in [i for i, a in allowed[m].items() if not a]:
                    leaves[m][i] = open_[m].pop(i)
                    del allowed[m][i]
            asked = ask if level == 0 else [False] * n
            if not any(open_) and not any(asked):
                break
            found = work.splits(_State(pending, growing, open_, allowed, asked, r)).collect()  # one row a model and node
            if level == 0:
                judge(found)
            below: list[dict[int, _Node]] = [{} for _ in models]
            for s in found:
                m, i = s["model"], s["node"]
                if i < 0 or stopped[m]:
                    continue
                tree, node, how = growing[m], open_[m][i], models[m].how
                if level == 0:
                    tree.value[0] = leaf_value(s["all_g"], s["all_h"], how.ridge, node.low, node.high)
                if not s["gain"] > how.least_gain:
                    leaves[m][i] = node
                    continue
                tree.feature[i], tree.bin[i], tree.gain[i] = s["feature"], s["bin"], s["gain"]
                a = leaf_value(s["g"], s["h"], how.ridge, node.low, node.high)
                b = leaf_value(s["all_g"] - s["g"], s["all_h"] - s["h"], how.ridge, node.low, node.high)
                tree.value[2 * i + 1], tree.value[2 * i + 2] = a, b
                used, sign, middle = node.used | {s["feature"]}, work.signs[m][s["feature"]], (a + b) / 2
                left, right = _Node(node.low, node.high, used), _Node(node.low, node.high, used)
                if sign > 0:
                    left.high, right.low = middle, middle
                elif sign < 0:
                    left.low, right.high = middle, middle
                below[m][2 * i + 1], below[m][2 * i + 2] = left, right
            open_ = below
        for m in range(n):
            leaves[m].update(open_[m])
        grown = [t if g and not s else None for t, g, s in zip(growing, grows, stopped, strict=True)]
        for t, model in zip(grown, models, strict=True):
            if t is not None:
                t.value *= model.how.rate
        if any(t is not None and model.loss.name == "quantile" for t, model in zip(grown, models, strict=True)):
            work.renewed(_State(pending, grown, [{} for _ in models], [{} for _ in models], [False] * n), grown, leaves)
        for m, t in enumerate(grown):
            if t is not None:
                trees[m].append(t)
                pending[m].append(t)
        if (r + 1) % KEEP == 0 and any(pending) and any(len(t) < model.how.rounds and not s for t, model, s in zip(trees, models, stopped, strict=True)):
            work.written(pending)
            pending = [[] for _ in models]
    out, k = [], len(folds)
    for i, (want, of) in enumerate(zip(wanted, own, strict=True)):
        part = slice(i * k, (i + 1) * k)
        rounds = [int(np.argmin(e)) if e else len(t) for e, t in zip(errors[part], trees[part], strict=True)]
        back = {f: j for j, f in enumerate(of)}
        for t in (t for ts in trees[part] for t in ts):  # in the fit's own features
            t.feature = np.array([back[f] if f >= 0 else -1 for f in t.feature.tolist()], np.int32)
        out.append(Boosted([features[f] for f in of], [edges[f] for f in of], folds, starts[i], trees[part], rounds, errors[part], want.loss))
    return out


# ---- whole tasks ----


def falls(model: Boosted, rows: DataFrame, monotone: dict[str, int]) -> DataFrame:
    """fold, feature, rows and falls: in how many rows a model's margin moves against the constraint as the feature alone goes through its
    bins from one end to the other."""
    at = {f: i for i, f in enumerate(model.features)}
    features, folds, edges, signs = model.features, model.folds, model.edges, [(f, at[f], s) for f, s in monotone.items()]

    counted = [trees[:n] for trees, n in zip(model.trees, model.best, strict=True)]
    using = [[[t for t in trees if (t.feature == i).any()] for trees in counted] for _, i, _ in signs]
    steps = [sorted({int(b) for trees in of for t in trees for b in t.bin[t.feature == i]}) for (_, i, _), of in zip(signs, using, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bad, n = np.zeros((len(folds), len(signs)), np.int64), 0
        for batch in batches:
            columns = np.ascontiguousarray(_binned(_doubles(batch.column(0), len(features)), edges).T)
            rows_here = columns.shape[1]
            n += rows_here
            for j, (_, i, sign) in enumerate(signs):  # only trees that use the feature move, and only where one of their splits is passed
                own, before, against = columns[i].copy(), None, np.zeros((rows_here, len(folds)), bool)
                for v in (0, *[b + 1 for b in steps[j]]):
                    columns[i] = v
                    m = _added(columns, np.zeros((rows_here, len(folds))), using[j])
                    if before is not None:
                        against |= sign * (m - before) < -1e-9
                    before = m
                columns[i] = own
                bad[:, j] += against.sum(0)
        f, j = np.indices(bad.shape)
        names = [signs[x][0] for x in j.ravel()]
        yield pa.RecordBatch.from_arrays([pa.array(np.array(folds)[f.ravel()].astype(np.int32)), pa.array(names), pa.array(np.full(bad.size, n)), pa.array(bad.ravel())], names=["fold", "feature", "rows", "falls"])

    wide = rows.select(_vector(features).alias("x"))
    return wide.mapInArrow(run, "fold int, feature string, rows long, falls long").groupBy("fold", "feature").agg(F.sum("rows").alias("rows"), F.sum("falls").alias("falls"))


def best_power(rows: DataFrame, features: Sequence[str], y: str, folds: Sequence[int], key: Sequence[str], powers: Sequence[float], how: How = How(), weight: str | None = None) -> list[tuple[float, float, Boosted]]:  # noqa: B008
    """(error out of fold, power, model) of each variance power, the best first. The error is the weighted squared one, which all powers share."""
    fits = fit_all(rows, features, folds, key, [Wanted(y, Loss("tweedie", p), how, weight) for p in powers])
    errors = _errors(fits, rows.where(F.col("fold").isNotNull()), y, weight)
    return sorted(zip(errors, powers, fits, strict=True), key=lambda r: r[:2])


def _errors(fits: Sequence[Boosted], rows: DataFrame, y: str, weight: str | None) -> list[float]:
    """The weighted error of each fit out of fold, all from one pass."""
    w, names = F.col(weight) if weight else F.lit(1.0), [f"_p{i}" for i in range(len(fits))]
    features = dict.fromkeys(f for fit in fits for f in fit.features)
    some = predict_all(fits, rows.select("fold", *dict.fromkeys(c for c in (y, weight) if c), *[c for c in features if c not in ("fold", y, weight)]), names)
    return [float(e) for e in some.agg(*[F.sqrt(F.avg(w * (F.col(y) - F.col(p)) ** 2) + 1e-9).alias(p) for p in names]).first()]


def with_quantiles(rows: DataFrame, features: Sequence[str], y: str, folds: Sequence[int], key: Sequence[str], shares: Sequence[float] = (0.6, 0.75, 0.9), how: How = How()) -> DataFrame:  # noqa: B008
    """rows with q60 and the like: quantiles out of fold."""
    fits = fit_all(rows, features, folds, key, [Wanted(y, Loss("quantile", s), how) for s in shares])
    return predict_all(fits, rows, [f"q{round(100 * s)}" for s in shares])


def search_errors(rows: DataFrame, features: Sequence[str], y: str, folds: Sequence[int], key: Sequence[str], weight: str | None = None, loss: Loss = Loss()):  # noqa: B008
    """A function from several settings (of How) to their weighted errors out of fold, for models.search: their models grow side by side. rows: a written table."""
    edges = bin_edges(rows.where(F.col("fold").isNotNull() & F.col(y).isNotNull()), features, How.bins)

    def errors(settings: Sequence[dict]) -> list[float]:
        return _errors(fit_all(rows, features, folds, key, [Wanted(y, loss, How(**s), weight) for s in settings], edges), rows, y, weight)

    return errors
