"""Blends, stacks, thresholds and calibration, from sums of products that one aggregate yields."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.models.evaluation import weighted_rmse


def gram(rows: DataFrame, columns: Sequence[str], y: str, w: Column) -> DataFrame:
    """n, the weighted sum of y squared, and the weighted sums of products of columns (i, j) and with y: one row."""
    c = [F.col(x) for x in columns]
    out = {"n": F.count(F.lit(1)), "yy": F.sum(w * F.col(y) * F.col(y))}
    out |= {f"xy_{i}": F.sum(w * a * F.col(y)) for i, a in enumerate(c)}
    out |= {f"xx_{i}_{j}": F.sum(w * a * b) for i, a in enumerate(c) for j, b in enumerate(c) if i <= j}
    return rows.agg(*[v.alias(k) for k, v in out.items()])


def gram_arrays(one, k: int) -> tuple[np.ndarray, np.ndarray, float, int]:
    a = np.array([[one[f"xx_{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], float)
    return a, np.array([one[f"xy_{i}"] for i in range(k)], float), float(one["yy"]), int(one["n"])


def blend_error(weights: np.ndarray, a: np.ndarray, b: np.ndarray, yy: float, n: int) -> float:
    return float(np.sqrt(max(yy - 2 * weights @ b + weights @ a @ weights, 0.0) / n + 1e-9))


def best_blend(one, steps: int = 20) -> tuple[float, float]:
    """(weight of the first of two models, error) on an even grid."""
    a, b, yy, n = gram_arrays(one, 2)
    scored = [(blend_error(np.array([i / steps, 1 - i / steps]), a, b, yy, n), i / steps) for i in range(steps + 1)]
    error, w = min(scored)
    return w, error


def best_simplex_blend(one, models: int, steps: int = 20) -> tuple[list[float], float]:
    a, b, yy, n = gram_arrays(one, models)

    def grid(left: int, k: int):
        if k == 1:
            yield (left,)
            return
        for i in range(left + 1):
            for rest in grid(left - i, k - 1):
                yield (i, *rest)

    error, w = min((blend_error(np.array(g) / steps, a, b, yy, n), g) for g in grid(steps, models))
    return [x / steps for x in w], error


def nonnegative_least_squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least squares with no negative weight, from the products a = X'X and b = X'y, by active sets."""
    n = len(b)
    x, free = np.zeros(n), np.zeros(n, bool)
    for _ in range(30 * n):
        slope = b - a @ x
        slope[free] = -np.inf
        if free.all() or slope.max() <= 1e-10 * max(1.0, np.abs(b).max()):
            return x
        free[int(slope.argmax())] = True
        while True:
            s = np.zeros(n)
            s[free] = np.linalg.lstsq(a[np.ix_(free, free)], b[free], rcond=None)[0]
            if (s[free] > 0).all():
                x = s
                break
            out = free & (s <= 0)
            step = np.min(x[out] / np.maximum(x[out] - s[out], 1e-300))
            x = x + step * (s - x)
            free &= x > 1e-12
            x[~free] = 0.0
    return x


def stack_columns(models: Sequence[str], threshold: float = 0.1) -> dict[str, Column]:
    """Each model, and how far it is above the threshold."""
    return {m: F.col(m) for m in models} | {f"{m}_over": F.greatest(F.col(m) - threshold, F.lit(0.0)) for m in models}


def fit_stack(rows: DataFrame, models: Sequence[str], y: str, w: Column) -> dict[str, float]:
    columns = stack_columns(models)
    wide = rows.select(F.col(y).alias("_y"), w.alias("_w"), *[c.alias(f"_{k}") for k, c in columns.items()])
    one = gram(wide, [f"_{k}" for k in columns], "_y", F.col("_w")).first()
    a, b, _, _ = gram_arrays(one, len(columns))
    return dict(zip(columns, nonnegative_least_squares(a, b).tolist(), strict=True))


def apply_stack(weights: dict[str, float], models: Sequence[str]) -> Column:
    columns = stack_columns(models)
    return sum((columns[k] * v for k, v in weights.items()), F.lit(0.0))


def soft_mixture(gate: Column, low: Column, high: Column, tau: float = 1.0) -> Column:
    g = F.pow(gate, tau)
    return g * high + (1 - g) * low


def hard_mixture(gate: Column, low: Column, high: Column, threshold: float) -> Column:
    return F.when(gate >= threshold, high).otherwise(low)


def grid_errors(rows: DataFrame, candidates: dict[str, Column], y: str, w: Column) -> DataFrame:
    """candidate and its error, all in one aggregate."""
    one = rows.agg(*[weighted_rmse(F.col(y), p, w).alias(f"c{i}") for i, p in enumerate(candidates.values())])
    return one.select(F.inline(F.array(*[F.struct(F.lit(k).alias("candidate"), F.col(f"c{i}").alias("wrmse")) for i, k in enumerate(candidates)])))


def zero_below(p: Column, threshold: float) -> Column:
    return F.when(p < threshold, 0.0).otherwise(p)


def fit_isotonic(rows: DataFrame, p: str, y: str, threshold: float = 0.1, weight: str | None = None):
    """Rising step function of rows at or over the threshold; an error where there are none."""
    part = rows.where(F.col(p) >= threshold)
    if part.isEmpty():
        raise ValueError("no prediction reaches the threshold")
    model = IsotonicRegression(featuresCol=p, labelCol=y, predictionCol="_calibrated", **({"weightCol": weight} if weight else {}))
    return model.fit(part)


def apply_isotonic(rows: DataFrame, model, p: str, out: str, threshold: float = 0.1) -> DataFrame:
    """Rows below the threshold stay as they are."""
    done = model.transform(rows)
    return done.withColumn(out, F.when(F.col(p) >= threshold, F.col("_calibrated")).otherwise(F.col(p))).drop("_calibrated")


def calibrated_by_fold(rows: DataFrame, p: str, y: str, folds: Sequence[int], fold: str = "fold") -> DataFrame:
    """p put through the rising step function of y over p of the other folds' rows."""
    parts = [apply_isotonic(rows.where(F.col(fold) == f), fit_isotonic(rows.where(F.col(fold) != f), p, y, 0.0), p, "_new", 0.0).withColumn(p, F.col("_new")).drop("_new") for f in folds]
    return reduce(DataFrame.unionByName, parts)


def best_isotonic_threshold(rows: DataFrame, p: str, y: str, w: Column, candidates: Sequence[float] = tuple(i / 100 for i in range(5, 20)), weight: str | None = None) -> tuple[float, float, object]:
    """(threshold, error, model): of a step function fitted over each threshold that any prediction reaches, the one of least error;
    the lower threshold of equals."""
    best = None
    for t in candidates:
        try:
            model = fit_isotonic(rows, p, y, t, weight)
        except ValueError:
            continue
        error = apply_isotonic(rows, model, p, "_new", t).agg(weighted_rmse(F.col(y), F.col("_new"), w).alias("e")).first()["e"]
        if best is None or error < best[1]:
            best = (t, error, model)
    if best is None:
        raise ValueError("no prediction reaches any threshold")
    return best


def fit_platt(rows: DataFrame, p: str, y: str):
    return LogisticRegression(featuresCol="_v", labelCol=y, probabilityCol="_p", rawPredictionCol="_r", predictionCol="_c").fit(VectorAssembler(inputCols=[p], outputCol="_v").transform(rows))


def apply_platt(rows: DataFrame, model, p: str, out: str) -> DataFrame:
    done = model.transform(VectorAssembler(inputCols=[p], outputCol="_v").transform(rows))
    return done.withColumn(out, vector_to_array("_p")[1]).drop("_v", "_p", "_r", "_c")


def platt(model, p: Column) -> Column:
    """The calibrated probability of apply_platt as an expression."""
    return 1 / (1 + F.exp(-(p * float(model.coefficients[0]) + F.lit(float(model.intercept)))))


def platt_by_fold(rows: DataFrame, p: str, y: str, folds: Sequence[int], fold: str = "fold", out: str = "calibrated") -> DataFrame:
    """Logistic calibration of each fold by the other folds' rows."""
    return reduce(DataFrame.unionByName, [apply_platt(rows.where(F.col(fold) == f), fit_platt(rows.where(F.col(fold) != f), p, y), p, out) for f in folds])
