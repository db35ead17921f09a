"""Boosted trees by fold: regression, gates with two experts, hurdles, success probabilities (by models/boosting.py), and a seeded search.

Spark's trees have no monotone or interaction constraints and no Tweedie or quantile loss; linear Tweedie models stand in for
the former (tweedie_oof) and monotone_violations() checks a fitted model after the fact.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import partial, reduce

import numpy as np
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.models import boosting
from fieldloom.models.blending import calibrated_by_fold, fit_platt, hard_mixture, platt, soft_mixture
from fieldloom.models.evaluation import weighted_rmse
from fieldloom.operators.quantiles import percentiles
from fieldloom.sources.staging import side_by_side, staged


def with_vector(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep").transform(rows)


def out_of_fold(rows: DataFrame, fit: Callable[[DataFrame], Callable[[DataFrame], DataFrame]], folds: Sequence[int], fold: str = "fold") -> DataFrame:
    """Every row predicted by the model that didn't see its fold. rows are written first: all fits and predictions read them."""
    rows = staged(rows, "rows")
    parts = [fit(rows.where(F.col(fold) != f))(rows.where(F.col(fold) == f)) for f in folds]
    return reduce(DataFrame.unionByName, parts)


def by_fold_and_new(rows: DataFrame, fit: Callable[[DataFrame], Callable[[DataFrame], DataFrame]], folds: Sequence[int], out: str, fold: str = "fold") -> DataFrame:
    """Rows with a fold predicted by the model that didn't see it, rows without one by the mean of all. rows: a written table."""
    models = {f: fit(rows.where(F.col(fold).isNotNull() & (F.col(fold) != f))) for f in folds}
    parts = [apply(rows.where(F.col(fold) == f)) for f, apply in models.items()]
    new = rows.where(F.col(fold).isNull())
    for f, apply in models.items():
        new = apply(new).withColumnRenamed(out, f"_p{f}")
    new = new.withColumn(out, sum((F.col(f"_p{f}") for f in folds), F.lit(0.0)) / len(folds)).drop(*[f"_p{f}" for f in folds])
    return reduce(DataFrame.unionByName, [*parts, new])


def regressor(y: str, out: str, weight: str | None = None, rounds: int = 20, depth: int = 4, rate: float = 0.1, seed: int = 42, features: str = "features"):
    def fit(rows: DataFrame):
        model = GBTRegressor(labelCol=y, featuresCol=features, predictionCol=out, maxIter=rounds, maxDepth=depth, stepSize=rate, seed=seed, **({"weightCol": weight} if weight else {})).fit(rows)
        return model.transform

    return fit


def classifier(y: str, out: str, weight: str | None = None, rounds: int = 20, depth: int = 4, seed: int = 42):
    """Probability of y = 1, kept off 0 and 1. Training rows of one kind only give their own rate."""

    def fit(rows: DataFrame):
        rate = rows.agg(F.avg(y)).first()[0]
        if rate is None or rate in (0.0, 1.0):
            return lambda df: df.withColumn(out, F.lit(min(max(rate if rate is not None else 0.5, 1e-4), 1 - 1e-4)))
        model = GBTClassifier(labelCol=y, featuresCol="features", predictionCol="_c", maxIter=rounds, maxDepth=depth, seed=seed, **({"weightCol": weight} if weight else {})).fit(rows)
        return lambda df: model.transform(df).withColumn(out, F.least(F.greatest(vector_to_array("probability")[1], F.lit(1e-4)), F.lit(1 - 1e-4))).drop("probability", "rawPrediction", "_c")

    return fit


def mixture_oof(rows: DataFrame, y: str, folds: Sequence[int], threshold: float = 0.1, weight: str | None = None, rounds: int = 10, least_rows: int = 100, calibrate: bool = True, high_features: Sequence[str] | None = None) -> DataFrame:
    """gate, low and high: both experts predict every row, whatever its label, so no label reaches its own prediction. calibrate:
    the gate goes through rising step functions of the other folds. high_features: what the high expert sees, instead of all."""
    rows = rows.withColumn("_high", (F.col(y) >= threshold).cast("double"))

    def expert(part: Column, out: str, features: str = "features"):
        def fit(train: DataFrame):
            own = train.where(part)
            return regressor(y, out, weight, rounds, features=features)(own if own.count() >= least_rows else train)

        return fit

    rows = out_of_fold(rows, classifier("_high", "gate", weight, rounds), folds)
    if calibrate:
        rows = calibrated_by_fold(staged(rows, "gate"), "gate", "_high", folds)
    rows = out_of_fold(rows, expert(F.col("_high") == 0, "low"), folds)
    if high_features is not None:
        rows = VectorAssembler(inputCols=list(high_features), outputCol="_few", handleInvalid="keep").transform(rows)
    rows = out_of_fold(rows, expert(F.col("_high") == 1, "high", "features" if high_features is None else "_few"), folds).drop("_few")
    return rows.withColumns({"soft": soft_mixture(F.col("gate"), F.col("low"), F.col("high")), "hard": hard_mixture(F.col("gate"), F.col("low"), F.col("high"), 0.5)}).drop("_high")


def hurdle_oof(rows: DataFrame, y: str, folds: Sequence[int], rounds: int = 10) -> DataFrame:
    """Chance of being over 0 times the expectation where it is."""
    rows = rows.withColumn("_some", (F.col(y) > 0).cast("double"))
    rows = out_of_fold(rows, classifier("_some", "chance", rounds=rounds), folds)
    rows = out_of_fold(rows, lambda train: regressor(y, "size", rounds=rounds)(train.where("_some = 1")), folds)
    return rows.withColumn("hurdle", F.col("chance") * F.col("size")).drop("_some")


def log_regressor(y: str, out: str, weight: str | None = None, rounds: int = 20, depth: int = 4):
    """Fitted on log(1 + y)."""

    def fit(rows: DataFrame):
        apply = regressor("_log", "_out", weight, rounds, depth)(rows.withColumn("_log", F.log1p(y)))
        return lambda df: apply(df).withColumn(out, F.expm1("_out")).drop("_out")

    return fit


def tweedie_oof(rows: DataFrame, y: str, folds: Sequence[int], power: float = 1.4, out: str = "tweedie", ridge: float = 0.01) -> DataFrame:
    def fit(train: DataFrame):
        return GeneralizedLinearRegression(family="tweedie", variancePower=power, linkPower=0.0, labelCol=y, featuresCol="features", predictionCol=out, regParam=ridge, maxIter=30).fit(train).transform

    return out_of_fold(rows, fit, folds)


def success_probability(actions: DataFrame, features: Sequence[str], groups: Sequence[str], folds: Sequence[int], rounds: int = 8, least_groups: int = 2, keep: Sequence[str] | None = None) -> DataFrame:
    """actions (the columns `keep`, or all) with xpass_prob by group of action. Rows with a fold are predicted out of fold and calibrated by the other folds; new rows (fold
    null) get the mean of all folds' models, calibrated by all predictions of rows with a fold after these were calibrated. A
    group within fewer than least_groups folds gets its own rate, or a half. A pass over a group's rows serves all its folds' models
    (models/boosting.py), groups grow side by side, and one pass predicts them all. actions: read several times, so a written table."""
    spark, keep = actions.sparkSession, list(actions.columns if keep is None else keep)
    rows = actions.where(F.col("group").isin(*groups)).withColumn("_y", F.coalesce((F.col("result_name") == "success").cast("double"), F.lit(0.0)))
    facts: dict[str, dict] = {}
    for r in rows.groupBy("group", "fold").agg(F.count(F.lit(1)).alias("n"), F.sum("_y").alias("s")).collect():  # groups times folds rows
        facts.setdefault(r["group"], {})[r["fold"]] = (r["n"], r["s"])
    kept = lambda p: F.least(F.greatest(p, F.lit(1e-4)), F.lit(1 - 1e-4))
    how = boosting.How(rounds=rounds, depth=3, rate=0.3, least_rows=1)
    chance, here = F.lit(0.5), {}
    for g, known in ((g, {f: of for f, of in facts.get(g, {}).items() if f is not None}) for g in groups):
        n, s = (sum(of[i] for of in known.values()) for i in (0, 1))
        if len(known) < least_groups or s in (0, n):
            chance = F.when(F.col("group") == g, F.lit(s / n if n else 0.5)).otherwise(chance)
        else:
            here[g] = [f for f in folds if f in known]
    if not here:
        return rows.select(*keep).withColumn("xpass_prob", kept(chance))
    models = side_by_side(spark, [partial(boosting.fit, rows.where(F.col("group") == g), features, "_y", of, features, boosting.Loss("logistic"), how) for g, of in here.items()])
    raws = {g: f"_raw{i}" for i, g in enumerate(here)}
    own = F.coalesce(*[F.when(F.col("group") == g, F.col(raw)) for g, raw in raws.items()])
    predicted = boosting.predict_all(models, rows, list(raws.values()), keep=list(dict.fromkeys([*keep, "group", "fold", "_y"])))
    raw = staged(predicted.withColumn("_raw", kept(own)).drop(*raws.values()), "raw")
    seen = {g: raw.where((F.col("group") == g) & F.col("fold").isNotNull()) for g in here}
    each = [(g, f) for g, of in here.items() for f in of]
    fits = dict(zip(each, side_by_side(spark, [partial(fit_platt, seen[g].where(F.col("fold") != f), "_raw", "_y") for g, f in each]), strict=True))
    calibrated = {g: F.coalesce(*[F.when(F.col("fold") == f, platt(fits[g, f], F.col("_raw"))) for f in of]) for g, of in here.items()}
    new = [g for g in here if None in facts[g]]
    for g, last in zip(new, side_by_side(spark, [partial(fit_platt, seen[g].select("_y", calibrated[g].alias("_raw")), "_raw", "_y") for g in new]), strict=True):
        calibrated[g] = F.when(F.col("fold").isNull(), platt(last, F.col("_raw"))).otherwise(calibrated[g])
    for g, c in calibrated.items():
        chance = F.when(F.col("group") == g, c).otherwise(chance)
    return raw.withColumn("xpass_prob", kept(chance)).select(*keep, "xpass_prob")


def random_search(rows: DataFrame, y: str, folds: Sequence[int], trials: int = 5, seed: int = 42) -> list[dict]:
    """Seeded draws of depth, rounds and rate, each scored out of fold; best first."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(trials):
        how = {"depth": int(rng.integers(2, 6)), "rounds": int(rng.integers(5, 25)), "rate": float(np.exp(rng.uniform(np.log(0.03), np.log(0.3))))}
        scored = out_of_fold(rows, regressor(y, "_p", **how), folds).agg(weighted_rmse(F.col(y), F.col("_p"), F.lit(1.0)).alias("e")).first()["e"]
        out.append(how | {"wrmse": float(scored)})
    return sorted(out, key=lambda r: r["wrmse"])


def monotone_violations(scored: DataFrame, feature: str, prediction: str, buckets: int = 20) -> DataFrame:
    """bucket of the feature, its mean prediction, and whether it is below the bucket before: at most `buckets` rows matter."""
    from pyspark.sql import Window

    edges = percentiles(scored, feature, [i / buckets for i in range(1, buckets)]).select(F.col("q").alias("_e"))
    placed = scored.crossJoin(F.broadcast(edges)).withColumn("bucket", F.size(F.filter("_e", lambda e: e < F.col(feature))))  # one row of edges
    means = placed.groupBy("bucket").agg(F.avg(prediction).alias("mean_pred"))
    return means.withColumn("falls", F.coalesce(F.col("mean_pred") < F.lag("mean_pred").over(Window.orderBy("bucket")), F.lit(False)))


def importance_table(importances: Sequence[tuple[int, str, float]], spark) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in importances], "fold int, feature string, gain double")


def importance_summary(rows: DataFrame, k: int) -> DataFrame:
    """The k features of the largest mean gain, with its spread over folds."""
    return rows.groupBy("feature").agg(F.avg("gain").alias("mean_gain"), F.coalesce(F.stddev_samp("gain"), F.lit(0.0)).alias("std_gain")).orderBy(F.desc("mean_gain"), "feature").limit(k)
