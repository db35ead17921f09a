"""One experiment from files to predictions, folds by match, sinks: run_experiment with the fused blocks and Spark's trees, run_chain with
all features, three learners and their stack, its tables kept between runs."""

from __future__ import annotations

from datetime import UTC, datetime
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions.columns import nan_to_null, snap
from fieldloom.models import boosting, evaluation, trees
from fieldloom.operators import blocks
from fieldloom.operators.sequence import KEY, one_direction, relevant
from fieldloom.operators.tabular import age_years, union_tables
from fieldloom.plans import full
from fieldloom.plans.fusion import enrich, fuse
from fieldloom.sources import tables
from fieldloom.sources.experiments import LEDGER, Settings, experiment_log, git_revision, manifest
from fieldloom.sources.stages import Stages

TARGET = "xAG"


def feature_blocks(kinds: tuple[str, ...]) -> list:
    return [
        blocks.nstep_chain(value=False), blocks.second_assist(), blocks.pass_geometry(), blocks.pass_latency(), blocks.time_blocks(), blocks.zone_density(), blocks.zone_thirds(), blocks.basic_stats(), blocks.goal_count(), blocks.type_pivot(kinds),
        blocks.success_rates(), blocks.attack_defence(), blocks.pass_to_shot(), blocks.progressive_pass(), blocks.progressive_carry(), blocks.gca_spatial(), blocks.linebreak_packing(), blocks.chain_quality(), blocks.box_entry(), blocks.setplay_share(), blocks.vision(),
    ]


def build_features(actions: DataFrame, rows: DataFrame, kinds: tuple[str, ...]) -> tuple[DataFrame, list[str]]:
    """rows with age and all features, and the features' names. An empty overlap of actions and rows is an error."""
    kept = one_direction(relevant(actions, rows))
    if kept.isEmpty():
        raise ValueError("no action belongs to a target row")
    wide = enrich(rows.withColumn("age", F.coalesce(age_years(F.col("Date"), F.col("birth_date")), F.lit(0.0))), fuse(kept, feature_blocks(kinds)))
    names = [c for c, t in wide.dtypes if c not in rows.columns and t in ("double", "bigint", "int")]
    return wide, names


def run_experiment(spark: SparkSession, settings: Settings, out: str, exp_id: str = "exp0001") -> dict:
    """Writes oof and submission tables (CSV), metrics.json and a ledger line below `out`; returns the metrics."""
    paths = settings.paths()
    if gone := tables.missing_files(list(paths.values())):
        raise FileNotFoundError(", ".join(gone))
    Path(out).mkdir(parents=True, exist_ok=True)
    log = experiment_log(str(Path(out) / "training.log"))
    actions = nan_to_null(tables.read_csv(spark, paths["actions"], tables.ACTIONS))
    train, test = (nan_to_null(tables.read_csv(spark, paths[k], tables.TARGETS)) for k in ("train", "test"))
    wide, names = build_features(actions, union_tables(train, test), settings.kinds)
    tables.write_parquet(wide, f"{out}/features", "overwrite")
    wide = trees.with_vector(tables.read_parquet(spark, f"{out}/features").withColumn("w", evaluation.step_weight(F.col(TARGET), settings.threshold, settings.pos_weight)), names)
    log.info("%d features", len(names))
    known = wide.where("is_train")
    known = known.join(evaluation.group_folds(known, splits=settings.folds), "match_id")
    folds = list(range(1, settings.folds + 1))
    how = trees.regressor(TARGET, "oof_pred", "w", settings.rounds, settings.depth, settings.rate, settings.seed)
    tables.write_csv(trees.out_of_fold(known, how, folds).select(*KEY, TARGET, "fold", "w", "oof_pred"), f"{out}/oof", "overwrite")
    oof = spark.read.option("header", True).schema(f"match_id string, player_id string, {TARGET} double, fold int, w double, oof_pred double").csv(f"{out}/oof")
    error = evaluation.weighted_rmse(F.col(TARGET), F.col("oof_pred"), F.col("w"))
    by_fold = {r["fold"]: r["e"] for r in oof.groupBy("fold").agg(error.alias("e")).collect()}  # one row a fold
    new = wide.where(~F.col("is_train"))
    parts = [trees.regressor(TARGET, f"p{f}", "w", settings.rounds, settings.depth, settings.rate, settings.seed)(known.where(F.col("fold") != f)) for f in folds]
    scored = reduce(lambda df, apply: apply(df), parts, new)
    mean = sum((F.col(f"p{f}") for f in folds), F.lit(0.0)) / len(folds)
    tables.write_csv(scored.select(*KEY, snap(F.greatest(mean, F.lit(0.0))).alias(TARGET)), f"{out}/submission", "overwrite")
    metrics = _metrics(by_fold, oof.agg(error).first()[0], len(names))
    _record(settings, out, exp_id, metrics, names, tables.read_parquet(spark, f"{out}/features"))
    log.info("out of fold %.4f", metrics["oof"])
    return metrics


def _metrics(by_fold: dict[int, float], all_rows: float, features: int) -> dict:
    m = sum(by_fold.values()) / len(by_fold)
    return {"cv_mean": m, "cv_std": (sum((e - m) ** 2 for e in by_fold.values()) / len(by_fold)) ** 0.5, "oof": all_rows, "features": features, "folds": by_fold}


def _record(settings: Settings, out: str, exp_id: str, metrics: dict, names: list[str], features: DataFrame) -> None:
    """metrics.json, the features' names and facts, and a ledger line below `out`."""
    tables.write_json(manifest(exp_id, settings, metrics), f"{out}/metrics.json")
    tables.write_names(names, f"{out}/features.txt")
    line = {"exp_id": exp_id, "date": datetime.now(UTC).date().isoformat(), "git_sha": git_revision(), "cv_metric": "wrmse", "cv_mean": metrics["cv_mean"], "cv_std": metrics["cv_std"], "seed": settings.seed, "n_splits": settings.folds, "cv_method": "group_kfold", "notes": settings.notes}
    line |= {"split_id": tables.split_id("group_kfold", settings.folds, settings.seed), "data_rev": tables.fingerprint(features).first()["fingerprint"]}
    tables.append_ledger(line, f"{out}/ledger.csv", LEDGER)
    tables.write_json(tables.feature_info(features.select(*names)), f"{out}/feature_info.json")


# ---- the whole chain ----


def _numbered(df: DataFrame, *ids: str) -> DataFrame:
    """df with names as numbers, by a hash of 64 bits: what graphs and encodings compare."""
    return df.withColumns({c: F.when(F.col(c).isNotNull(), F.xxhash64(c)) for c in ids})


def _chain_rows(train: str, test: str, spark: SparkSession, folds: int, seed: int) -> DataFrame:
    """Training rows with a fold by match, and new rows without one; name is the player's own."""
    read = lambda path: nan_to_null(tables.read_csv(spark, path, tables.TARGETS))
    rows = union_tables(read(train), read(test)).withColumn("age", F.coalesce(age_years(F.col("Date"), F.col("birth_date")), F.lit(0.0)))
    rows = _numbered(rows.withColumn("name", F.col("player_id")), "player_id").withColumnsRenamed({"Squad": "squad", "Opponent": "opponent", "Comp": "comp"})
    dealt = evaluation.group_folds(rows.where("is_train"), splits=folds, seed=seed)
    known = rows.where("is_train").join(dealt, "match_id")
    return known.unionByName(rows.where(~F.col("is_train")).withColumns({"fold": F.lit(None).cast("int"), TARGET: F.lit(None).cast("double")}))


def run_chain(spark: SparkSession, settings: Settings, out: str, exp_id: str = "exp0001", kept: str | None = None, groups: tuple[str, ...] = ("pass", "cross", "carry")) -> dict:
    """As run_experiment, with all features of plans.full and its learners, stack and calibration. The tables rows, features and
    predictions are kept below `kept` (a shared folder; else out/stages): a run that was stopped, or whose model alone changed, begins
    where it must. groups: the groups of actions that expected value is taken of."""
    paths = settings.paths()
    if gone := tables.missing_files(list(paths.values())):
        raise FileNotFoundError(", ".join(gone))
    Path(out).mkdir(parents=True, exist_ok=True)
    log = experiment_log(str(Path(out) / "training.log"))
    stages, folds = Stages(spark, kept or f"{out}/stages"), list(range(1, settings.folds + 1))

    def features(path: str, rows: DataFrame, kinds: tuple[str, ...], groups: tuple[str, ...], folds: list[int]) -> DataFrame:
        actions = _numbered(nan_to_null(tables.read_csv(spark, path, tables.ACTIONS)), "player_id", "team_id")
        if relevant(actions, rows).isEmpty():
            raise ValueError("no action belongs to a target row")
        return full.all_features(actions, rows, kinds, groups, folds, TARGET, "Date")[0]

    def predictions(wide: DataFrame, folds: list[int], threshold: float, heavy: float, **how: float) -> DataFrame:
        return full.predict(wide, names, folds, TARGET, boosting.How(**how), threshold, heavy)

    rows = stages.keep("rows", lambda train, test, folds, seed: _chain_rows(train, test, spark, folds, seed), paths["train"], paths["test"], folds=settings.folds, seed=settings.seed)
    wide = stages.keep("features", features, paths["actions"], rows, kinds=settings.kinds, groups=groups, folds=folds)
    names = full.feature_names(wide.table, [c for c in rows.table.columns if c != "age"])
    log.info("%d features", len(names))
    done = stages.keep("predictions", predictions, wide, folds=folds, threshold=settings.threshold, heavy=settings.pos_weight, rounds=settings.rounds, depth=settings.depth, rate=settings.rate, seed=settings.seed, patience=6)
    log.info("tables kept from before: %s", ", ".join(s.name for s in (rows, wide, done) if s.reused) or "none")
    named = rows.table.select(F.col("player_id").alias("number"), "name").distinct()
    scored = done.table.join(named, F.col("player_id").eqNullSafe(F.col("number"))).withColumn("player_id", F.col("name"))
    oof = scored.where("fold is not null").withColumn("w", evaluation.step_weight(F.col(TARGET), settings.threshold, settings.pos_weight))
    tables.write_csv(oof.select(*KEY, TARGET, "fold", "w", F.col("prediction").alias("oof_pred")), f"{out}/oof", "overwrite")
    tables.write_csv(scored.where("fold is null").select(*KEY, F.col("prediction").alias(TARGET)), f"{out}/submission", "overwrite")
    error = evaluation.weighted_rmse(F.col(TARGET), F.col("prediction"), F.col("w"))
    by_fold = {r["fold"]: r["e"] for r in oof.groupBy("fold").agg(error.alias("e")).collect()}  # one row a fold
    metrics = _metrics(by_fold, oof.agg(error).first()[0], len(names))
    _record(settings, out, exp_id, metrics, names, wide.table)
    log.info("out of fold %.4f", metrics["oof"])
    return metrics
