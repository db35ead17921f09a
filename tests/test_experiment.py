from __future__ import annotations

import json
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from fieldloom.plans.catalog import actions, goals
from fieldloom.plans.experiment import run_chain, run_experiment
from fieldloom.sources import tables
from fieldloom.sources.experiments import Settings, load_settings, missing_parts, next_experiment


def _files(spark, small, tmp_path, **settings) -> tuple:
    """The settings and the target rows, after the files are written."""
    a = actions(spark, small)
    a.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in tables.ACTIONS]).coalesce(1).write.option("header", True).csv(str(tmp_path / "action_data.csv"))
    rows = goals(spark, small).select(F.col("match_id"), F.col("player_id").cast("string").alias("player_id"), F.col("match_id").alias("Date"), F.lit("2000-01-01").alias("birth_date"), F.concat(F.lit("League No. "), F.col("comp")).alias("Comp"), F.concat(F.lit("s "), F.col("squad")).alias("Squad"), F.concat(F.lit("s "), F.col("opponent")).alias("Opponent"), F.lit("h").alias("Venue"), F.col("xag").alias("xAG"), "fold")
    rows.where("fold <= 4").drop("fold").coalesce(1).write.option("header", True).csv(str(tmp_path / "match_train_data.csv"))
    rows.where("fold = 5").drop("fold").withColumn("xAG", F.lit(None).cast("double")).coalesce(1).write.option("header", True).csv(str(tmp_path / "match_test_data.csv"))
    (tmp_path / "settings.json").write_text(json.dumps({"data_dir": ".", "folds": 2, "rounds": 2, "depth": 2, **settings}))
    return load_settings(str(tmp_path / "settings.json")), rows


def test_from_files_to_predictions(spark, small, tmp_path):
    settings, rows = _files(spark, small, tmp_path, other=1)
    assert settings.extra == {"other": 1} and settings.paths()["train"].startswith(str(tmp_path))
    out = str(tmp_path / "exp0001")
    metrics = run_experiment(spark, settings, out)
    assert 0 < metrics["oof"] < 1 and metrics["features"] > 60 and set(metrics["folds"]) == {1, 2}
    assert spark.read.option("header", True).csv(f"{out}/submission").count() == rows.where("fold = 5").count()
    assert spark.read.option("header", True).csv(f"{out}/oof").count() == rows.where("fold <= 4").count()
    assert missing_parts(out) == [] and next_experiment(str(tmp_path)) == "exp0002"
    assert len((tmp_path / "exp0001" / "ledger.csv").read_text().splitlines()) == 2


def test_the_whole_chain_goes_on_where_it_must(spark, small, tmp_path):
    settings, rows = _files(spark, small, tmp_path)
    out, other = str(tmp_path / "exp0001"), str(tmp_path / "exp0002")
    metrics = run_chain(spark, settings, out, kept=str(tmp_path / "kept"))
    assert 0 < metrics["oof"] < 1 and metrics["features"] > 250 and set(metrics["folds"]) == {1, 2}
    read = lambda path: spark.read.option("header", True).csv(path)
    at = ["match_id", "player_id"]
    new, known = rows.where("fold = 5").select(*at), rows.where("fold <= 4").select(*at)
    assert sorted(read(f"{out}/submission").select(*at).collect()) == sorted(new.collect()) and sorted(read(f"{out}/oof").select(*at).collect()) == sorted(known.collect())
    begun = {p.name for p in (tmp_path / "kept").iterdir()}
    again = run_chain(spark, replace(settings, notes="again"), other, "exp0002", kept=str(tmp_path / "kept"))
    assert len(begun) == 3 and {p.name for p in (tmp_path / "kept").iterdir()} == begun
    assert again["features"] == metrics["features"] and again["oof"] == pytest.approx(metrics["oof"])


def test_missing_files(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        run_experiment(spark, Settings(data_dir=str(tmp_path)), str(tmp_path / "o"))
