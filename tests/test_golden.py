"""Hand-sized cases for rules that are easy to get wrong."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from fieldloom.functions import columns as C
from fieldloom.models import evaluation
from fieldloom.operators import blocks, encoding, tabular, windows
from fieldloom.operators.sequence import one_direction, with_neighbours
from fieldloom.operators.value import zone
from fieldloom.plans.fusion import credit, run

SCHEMA = "action_id long, match_id string, player_id long, team_id long, period_id int, time_seconds double, type_name string, result_name string, start_x double, start_y double, end_x double, end_y double, is_home boolean, minutes_played long, bodypart_name string, xt_learned_delta double"


def play(spark, *rows):
    base = {"match_id": "m", "player_id": 1, "team_id": 1, "period_id": 1, "type_name": "pass", "result_name": "success", "start_x": 50.0, "start_y": 30.0, "end_x": 60.0, "end_y": 30.0, "is_home": True, "minutes_played": 90, "bodypart_name": "head", "xt_learned_delta": 0.0}
    names = [c.strip().split()[0] for c in SCHEMA.split(",")]
    out = [base | {"action_id": i, "time_seconds": float(i)} | r for i, r in enumerate(rows)]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in out], SCHEMA)


def one(df):
    return df.collect()[0].asDict()


def test_last_action_has_no_chain(spark):
    assert one(run(play(spark, {}), blocks.nstep_chain()))["nstep_to_shot"] == 0.0


def test_team_change_breaks_the_chain_but_not_pass_to_shot(spark):
    a = play(spark, {}, {"type_name": "shot", "team_id": 2, "player_id": 2})
    got = {r["player_id"]: r["nstep_to_shot"] for r in run(a, blocks.nstep_chain()).collect()}
    assert got[1] == 0.0
    assert one(run(a, blocks.pass_to_shot()))["pass_leads_to_shot"] == 1


def test_shot_is_credited_to_the_earlier_player(spark):
    a = with_neighbours(play(spark, {}, {"type_name": "shot", "player_id": 2}), before=2)
    assert one(credit(a, blocks.shot_creation(1), "player_p1", "sca1")) == {"match_id": "m", "player_id": 1, "sca1": 1}


def test_discount(spark):
    a = play(spark, {"player_id": 1}, {"player_id": 2, "type_name": "carry"}, {"player_id": 3, "type_name": "shot"})
    got = {r["player_id"]: round(r["nstep_to_shot"], 9) for r in run(a, blocks.nstep_chain(3, 0.7)).collect()}
    assert got == {1: 0.7, 2: 1.0, 3: 0.0}


def test_single_action_has_no_spread(spark):
    got = one(run(windows.with_own_previous(play(spark, {})), blocks.dynamic_position()))
    assert got["position_variance_x"] == 0 and got["position_range_y"] == 0 and got["avg_action_distance"] == 0


def test_thirds_and_grid_edges(spark):
    xs = spark.createDataFrame([(0.0,), (35.0,), (70.0,), (105.0,), (106.0,)], "x double")
    assert [r[0] for r in xs.select(C.third_code("x")).collect()] == [0, 0, 1, 2, None]
    gs = spark.createDataFrame([(0.0,), (6.5625,), (105.0,), (-1.0,)], "x double")
    assert [r[0] for r in gs.select(C.grid_index("x", 105.0, 16)).collect()] == [0, 1, 15, 0]


def test_null_zone(spark):
    df = spark.createDataFrame([(None, 10.0)], "x double, y double")
    assert one(df.select(zone("x", "y").alias("a"), zone("x", "y", 0.0).alias("b")))["a"] is None


def test_missing_previous_team_is_a_turnover(spark):
    got = one(run(play(spark, {"team_id": None}), blocks.attack_tempo()))
    assert got["quick_transition_rate"] == 0.0


def test_possessions(spark):
    a = play(spark, {"time_seconds": 0.0}, {"time_seconds": 15.0}, {"time_seconds": 30.1}, {"time_seconds": 31.0, "result_name": "fail"}, {"time_seconds": 32.0}, {"time_seconds": 33.0, "team_id": 2})
    assert [r["possession_no"] for r in windows.with_possessions(a).orderBy("action_id").collect()] == [1, 1, 2, 2, 3, 4]


def test_period_before_clock(spark):
    a = play(spark, {"time_seconds": 10.0, "type_name": "shot"}, {"time_seconds": 5.0, "period_id": 2, "player_id": 2})
    got = {r["action_id"]: r["type_p1"] for r in with_neighbours(a, before=1).collect()}
    assert got == {0: None, 1: "shot"}


def test_flip(spark):
    a = one_direction(play(spark, {"is_home": False}, {"is_home": None}))
    assert [r["start_x"] for r in a.orderBy("action_id").collect()] == [55.0, 50.0]


def test_snap(spark):
    v = [0.08, 0.12, 0.13, 0.18, 0.22, 0.28, 0.32]
    df = spark.createDataFrame([(x,) for x in v], "x double")
    got = [round(r[0], 6) for r in df.select(C.snap(F.col("x"))).collect()]
    for given, new in zip(v, got, strict=True):
        assert new == given or abs(new - given) <= 0.02 + 1e-9
    assert got[2] == 0.13 and got[1] in (0.1, 0.12)


def test_weights_and_error(spark):
    df = spark.createDataFrame([(0.0999,), (0.1,)], "y double")
    assert [r[0] for r in df.select(evaluation.step_weight(F.col("y"))).collect()] == [1.0, 5.0]
    assert math.isclose(df.agg(evaluation.weighted_rmse(F.col("y"), F.col("y"), F.lit(1.0))).first()[0], math.sqrt(1e-9))
    with pytest.raises(ValueError):
        evaluation.sample_weight(F.col("y"), "other")


def test_encoding_of_an_unseen_key_is_the_mean(spark):
    rows = spark.createDataFrame([("a", 1, 0.2), ("b", 2, 0.4)], "k string, fold int, xag double")
    got = {r["k"]: r["k_target_enc"] for r in encoding.target_encoding(rows, "k").collect()}
    assert all(math.isclose(v, 0.3) for v in got.values())


def test_trend_stays_with_its_player(spark):
    rows = spark.createDataFrame([("d1", 1, 1.0, 1), ("d2", 1, 2.0, 1), ("d3", 1, 4.0, 1), ("d1", 2, 9.0, 1), ("d4", 1, 8.0, 5), ("d4", 3, 1.0, 5)], "match_id string, player_id long, xag double, fold int")
    got = {(r["player_id"], r["match_id"]): (r["xag_expanding_mean"], r["xag_rolling3_mean"], r["xag_diff_prev"]) for r in windows.player_trend(rows, F.col("fold") <= 4).collect()}
    assert got[1, "d1"] == (0, 0, 0) and got[1, "d3"] == (1.5, 1.5, 2.0) and got[2, "d1"] == (0, 0, 0)
    assert got[1, "d4"][0] == pytest.approx(7 / 3) and got[1, "d4"][2] == 4.0 and got[3, "d4"] == (0, 0, 0)


def test_ratio_and_clamp(spark):
    df = spark.createDataFrame([(1.0, 0.0), (None, 2.0), (3.0, 2.0)], "n double, d double")
    assert [r[0] for r in df.select(C.ratio(F.col("n"), F.col("d"))).collect()] == [0.0, 0.0, 1.5]
    assert [r[0] for r in df.select(C.clamp(F.col("n"), 2.0)).collect()] == [2.0, None, 3.0]


def test_passengers(spark):
    rows = spark.createDataFrame([(1, "Doe, Mlle. A", None, 10.0, "S", 1, 0), (2, "Doe, Ms. B", 12.0, None, None, 0, 0), (3, "Doe", 101.0, 30.0, "S", 0, 2)], "PassengerId int, Name string, Age double, Fare double, Embarked string, SibSp int, Parch int")
    got = {r["PassengerId"]: r for r in tabular.prepare_passengers(rows).collect()}
    assert [got[i]["Title"] for i in (1, 2, 3)] == ["Miss", "Mrs", "Rare"]
    assert got[1]["Age"] == 56.5 and got[2]["AgeBand"] == "Child" and got[3]["AgeBand"] is None
    assert got[2]["Embarked"] == "S" and got[2]["IsAlone"] == 1 and got[3]["FamilySize"] == 3


def test_nan_to_null(spark):
    df = C.nan_to_null(spark.createDataFrame([(float("nan"),), (1.0,)], "x double"))
    assert [r[0] for r in df.collect()] == [None, 1.0]
