"""The registered queries of the feature engine: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions.columns import rounded, select_columns, snap
from fieldloom.models import blending, boosting, evaluation, search, trees
from fieldloom.operators import blocks, encoding, expected, network, tabular, value, windows
from fieldloom.operators.sequence import KEY, one_direction, relevant, with_neighbours
from fieldloom.plans import full
from fieldloom.plans.fusion import Block, credit, enrich, fuse, run
from fieldloom.sources.staging import staged
from fieldloom.sources.tables import actions, fingerprint, profile, targets

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
FOLDS = (1, 2, 3, 4, 5)
KINDS = ("pass", "cross", "carry", "shot")
LEAGUES = (0, 1, 2)
#: Results whose exact values end in a five at the seventh place are rounded further down.
NINE_DIGITS = {"feature_table", "nstep_chain", "extended_chain", "xpass_risk", "possession_table", "possession_player", "heuristic_xt", "fold_balance", "calibration_deciles", "prediction_summary", "blend_gram", "player_features", "league_gate_values"}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    digits = 9 if f.__name__ in NINE_DIGITS else 6
    QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir), digits)
    return f


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actions of the target players, all attacking the same way."""
    a = actions(spark, sf_dir)
    return one_direction(relevant(a, targets(a)))


def dense(a: DataFrame) -> DataFrame:
    """Actions that follow each other within seconds, as in a match, so that limits in seconds tell them apart."""
    return a.withColumn("time_seconds", F.col("time_seconds") / F.lit(20.0))


def valued(spark: SparkSession, sf_dir: str) -> DataFrame:
    """prepared() with values from the fixed grid under the names of learned ones, and a made-up success probability."""
    a = value.with_heuristic_value(prepared(spark, sf_dir))
    done = F.col("result_name") == "success"
    delta = F.when(done, F.col("xt_end")).otherwise(0.0) - F.col("xt_start")
    a = a.withColumns({"xt_learned_start": F.col("xt_start"), "xt_learned_end": F.col("xt_end"), "xt_learned_delta": delta, "xt_learned_positive_delta": F.greatest(delta, F.lit(0.0)), "xt_learned_delta_on_success": F.when(done, delta)})
    return a.withColumn("xpass_prob", (F.pmod(F.col("action_id") * 13, F.lit(97)) + 1).cast("double") / 99.0)


def misplaced(a: DataFrame) -> DataFrame:
    """Actions some of which have no place, or one off the pitch."""
    i = F.col("action_id")
    return a.withColumns({"start_x": F.when(i % 7 == 0, None).when(i % 13 == 0, F.col("start_x") - 40.0).otherwise(F.col("start_x")), "end_x": F.when(i % 17 == 0, None).when(i % 11 == 0, F.col("end_x") + 60.0).otherwise(F.col("end_x"))})


def goals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return targets(actions(spark, sf_dir))


def _block(name: str, make: Callable[[], Block], source):
    return lambda spark, sf_dir: rounded(run(source(spark, sf_dir), make()), 9 if name in NINE_DIGITS else 6)


for _name, _make, _source in (
    ("nstep_chain", blocks.nstep_chain, valued),
    ("extended_chain", lambda: blocks.nstep_chain(7, 0.6, "longchain"), valued),
    ("second_assist", blocks.second_assist, prepared),
    ("pass_geometry", blocks.pass_geometry, prepared),
    ("pass_latency", blocks.pass_latency, prepared),
    ("xpass_risk", blocks.pass_risk, valued),
    ("time_blocks", blocks.time_blocks, prepared),
    ("zone_density", blocks.zone_density, prepared),
    ("zone_thirds", blocks.zone_thirds, prepared),
    ("basic_stats", blocks.basic_stats, prepared),
    ("goal_count", blocks.goal_count, prepared),
    ("type_pivot", lambda: blocks.type_pivot(KINDS), prepared),
    ("success_rates", blocks.success_rates, prepared),
    ("attack_defence", blocks.attack_defence, prepared),
    ("pass_to_shot", blocks.pass_to_shot, prepared),
    ("progressive_pass", blocks.progressive_pass, prepared),
    ("progressive_carry", blocks.progressive_carry, prepared),
    ("gca_spatial", blocks.gca_spatial, prepared),
    ("linebreak_packing", blocks.linebreak_packing, prepared),
    ("linebreak_missing_zones", blocks.linebreak_packing, lambda spark, sf_dir: misplaced(prepared(spark, sf_dir))),
    ("chain_quality", blocks.chain_quality, lambda spark, sf_dir: dense(prepared(spark, sf_dir))),
    ("box_entry", blocks.box_entry, lambda spark, sf_dir: dense(prepared(spark, sf_dir))),
    ("setplay_share", blocks.setplay_share, prepared),
    ("bodypart_pivot", blocks.bodypart_pivot, prepared),
    ("attack_tempo", blocks.attack_tempo, prepared),
    ("vision", blocks.vision, prepared),
    ("box_receiver_volume", blocks.box_receiver_volume, prepared),
    ("box_receiver_timing", blocks.box_receiver_timing, prepared),
    ("box_receiver_angles", blocks.box_receiver_angles, prepared),
    ("box_receiver_origin", blocks.box_receiver_origin, prepared),
    ("final_third_receive", blocks.final_third_receive, prepared),
):
    QUERIES[_name] = _block(_name, _make, _source)


# ---- actions ----


@query
def semi_join_actions(spark, sf_dir):
    a = actions(spark, sf_dir)
    return relevant(a, targets(a)).select("action_id", "match_id", "player_id")


@query
def flip_coords(spark, sf_dir):
    return prepared(spark, sf_dir).select("action_id", "start_x", "start_y", "end_x", "end_y")


@query
def feature_table(spark, sf_dir):
    """Twenty blocks in one pass, beside their targets."""
    return enrich(goals(spark, sf_dir), fuse(valued(spark, sf_dir), full.fused_blocks(KINDS)))


@query
def player_features(spark, sf_dir):
    """All features that come from the actions alone but the path measures of networks, beside their targets."""
    wide = goals(spark, sf_dir)
    for part in full.own_features(staged(valued(spark, sf_dir), "actions"), KINDS):
        wide = enrich(wide, part)
    return wide.withColumn("pass_tempo_variance", F.round("pass_tempo_variance", 6))  # its exact values end in a five at the tenth place


@query
def age_days(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    day, born = F.lit("2000-01-01").cast("date"), F.col("o_orderdate").cast("date")
    return o.select("o_orderkey", F.datediff(day, born).cast("long").alias("days"), tabular.age_years(day, born).alias("years"))


@query
def per_minute(spark, sf_dir):
    f = fuse(prepared(spark, sf_dir), [blocks.basic_stats(), blocks.goal_count(), blocks.type_pivot(KINDS)])
    names = ("action_count", "goal_count", *[f"type_{k}_count" for k in KINDS])
    return f.withColumns(blocks.per_minute(names)).select(*KEY, *[f"{n}_per_minute" for n in names])


def _credited(k: int, goals_only: bool, name: str):
    def f(spark, sf_dir):
        a = with_neighbours(prepared(spark, sf_dir), before=2)
        return credit(a, blocks.shot_creation(k, goals_only), f"player_p{k}", name)

    QUERIES[name] = f


for _k in (1, 2):
    _credited(_k, False, f"sca{_k}")
    _credited(_k, True, f"gca{_k}")


# ---- windows ----


@query
def dynamic_position(spark, sf_dir):
    return run(windows.with_own_previous(prepared(spark, sf_dir)), blocks.dynamic_position())


@query
def pass_tempo(spark, sf_dir):
    return run(windows.with_pass_gaps(prepared(spark, sf_dir)), blocks.pass_tempo())


@query
def possession_table(spark, sf_dir):
    return windows.possession_table(windows.with_possessions(dense(valued(spark, sf_dir)))).withColumn("final_third_step", F.coalesce(F.col("final_third_step").cast("long"), F.lit(-1).cast("long")))


@query
def possession_player(spark, sf_dir):
    return windows.possession_player(windows.with_possessions(dense(valued(spark, sf_dir))))


@query
def player_trend(spark, sf_dir):
    return windows.player_trend(goals(spark, sf_dir), F.col("fold") <= 4).select(*KEY, "xag_expanding_mean", "xag_rolling3_mean", "xag_diff_prev")


@query
def team_context(spark, sf_dir):
    return windows.team_context(goals(spark, sf_dir), ["xag"]).select(*KEY, "xag_team_sum", "xag_team_share", "xag_team_lopo")


# ---- value of places ----


@query
def heuristic_xt(spark, sf_dir):
    return run(value.with_heuristic_value(prepared(spark, sf_dir)), blocks.heuristic_value())


@query
def xt_transition_counts(spark, sf_dir):
    return value.transition_counts(prepared(spark, sf_dir)).fillna(-1, subset=["end_zone"])


@query
def xt_values(spark, sf_dir):
    v = value.solve_values(value.transition_counts(prepared(spark, sf_dir)))
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "zone int, value double")


@query
def xt_player(spark, sf_dir):
    a = prepared(spark, sf_dir)
    train = a.where(F.substring("match_id", 9, 2).cast("int") % 5 + 1 <= 4)
    return value.value_player(value.with_learned_value(a, value.solve_values(value.transition_counts(train))))


# ---- networks ----


@query
def pass_degree(spark, sf_dir):
    return network.degrees(network.weighted_edges(network.passer_chain(prepared(spark, sf_dir))))


@query
def pass_entropy(spark, sf_dir):
    return network.diversity(network.passer_chain(prepared(spark, sf_dir)))


@query
def pass_betweenness(spark, sf_dir):
    edges = network.weighted_edges(network.passer_chain(prepared(spark, sf_dir)))
    return network.hop_centrality(edges)


@query
def passnet_edges(spark, sf_dir):
    return network.weighted_edges(network.received_passes(with_neighbours(prepared(spark, sf_dir), 1)))


@query
def passnet_centrality(spark, sf_dir):
    return network.centrality(network.weighted_edges(network.received_passes(with_neighbours(prepared(spark, sf_dir), 1))))


@query
def passnet_receive(spark, sf_dir):
    return network.receive_counts(network.received_passes(with_neighbours(prepared(spark, sf_dir), 1)))


@query
def passnet_attempts(spark, sf_dir):
    return network.pass_lengths(prepared(spark, sf_dir))


@query
def box_receiver_diversity(spark, sf_dir):
    return network.diversity(network.box_receivers(with_neighbours(prepared(spark, sf_dir), 1)), names=("box_receiver_diversity", "unique_box_receivers"))


# ---- expected value ----


def _components(spark, sf_dir) -> DataFrame:
    a = expected.with_components(valued(spark, sf_dir))
    return a.withColumn("fold", F.substring("match_id", 9, 2).cast("int") % 5 + 1)


@query
def edxt_components(spark, sf_dir):
    a = _components(spark, sf_dir)
    return expected.component_sums(expected.with_scaled_failure(a, expected.fold_moments(a)))


@query
def edxt_fold_norm(spark, sf_dir):
    a = _components(spark, sf_dir)
    return expected.fold_moments(a).where("fold is not null").join(expected.fold_medians(a, list(FOLDS)), ["group", "fold"])


@query
def quantile_center(spark, sf_dir):
    a = _components(spark, sf_dir).where(F.col("group") == "pass")
    return encoding.empirical_position(a, "start_x", F.col("fold") <= 4).select("action_id", "centred")


def _penalties(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    a = _components(spark, sf_dir)
    a = staged(expected.with_scaled_failure(a, expected.fold_moments(a)), "components")  # for the statistics and for the features
    return a, expected.penalty_statistics(expected.component_sums(a), goals(spark, sf_dir), evaluation.step_weight(F.col("xag")))


@query
def lambda_stats(spark, sf_dir):
    return _penalties(spark, sf_dir)[1]


@query
def edxt_features(spark, sf_dir):
    a, stats = _penalties(spark, sf_dir)
    found: dict[str, list] = {}
    for r in stats.collect():  # groups times folds rows
        found.setdefault(r["group"], []).append(r)
    return expected.expected_features(a, {g: expected.best_penalty(found[g], *expected.PENALTY_BOUNDS[g]) for g in sorted(found)})


# ---- encodings ----


@query
def target_encoding_oof(spark, sf_dir):
    return encoding.target_encoding(goals(spark, sf_dir), "player_id")


@query
def target_encoding_cross(spark, sf_dir):
    rows = goals(spark, sf_dir).withColumn("matchup", encoding.crossed_key("squad", "opponent"))
    return encoding.target_encoding(rows, "matchup")


@query
def comp_residuals(spark, sf_dir):
    return encoding.league_residuals(goals(spark, sf_dir))


@query
def comp_residuals_missing(spark, sf_dir):
    """Rows without a squad, opponent or league, and new rows without a fold: all stay."""
    gone = lambda c, m: F.when(F.col("player_id") % m == 0, None).otherwise(F.col(c))
    return encoding.league_residuals(_with_new_rows(spark, sf_dir).withColumns({"squad": gone("squad", 7), "opponent": gone("opponent", 11), "comp": gone("comp", 13)}))


@query
def quantile_center_missing(spark, sf_dir):
    """Values that are missing stay, without a position."""
    a = misplaced(_components(spark, sf_dir).where(F.col("group") == "pass"))
    return encoding.empirical_position(a, "start_x", F.col("fold") <= 4).select("action_id", "centred")


@query
def league_gate_values(spark, sf_dir):
    """Learned values and possessions crossed with the league."""
    wide = enrich(enrich(goals(spark, sf_dir), xt_player(spark, sf_dir)), possession_player(spark, sf_dir))
    return encoding.category_crosses(wide, list(full.OF_LEAGUE), "comp", list(LEAGUES)).select(*KEY, *[f"{c}__comp_gate_{v}" for c in full.OF_LEAGUE for v in LEAGUES])


@query
def league_gate(spark, sf_dir):
    rows = encoding.one_hot(goals(spark, sf_dir), "comp", list(LEAGUES))
    return encoding.category_crosses(rows, ["xag"], "comp", list(LEAGUES)).select(*KEY, *[f"comp_{v}" for v in LEAGUES], *[f"xag__comp_gate_{v}" for v in LEAGUES])


# ---- folds, weights, metrics ----


def _predictions(spark, sf_dir) -> DataFrame:
    """Targets with two made-up predictions and a gate."""
    h = F.pmod(F.col("player_id") * 31 + F.col("fold") * 7, F.lit(101)).cast("double") / 100.0
    g = F.pmod(F.col("player_id") * 17 + F.col("fold") * 3, F.lit(89)).cast("double") / 88.0
    return goals(spark, sf_dir).withColumns({"a": F.col("xag") * 0.5 + h * 0.3, "b": F.col("xag") * 0.4 + g * 0.2, "gate": g})


@query
def group_fold_sizes(spark, sf_dir):
    rows = goals(spark, sf_dir).drop("fold")
    return rows.join(evaluation.group_folds(rows), "match_id").groupBy("fold").agg(F.count(F.lit(1)).alias("n"))


@query
def strat_group_folds(spark, sf_dir):
    return evaluation.stratified_group_folds(goals(spark, sf_dir))


@query
def group_strata(spark, sf_dir):
    return evaluation.group_strata(goals(spark, sf_dir))


@query
def cv_splits(spark, sf_dir):
    rows = goals(spark, sf_dir).select(*KEY, "fold")
    return evaluation.explode_folds(rows, 5, "group_kfold")


@query
def fold_balance(spark, sf_dir):
    return evaluation.fold_balance(goals(spark, sf_dir))


@query
def step_weights(spark, sf_dir):
    return goals(spark, sf_dir).select(*KEY, evaluation.sample_weight(F.col("xag"), "step").alias("w"))


@query
def smooth_weights(spark, sf_dir):
    return goals(spark, sf_dir).select(*KEY, evaluation.sample_weight(F.col("xag"), "smooth").alias("w"), evaluation.sample_weight(F.col("xag"), "band").alias("band"))


@query
def weight_stats(spark, sf_dir):
    y = F.col("xag")
    return evaluation.weight_statistics(goals(spark, sf_dir), {"step": evaluation.step_weight(y)} | {f"smooth_{t}": evaluation.smooth_weight(y, tau=t) for t in (0.02, 0.03, 0.05)})


@query
def wrmse_by_fold(spark, sf_dir):
    w = evaluation.step_weight(F.col("xag"))
    return _predictions(spark, sf_dir).groupBy("fold").agg(evaluation.weighted_rmse(F.col("xag"), F.col("a"), w).alias("wrmse"), evaluation.log_loss((F.col("xag") >= 0.1).cast("double"), F.col("gate")).alias("log_loss"))


@query
def prediction_summary(spark, sf_dir):
    return evaluation.prediction_summary(_predictions(spark, sf_dir), "a")


@query
def gate_quality(spark, sf_dir):
    return evaluation.ranking_quality(_predictions(spark, sf_dir).withColumn("y", (F.col("xag") >= 0.1).cast("int")), "gate", "y")


@query
def calibration_deciles(spark, sf_dir):
    return evaluation.calibration_table(_predictions(spark, sf_dir), "a", "xag")


# ---- blends ----


@query
def blend_gram(spark, sf_dir):
    return blending.gram(_predictions(spark, sf_dir), ["a", "b"], "xag", evaluation.step_weight(F.col("xag")))


@query
def blend_two(spark, sf_dir):
    w, e = blending.best_blend(blend_gram(spark, sf_dir).first())
    return spark.createDataFrame([(w, e)], "weight double, wrmse double")


@query
def nnls_stack(spark, sf_dir):
    weights = blending.fit_stack(_predictions(spark, sf_dir), ["a", "b"], "xag", evaluation.step_weight(F.col("xag")))
    return spark.createDataFrame(sorted(weights.items()), "feature string, weight double")


@query
def isotonic_pos(spark, sf_dir):
    rows = _predictions(spark, sf_dir)
    return blending.apply_isotonic(rows, blending.fit_isotonic(rows, "a", "xag"), "a", "calibrated").select(*KEY, "a", "calibrated")


@query
def platt_by_fold(spark, sf_dir):
    rows = _predictions(spark, sf_dir).withColumn("y", (F.col("xag") >= 0.1).cast("double"))
    return blending.platt_by_fold(rows, "gate", "y", FOLDS).select(*KEY, "gate", "calibrated")


def _grid(candidates: Callable[[], dict[str, Column]]):
    return lambda spark, sf_dir: rounded(blending.grid_errors(_predictions(spark, sf_dir), candidates(), "xag", evaluation.step_weight(F.col("xag"))))


_gate = lambda: (F.col("gate"), F.col("b"), F.col("a"))
QUERIES["moe_soft"] = _grid(lambda: {f"{t:.2f}": blending.soft_mixture(*_gate(), tau=t) for t in (0.6, 0.8, 1.0, 1.2, 1.4, 1.6, 2.0)})
QUERIES["moe_hard"] = _grid(lambda: {f"{t:.2f}": blending.hard_mixture(*_gate(), threshold=t) for t in (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7)})
QUERIES["zero_threshold_grid"] = _grid(lambda: {f"{t / 100:.2f}": blending.zero_below(F.col("a"), t / 100) for t in range(0, 20)})


@query
def round_snap(spark, sf_dir):
    return _predictions(spark, sf_dir).select(*KEY, snap(F.round(F.col("a"), 3)).alias("snapped"))


@query
def importance_topk(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    gains = p.select((F.col("l_linenumber")).alias("fold"), F.concat(F.lit("f"), F.col("l_suppkey").cast("string")).alias("feature"), F.col("l_quantity").alias("gain")).groupBy("fold", "feature").agg(F.sum("gain").alias("gain"))
    return trees.importance_summary(gains, 15)


# ---- models ----


#: What sums up or contains the target itself (shots) is no feature of it.
_OF_SHOTS = ("shot", "goal", "gca", "sca")


def _model_rows(spark, sf_dir) -> tuple[DataFrame, list[str]]:
    """Targets with all features of the fused table, as a vector."""
    g = goals(spark, sf_dir)
    wide = enrich(g, fuse(prepared(spark, sf_dir), full.fused_blocks(KINDS, value=False)))
    features = [c for c, t in wide.dtypes if c not in g.columns and t in ("double", "bigint", "int") and not any(x in c for x in _OF_SHOTS)]
    return trees.with_vector(wide.withColumn("w", evaluation.step_weight(F.col("xag"))), features), features


@query
def gbt_oof(spark, sf_dir):
    rows, _ = _model_rows(spark, sf_dir)
    return trees.out_of_fold(rows, trees.regressor("xag", "oof_pred", "w"), FOLDS).select(*KEY, "fold", "xag", "oof_pred")


@query
def hurdle_oof(spark, sf_dir):
    rows, _ = _model_rows(spark, sf_dir)
    return trees.hurdle_oof(rows, "xag", FOLDS).select(*KEY, "fold", "xag", "chance", "hurdle")


#: Twenty features for the expert on high values.
FOR_HIGH = (
    "box_entries", "pass_dist_mean", "pass_dist_max", "to_goal_dist_mean", "to_goal_angle_abs_mean", "progressive_pass_count", "progressive_pass_success", "progressive_pass_distance_total", "progressive_carry_count", "progressive_carry_distance_total",
    "deep_completion_count", "final_third_entry_count", "penalty_area_entry_count", "attacking_zone_actions", "zone_attacking_ratio", "type_offensive_actions", "linebreak_third_transition_count", "through_channel_pass_count", "packing_approx_score_mean", "time_weighted_intensity",
)


@query
def mixture_oof(spark, sf_dir):
    rows, _ = _model_rows(spark, sf_dir)
    return trees.mixture_oof(rows, "xag", FOLDS, threshold=0.3, weight="w", high_features=FOR_HIGH).select(*KEY, "fold", "xag", "gate", "low", "high", "soft", "hard")


@query
def log_oof(spark, sf_dir):
    rows, _ = _model_rows(spark, sf_dir)
    return trees.out_of_fold(rows, trees.log_regressor("xag", "oof_pred", "w"), FOLDS).select(*KEY, "fold", "xag", "oof_pred")


def _boosted_rows(spark, sf_dir) -> tuple[DataFrame, list[str]]:
    """Targets with weights and all features of the fused table, written."""
    g = goals(spark, sf_dir)
    wide = enrich(g, fuse(prepared(spark, sf_dir), full.fused_blocks(KINDS, value=False)))
    features = [c for c, t in wide.dtypes if c not in g.columns and t in ("double", "bigint", "int") and (c in full.RISING or not any(x in c for x in _OF_SHOTS))]
    return staged(wide.withColumn("w", evaluation.step_weight(F.col("xag"))), "rows"), features


BOOSTED = {"rounds": 20, "depth": 3, "rate": 0.2, "bins": 32}


@query
def boosted_monotone(spark, sf_dir):
    """How often a fold's model falls with one of the features that it must rise with: never."""
    rows, features = _boosted_rows(spark, sf_dir)
    rising = {f: 1 for f in full.RISING}
    model = boosting.fit(rows, features, "xag", FOLDS, KEY, how=boosting.How(**BOOSTED, monotone=rising), weight="w")
    return boosting.falls(model, rows, rising)


#: Features that may meet on a path of a tree.
TOGETHER = (
    ("pass_dist_mean", "pass_dist_max", "to_goal_dist_mean", "to_goal_angle_abs_mean", "pass_success_rate", "through_channel_pass_count"),
    ("progressive_pass_count", "progressive_pass_success", "progressive_pass_distance_total", "deep_completion_count", "final_third_entry_count", "penalty_area_entry_count"),
    ("progressive_carry_count", "progressive_carry_success", "progressive_carry_distance_total", "action_count", "minutes_played"),
    ("defensive_zone_actions", "middle_zone_actions", "attacking_zone_actions", "box_entries", "central_corridor_actions", "halfspace_left_actions", "halfspace_right_actions"),
    ("first_half_actions", "second_half_actions", "final_15min_actions", "early_10min_actions", "time_weighted_intensity"),
)


@query
def boosted_groups(spark, sf_dir):
    """Out of fold, with trees whose paths stay within one group of features."""
    rows, features = _boosted_rows(spark, sf_dir)
    model = boosting.fit(rows, features, "xag", FOLDS, KEY, how=boosting.How(**BOOSTED, groups=TOGETHER), weight="w")
    return model.predict(rows).select(*KEY, "fold", "xag", "prediction")


@query
def boosted_tweedie(spark, sf_dir):
    """Variance powers by their error out of fold."""
    rows, features = _boosted_rows(spark, sf_dir)
    found = boosting.best_power(rows, features, "xag", FOLDS, KEY, (1.2, 1.4, 1.6), boosting.How(**BOOSTED), "w")
    return spark.createDataFrame([(i + 1, p, e) for i, (e, p, _) in enumerate(found)], "place int, power double, wrmse double")


@query
def boosted_quantiles(spark, sf_dir):
    """Three quantiles out of fold, their blend on a simplex, put through a rising step function."""
    rows, features = _boosted_rows(spark, sf_dir)
    rows = staged(boosting.with_quantiles(rows, features, "xag", FOLDS, KEY, how=boosting.How(rounds=12, depth=3, rate=0.2, bins=32)).select(*KEY, "fold", "xag", "w", "q60", "q75", "q90"), "quantiles")
    names = ["q60", "q75", "q90"]
    weights, _ = blending.best_simplex_blend(blending.gram(rows, names, "xag", F.col("w")).first(), 3)
    rows = rows.withColumn("blend", F.greatest(sum((F.lit(float(w)) * F.col(n) for w, n in zip(weights, names, strict=True)), F.lit(0.0)), F.lit(0.0)))
    return blending.apply_isotonic(rows, blending.fit_isotonic(rows, "blend", "xag"), "blend", "calibrated").select(*KEY, "fold", "xag", *names, "blend", "calibrated")


@query
def boosted_history(spark, sf_dir):
    """Held-out error by fold and round, and the round that counts."""
    rows, features = _boosted_rows(spark, sf_dir)
    model = boosting.fit(rows, features, "xag", FOLDS, KEY, how=boosting.How(rounds=40, depth=3, rate=0.4, patience=4, row_share=0.8, feature_share=0.8), weight="w")
    return spark.createDataFrame(model.history(), "fold int, round int, error double, counts boolean")


@query
def boosted_importance(spark, sf_dir):
    """The twenty features of the largest mean gain over folds."""
    rows, features = _boosted_rows(spark, sf_dir)
    model = boosting.fit(rows, features, "xag", FOLDS, KEY, how=boosting.How(**BOOSTED), weight="w")
    return trees.importance_summary(trees.importance_table(model.importance(), spark), 20)


@query
def tree_search(spark, sf_dir):
    """Thirty trials over the first three folds."""
    rows, features = _boosted_rows(spark, sf_dir)
    rows = staged(rows.where("fold <= 3"), "rows")
    space = {"depth": search.Setting(2, 4, whole=True), "rounds": search.Setting(4, 12, whole=True), "rate": search.Setting(0.05, 0.5, log=True), "ridge": search.Setting(0.1, 10.0, log=True), "least_rows": search.Setting(5, 60, log=True, whole=True)}
    done = search.search(boosting.search_errors(rows, features, "xag", FOLDS[:3], KEY, "w"), space, trials=30, at_once=6, together=True)
    found = sorted(((e, i, t) for i, (t, e) in enumerate(done)), key=lambda r: r[:2])
    return spark.createDataFrame([(p + 1, i + 1, t["depth"], t["rounds"], t["rate"], t["ridge"], t["least_rows"], e) for p, (e, i, t) in enumerate(found)], "place int, trial int, depth int, rounds int, rate double, ridge double, least_rows int, wrmse double")


@query
def ordered_target(spark, sf_dir):
    """A league's and a squad's mean over the rows before, in one order of the rows."""
    rows = staged(goals(spark, sf_dir).withColumn("o", F.pmod(F.col("player_id") * 37 + F.col("fold") * 11, F.lit(101))), "rows")
    rows = staged(encoding.ordered_target_encoding(rows, "comp", ["o", *KEY]), "encoded")  # each encoding reads its rows several times
    rows = encoding.ordered_target_encoding(rows, "squad", ["o", *KEY])
    return rows.select(*KEY, "comp_ordered_enc", "squad_ordered_enc")


@query
def feature_correlations(spark, sf_dir):
    """Of the target and some features with one another."""
    names = ["xag", "action_count", "pass_dist_mean", "progressive_pass_count", "box_entries"]
    return evaluation.correlations(enrich(goals(spark, sf_dir), fuse(prepared(spark, sf_dir), full.fused_blocks(KINDS, value=False))), names)


@query
def stratified_splits(spark, sf_dir):
    """Rows by fold and class, classes dealt out evenly."""
    rows = goals(spark, sf_dir).drop("fold").withColumn("high", (F.col("xag") >= 0.1).cast("int"))
    return evaluation.stratified_folds(rows, "high", KEY).groupBy("fold", "high").agg(F.count(F.lit(1)).alias("n"))


@query
def ordered_splits(spark, sf_dir):
    """Blocks of days, each tested after those before."""
    rows = goals(spark, sf_dir).drop("fold").withColumn("day", F.substring("match_id", 9, 2).cast("int"))
    return evaluation.ordered_folds(rows, ["day"]).groupBy("fold").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count(F.lit(1)).alias("n"))


@query
def blend_simplex(spark, sf_dir):
    rows = _predictions(spark, sf_dir)
    weights, error = blending.best_simplex_blend(blending.gram(rows, ["a", "b", "gate"], "xag", evaluation.step_weight(F.col("xag"))).first(), 3)
    return spark.createDataFrame([(*weights, error)], "a double, b double, gate double, wrmse double")


@query
def isotonic_threshold(spark, sf_dir):
    rows = _predictions(spark, sf_dir).withColumn("w", evaluation.step_weight(F.col("xag")))
    threshold, error, _ = blending.best_isotonic_threshold(staged(rows, "rows"), "a", "xag", F.col("w"), weight="w")
    return spark.createDataFrame([(threshold, error)], "threshold double, wrmse double")


#: The kinds of action that these events have.
PRESENT = ("pass", "cross", "carry")


def _with_new_rows(spark, sf_dir) -> DataFrame:
    """Targets of which the fifth fold is new: without a fold and without a value."""
    known = F.col("fold") <= 4
    return goals(spark, sf_dir).withColumns({"xag": F.when(known, F.col("xag")), "fold": F.when(known, F.col("fold"))})


@query
def edxt_pipeline(spark, sf_dir):
    """Learned values, success probabilities out of fold, expected value by group and its team context, one after the other. Targets and
    the columns of actions that this needs are written once: all steps read them."""
    rows = staged(_with_new_rows(spark, sf_dir).select(*KEY, "xag", "fold", "squad"), "rows")
    many = rows.hint("merge")  # targets grow with the actions: small files of them are still too many rows to broadcast
    a = one_direction(relevant(actions(spark, sf_dir), many)).join(F.broadcast(rows.select("match_id", "fold").distinct()), "match_id")  # one row a match
    a = staged(a.select(*KEY, "fold", "type_name", "result_name", *[c for c in full.PLACE if c in a.columns]), "actions")
    a = value.with_learned_value(a, value.solve_values(value.transition_counts(a.where("fold is not null"))))
    wide = many.select(*KEY, "squad").join(full.expected_value(full.chances(a, PRESENT, FOLDS[:4], full.VALUED), many, PRESENT), list(KEY))
    return windows.team_context(wide, [c for c in wide.columns if c.endswith("_edxt_sum")]).drop("squad")


@query
def full_run(spark, sf_dir):
    """From actions to calibrated predictions: all features, models by fold, their stack."""
    wide, names = full.all_features(actions(spark, sf_dir), _with_new_rows(spark, sf_dir), KINDS, PRESENT, FOLDS[:4])
    return full.predict(wide, names, FOLDS[:4])


@query
def tweedie_oof(spark, sf_dir):
    rows, _ = _model_rows(spark, sf_dir)
    return trees.tweedie_oof(rows, "xag", FOLDS).select(*KEY, "fold", "xag", "tweedie")


@query
def xpass_model(spark, sf_dir):
    a = staged(_components(spark, sf_dir).drop("xpass_prob"), "actions")
    return trees.success_probability(a, ["start_x", "start_y", "end_x", "end_y", "time_seconds"], ["pass", "cross", "carry"], FOLDS).select("action_id", "group", "xpass_prob")


# ---- plain tables ----


@query
def union_targets(spark, sf_dir):
    g = goals(spark, sf_dir)
    return tabular.union_tables(g.where("fold <= 4"), g.where("fold = 5").drop("xag")).select(*KEY, "is_train", "xag")


@query
def distinct_pairs(spark, sf_dir):
    return tabular.distinct_pairs(actions(spark, sf_dir))


@query
def match_overlap(spark, sf_dir):
    g = goals(spark, sf_dir)
    return tabular.overlap(g.where("fold <= 3"), g.where("fold >= 2"))


@query
def table_profile(spark, sf_dir):
    return profile(spark.read.parquet(f"{sf_dir}/orders.parquet"))


@query
def one_hot_union(spark, sf_dir):
    """The columns of a category are those of both tables together."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderpriority")
    values = tabular.categories(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1"), column="o_orderpriority")
    wide = encoding.one_hot(o, "o_orderpriority", values)
    return wide.select("o_orderkey", *[F.col(f"o_orderpriority_{v}").alias(f"is_{v[0]}") for v in values])


@query
def dictionary_codes(spark, sf_dir):
    return tabular.dictionary(spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("part", F.col("l_partkey").cast("string")), "part")


@query
def selected_columns(spark, sf_dir):
    return select_columns(actions(spark, sf_dir), prefixes=["start_"], keep=["action_id"])


@query
def table_fingerprint(spark, sf_dir):
    return fingerprint(spark.read.parquet(f"{sf_dir}/orders.parquet"))


def _passengers(spark, sf_dir) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    kinds = F.array(*[F.lit(x) for x in ("Mr", "Mrs", "Miss", "Dr", "Mlle", "")])
    word = F.get(kinds, F.pmod("c_custkey", F.lit(6)).cast("int"))
    port = F.get(F.array(F.lit("S"), F.lit("C"), F.lit("S"), F.lit("Q")), F.pmod("c_custkey", F.lit(4)).cast("int"))
    return c.select(
        F.col("c_custkey").alias("PassengerId"), F.concat(F.lit("Doe, "), word, F.when(word == "", "").otherwise(". "), F.col("c_name")).alias("Name"), F.when(F.col("c_custkey") % 7 != 0, (F.col("c_custkey") * 13 % 101).cast("double")).alias("Age"),
        F.when(F.col("c_custkey") % 11 != 0, F.abs("c_acctbal")).alias("Fare"), F.when(F.col("c_custkey") % 9 != 0, port).alias("Embarked"), (F.col("c_custkey") % 3).alias("SibSp"), (F.col("c_custkey") % 2).alias("Parch"),
    )


@query
def impute_median_mode(spark, sf_dir):
    return tabular.impute(_passengers(spark, sf_dir), {"Age": "median", "Fare": "mean", "Embarked": "mode"}).select("PassengerId", "Age", "Fare", "Embarked")


@query
def title_regex(spark, sf_dir):
    return _passengers(spark, sf_dir).select("PassengerId", tabular.title(F.col("Name")).alias("Title"))


@query
def age_band(spark, sf_dir):
    return _passengers(spark, sf_dir).select("PassengerId", tabular.band(F.col("Age")).alias("AgeBand"))


@query
def fare_quartile(spark, sf_dir):
    return tabular.quartile_band(_passengers(spark, sf_dir), "Fare", "FareBand").select("PassengerId", "FareBand")


@query
def family_size(spark, sf_dir):
    return _passengers(spark, sf_dir).withColumns(tabular.family(F.col("SibSp"), F.col("Parch"))).select("PassengerId", "FamilySize", "IsAlone")
