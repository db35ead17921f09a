"""The whole run from actions to predictions: learned values, possessions, networks, expected value, context and encodings beside the
fused blocks; models by fold, a stack of them, and its calibration. Rows without a fold are new: nothing is learned from them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.columns import snap, yes
from fieldloom.models import blending, boosting, evaluation, trees
from fieldloom.operators import blocks, encoding, expected, network, tabular, value, windows
from fieldloom.operators.sequence import KEY, one_direction, relevant, with_neighbours
from fieldloom.plans.fusion import Block, credit, enrich, fuse
from fieldloom.sources.staging import staged

PLACE = ("start_x", "start_y", "end_x", "end_y", "time_seconds", "xt_learned_start")
#: Sums that are compared with the team's, by their beginnings and ends.
OF_TEAM = ("xt_learned_", "possession_xt_"), ("_edxt_sum",)
ENCODED = ("player_id", "matchup")
#: The columns that are crossed with the league.
OF_LEAGUE = ("xt_learned_delta_sum", "xt_learned_positive_delta_sum", "possession_xt_positive_sum", "possession_xt_delta_sum", "possession_speed_ground_mean")
#: Counts that also enter by minute of play.
BY_MINUTE = ("action_count", "goal_count", "pass_leads_to_shot", "type_offensive_actions", "type_defensive_actions", "progressive_pass_count", "progressive_carry_count")


def fused_blocks(kinds: Sequence[str], value: bool = True) -> list[Block]:
    """Twenty blocks that one pass over the actions yields."""
    return [
        blocks.nstep_chain(value=value), blocks.second_assist(), blocks.pass_geometry(), blocks.time_blocks(), blocks.zone_density(), blocks.zone_thirds(), blocks.basic_stats(), blocks.goal_count(), blocks.type_pivot(kinds), blocks.success_rates(),
        blocks.attack_defence(), blocks.pass_to_shot(), blocks.progressive_pass(), blocks.progressive_carry(), blocks.gca_spatial(), blocks.linebreak_packing(), blocks.chain_quality(), blocks.box_entry(), blocks.attack_tempo(), blocks.vision(),
    ]


def more_blocks() -> list[Block]:
    """The blocks that the twenty leave out: longer chains, waits, set plays, body parts, receiving in the box, heuristic values."""
    return [
        blocks.nstep_chain(7, 0.6, "longchain"), blocks.pass_latency(), blocks.setplay_share(), blocks.bodypart_pivot(), blocks.box_receiver_volume(), blocks.box_receiver_timing(), blocks.box_receiver_angles(),
        blocks.box_receiver_origin(), blocks.final_third_receive(), blocks.dynamic_position(), blocks.heuristic_value(),
    ]


def credits(actions: DataFrame) -> list[DataFrame]:
    """Shots and goals credited to the players one and two actions before."""
    a = with_neighbours(actions, before=2)
    return [credit(a, blocks.shot_creation(k, goals), f"player_p{k}", f"{name}{k}") for k in (1, 2) for goals, name in ((False, "sca"), (True, "gca"))]


#: What expected_value() needs of an action besides its probability.
VALUED = (*KEY, "fold", "type_name", "xt_learned_start", "xt_learned_delta")


def chances(actions: DataFrame, groups: Sequence[str], folds: Sequence[int], keep: Sequence[str] | None = None) -> DataFrame:
    """Actions of the groups (the columns `keep`, or all) with success probabilities and components, written. actions: a written table with fold and learned values."""
    a = actions.withColumn("group", expected.action_group()).where(F.col("group").isin(*groups))
    return staged(expected.with_components(trees.success_probability(a, PLACE, groups, folds, keep=keep)), "chances")


def expected_value(chanced: DataFrame, rows: DataFrame, groups: Sequence[str], y: str = "xag") -> DataFrame:
    """Features of expected value by player. chanced: as chances() gives them."""
    a = staged(expected.with_scaled_failure(chanced, expected.fold_moments(chanced)), "components")
    found: dict[str, list] = {}
    known = rows.where(F.col("fold").isNotNull())
    for r in expected.penalty_statistics(expected.component_sums(a.where(F.col("fold").isNotNull())), known, evaluation.step_weight(F.col(y)), y).collect():  # groups times folds rows
        found.setdefault(r["group"], []).append(r)
    return expected.expected_features(a, {g: expected.best_penalty(found[g], *expected.PENALTY_BOUNDS[g]) if g in found else 0.0 for g in groups})


def _players(of_teams: DataFrame) -> DataFrame:
    return of_teams.drop("team_id").groupBy(*KEY).agg(*[F.max(c).alias(c) for c in of_teams.columns if c not in (*KEY, "team_id")])


def block_features(a: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """All blocks in one aggregate, but for the waits of receivers: among sums, their percentiles would have all rows sorted with all their
    neighbours. They need the few rows alone that receive in the box. a: players aren't missing."""
    many, wait = [*fused_blocks(kinds), *more_blocks()], blocks.box_receiver_timing()
    waits = with_neighbours(a, wait.after).where(yes(wait.rows)).groupBy(*KEY).agg(*[c.alias(n) for n, c in wait.columns.items()])
    out = fuse(windows.with_own_previous(value.with_heuristic_value(a)), [b for b in many if b.name != wait.name])
    return enrich(out, waits).select(*KEY, *[n for b in many for n in b.columns])


def own_features(a: DataFrame, kinds: Sequence[str]) -> list[DataFrame]:
    """Tables of features that come from a player's actions and their neighbours. a: with learned values, written."""
    received, partners = network.received_passes(with_neighbours(a, 1)), network.passer_chain(a)
    return [
        block_features(a, kinds), fuse(windows.with_pass_gaps(a), [blocks.pass_tempo()]), *credits(a), value.value_player(a), windows.possession_player(windows.with_possessions(a)),
        _players(network.degrees(network.weighted_edges(partners))), network.diversity(partners), network.pass_lengths(a), network.receive_counts(received),
        network.diversity(network.box_receivers(with_neighbours(a, 1)), names=("box_receiver_diversity", "unique_box_receivers")),
    ]


def path_features(a: DataFrame) -> list[DataFrame]:
    """Path measures of both pass networks: by number of passes in the chain of passers, by weight among passers and receivers."""
    hops = network.hop_centrality(network.weighted_edges(network.passer_chain(a)))
    hops = hops.withColumnsRenamed({c: f"chain_{c}" for c in hops.columns if c.startswith("pass_net_")})
    return [_players(hops), _players(network.centrality(network.weighted_edges(network.received_passes(with_neighbours(a, 1)))))]


def all_features(actions: DataFrame, rows: DataFrame, kinds: Sequence[str], groups: Sequence[str], folds: Sequence[int], y: str = "xag", date: str = "match_id") -> tuple[DataFrame, list[str]]:
    """rows (match_id, player_id, y, fold, squad, opponent, comp) with all features, and the features' names. No row is lost. date: the
    column that says which of a player's rows come before."""
    a = one_direction(relevant(actions, rows)).join(rows.select("match_id", "fold").distinct(), "match_id")
    a = staged(value.with_learned_value(a, value.solve_values(value.transition_counts(a.where(F.col("fold").isNotNull())))), "actions")
    known = F.col("fold").isNotNull()
    chanced = chances(a, groups, folds)
    parts = [*own_features(a, kinds), *path_features(a), fuse(chanced, [blocks.pass_risk()]), expected_value(chanced, rows, groups, y), windows.player_trend(rows.select(*dict.fromkeys((*KEY, y, "fold", date))), known, y, date).drop(y, "fold", *({date} - {*KEY}))]
    narrow = staged(rows.withColumn("matchup", encoding.crossed_key("squad", "opponent")), "rows")
    wide = encoding.with_residuals(narrow, y)
    for key in ENCODED:
        wide = encoding.with_target_encoding(wide, key, y, of=narrow)
    wide = staged(wide.drop("matchup"), "encoded")
    encoded = [c for c in wide.columns if c not in rows.columns]
    for part in parts:
        wide = enrich(wide, part)
    wide = staged(wide, "players")
    (begin, end) = OF_TEAM
    wide = windows.team_context(wide, [c for c in wide.columns if (c.startswith(begin) and c.endswith("_sum")) or c.endswith(end)])
    wide = wide.withColumns(blocks.per_minute(tuple(c for c in BY_MINUTE if c in wide.columns)))
    wide = wide.select(*[c for c in wide.columns if c not in encoded], *encoded)
    gates = tabular.categories(rows, column="comp")
    wide = encoding.category_crosses(encoding.one_hot(wide, "comp", gates), list(OF_LEAGUE), "comp", gates)
    return wide, feature_names(wide, rows.columns)


def feature_names(wide: DataFrame, given: Sequence[str]) -> list[str]:
    """The numeric columns that were not given."""
    return [c for c, t in wide.dtypes if c not in given and t in ("double", "bigint", "int")]


#: Features that the prediction must rise with.
RISING = (
    "progressive_pass_count", "progressive_pass_success", "progressive_pass_distance_total", "progressive_pass_distance_mean", "progressive_carry_count", "progressive_carry_success", "progressive_carry_distance_total",
    "progressive_carry_distance_mean", "deep_completion_count", "final_third_entry_count", "penalty_area_entry_count", "goal_count", "pass_leads_to_shot", "zone_attacking_count", "zone_attacking_ratio", "type_offensive_actions", "type_offensive_action_ratio",
)
CATEGORIES = ("comp", "squad", "opponent")


def predict(wide: DataFrame, names: Sequence[str], folds: Sequence[int], y: str = "xag", how: boosting.How = boosting.How(rounds=20, depth=3, rate=0.2, patience=6), threshold: float = 0.1, heavy: float = 5.0) -> DataFrame:  # noqa: B008
    """match_id, player_id, fold, y and prediction of all rows. Three learners out of fold: boosted trees that rise with RISING; others on the
    logarithm of y; and a third with its own seed, that draws rows and features and sees categories by ordered statistics. A stack
    without negative weights, a rising step function, snapped. New rows get the means of the folds' models. Rows of at least
    `threshold` weigh `heavy`."""
    given = [c for c in CATEGORIES if c in wide.columns]
    rows = staged(wide.select(*KEY, "fold", y, *given, *names).withColumns({"w": evaluation.step_weight(F.col(y), threshold, heavy), "_log": F.log1p(y)}), "wide")
    coded, codes = encoding.ordered_encodings(rows, given, KEY, y)
    rows = staged(coded, "coded")
    rising = replace(how, monotone={f: 1 for f in RISING if f in names})
    other = replace(how, seed=how.seed + 100, row_share=0.8, feature_share=0.5)
    wanted = [boosting.Wanted(y, how=rising, weight="w", features=names), boosting.Wanted("_log", how=how, weight="w", features=names), boosting.Wanted(y, how=other, weight="w")]
    fits = ["trees", "logs", "other"]
    learners = boosting.fit_all(rows, [*names, *codes], folds, KEY, wanted)  # a pass over the rows serves all three
    rows = staged(boosting.predict_all(learners, rows, fits, keep=[*KEY, "fold", y, "w"]).withColumn("logs", F.expm1("logs")), "learners")
    known = rows.where(F.col("fold").isNotNull())
    weights = blending.fit_stack(known, fits, y, F.col("w"))
    rows = staged(rows.withColumn("stack", F.greatest(blending.apply_stack(weights, fits), F.lit(0.0))), "stack")
    known = rows.where(F.col("fold").isNotNull())
    try:
        threshold, _, model = blending.best_isotonic_threshold(known, "stack", y, F.col("w"), weight="w")
        rows = blending.apply_isotonic(rows, model, "stack", "prediction", threshold)
    except ValueError:  # no prediction is high enough to be calibrated
        rows = rows.withColumn("prediction", F.col("stack"))
    return rows.select(*KEY, "fold", y, snap(F.col("prediction")).alias("prediction"))
