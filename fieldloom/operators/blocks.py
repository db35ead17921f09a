"""Feature blocks over ordered actions, each a plans.fusion.Block for a key of match and player.

Null rules: a comparison with a missing neighbour is false; a missing previous team counts as another team; shares and means
without rows are 0. Neighbours are those in the sequence of with_neighbours.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldloom.functions.columns import (
    clamp, count_where, differs, goal_angle, goal_distance, in_box, in_centre, in_left, in_right, in_zone14, is_shot, mean_where, ratio, same, share_where, sum_where, third_code, yes,
)
from fieldloom.operators.sequence import by_match
from fieldloom.plans.fusion import Block

# Columns are made by functions: they need a running session, which an import doesn't.


def is_pass() -> Column:
    return yes(F.col("type_name") == "pass")


def succeeded() -> Column:
    return yes(F.col("result_name") == "success")


def sx() -> Column:
    return F.col("start_x")


def sy() -> Column:
    return F.col("start_y")


def ex() -> Column:
    return F.col("end_x")


def ey() -> Column:
    return F.col("end_y")


def dx() -> Column:
    return ex() - sx()


def dy() -> Column:
    return ey() - sy()


#: Action kinds by role.
PASS_LIKE = ("pass", "cross", "freekick_crossed", "corner_crossed")
CARRY_LIKE = ("carry", "dribble", "take_on")
SUCCESS_KINDS = ("pass", "shot", "take_on", "cross", "corner_crossed", "freekick_crossed")
SET_PLAYS = ("corner", "freekick_short", "freekick_crossed", "throw_in")
OFFENSIVE = ("shot", "pass", "cross", "take_on", "dribble")
DEFENSIVE = ("tackle", "interception", "clearance")
FEET = {"right": "right_foot", "left": "left_foot", "head": "head"}


def near(i: int, kind: Column | None = None) -> Column:
    """The i-th next action is of the same team (and of that kind)."""
    out = same(f"team_{i}", "team_id")
    return out if kind is None else out & kind


def shot_within(*steps: int) -> Column:
    out = F.lit(False)
    for i in steps:
        out = out | near(i, is_shot(f"type_{i}"))
    return out


# ---- chains ----


def nstep_chain(steps: int = 3, gamma: float = 0.7, prefix: str = "nstep", value: bool = True) -> Block:
    """Discounted shots, and discounted gains in value, among the same team's next actions."""
    to_shot, gain = F.lit(0.0), F.lit(0.0)
    for k in range(1, steps + 1):
        weight = F.lit(gamma ** (k - 1))
        to_shot = to_shot + F.when(near(k, is_shot(f"type_{k}")), weight).otherwise(0.0)
        if value:
            gain = gain + F.when(near(k), weight * F.coalesce(F.col(f"xt_{k}"), F.lit(0.0))).otherwise(0.0)
    return Block(f"{prefix}_chain", {f"{prefix}_to_shot": F.sum(to_shot), f"{prefix}_xt_delta": F.sum(gain)}, after=steps)


def second_assist() -> Block:
    cond = is_pass() & yes(F.col("type_1") == "pass") & is_shot("type_2") & near(1) & near(2)
    return Block("second_assist", {"second_assist_count": count_where(cond)}, cond, after=2)


def shot_creation(k: int, goals_only: bool = False) -> Column:
    """Shots (or goals) whose k-th previous action was the same team's; credited to that action's player."""
    cond = is_shot("type_name") & same(f"team_p{k}", "team_id")
    return cond & succeeded() if goals_only else cond


def pass_geometry() -> Block:
    length = F.hypot(F.coalesce(dx(), F.lit(0.0)), F.coalesce(dy(), F.lit(0.0)))
    w = lambda f, c: f(F.when(is_pass(), c))
    return Block("pass_geometry", {"pass_dist_mean": w(F.avg, length), "pass_dist_max": w(F.max, length), "to_goal_angle_abs_mean": w(F.avg, goal_angle(ex(), ey())), "to_goal_dist_mean": w(F.avg, goal_distance(ex(), ey()))}, is_pass())


def pass_latency() -> Block:
    cond = is_pass() & near(1, is_shot("type_1"))
    wait = clamp(F.col("time_1") - F.col("time_seconds"), low=0.0)
    return Block("pass_latency", {"pass_to_shot_latency_mean": F.avg(F.when(cond, wait)), "pass_to_shot_latency_min": F.min(F.when(cond, wait))}, cond, after=1)


def pass_risk() -> Block:
    """Needs xpass_prob and xt_learned_delta_on_success."""
    p, gain = F.col("xpass_prob"), F.coalesce(F.col("xt_learned_delta_on_success"), F.lit(0.0))
    mean = mean_where(is_pass(), p)
    return Block(
        "pass_risk",
        {
            "risk_creativity_sum": sum_where(is_pass(), (1 - p) * gain), "xpass_mean": mean, "xpass_min": F.coalesce(F.min(F.when(is_pass(), p)), F.lit(0.0)), "pass_success_minus_xpass": share_where(is_pass(), succeeded()) - mean,
            "xpass_deep_mean": mean_where(is_pass() & yes(ex() >= 70), p), "xpass_box_mean": mean_where(is_pass() & yes(ex() >= 88) & yes(ey().between(14, 54)), p),
        },
        is_pass(),
    )


# ---- when and where ----


def time_blocks() -> Block:
    t, p = F.col("time_seconds"), F.col("period_id")
    pace = F.when(p == 1, t / 2700.0 * 0.5).otherwise(0.5 + t / 2700.0 * 0.5)
    return Block(
        "time_blocks",
        {
            "first_half_actions": count_where(p == 1), "second_half_actions": count_where(p == 2), "final_15min_actions": count_where((p == 2) & (t >= 2700)), "early_10min_actions": count_where((p == 1) & (t <= 600)),
            "time_weighted_intensity": F.coalesce(F.sum(pace), F.lit(0.0)),
        },
    )


def zone_density() -> Block:
    return Block(
        "zone_density",
        {
            "defensive_zone_actions": count_where(sx() < 35), "middle_zone_actions": count_where((sx() >= 35) & (sx() < 70)), "attacking_zone_actions": count_where(sx() >= 70),
            "halfspace_left_actions": count_where(in_left(sy())), "halfspace_right_actions": count_where(in_right(sy())), "central_corridor_actions": count_where(in_centre(sy())),
            "final_third_penetrations": count_where(sx() >= 70), "box_entries": count_where(in_box(sx(), sy())),
        },
    )


def zone_thirds(middle: float = 70.0) -> Block:
    """Counts by third of the pitch and their shares; the border of the last third varies (70 or 75)."""
    zone = F.when(sx() < 35, "defensive").when(sx() < middle, "middle").when(sx().isNotNull(), "attacking").otherwise("unknown")
    count = lambda z: F.count_if(zone == z)
    names = ("defensive", "middle", "attacking")
    return Block("zone_thirds", {f"zone_{z}_count": count(z) for z in names} | {f"zone_{z}_ratio": ratio(count(z), F.count(F.lit(1))) for z in names})


def basic_stats() -> Block:
    first = F.min_by("minutes_played", F.when(F.col("minutes_played").isNotNull(), F.col("_place")))  # a number: a struct would have the whole aggregate sorted
    return Block("basic_stats", {"action_count": F.count(F.lit(1)), "avg_x": F.bround(F.round(F.avg(sx()), 7), 2), "avg_y": F.bround(F.round(F.avg(sy()), 7), 2), "minutes_played": first.cast("double")}, derived={"_place": F.row_number().over(by_match())})


def goal_count() -> Block:
    return Block("goal_count", {"goal_count": count_where(is_shot("type_name") & succeeded())})


def type_pivot(kinds: tuple[str, ...]) -> Block:
    return Block("type_pivot", {f"type_{k}_count": count_where(F.col("type_name") == k) for k in kinds})


def success_rates(kinds: tuple[str, ...] = SUCCESS_KINDS) -> Block:
    return Block("success_rates", {f"{k}_success_rate": share_where(F.col("type_name") == k, succeeded()) for k in kinds})


def attack_defence() -> Block:
    off, de = F.col("type_name").isin(*OFFENSIVE), F.col("type_name").isin(*DEFENSIVE)
    return Block("attack_defence", {"type_offensive_actions": count_where(off), "type_defensive_actions": count_where(de), "type_offensive_action_ratio": ratio(count_where(off), count_where(off | de))}, off | de)


def pass_to_shot() -> Block:
    cond = is_pass() & yes(F.col("type_1") == "shot")
    return Block("pass_to_shot", {"pass_leads_to_shot": count_where(cond)}, cond, after=1)


def per_minute(names: tuple[str, ...]) -> dict[str, Column]:
    """Rates of columns by minutes_played, 0 where that is 0 or missing."""
    return {f"{n}_per_minute": ratio(F.col(n), F.col("minutes_played")) for n in names}


# ---- progress ----


def progressive_pass() -> Block:
    end_x, end_y = F.coalesce(ex(), sx()), F.coalesce(ey(), sy())
    kind = yes(F.col("type_name").isin(*PASS_LIKE))
    gain = end_x - sx()
    forward = kind & yes((gain >= 10) | ((sx() < 70) & (end_x >= 70)) | (end_x >= 85))
    length = F.hypot(gain, end_y - sy())
    return Block(
        "progressive_pass",
        {
            "progressive_pass_count": count_where(forward), "progressive_pass_success": count_where(forward & succeeded()), "progressive_pass_distance_total": sum_where(forward, length), "progressive_pass_distance_mean": mean_where(forward, length), "progressive_pass_success_rate": share_where(forward, succeeded()),
            "final_third_entry_count": count_where(kind & succeeded() & (sx() < 70) & (end_x >= 70)), "deep_completion_count": count_where(kind & succeeded() & (end_x >= 85)), "penalty_area_entry_count": count_where(kind & succeeded() & (end_x >= 88)),
        },
        kind,
    )


def progressive_carry() -> Block:
    end_x, end_y = F.coalesce(ex(), sx()), F.coalesce(ey(), sy())
    kind = yes(F.col("type_name").isin(*CARRY_LIKE))
    forward = kind & yes((end_x - sx() >= 5) | ((sx() < 70) & (end_x >= 70)))
    length = F.hypot(end_x - sx(), end_y - sy())
    return Block("progressive_carry", {"progressive_carry_count": count_where(forward), "progressive_carry_success": count_where(forward & succeeded()), "progressive_carry_distance_total": sum_where(forward, length), "progressive_carry_distance_mean": mean_where(forward, length), "progressive_carry_success_rate": share_where(forward, succeeded())}, kind)


# ---- chance creation ----


def gca_spatial() -> Block:
    z14 = is_pass() & in_zone14(sx(), sy())
    left, right = (is_pass() & side(sy()) & in_box(ex(), ey()) for side in (in_left, in_right))
    cutback = is_pass() & yes(sx() >= 95) & yes((sy() < 20) | (sy() > 48)) & (yes(ex() < sx()) | yes(F.abs(dy()) > 10))
    out = {"zone14_origin_pass_count": count_where(z14), "zone14_origin_pass_success_rate": share_where(z14, succeeded()), "zone14_pregca_count": count_where(z14 & shot_within(1, 2))}
    for side, cond in (("l", left), ("r", right)):
        out |= {f"halfspace_{side}_to_box_count": count_where(cond), f"halfspace_{side}_to_box_success_rate": share_where(cond, succeeded())}
    out |= {"cutback_count": count_where(cutback), "cutback_success_rate": share_where(cutback, succeeded()), "cutback_next_shot_rate": share_where(cutback, near(1, is_shot("type_1")))}
    return Block("gca_spatial", out, z14 | left | right | cutback, after=2)


def linebreak_packing() -> Block:
    a, b = third_code(sx()), third_code(ex())
    crossed = ~yes(a == b) & yes(dx() >= 10.5) & succeeded()
    channel = in_centre(sy()) & yes(dx() >= 10.5) & succeeded()
    step = F.greatest(F.coalesce(b, F.lit(0)) - F.coalesce(a, F.lit(0)), F.lit(0))  # each end outside the pitch counts as the first third
    score = F.when(step == 2, 3).otherwise(step).cast("double")
    return Block(
        "linebreak_packing",
        {
            "linebreak_third_transition_count": count_where(is_pass() & crossed), "linebreak_third_transition_rate": share_where(is_pass(), crossed), "through_channel_pass_count": count_where(is_pass() & channel),
            "through_channel_pass_rate": share_where(is_pass(), channel), "packing_approx_score_mean": mean_where(is_pass(), score),
        },
        is_pass(),
    )


def chain_quality(one_two_s: float = 3.0, burst_s: float = 5.0) -> Block:
    wait = F.col("time_2") - F.col("time_seconds")
    one_two = is_pass() & yes(F.col("type_1") == "pass") & near(1) & same("player_2", "player_id") & yes(wait <= one_two_s)
    third_man = is_pass() & yes(F.col("type_1") == "pass") & yes(F.col("type_2") == "pass") & is_shot("type_3") & near(1) & near(2) & near(3)
    burst = yes(F.coalesce(wait, F.lit(999.0)) <= burst_s) & near(2, is_shot("type_2"))
    return Block("chain_quality", {"one_two_chain_count": count_where(one_two), "third_man_release_count": count_where(third_man), "burst_window_sca_rate": F.avg(burst.cast("double"))}, after=3)


def box_entry(touch_s: float = 1.0) -> Block:
    inside = in_box(ex(), ey())
    cond = is_pass() & inside
    wait = F.coalesce(F.col("time_1") - F.col("time_seconds"), F.lit(999.0))
    return Block(
        "box_entry",
        {
            "box_entry_from_zone14_count": count_where(cond & in_zone14(sx(), sy())), "box_entry_from_halfspace_l_count": count_where(cond & in_left(sy())), "box_entry_from_halfspace_r_count": count_where(cond & in_right(sy())),
            "facing_forward_share_in_box": share_where(inside, goal_angle(ex(), ey()) < 0.785), "first_touch_shot_rate_in_box": share_where(inside, is_shot("type_1") & (wait < touch_s)),
        },
        inside,
        after=1,
    )


def _loose_gca() -> Column:
    """Kind and team are each looked up among the two next actions, not as a pair."""
    return (is_shot("type_1") | is_shot("type_2")) & (near(1) | near(2))


def setplay_share() -> Block:
    gca, dead = _loose_gca(), yes(F.col("type_name").isin(*SET_PLAYS))
    return Block("setplay_share", {"setplay_gca_share": share_where(dead, gca), "openplay_gca_share": share_where(~dead, gca)}, after=2)


def bodypart_pivot() -> Block:
    """Counts of the body part on passes that lead to a shot; parts outside the list are left out."""
    key_pass = is_pass() & _loose_gca()
    return Block("bodypart_pivot", {f"bodypart_on_key_pass_rate_{k}": count_where(key_pass & (F.col("bodypart_name") == v)) for k, v in FEET.items()}, key_pass & yes(F.col("bodypart_name").isin(*FEET.values())), after=2)


def attack_tempo() -> Block:
    gca = shot_within(1, 2)
    t = F.col("time_seconds")
    prior = F.when(same("team_p1", "team_id"), clamp(t - F.col("time_p1"), 0.0, 120.0)).otherwise(0.0)
    turnover = differs("team_p1", "team_id")
    return Block(
        "attack_tempo",
        {
            "possession_duration_before_shot": mean_where(gca, prior), "quick_transition_rate": share_where(turnover, yes(t - F.col("time_p1") <= 5) & gca), "slow_buildup_gca_rate": share_where(gca, prior >= 15),
        },
        after=2,
        before=1,
    )


def pass_tempo() -> Block:
    """Needs gap_1, gap_2 and gap_3 of operators.windows.with_pass_gaps."""
    g1, g2, g3 = (F.col(f"gap_{i}") for i in (1, 2, 3))
    return Block("pass_tempo", {"pass_tempo_variance": F.coalesce(F.var_samp(g1), F.lit(0.0)), "acceleration_phase_count": count_where((g1 > g2) & (g2 > g3))})


def vision() -> Block:
    gca = shot_within(1, 2)
    angle = F.abs(F.degrees(F.atan2(dy(), dx())))
    return Block(
        "vision",
        {
            "switch_play_gca": count_where(is_pass() & (F.abs(dy()) >= 40) & gca), "blind_side_pass_count": count_where(is_pass() & (dx() >= 10) & (F.abs(dy()) / F.greatest(dx(), F.lit(0.1)) < 0.5)),
            "cross_field_progression": count_where(is_pass() & (dx() >= 10) & (F.abs(dy()) >= 10)), "vision_angle_wide_pass": count_where(is_pass() & (angle >= 120)),
        },
        is_pass(),
        after=2,
    )


def dynamic_position() -> Block:
    """Needs x_own and y_own: the player's previous place in the match."""
    spread = lambda c: F.when(F.count(c) > 1, F.max(c) - F.min(c)).otherwise(0.0)
    step = F.coalesce(F.hypot(sx() - F.col("x_own"), sy() - F.col("y_own")), F.lit(0.0))
    zero = F.lit(0.0)
    return Block("dynamic_position", {"position_variance_x": F.coalesce(F.var_samp(sx()), zero), "position_variance_y": F.coalesce(F.var_samp(sy()), zero), "position_range_x": spread(sx()), "position_range_y": spread(sy()), "avg_action_distance": F.avg(step)})


# ---- receiving in the box ----

def received() -> Column:
    """A successful pass into the box that the team keeps."""
    return is_pass() & succeeded() & near(1) & in_box(ex(), ey())


def _wait() -> Column:
    """Seconds to the next action; a missing time is as good as never."""
    return F.coalesce(F.col("time_1") - F.col("time_seconds"), F.lit(999.0))


def box_receiver_volume() -> Block:
    cond, entered = received(), is_pass() & in_box(ex(), ey())
    shot = is_shot("type_1") & yes(_wait() < 3)
    return Block("box_receiver_volume", {"box_receive_count": count_where(cond), "box_receive_to_shot_rate": share_where(cond, shot), "box_receive_success_share": share_where(entered, succeeded())}, entered, after=1)


def box_receiver_timing(touch_s: tuple[float, ...] = (0.7, 1.0, 1.5)) -> Block:
    shot = received() & is_shot("type_1")
    p = F.percentile(F.when(shot, _wait()), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = {f"box_receive_time_to_shot_p{q}": F.coalesce(p[i], F.lit(0.0)) for i, q in enumerate((25, 50, 75))}
    out |= {"box_receive_time_to_next_action_mean": mean_where(received(), _wait()), "one_touch_pass_rate_in_box": share_where(received(), (F.col("type_1") == "pass") & (_wait() < 1))}
    for s in touch_s:
        out[f"first_touch_shot_{str(s).replace('.', 'p')}s_rate"] = share_where(received(), is_shot("type_1") & yes(_wait() < s))
    touched = received() & is_shot("type_1") & yes(_wait() < 1.0)
    known = touched & yes(F.col("bodypart_name").isin(*FEET.values()))
    for name in FEET.values():
        out[f"first_touch_shot_bodypart_share_{name}"] = ratio(count_where(touched & (F.col("bodypart_name") == name)), count_where(known))
    return Block("box_receiver_timing", out, received(), after=1)


def box_receiver_angles() -> Block:
    d, angle = goal_distance(ex(), ey()), F.degrees(goal_angle(ex(), ey()))
    b = {"0_30": angle < 30, "30_60": (angle >= 30) & (angle < 60), "60plus": angle >= 60}
    zero = F.lit(0.0)
    return Block(
        "box_receiver_angles",
        {
            "receive_distance_to_goal_mean": mean_where(received(), d), "receive_distance_to_goal_min": F.coalesce(F.min(F.when(received(), d)), zero), "receive_to_goal_angle_mean": mean_where(received(), goal_angle(ex(), ey())), "receive_to_goal_angle_std": F.coalesce(F.stddev_samp(F.when(received(), goal_angle(ex(), ey()))), zero),
            "facing_forward_30deg_share_in_box": share_where(received(), angle < 30), **{f"receive_angle_bucket_share_{k}": share_where(received(), c) for k, c in b.items()},
        },
        received(),
        after=1,
    )


def box_receiver_origin() -> Block:
    carry = yes(F.col("type_1") == "carry")
    return Block(
        "box_receiver_origin",
        {
            "cross_receive_share_in_box": share_where(received(), F.col("type_name").isin("cross", "corner_crossed", "freekick_crossed")), "cutback_receive_share": share_where(received(), (sx() > 100) & (F.abs(dy()) > 15)),
            "zone14_to_box_receive_share": share_where(received(), in_zone14(sx(), sy())), "halfspace_l_to_box_receive_share": share_where(received(), in_left(sy())), "halfspace_r_to_box_receive_share": share_where(received(), in_right(sy())),
            "carry_after_box_receive_rate": share_where(received(), carry), "carry_after_box_receive_distance_mean": mean_where(received() & carry, goal_distance(ex(), ey())), "carry_to_shot_share_in_box": share_where(received(), carry & is_shot("type_2")),
        },
        received(),
        after=2,
    )


def final_third_receive() -> Block:
    cond = is_pass() & succeeded() & near(1) & yes(ex() >= 70)
    return Block("final_third_receive", {"final_third_receive_count": count_where(cond), "final_third_receive_to_shot_rate": share_where(cond, is_shot("type_1") & yes(_wait() < 3))}, cond, after=1)


def heuristic_value() -> Block:
    """Needs xt_start and xt_end of operators.value.with_heuristic_value."""
    kind = yes(F.col("type_name").isin("pass", "cross", "carry", "dribble", "free_kick", "corner"))
    delta = F.col("xt_end") - F.col("xt_start")
    value = F.when(succeeded(), delta).otherwise(F.col("xt_start") * -0.3)
    w = lambda f, c: f(F.when(kind, c))
    up = F.greatest(delta, F.lit(0.0))
    return Block(
        "heuristic_xt",
        {
            "xt_delta_sum": w(F.sum, delta), "xt_delta_mean": w(F.avg, delta), "xt_delta_max": w(F.max, delta), "xt_positive_sum": w(F.sum, up), "xt_positive_mean": w(F.avg, up),
            "xt_value_sum": w(F.sum, value), "xt_value_mean": w(F.avg, value), "xt_start_mean": w(F.avg, F.col("xt_start")), "xt_start_max": w(F.max, F.col("xt_start")),
        },
        kind,
    )
