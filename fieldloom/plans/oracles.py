"""SQL for the registered queries, in DuckDB's dialect over the same tables, written apart from the DataFrame code."""

from __future__ import annotations

from fieldloom.operators.value import heuristic_grid
from fieldloom.plans.catalog import NINE_DIGITS

_ACTIONS = """
WITH e AS (SELECT event_id, user_id, event_type, CAST(json_extract_string(props,'$.k') AS BIGINT) AS k,
  CAST(hour(ts) AS BIGINT)*3600+minute(ts)*60+second(ts) AS sod, strftime(ts,'%Y-%m-%d') AS match_id FROM events),
actions AS (SELECT event_id AS action_id, match_id, user_id AS player_id, user_id % 2 AS team_id, CASE WHEN sod < 43200 THEN 1 ELSE 2 END AS period_id, CAST(sod % 43200 AS DOUBLE)/16.0::DOUBLE AS time_seconds,
  CASE WHEN event_type IN ('view','click') THEN 'pass' WHEN event_type='signup' THEN 'carry' WHEN event_type='error' THEN 'cross' ELSE 'shot' END AS type_name, CASE WHEN k % 3 <> 0 THEN 'success' ELSE 'fail' END AS result_name,
  CAST((event_id*37) % 1051 AS DOUBLE)/10.0::DOUBLE AS start_x, CAST((event_id*53) % 681 AS DOUBLE)/10.0::DOUBLE AS start_y, CAST((event_id*71) % 1051 AS DOUBLE)/10.0::DOUBLE AS end_x, CAST((event_id*89) % 681 AS DOUBLE)/10.0::DOUBLE AS end_y,
  (user_id % 2)=0 AS is_home, 15+user_id%76 AS minutes_played, CASE k % 4 WHEN 0 THEN 'head' WHEN 1 THEN 'left_foot' ELSE 'right_foot' END AS bodypart_name FROM e),
targets AS (SELECT match_id, player_id, CAST(SUM(CASE WHEN type_name='shot' THEN 1 ELSE 0 END) AS DOUBLE)/10 AS xag, CAST(substr(match_id,9,2) AS INT) % 5 + 1 AS fold, MIN(team_id) AS squad, 1-MIN(team_id) AS opponent, player_id % 3 AS comp
  FROM actions WHERE player_id % 5 <> 4 GROUP BY match_id, player_id),
a AS (SELECT * REPLACE (CASE WHEN NOT is_home THEN 105.0::DOUBLE-start_x ELSE start_x END AS start_x, CASE WHEN NOT is_home THEN 68.0::DOUBLE-start_y ELSE start_y END AS start_y, CASE WHEN NOT is_home THEN 105.0::DOUBLE-end_x ELSE end_x END AS end_x,
  CASE WHEN NOT is_home THEN 68.0::DOUBLE-end_y ELSE end_y END AS end_y) FROM actions SEMI JOIN targets USING (match_id, player_id))"""

_DENSE = _ACTIONS + ", d AS (SELECT * REPLACE (time_seconds/20.0::DOUBLE AS time_seconds) FROM a)"

_GRID = ", ".join(f"{v!r}::DOUBLE" for v in heuristic_grid())
_VALUED = f""",
g AS (SELECT [{_GRID}] AS grid),
h AS (SELECT a.*, grid[1 + CAST(least(greatest(floor(start_x/105.0::DOUBLE*16),0),15)*12 + least(greatest(floor(start_y/68.0::DOUBLE*12),0),11) AS BIGINT)] AS xt_start,
  grid[1 + CAST(least(greatest(floor(end_x/105.0::DOUBLE*16),0),15)*12 + least(greatest(floor(end_y/68.0::DOUBLE*12),0),11) AS BIGINT)] AS xt_end FROM a, g),
v AS (SELECT *, CASE WHEN result_name='success' THEN xt_end ELSE 0.0::DOUBLE END - xt_start AS xt, CAST((action_id*13) % 97 + 1 AS DOUBLE)/99.0::DOUBLE AS xpass_prob FROM h)"""


def _neighbours(source: str, after: int, before: int = 0) -> str:
    w = "OVER (PARTITION BY match_id ORDER BY period_id, time_seconds, action_id)"
    short = {"type": "type_name", "team": "team_id", "player": "player_id", "time": "time_seconds"} | ({"xt": "xt"} if source == "v" else {})
    cols = [f"lead({c},{i}) {w} AS {k}_{i}" for i in range(1, after + 1) for k, c in short.items()]
    cols += [f"lag({c},{i}) {w} AS {k}_p{i}" for i in range(1, before + 1) for k, c in short.items() if k != "xt"]
    return f",\nn AS (SELECT *, {', '.join(cols)} FROM {source})"


_SHOT = "('shot','shot_freekick','shot_penalty')"
_BOX = "(end_x >= 88.5 AND end_y BETWEEN 13.84 AND 54.16)"
_Z14 = "(start_x >= 65 AND start_x < 85 AND start_y BETWEEN 20 AND 48)"
_GCA = f"coalesce((type_1 IN {_SHOT} AND team_1 = team_id) OR (type_2 IN {_SHOT} AND team_2 = team_id), false)"
_LOOSE = f"((coalesce(type_1 IN {_SHOT}, false) OR coalesce(type_2 IN {_SHOT}, false)) AND (coalesce(team_1 = team_id, false) OR coalesce(team_2 = team_id, false)))"
_BY = " GROUP BY match_id, player_id"


def _cnt(cond: str, name: str) -> str:
    return f"CAST(count(*) FILTER (WHERE {cond}) AS BIGINT) AS {name}"


def _mean(cond: str, value: str, name: str) -> str:
    return f"round(coalesce(avg({value}) FILTER (WHERE {cond}), 0.0::DOUBLE), 6) + 0.0 AS {name}"


def _share(cond: str, flag: str, name: str) -> str:
    return _mean(cond, f"CASE WHEN {flag} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END", name)


def _agg(agg: str, name: str) -> str:
    return f"round(coalesce({agg}, 0.0::DOUBLE), 6) + 0.0 AS {name}"


def _per_player(cols: list[str], source: str, where: str = "") -> str:
    return f" SELECT match_id, player_id, {', '.join(cols)} FROM {source}{' WHERE ' + where if where else ''}{_BY}"


def _having(cols: list[str], source: str, rows: str) -> str:
    return _per_player(cols, source) + f" HAVING count(*) FILTER (WHERE {rows}) > 0"


def _half_even(c: str, name: str) -> str:
    """Two places of a value that isn't negative, ties to even, in whole numbers."""
    v = f"CAST(round({c}*1e7) AS BIGINT)"
    return f"CAST({v}//100000 + CASE WHEN {v}%100000>50000 OR ({v}%100000=50000 AND ({v}//100000)%2=1) THEN 1 ELSE 0 END AS DOUBLE)/100.0::DOUBLE AS {name}"


ORACLE_SQL: dict[str, str] = {}
_q = ORACLE_SQL

_q["semi_join_actions"] = _ACTIONS + " SELECT action_id, match_id, player_id FROM a"
_q["flip_coords"] = _ACTIONS + " SELECT action_id, round(start_x,6)+0.0 AS start_x, round(start_y,6)+0.0 AS start_y, round(end_x,6)+0.0 AS end_x, round(end_y,6)+0.0 AS end_y FROM a"
_q["age_days"] = "SELECT o_orderkey, date_diff('day', CAST(o_orderdate AS DATE), DATE '2000-01-01') AS days, round(date_diff('day', CAST(o_orderdate AS DATE), DATE '2000-01-01')/365.25::DOUBLE, 6)+0.0 AS years FROM orders"


def _chain(steps: int, gamma: float, name: str) -> str:
    shot = "+".join(f"CASE WHEN team_{k}=team_id AND type_{k} IN {_SHOT} THEN {gamma ** (k - 1)!r}::DOUBLE ELSE 0 END" for k in range(1, steps + 1))
    gain = "+".join(f"CASE WHEN team_{k}=team_id THEN {gamma ** (k - 1)!r}::DOUBLE*coalesce(xt_{k},0) ELSE 0 END" for k in range(1, steps + 1))
    return _ACTIONS + _VALUED + _neighbours("v", steps) + _per_player([_agg(f"sum({shot})", f"{name}_to_shot"), _agg(f"sum({gain})", f"{name}_xt_delta")], "n")


_q["nstep_chain"] = _chain(3, 0.7, "nstep")
_q["extended_chain"] = _chain(7, 0.6, "longchain")
_second = f"type_name='pass' AND type_1='pass' AND type_2 IN {_SHOT} AND team_1=team_id AND team_2=team_id"
_q["second_assist"] = _ACTIONS + _neighbours("a", 2) + f" SELECT match_id, player_id, count(*) AS second_assist_count FROM n WHERE {_second}{_BY}"
for _k in (1, 2):
    for _name, _more in ((f"sca{_k}", ""), (f"gca{_k}", " AND result_name='success'")):
        _q[_name] = _ACTIONS + _neighbours("a", 0, 2) + f" SELECT match_id, player_p{_k} AS player_id, count(*) AS {_name} FROM n WHERE type_name IN {_SHOT} AND team_p{_k}=team_id AND player_p{_k} IS NOT NULL{_more} GROUP BY 1, 2"
_len = "sqrt(power(end_x-start_x,2)+power(end_y-start_y,2))"
_angle = "atan2(abs(34.0::DOUBLE-end_y), greatest(105.0::DOUBLE-end_x, 1e-6::DOUBLE))"
_dist = "sqrt(power(105.0::DOUBLE-end_x,2)+power(34.0::DOUBLE-end_y,2))"
_q["pass_geometry"] = _ACTIONS + _per_player([f"round(avg({_len}),6)+0.0 AS pass_dist_mean", f"round(max({_len}),6)+0.0 AS pass_dist_max", f"round(avg({_angle}),6)+0.0 AS to_goal_angle_abs_mean", f"round(avg({_dist}),6)+0.0 AS to_goal_dist_mean"], "a", "type_name='pass'")
_q["pass_latency"] = _ACTIONS + _neighbours("a", 1) + _per_player(["round(avg(greatest(time_1-time_seconds,0)),6)+0.0 AS pass_to_shot_latency_mean", "round(min(greatest(time_1-time_seconds,0)),6)+0.0 AS pass_to_shot_latency_min"], "n", f"type_name='pass' AND type_1 IN {_SHOT} AND team_1=team_id")
_ok = "result_name='success'"
_q["xpass_risk"] = _ACTIONS + _VALUED + _per_player(
    [
        f"round(sum((1-xpass_prob)*(CASE WHEN {_ok} THEN xt ELSE 0 END)),6)+0.0 AS risk_creativity_sum", "round(avg(xpass_prob),6)+0.0 AS xpass_mean", "round(min(xpass_prob),6)+0.0 AS xpass_min",
        f"round(avg(CASE WHEN {_ok} THEN 1.0::DOUBLE ELSE 0 END)-avg(xpass_prob),6)+0.0 AS pass_success_minus_xpass", _mean("end_x >= 70", "xpass_prob", "xpass_deep_mean"), _mean("end_x >= 88 AND end_y BETWEEN 14 AND 54", "xpass_prob", "xpass_box_mean"),
    ], "v", "type_name='pass'")
_q["time_blocks"] = _ACTIONS + _per_player([_cnt("period_id=1", "first_half_actions"), _cnt("period_id=2", "second_half_actions"), _cnt("period_id=2 AND time_seconds>=2700", "final_15min_actions"), _cnt("period_id=1 AND time_seconds<=600", "early_10min_actions"), _agg("sum(CASE WHEN period_id=1 THEN time_seconds/2700.0::DOUBLE*0.5::DOUBLE ELSE 0.5::DOUBLE+time_seconds/2700.0::DOUBLE*0.5::DOUBLE END)", "time_weighted_intensity")], "a")
_q["zone_density"] = _ACTIONS + _per_player(
    [
        _cnt("start_x<35", "defensive_zone_actions"), _cnt("start_x>=35 AND start_x<70", "middle_zone_actions"), _cnt("start_x>=70", "attacking_zone_actions"), _cnt("start_y<22.67", "halfspace_left_actions"), _cnt("start_y>45.33", "halfspace_right_actions"),
        _cnt("start_y BETWEEN 22.67 AND 45.33", "central_corridor_actions"), _cnt("start_x>=70", "final_third_penetrations"), _cnt("start_x>=88.5 AND start_y BETWEEN 13.84 AND 54.16", "box_entries"),
    ], "a")
_zones = {"defensive": "start_x<35", "middle": "start_x>=35 AND start_x<70", "attacking": "start_x>=70"}
_q["zone_thirds"] = _ACTIONS + _per_player([_cnt(c, f"zone_{z}_count") for z, c in _zones.items()] + [_share("true", c, f"zone_{z}_ratio") for z, c in _zones.items()], "a")
_q["basic_stats"] = _ACTIONS + _per_player(["count(*) AS action_count", *[_half_even(f"avg(start_{c})", f"avg_{c}") for c in "xy"], "CAST(max(minutes_played) AS DOUBLE) AS minutes_played"], "a")
_q["goal_count"] = _ACTIONS + _per_player([_cnt(f"type_name IN {_SHOT} AND {_ok}", "goal_count")], "a")
_q["type_pivot"] = _ACTIONS + _per_player([_cnt(f"type_name='{k}'", f"type_{k}_count") for k in ("pass", "cross", "carry", "shot")], "a")
_q["success_rates"] = _ACTIONS + _per_player([_share(f"type_name='{k}'", _ok, f"{k}_success_rate") for k in ("pass", "shot", "take_on", "cross", "corner_crossed", "freekick_crossed")], "a")
_off, _def = "type_name IN ('shot','pass','cross','take_on','dribble')", "type_name IN ('tackle','interception','clearance')"
_q["attack_defence"] = _ACTIONS + _having([_cnt(_off, "type_offensive_actions"), _cnt(_def, "type_defensive_actions"), _share(f"{_off} OR {_def}", _off, "type_offensive_action_ratio")], "a", f"{_off} OR {_def}")
_q["pass_to_shot"] = _ACTIONS + _neighbours("a", 1) + f" SELECT match_id, player_id, count(*) AS pass_leads_to_shot FROM n WHERE type_name='pass' AND type_1='shot'{_BY}"
_minutes = {"action_count": "true", "goal_count": f"type_name IN {_SHOT} AND {_ok}"} | {f"type_{k}_count": f"type_name='{k}'" for k in ("pass", "cross", "carry", "shot")}
_q["per_minute"] = _ACTIONS + _per_player([f"round(count(*) FILTER (WHERE {c})/max(CAST(minutes_played AS DOUBLE)),6)+0.0 AS {n}_per_minute" for n, c in _minutes.items()], "a")
_pp = "type_name IN ('pass','cross','freekick_crossed','corner_crossed')"
_pf = f"{_pp} AND (end_x-start_x>=10 OR (start_x<70 AND end_x>=70) OR end_x>=85)"
_q["progressive_pass"] = _ACTIONS + _having(
    [
        _cnt(_pf, "progressive_pass_count"), _cnt(f"{_pf} AND {_ok}", "progressive_pass_success"), _agg(f"sum({_len}) FILTER (WHERE {_pf})", "progressive_pass_distance_total"), _mean(_pf, _len, "progressive_pass_distance_mean"), _share(_pf, _ok, "progressive_pass_success_rate"),
        _cnt(f"{_pp} AND {_ok} AND start_x<70 AND end_x>=70", "final_third_entry_count"), _cnt(f"{_pp} AND {_ok} AND end_x>=85", "deep_completion_count"), _cnt(f"{_pp} AND {_ok} AND end_x>=88", "penalty_area_entry_count"),
    ], "a", _pp)
_cc = "type_name IN ('carry','dribble','take_on')"
_cf = f"{_cc} AND (end_x-start_x>=5 OR (start_x<70 AND end_x>=70))"
_q["progressive_carry"] = _ACTIONS + _having([_cnt(_cf, "progressive_carry_count"), _cnt(f"{_cf} AND {_ok}", "progressive_carry_success"), _agg(f"sum({_len}) FILTER (WHERE {_cf})", "progressive_carry_distance_total"), _mean(_cf, _len, "progressive_carry_distance_mean"), _share(_cf, _ok, "progressive_carry_success_rate")], "a", _cc)
_hl, _hr = f"type_name='pass' AND start_y<22.67 AND {_BOX}", f"type_name='pass' AND start_y>45.33 AND {_BOX}"
_cb = "type_name='pass' AND start_x>=95 AND (start_y<20 OR start_y>48) AND (end_x<start_x OR abs(end_y-start_y)>10)"
_z = f"type_name='pass' AND {_Z14}"
_q["gca_spatial"] = _ACTIONS + _neighbours("a", 2) + _having(
    [
        _cnt(_z, "zone14_origin_pass_count"), _share(_z, _ok, "zone14_origin_pass_success_rate"), _cnt(f"{_z} AND {_GCA}", "zone14_pregca_count"), _cnt(_hl, "halfspace_l_to_box_count"), _share(_hl, _ok, "halfspace_l_to_box_success_rate"), _cnt(_hr, "halfspace_r_to_box_count"),
        _share(_hr, _ok, "halfspace_r_to_box_success_rate"), _cnt(_cb, "cutback_count"), _share(_cb, _ok, "cutback_success_rate"), _share(_cb, f"type_1 IN {_SHOT} AND team_1=team_id", "cutback_next_shot_rate"),
    ], "n", f"({_z}) OR ({_hl}) OR ({_hr}) OR ({_cb})")
_t = lambda c: f"CASE WHEN {c}>=0 AND {c}<=35 THEN 0 WHEN {c}>35 AND {c}<=70 THEN 1 WHEN {c}>70 AND {c}<=105 THEN 2 END"
_cross = f"(({_t('start_x')}) IS NULL OR ({_t('end_x')}) IS NULL OR ({_t('start_x')})<>({_t('end_x')})) AND end_x-start_x>=10.5 AND {_ok}"
_chan = f"start_y BETWEEN 22.67 AND 45.33 AND end_x-start_x>=10.5 AND {_ok}"
_q["linebreak_packing"] = _ACTIONS + _per_player([_cnt(_cross, "linebreak_third_transition_count"), _share("true", _cross, "linebreak_third_transition_rate"), _cnt(_chan, "through_channel_pass_count"), _share("true", _chan, "through_channel_pass_rate"), _mean("true", f"CASE ({_t('end_x')})-({_t('start_x')}) WHEN 1 THEN 1.0::DOUBLE WHEN 2 THEN 3.0::DOUBLE ELSE 0.0::DOUBLE END", "packing_approx_score_mean")], "a", "type_name='pass'")
# both zones are looked up one by one, and a missing one is the first; zones of which one is missing differ
_q["linebreak_missing_zones"] = _ACTIONS + ", m AS (SELECT * REPLACE (CASE WHEN action_id % 7 = 0 THEN NULL WHEN action_id % 13 = 0 THEN start_x - 40 ELSE start_x END AS start_x, CASE WHEN action_id % 17 = 0 THEN NULL WHEN action_id % 11 = 0 THEN end_x + 60 ELSE end_x END AS end_x) FROM a)" + _per_player(
    [
        _cnt(_cross, "linebreak_third_transition_count"), _share("true", _cross, "linebreak_third_transition_rate"), _cnt(_chan, "through_channel_pass_count"), _share("true", _chan, "through_channel_pass_rate"),
        _mean("true", f"CASE greatest(coalesce({_t('end_x')}, 0) - coalesce({_t('start_x')}, 0), 0) WHEN 1 THEN 1.0::DOUBLE WHEN 2 THEN 3.0::DOUBLE ELSE 0.0::DOUBLE END", "packing_approx_score_mean"),
    ], "m", "type_name='pass'")
_one_two = "type_name='pass' AND type_1='pass' AND team_1=team_id AND player_2=player_id AND time_2-time_seconds<=3"
_third = f"type_name='pass' AND type_1='pass' AND type_2='pass' AND type_3 IN {_SHOT} AND team_1=team_id AND team_2=team_id AND team_3=team_id"
_q["chain_quality"] = _DENSE + _neighbours("d", 3) + _per_player([_cnt(_one_two, "one_two_chain_count"), _cnt(_third, "third_man_release_count"), _share("true", f"coalesce(time_2-time_seconds,999)<=5 AND type_2 IN {_SHOT} AND team_2=team_id", "burst_window_sca_rate")], "n")
_pb = f"type_name='pass' AND {_BOX}"
_q["box_entry"] = _DENSE + _neighbours("d", 1) + _having(
    [
        _cnt(f"{_pb} AND {_Z14}", "box_entry_from_zone14_count"), _cnt(f"{_pb} AND start_y<22.67", "box_entry_from_halfspace_l_count"), _cnt(f"{_pb} AND start_y>45.33", "box_entry_from_halfspace_r_count"),
        _share(_BOX, f"{_angle}<0.785", "facing_forward_share_in_box"), _share(_BOX, f"type_1 IN {_SHOT} AND coalesce(time_1-time_seconds,999)<1", "first_touch_shot_rate_in_box"),
    ], "n", _BOX)
_dead = "type_name IN ('corner','freekick_short','freekick_crossed','throw_in')"
_q["setplay_share"] = _ACTIONS + _neighbours("a", 2) + _per_player([_share(_dead, _LOOSE, "setplay_gca_share"), _share(f"NOT {_dead}", _LOOSE, "openplay_gca_share")], "n")
_feet = {"right": "right_foot", "left": "left_foot", "head": "head"}
_q["bodypart_pivot"] = _ACTIONS + _neighbours("a", 2) + _having([_cnt(f"type_name='pass' AND {_LOOSE} AND bodypart_name='{v}'", f"bodypart_on_key_pass_rate_{k}") for k, v in _feet.items()], "n", f"type_name='pass' AND {_LOOSE}")
_prior = "CASE WHEN team_p1=team_id THEN least(greatest(time_seconds-time_p1,0),120) ELSE 0.0::DOUBLE END"
_turn = "(team_p1 IS NULL OR team_p1<>team_id)"
_q["attack_tempo"] = _ACTIONS + _neighbours("a", 2, 1) + _per_player([_mean(_GCA, _prior, "possession_duration_before_shot"), _share(_turn, f"time_seconds-time_p1<=5 AND {_GCA}", "quick_transition_rate"), _share(_GCA, f"({_prior})>=15", "slow_buildup_gca_rate")], "n")
_wt = "OVER (PARTITION BY match_id, team_id ORDER BY period_id, time_seconds, action_id)"
_q["pass_tempo"] = _ACTIONS + f""", p AS (SELECT *, least(greatest(lead(time_seconds) {_wt} - time_seconds, 0), 60) AS g0, lead(time_seconds) {_wt} AS nx FROM a WHERE type_name='pass'),
q AS (SELECT *, CASE WHEN nx IS NOT NULL THEN g0 END AS g1 FROM p), r AS (SELECT *, lead(g1,1) {_wt} AS g2, lead(g1,2) {_wt} AS g3 FROM q)""" + _per_player([_agg("var_samp(g1)", "pass_tempo_variance"), _cnt("g1>g2 AND g2>g3", "acceleration_phase_count")], "r")
_q["vision"] = _ACTIONS + _neighbours("a", 2) + _per_player([_cnt(f"abs(end_y-start_y)>=40 AND {_GCA}", "switch_play_gca"), _cnt("end_x-start_x>=10 AND abs(end_y-start_y)/greatest(end_x-start_x,0.1::DOUBLE)<0.5", "blind_side_pass_count"), _cnt("end_x-start_x>=10 AND abs(end_y-start_y)>=10", "cross_field_progression"), _cnt("abs(degrees(atan2(end_y-start_y,end_x-start_x)))>=120", "vision_angle_wide_pass")], "n", "type_name='pass'")
_wp = "OVER (PARTITION BY match_id, player_id ORDER BY period_id, time_seconds, action_id)"
_q["dynamic_position"] = _ACTIONS + f", p AS (SELECT *, lag(start_x) {_wp} AS xo, lag(start_y) {_wp} AS yo FROM a)" + _per_player([_agg("var_samp(start_x)", "position_variance_x"), _agg("var_samp(start_y)", "position_variance_y"), _agg("max(start_x)-min(start_x)", "position_range_x"), _agg("max(start_y)-min(start_y)", "position_range_y"), _agg("avg(coalesce(sqrt(power(start_x-xo,2)+power(start_y-yo,2)),0))", "avg_action_distance")], "p")

_R = f"(type_name='pass' AND {_ok} AND coalesce(team_1=team_id,false) AND {_BOX})"
_wait = "(time_1-time_seconds)"
_rs = f"{_R} AND type_1 IN {_SHOT}"
_q["box_receiver_volume"] = _ACTIONS + _neighbours("a", 1) + _having([_cnt(_R, "box_receive_count"), _share(_R, f"type_1 IN {_SHOT} AND {_wait}<3", "box_receive_to_shot_rate"), _share(_pb, _ok, "box_receive_success_share")], "n", _pb)
_q["box_receiver_timing"] = _ACTIONS + _neighbours("a", 1) + _having(
    [
        *[_agg(f"quantile_cont({_wait},{p}) FILTER (WHERE {_rs})", f"box_receive_time_to_shot_p{n}") for p, n in ((0.25, 25), (0.5, 50), (0.75, 75))], _mean(_R, _wait, "box_receive_time_to_next_action_mean"), _share(_R, f"type_1='pass' AND {_wait}<1", "one_touch_pass_rate_in_box"),
        *[_share(_R, f"type_1 IN {_SHOT} AND {_wait}<{s}", f"first_touch_shot_{n}s_rate") for s, n in ((0.7, "0p7"), (1.0, "1p0"), (1.5, "1p5"))],
        *[_share(f"{_rs} AND {_wait}<1.0", f"bodypart_name='{b}'", f"first_touch_shot_bodypart_share_{b}") for b in ("right_foot", "left_foot", "head")],
    ], "n", _R)
_deg = f"degrees({_angle})"
_q["box_receiver_angles"] = _ACTIONS + _neighbours("a", 1) + _having(
    [
        _mean(_R, _dist, "receive_distance_to_goal_mean"), _agg(f"min({_dist}) FILTER (WHERE {_R})", "receive_distance_to_goal_min"), _mean(_R, _angle, "receive_to_goal_angle_mean"), _agg(f"stddev_samp({_angle}) FILTER (WHERE {_R})", "receive_to_goal_angle_std"), _share(_R, f"{_deg}<30", "facing_forward_30deg_share_in_box"),
        _share(_R, f"{_deg}<30", "receive_angle_bucket_share_0_30"), _share(_R, f"{_deg}>=30 AND {_deg}<60", "receive_angle_bucket_share_30_60"), _share(_R, f"{_deg}>=60", "receive_angle_bucket_share_60plus"),
    ], "n", _R)
_q["box_receiver_origin"] = _ACTIONS + _neighbours("a", 2) + _having(
    [
        _share(_R, "type_name IN ('cross','corner_crossed','freekick_crossed')", "cross_receive_share_in_box"), _share(_R, "start_x>100 AND abs(end_y-start_y)>15", "cutback_receive_share"), _share(_R, _Z14, "zone14_to_box_receive_share"), _share(_R, "start_y<22.67", "halfspace_l_to_box_receive_share"),
        _share(_R, "start_y>45.33", "halfspace_r_to_box_receive_share"), _share(_R, "type_1='carry'", "carry_after_box_receive_rate"), _mean(f"{_R} AND type_1='carry'", _dist, "carry_after_box_receive_distance_mean"), _share(_R, f"type_1='carry' AND type_2 IN {_SHOT}", "carry_to_shot_share_in_box"),
    ], "n", _R)
_ft = f"type_name='pass' AND {_ok} AND team_1=team_id AND end_x>=70"
_q["final_third_receive"] = _ACTIONS + _neighbours("a", 1) + _having([_cnt(_ft, "final_third_receive_count"), _share(_ft, f"type_1 IN {_SHOT} AND {_wait}<3", "final_third_receive_to_shot_rate")], "n", _ft)

# ---- possessions, form, context ----
_wm = "OVER (PARTITION BY match_id ORDER BY period_id, time_seconds, action_id)"
_POSS = _DENSE + _VALUED.replace("a.*", "d.*").replace("FROM a, g", "FROM d, g") + f""",
f AS (SELECT *, CASE WHEN lag(team_id) {_wm} = team_id AND lag(result_name) {_wm} = 'success' AND time_seconds - lag(time_seconds) {_wm} <= 15 THEN 0 ELSE 1 END AS fresh FROM v),
s AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY match_id ORDER BY period_id, time_seconds, action_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS possession_no FROM f),
st AS (SELECT *, row_number() OVER (PARTITION BY match_id, possession_no ORDER BY period_id, time_seconds, action_id) AS step FROM s),
ends AS (SELECT match_id, possession_no, max(step) AS last_step FROM st GROUP BY 1, 2),
po AS (SELECT st.match_id, st.possession_no, max(team_id) FILTER (WHERE step=1) AS team_id, max(start_x) FILTER (WHERE step=1) AS x0, max(start_y) FILTER (WHERE step=1) AS y0, max(end_x) FILTER (WHERE step=last_step) AS x1, max(end_y) FILTER (WHERE step=last_step) AS y1,
  max(time_seconds) FILTER (WHERE step=1) AS t0, max(time_seconds) FILTER (WHERE step=last_step) AS t1, count(player_id) AS action_count, count(DISTINCT player_id) AS unique_players, sum(greatest(xt,0)) AS xt_positive_sum, sum(xt) AS xt_delta_sum,
  min(step) FILTER (WHERE end_x>=70) AS final_third_step, min(time_seconds) FILTER (WHERE end_x>=70) AS ft FROM st JOIN ends ON st.match_id=ends.match_id AND st.possession_no=ends.possession_no GROUP BY 1, 2),
pt AS (SELECT *, greatest(t1-t0,1) AS duration, sqrt(power(x1-x0,2)+power(y1-y0,2)) AS ground_distance FROM po),
pz AS (SELECT match_id, possession_no, team_id, action_count, unique_players, duration, ground_distance, CASE WHEN ground_distance>0 THEN (x1-x0)/ground_distance ELSE 0 END AS directness, (x1-x0)/duration AS speed_x, ground_distance/duration AS speed_ground, xt_positive_sum, xt_delta_sum,
  xt_positive_sum/duration AS xt_positive_per_second, CASE WHEN final_third_step IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS final_third_flag, final_third_step, ft-t0 AS time_to_final_third FROM pt)"""
_pcols = ("duration", "ground_distance", "directness", "speed_x", "speed_ground", "xt_positive_sum", "xt_delta_sum", "xt_positive_per_second", "final_third_flag", "time_to_final_third")
_q["possession_table"] = _POSS + f" SELECT match_id, possession_no, team_id, action_count, unique_players, coalesce(final_third_step,-1) AS final_third_step, {', '.join(f'round({c},6)+0.0 AS {c}' for c in _pcols)} FROM pz"
_pmeans = {"duration": "duration_mean", "ground_distance": "ground_distance_mean", "directness": "directness_mean", "speed_x": "speed_x_mean", "speed_ground": "speed_ground_mean", "xt_positive_per_second": "xt_positive_per_second_mean", "action_count": "actions_per_pos_mean", "final_third_flag": "final_third_rate", "final_third_step": "final_third_step_mean", "time_to_final_third": "time_to_final_third_mean"}
_q["possession_player"] = _POSS + ", pp AS (SELECT DISTINCT match_id, player_id, possession_no FROM st) SELECT match_id, player_id, count(*) AS possession_count, " + ", ".join([*[_agg(f"avg({c})", f"possession_{n}") for c, n in _pmeans.items()], _agg("sum(xt_positive_sum)", "possession_xt_positive_sum"), _agg("sum(xt_delta_sum)", "possession_xt_delta_sum")]) + " FROM pp JOIN pz USING (match_id, possession_no)" + _BY
_q["player_trend"] = _ACTIONS + """,
tr AS (SELECT match_id, player_id, avg(xag) OVER (PARTITION BY player_id ORDER BY match_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS x, avg(xag) OVER (PARTITION BY player_id ORDER BY match_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS r, xag-lag(xag) OVER (PARTITION BY player_id ORDER BY match_id) AS d FROM targets WHERE fold<=4),
rk AS (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY match_id DESC) AS k FROM targets WHERE fold<=4), hi AS (SELECT player_id, avg(xag) AS x, avg(xag) FILTER (WHERE k<=3) AS r, max(xag) FILTER (WHERE k=1) AS l FROM rk GROUP BY 1),
te AS (SELECT t.match_id, t.player_id, x, r, t.xag-l AS d FROM targets t LEFT JOIN hi USING (player_id) WHERE fold>4), al AS (SELECT * FROM tr UNION ALL SELECT * FROM te)
SELECT match_id, player_id, """ + ", ".join(f"round(coalesce({c},0),6)+0.0 AS xag_{n}" for c, n in (("x", "expanding_mean"), ("r", "rolling3_mean"), ("d", "diff_prev"))) + " FROM al"
_q["team_context"] = _ACTIONS + ", tc AS (SELECT *, sum(xag) OVER (PARTITION BY match_id, squad) AS s FROM targets) SELECT match_id, player_id, round(s,6)+0.0 AS xag_team_sum, round(CASE WHEN s=0 THEN 0 ELSE xag/s END,6)+0.0 AS xag_team_share, round(s-xag,6)+0.0 AS xag_team_lopo FROM tc"

# ---- values ----
_hx = ("xt_end-xt_start", "greatest(xt_end-xt_start,0)", f"CASE WHEN {_ok} THEN xt_end-xt_start ELSE xt_start*-0.3::DOUBLE END", "xt_start")
_q["heuristic_xt"] = _ACTIONS + _VALUED + _per_player([f"round({f}({_hx[i]}),6)+0.0 AS {n}" for f, i, n in (("sum", 0, "xt_delta_sum"), ("avg", 0, "xt_delta_mean"), ("max", 0, "xt_delta_max"), ("sum", 1, "xt_positive_sum"), ("avg", 1, "xt_positive_mean"), ("sum", 2, "xt_value_sum"), ("avg", 2, "xt_value_mean"), ("avg", 3, "xt_start_mean"), ("max", 3, "xt_start_max"))], "v", "type_name IN ('pass','cross','carry','dribble','free_kick','corner')")
_cell = lambda x, y: f"CAST(least(greatest(floor({y}*12/68.0::DOUBLE),0),11)*16+least(greatest(floor({x}*16/105.0::DOUBLE),0),15) AS INT)"
_mv = "type_name IN ('pass','cross','carry','dribble','take_on','freekick_crossed','corner_crossed','throw_in','goal_kick','clearance')"
_q["xt_transition_counts"] = _ACTIONS + f""" SELECT {_cell('start_x', 'start_y')} AS start_zone, CASE WHEN {_mv} AND {_ok} THEN {_cell('end_x', 'end_y')} ELSE -1 END AS end_zone, CAST(sum(CASE WHEN {_mv} AND {_ok} THEN 1 ELSE 0 END) AS BIGINT) AS moves,
 CAST(sum(CASE WHEN type_name IN {_SHOT} THEN 1 ELSE 0 END) AS BIGINT) AS shots, CAST(sum(CASE WHEN type_name IN {_SHOT} AND {_ok} THEN 1 ELSE 0 END) AS BIGINT) AS goals, CAST(sum(CASE WHEN {_mv} AND NOT {_ok} THEN 1 ELSE 0 END) AS BIGINT) AS losses FROM a WHERE {_mv} OR type_name IN {_SHOT} GROUP BY 1, 2"""

# ---- networks ----
_CHAIN = _ACTIONS + f", ps AS (SELECT match_id, team_id, player_id AS src, lead(player_id) {_wt} AS dst FROM a WHERE type_name='pass'), pr AS (SELECT * FROM ps WHERE dst IS NOT NULL AND dst<>src)"
_entropy = lambda names: f", us AS (SELECT match_id, src, dst, count(*) AS n FROM pr GROUP BY 1,2,3), sh AS (SELECT match_id, src, n/CAST(sum(n) OVER (PARTITION BY match_id, src) AS DOUBLE) AS p FROM us) SELECT match_id, src AS player_id, round(-sum(p*log2(p+1e-9::DOUBLE)),6)+0.0 AS {names[0]}, count(*) AS {names[1]} FROM sh GROUP BY 1, 2"
_q["pass_entropy"] = _CHAIN + _entropy(("pass_receiver_diversity", "unique_pass_partners"))
_q["pass_degree"] = _CHAIN + """, ed AS (SELECT match_id, team_id, src, dst, count(*) AS w FROM pr GROUP BY 1,2,3,4), en AS (SELECT match_id, team_id, src AS player_id, w AS o, 0 AS i FROM ed UNION ALL SELECT match_id, team_id, dst, 0, w FROM ed),
ag AS (SELECT match_id, team_id, player_id, CAST(sum(o) AS BIGINT) AS o, CAST(sum(i) AS BIGINT) AS i, count(*) AS k FROM en GROUP BY 1,2,3) SELECT match_id, team_id, player_id, o AS pass_net_out_degree, i AS pass_net_in_degree, round(k/CAST(count(*) OVER (PARTITION BY match_id, team_id)-1 AS DOUBLE),6)+0.0 AS degree_centrality FROM ag"""
_REC = _ACTIONS + _neighbours("a", 1) + f", rc AS (SELECT match_id, team_id, player_id AS src, player_1 AS dst, end_x, end_y FROM n WHERE type_name='pass' AND {_ok} AND team_1=team_id)"
_q["passnet_edges"] = _REC + " SELECT match_id, team_id, src, dst, count(*) AS weight FROM rc GROUP BY 1,2,3,4"
_q["passnet_receive"] = _REC + " SELECT match_id, dst AS player_id, count(*) AS pass_net_receive_count FROM rc GROUP BY 1,2"
_q["passnet_attempts"] = _ACTIONS + _per_player(["count(*) AS pass_net_attempts", _agg(f"avg({_len})", "pass_net_avg_distance"), _share("true", "abs(end_y-start_y)>=20", "pass_net_switch_rate")], "a", "type_name='pass'")
_q["box_receiver_diversity"] = _REC + f", pr AS (SELECT * FROM rc WHERE {_BOX})" + _entropy(("box_receiver_diversity", "unique_box_receivers"))

# ---- expected value ----
_EX = _ACTIONS + _VALUED + """, x AS (SELECT *, type_name AS grp, CAST(substr(match_id,9,2) AS INT) % 5 + 1 AS fold, xpass_prob*xt AS success, (1-xpass_prob)*xt_start AS fail_raw, 1-xpass_prob AS fail_weight FROM v WHERE type_name IN ('pass','cross','carry')),
gf AS (SELECT DISTINCT grp, fold FROM x), mo AS (SELECT gf.grp, gf.fold, avg(x.xt_start) AS mean, stddev_pop(x.xt_start) AS std FROM gf JOIN x ON x.grp=gf.grp AND x.fold<>gf.fold GROUP BY 1,2),
al AS (SELECT avg(xt_start) AS mean, CASE WHEN stddev_pop(xt_start)>=1e-6 THEN stddev_pop(xt_start) ELSE 1 END AS std FROM x),
pq AS (SELECT val, below, total FROM (SELECT xt_start AS val, sum(count(*)) OVER (ORDER BY xt_start) - count(*) AS below, sum(count(*)) OVER () AS total FROM x WHERE grp='pass' GROUP BY xt_start)),
y AS (SELECT x.*, x.fail_weight*CASE WHEN x.grp='pass' THEN least(greatest((pq.below+0.5::DOUBLE)/pq.total,1e-6::DOUBLE),1-1e-6::DOUBLE)-0.5::DOUBLE ELSE (x.xt_start-coalesce(mo.mean,al.mean))/CASE WHEN mo.std>1e-6 THEN mo.std ELSE al.std END END AS fail_scaled
  FROM x LEFT JOIN mo ON x.grp=mo.grp AND x.fold=mo.fold LEFT JOIN pq ON x.grp='pass' AND x.xt_start=pq.val, al),
cs AS (SELECT match_id, player_id, grp, sum(success) AS success_sum, sum(fail_scaled) AS fail_scaled_sum, sum(fail_raw) AS fail_raw_sum, sum(fail_weight) AS fail_weight_sum, count(success) AS action_count FROM y GROUP BY 1,2,3)"""
_q["edxt_components"] = _EX + ' SELECT match_id, player_id, grp AS "group", action_count, ' + ", ".join(f"round({c},6)+0.0 AS {c}" for c in ("success_sum", "fail_scaled_sum", "fail_raw_sum", "fail_weight_sum")) + " FROM cs"
_q["edxt_fold_norm"] = _EX + """, md AS (SELECT gf.grp, gf.fold, quantile_cont(x.xt_start,0.5) AS median FROM gf JOIN x ON x.grp=gf.grp AND x.fold<>gf.fold GROUP BY 1,2), ma AS (SELECT md.grp, md.fold, max(median) AS median, quantile_cont(abs(x.xt_start-median),0.5) AS mad FROM md JOIN x ON x.grp=md.grp AND x.fold<>md.fold GROUP BY 1,2)
SELECT mo.grp AS "group", mo.fold, round(mean,6)+0.0 AS mean, round(std,6)+0.0 AS std, round(median,6)+0.0 AS median, round(mad,6)+0.0 AS mad FROM mo JOIN ma ON mo.grp=ma.grp AND mo.fold=ma.fold"""
_q["lambda_stats"] = _EX + """, ls AS (SELECT grp, fold, CASE WHEN xag>=0.1 THEN 5.0::DOUBLE ELSE 1.0::DOUBLE END AS w, xag-success_sum AS r, fail_scaled_sum AS q FROM cs JOIN targets USING (match_id, player_id))
SELECT grp AS "group", fold, count(*) AS n, round(sum(w*r*r),6)+0.0 AS wrr, round(sum(w*r*q),6)+0.0 AS wrq, round(sum(w*q*q),6)+0.0 AS wqq FROM ls GROUP BY 1,2"""
_q["quantile_center"] = _EX + """, rf AS (SELECT start_x AS val, count(*) AS c FROM x WHERE grp='pass' AND fold<=4 GROUP BY 1), dv AS (SELECT DISTINCT start_x AS val FROM x WHERE grp='pass'),
cu AS (SELECT dv.val, coalesce(sum(rf.c) OVER (ORDER BY dv.val ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS below FROM dv LEFT JOIN rf USING (val)), tt AS (SELECT sum(c) AS total FROM rf)
SELECT action_id, round(least(greatest((below+0.5::DOUBLE)/total,1e-6::DOUBLE),1-1e-6::DOUBLE)-0.5::DOUBLE,6)+0.0 AS centred FROM x JOIN cu ON x.start_x=cu.val, tt WHERE grp='pass'"""
_q["quantile_center_missing"] = _EX + """, z AS (SELECT action_id, fold, CASE WHEN action_id % 7 = 0 THEN NULL WHEN action_id % 13 = 0 THEN start_x - 40 ELSE start_x END AS val FROM x WHERE grp='pass'),
rf AS (SELECT val FROM z WHERE fold<=4 AND val IS NOT NULL), dv AS (SELECT DISTINCT val FROM z WHERE val IS NOT NULL), cc AS (SELECT val, count(*) AS c FROM rf GROUP BY val),
cu AS (SELECT dv.val, coalesce(sum(cc.c) OVER (ORDER BY dv.val ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS below FROM dv LEFT JOIN cc USING (val))
SELECT action_id, CASE WHEN below IS NOT NULL THEN round(least(greatest((below+0.5::DOUBLE)/(SELECT count(*) FROM rf),1e-6::DOUBLE),1-1e-6::DOUBLE)-0.5::DOUBLE,6)+0.0 END AS centred FROM z LEFT JOIN cu ON z.val=cu.val"""


_q["one_hot_union"] = "SELECT o_orderkey, " + ", ".join(f"CASE WHEN o_orderpriority LIKE '{i}%' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS is_{i}" for i in range(1, 6)) + " FROM orders"
_q["dictionary_codes"] = "SELECT value, row_number() OVER (ORDER BY n DESC, value) - 1 AS code FROM (SELECT CAST(l_partkey AS VARCHAR) AS value, count(*) AS n FROM lineitem GROUP BY 1)"
_q["selected_columns"] = _ACTIONS + " SELECT action_id, start_x, start_y FROM actions"


# ---- encodings ----
def _enc(key: str, alpha: float, source: str = "targets", name: str = "te") -> str:
    return f", {name} AS (SELECT k.{key}, k.fold, (coalesce(sum(o.xag),0)+{alpha!r}::DOUBLE*(SELECT avg(xag) FROM targets))/(count(o.xag)+{alpha!r}::DOUBLE) AS enc FROM (SELECT DISTINCT {key}, fold FROM {source}) k LEFT JOIN {source} o ON o.{key}=k.{key} AND o.fold<>k.fold GROUP BY 1,2)"


_q["target_encoding_oof"] = _ACTIONS + _enc("player_id", 10.0) + " SELECT player_id, fold, round(enc,6)+0.0 AS player_id_target_enc FROM te"
_q["target_encoding_cross"] = _ACTIONS + ", tx AS (SELECT *, CAST(squad AS VARCHAR)||'_vs_'||CAST(opponent AS VARCHAR) AS matchup FROM targets)" + _enc("matchup", 10.0, "tx") + " SELECT matchup, fold, round(enc,6)+0.0 AS matchup_target_enc FROM te"
_q["comp_residuals"] = _ACTIONS + _enc("comp", 5.0, name="c") + _enc("squad", 10.0, name="s") + _enc("opponent", 10.0, name="o") + " SELECT match_id, player_id, round(c.enc,6)+0.0 AS comp_target_enc, round(s.enc-c.enc,6)+0.0 AS squad_comp_residual, round(s.enc-(SELECT avg(xag) FROM targets),6)+0.0 AS squad_global_residual, round(s.enc-o.enc,6)+0.0 AS squad_vs_opponent_gap FROM targets t JOIN c ON c.comp=t.comp AND c.fold=t.fold JOIN s ON s.squad=t.squad AND s.fold=t.fold JOIN o ON o.opponent=t.opponent AND o.fold=t.fold"
_q["comp_residuals_missing"] = _ACTIONS + f""", g AS (SELECT match_id, player_id, CASE WHEN fold <= 4 THEN xag END AS xag, CASE WHEN fold <= 4 THEN fold END AS fold, CASE WHEN player_id % 7 <> 0 THEN squad END AS squad, CASE WHEN player_id % 11 <> 0 THEN opponent END AS opponent, CASE WHEN player_id % 13 <> 0 THEN comp END AS comp FROM targets),
kn AS (SELECT * FROM g WHERE fold IS NOT NULL), am AS (SELECT avg(xag) AS am FROM kn),
en AS (SELECT match_id, player_id, am, c, s, o FROM (SELECT g.match_id, g.player_id, am.am, {', '.join(f"coalesce(e{k}.enc, am.am) AS {k}" for k in "cso")} FROM g CROSS JOIN am {' '.join(f"LEFT JOIN e{k} ON e{k}.{c} = g.{c} AND e{k}.fold IS NOT DISTINCT FROM g.fold" for k, c in (("c", "comp"), ("s", "squad"), ("o", "opponent")))}) q)
SELECT match_id, player_id, round(c,6)+0.0 AS comp_target_enc, round(s-c,6)+0.0 AS squad_comp_residual, round(s-am,6)+0.0 AS squad_global_residual, round(s-o,6)+0.0 AS squad_vs_opponent_gap FROM en"""
_q["comp_residuals_missing"] = _q["comp_residuals_missing"].replace("en AS (SELECT match_id", ", ".join(
    f"e{k} AS (SELECT t.{c}, t.fold, CASE WHEN count(o.xag) > 0 THEN (sum(o.xag) + {a!r}::DOUBLE * max(am.am)) / (count(o.xag) + {a!r}::DOUBLE) ELSE max(am.am) END AS enc FROM (SELECT DISTINCT {c}, fold FROM g WHERE {c} IS NOT NULL) t CROSS JOIN am LEFT JOIN kn o ON o.{c} = t.{c} AND (t.fold IS NULL OR o.fold <> t.fold) GROUP BY t.{c}, t.fold)"
    for k, c, a in (("c", "comp", 5.0), ("s", "squad", 10.0), ("o", "opponent", 10.0))) + ",\nen AS (SELECT match_id")
_before = lambda c: f"(coalesce(sum(xag) OVER (PARTITION BY {c} ORDER BY o, match_id, player_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0)+(SELECT avg(xag) FROM targets))/(count(xag) OVER (PARTITION BY {c} ORDER BY o, match_id, player_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)+1.0::DOUBLE)"
_q["ordered_target"] = _ACTIONS + ", t AS (SELECT *, (player_id*37+fold*11) % 101 AS o FROM targets) SELECT match_id, player_id, " + ", ".join(f"round({_before(c)},6)+0.0 AS {c}_ordered_enc" for c in ("comp", "squad")) + " FROM t"
_q["league_gate"] = _ACTIONS + " SELECT match_id, player_id, " + ", ".join(f"CASE WHEN comp={v} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS comp_{v}, CASE WHEN comp={v} THEN xag ELSE 0.0::DOUBLE END AS xag__comp_gate_{v}" for v in (0, 1, 2)) + " FROM targets"

# ---- folds, weights, metrics ----
_PRED = _ACTIONS + ", p AS (SELECT *, xag*0.5::DOUBLE+(CAST((player_id*31+fold*7) % 101 AS DOUBLE)/100.0::DOUBLE)*0.3::DOUBLE AS a, xag*0.4::DOUBLE+(CAST((player_id*17+fold*3) % 89 AS DOUBLE)/88.0::DOUBLE)*0.2::DOUBLE AS b, CAST((player_id*17+fold*3) % 89 AS DOUBLE)/88.0::DOUBLE AS gate, CASE WHEN xag>=0.1 THEN 5.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM targets)"
_STRATA = _ACTIONS + ", ra AS (SELECT match_id, count(*) AS n, count(*) FILTER (WHERE xag>=0.1) AS n_pos FROM targets GROUP BY 1), rr AS (SELECT *, n_pos/CAST(n AS DOUBLE) AS rate FROM ra), eg AS (SELECT quantile_cont(rate,[0.2,0.4,0.6,0.8]) AS q FROM targets JOIN rr USING (match_id))"
_q["group_strata"] = _STRATA + " SELECT match_id, n, n_pos, CAST(len(list_filter(q, lambda x : x<=rate)) AS INT) AS bin FROM rr, eg"
_q["cv_splits"] = _ACTIONS + " SELECT match_id, player_id, CAST(i AS INT) AS fold_no, CASE WHEN fold=i THEN fold ELSE -1 END AS fold, 'group_kfold' AS split_id FROM targets, range(1,6) r(i)"
_q["fold_balance"] = _ACTIONS + " SELECT fold, count(*) AS n, count(*) FILTER (WHERE xag>=0.1) AS n_pos, round(avg(CASE WHEN xag>=0.1 THEN 1.0::DOUBLE ELSE 0 END),6)+0.0 AS pos_rate, round(avg(xag),6)+0.0 AS mean, round(stddev_pop(xag),6)+0.0 AS std FROM targets GROUP BY 1"
_smooth = lambda t: f"1+4/(1+exp(-(xag-0.1::DOUBLE)/{t}::DOUBLE))"
_q["step_weights"] = _ACTIONS + " SELECT match_id, player_id, CASE WHEN xag>=0.1 THEN 5.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM targets"
_band = "round(abs(xag-0.1::DOUBLE),9)"
_q["smooth_weights"] = _ACTIONS + f" SELECT match_id, player_id, round({_smooth(0.03)},6)+0.0 AS w, CASE WHEN {_band}<=0.01 THEN 5.0::DOUBLE WHEN {_band}<=0.03 THEN 3.0::DOUBLE WHEN {_band}<=0.05 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS band FROM targets"
_schemes = {"step": "CASE WHEN xag>=0.1 THEN 5.0::DOUBLE ELSE 1.0::DOUBLE END"} | {f"smooth_{t}": _smooth(t) for t in (0.02, 0.03, 0.05)}
_q["weight_stats"] = _ACTIONS + ", ws AS (" + " UNION ALL ".join(f"SELECT '{k}' AS scheme, xag, {w} AS w FROM targets" for k, w in _schemes.items()) + ") SELECT scheme, round(avg(w),6)+0.0 AS mean, round(stddev_pop(w),6)+0.0 AS std, round(min(w),6)+0.0 AS min, round(max(w),6)+0.0 AS max, count(*) FILTER (WHERE xag>=0.1) AS n_pos, round(avg(CASE WHEN xag>=0.1 THEN 1.0::DOUBLE ELSE 0 END),6)+0.0 AS pos_rate, round(sum(w)*sum(w)/sum(w*w),6)+0.0 AS effective_n FROM ws GROUP BY 1"
_q["wrmse_by_fold"] = _PRED + ", l AS (SELECT *, least(greatest(gate,1e-15::DOUBLE),1-1e-15::DOUBLE) AS g FROM p) SELECT fold, round(sqrt(avg(w*(xag-a)*(xag-a))+1e-9::DOUBLE),6)+0.0 AS wrmse, round(-avg(CASE WHEN xag>=0.1 THEN ln(g) ELSE ln(1-g) END),6)+0.0 AS log_loss FROM l GROUP BY 1"
_q["prediction_summary"] = _PRED + " SELECT " + ", ".join(f"round({f},6)+0.0 AS {n}" for f, n in (("avg(a)", "mean"), ("stddev_pop(a)", "std"), ("min(a)", "min"), ("max(a)", "max"), ("quantile_cont(a,0.25)", "p25"), ("quantile_cont(a,0.5)", "p50"), ("quantile_cont(a,0.75)", "p75"))) + " FROM p"
_q["gate_quality"] = _PRED + """, d AS (SELECT gate, sum(CASE WHEN xag>=0.1 THEN 1.0::DOUBLE ELSE 0 END) AS pos, sum(CASE WHEN xag>=0.1 THEN 0 ELSE 1.0::DOUBLE END) AS neg FROM p GROUP BY 1), r AS (SELECT *, sum(pos) OVER (ORDER BY gate DESC) AS tp, sum(neg) OVER (ORDER BY gate DESC) AS fp FROM d)
SELECT round(sum(neg*(tp-pos/2))/(sum(pos)*sum(neg)),6)+0.0 AS auc, round(sum(pos*tp/(tp+fp))/sum(pos),6)+0.0 AS average_precision FROM r"""
_q["calibration_deciles"] = _PRED + ", eg AS (SELECT quantile_cont(a,[0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]) AS q FROM p) SELECT CAST(len(list_filter(q, lambda x : x<a)) AS INT) AS bucket, count(*) AS n, round(avg(a),6)+0.0 AS mean_pred, round(avg(xag),6)+0.0 AS rate FROM p, eg GROUP BY 1"
_q["blend_gram"] = _PRED + " SELECT count(*) AS n, " + ", ".join(f"round(sum(w*{f}),6)+0.0 AS {n}" for f, n in (("xag*xag", "yy"), ("a*xag", "xy_0"), ("b*xag", "xy_1"), ("a*a", "xx_0_0"), ("a*b", "xx_0_1"), ("b*b", "xx_1_1"))) + " FROM p"


def _errors(candidates: dict[str, str]) -> str:
    return _PRED + " " + " UNION ALL ".join(f"SELECT '{k}' AS candidate, round(sqrt(avg(w*(xag-({c}))*(xag-({c})))+1e-9::DOUBLE),6)+0.0 AS wrmse FROM p" for k, c in candidates.items())


_q["moe_soft"] = _errors({f"{t:.2f}": f"power(gate,{t}::DOUBLE)*a+(1-power(gate,{t}::DOUBLE))*b" for t in (0.6, 0.8, 1.0, 1.2, 1.4, 1.6, 2.0)})
_q["moe_hard"] = _errors({f"{t:.2f}": f"CASE WHEN gate>={t}::DOUBLE THEN a ELSE b END" for t in (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7)})
_q["zero_threshold_grid"] = _errors({f"{t / 100:.2f}": f"CASE WHEN a<{t / 100!r}::DOUBLE THEN 0.0::DOUBLE ELSE a END" for t in range(0, 20)})
_q["round_snap"] = _PRED + ", s AS (SELECT *, round(a,3) AS c FROM p), t AS (SELECT *, round_even(round_even(c/0.1::DOUBLE,0)*0.1::DOUBLE,6) AS near FROM s) SELECT match_id, player_id, round(CASE WHEN abs(c-near)<=0.02::DOUBLE THEN near ELSE c END,6)+0.0 AS snapped FROM t"
_q["importance_topk"] = "WITH g AS (SELECT l_linenumber AS fold, 'f'||CAST(l_suppkey AS VARCHAR) AS feature, sum(l_quantity) AS gain FROM lineitem GROUP BY 1,2) SELECT feature, round(avg(gain),6)+0.0 AS mean_gain, round(coalesce(stddev_samp(gain),0),6)+0.0 AS std_gain FROM g GROUP BY 1 ORDER BY avg(gain) DESC, feature LIMIT 15"

# ---- plain tables ----
_q["union_targets"] = _ACTIONS + " SELECT match_id, player_id, true AS is_train, xag FROM targets WHERE fold<=4 UNION ALL SELECT match_id, player_id, false, CAST(NULL AS DOUBLE) FROM targets WHERE fold=5"
_q["distinct_pairs"] = _ACTIONS + " SELECT DISTINCT match_id, player_id FROM actions"
_q["match_overlap"] = _ACTIONS + ", x AS (SELECT DISTINCT match_id FROM targets WHERE fold<=3), y AS (SELECT DISTINCT match_id FROM targets WHERE fold>=2) SELECT (SELECT count(*) FROM x SEMI JOIN y USING (match_id)) AS in_both, (SELECT count(*) FROM x ANTI JOIN y USING (match_id)) AS only_a, (SELECT count(*) FROM y ANTI JOIN x USING (match_id)) AS only_b"
_q["table_profile"] = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS nulls, count({c}) AS \"values\" FROM orders" for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"))
_PASS = """WITH pg AS (SELECT c_custkey AS "PassengerId", ['Mr','Mrs','Miss','Dr','Mlle',''][1+c_custkey%6] AS word, 'Doe, '||['Mr','Mrs','Miss','Dr','Mlle',''][1+c_custkey%6]||CASE WHEN c_custkey%6=5 THEN '' ELSE '. ' END||c_name AS "Name", CASE WHEN c_custkey%7<>0 THEN CAST(c_custkey*13%101 AS DOUBLE) END AS "Age",
 CASE WHEN c_custkey%11<>0 THEN abs(c_acctbal) END AS "Fare", CASE WHEN c_custkey%9<>0 THEN ['S','C','S','Q'][1+c_custkey%4] END AS "Embarked", c_custkey%3 AS "SibSp", c_custkey%2 AS "Parch" FROM customer)"""
_q["title_regex"] = _PASS + """ SELECT "PassengerId", CASE regexp_extract("Name", ' ([A-Za-z]+)\\.', 1) WHEN 'Mr' THEN 'Mr' WHEN 'Mrs' THEN 'Mrs' WHEN 'Miss' THEN 'Miss' WHEN 'Master' THEN 'Master' WHEN 'Mlle' THEN 'Miss' WHEN 'Ms' THEN 'Mrs' WHEN 'Mme' THEN 'Mrs' ELSE 'Rare' END AS "Title" FROM pg"""
_q["age_band"] = _PASS + """ SELECT "PassengerId", CASE WHEN "Age">0 AND "Age"<=12 THEN 'Child' WHEN "Age">12 AND "Age"<=18 THEN 'Teen' WHEN "Age">18 AND "Age"<=35 THEN 'Adult' WHEN "Age">35 AND "Age"<=60 THEN 'Middle' WHEN "Age">60 AND "Age"<=100 THEN 'Senior' END AS "AgeBand" FROM pg"""
_q["fare_quartile"] = _PASS + """, eg AS (SELECT quantile_cont("Fare",[0.25,0.5,0.75]) AS q FROM pg) SELECT "PassengerId", CASE WHEN "Fare" IS NULL THEN NULL ELSE ['Low','Medium','High','VeryHigh'][1+len(list_filter(q, lambda x : x<"Fare"))] END AS "FareBand" FROM pg, eg"""
_q["family_size"] = _PASS + """ SELECT "PassengerId", "SibSp"+"Parch"+1 AS "FamilySize", CASE WHEN "SibSp"+"Parch"=0 THEN 1 ELSE 0 END AS "IsAlone" FROM pg"""
_q["impute_median_mode"] = _PASS + """, st AS (SELECT quantile_cont("Age",0.5) AS md, avg("Fare") AS mn FROM pg), mo AS (SELECT "Embarked" AS e FROM pg WHERE "Embarked" IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT "PassengerId", round(coalesce("Age",md),6)+0.0 AS "Age", round(coalesce("Fare",mn),6)+0.0 AS "Fare", coalesce("Embarked",e) AS "Embarked" FROM pg, st, mo"""

# ---- whole chains ----
def _learned(source: str, where: str = "true") -> str:
    """The learned values by value iteration over lists, until no zone changes by 1e-6 or more."""
    move, done = _mv, "result_name='success'"
    return f""",
tm AS (SELECT {_cell('start_x', 'start_y')} AS s, {_cell('end_x', 'end_y')} AS e, {move} AND {done} AS m, type_name IN {_SHOT} AS sh, type_name IN {_SHOT} AND {done} AS g, {move} AND NOT {done} AS l FROM {source} WHERE ({move} OR type_name IN {_SHOT}) AND {where}),
zs AS (SELECT i AS z FROM range(192) t(i)),
ct AS (SELECT z, CAST(count(*) FILTER (WHERE m OR sh OR l) AS DOUBLE) AS total, CAST(count(*) FILTER (WHERE sh) AS DOUBLE) AS shots, CAST(count(*) FILTER (WHERE g) AS DOUBLE) AS goals FROM zs LEFT JOIN tm ON tm.s=z GROUP BY z),
mv AS (SELECT s, e, CAST(count(*) AS DOUBLE) AS n FROM tm WHERE m GROUP BY 1, 2),
rw AS (SELECT a.z, list(coalesce(mv.n, 0.0::DOUBLE) ORDER BY b.z) AS r FROM zs a CROSS JOIN zs b LEFT JOIN mv ON mv.s=a.z AND mv.e=b.z GROUP BY a.z),
mx AS (SELECT list(list_transform(r, lambda x : 0.95::DOUBLE*x/greatest(total,1)) ORDER BY ct.z) AS m, list(CASE WHEN shots>0 THEN shots/greatest(total,1)*goals/shots ELSE 0.0::DOUBLE END ORDER BY ct.z) AS r FROM ct JOIN rw ON rw.z=ct.z),
it AS (SELECT 0 AS i, list_transform(range(192), lambda x : 0.0::DOUBLE) AS v, 1.0::DOUBLE AS off UNION ALL
  SELECT i+1, w, list_max(list_transform(list_zip(w, v), lambda p : abs(p[1]-p[2]))) FROM (SELECT i, v, list_transform(list_zip(m, r), lambda p : p[2]+list_dot_product(p[1], v)) AS w FROM it, mx WHERE i<500 AND off>=1e-6)),
lv AS (SELECT v FROM it ORDER BY i DESC LIMIT 1)"""


_RECURSIVE = _ACTIONS.replace("WITH", "WITH RECURSIVE", 1)
_q["xt_values"] = _RECURSIVE + _learned("a") + " SELECT CAST(i AS INT) AS zone, round(v[i+1],6)+0.0 AS value FROM lv, range(192) t(i)"
_ok_end = "CASE WHEN result_name='success' THEN ve END"
_q["xt_player"] = _RECURSIVE + _learned("a", "CAST(substr(match_id,9,2) AS INT) % 5 + 1 <= 4") + f""",
w AS (SELECT *, CASE WHEN result_name='success' THEN ve ELSE 0.0::DOUBLE END - vs AS d FROM (SELECT a.*, v[1+{_cell('start_x', 'start_y')}] AS vs, v[1+{_cell('end_x', 'end_y')}] AS ve FROM a, lv))
SELECT match_id, player_id, count(*) AS xt_learned_action_count, """ + ", ".join(
    _agg(x, f"xt_learned_{n}") for n, x in (("start_mean", "avg(vs)"), ("start_max", "max(vs)"), ("delta_sum", "sum(d)"), ("delta_mean", "avg(d)"), ("positive_delta_sum", "sum(greatest(d,0))"), ("positive_delta_mean", "avg(greatest(d,0))"), ("success_rate", "avg(CASE WHEN result_name='success' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)"), ("end_success_mean", f"avg({_ok_end})"), ("delta_success_mean", "avg(d) FILTER (WHERE result_name='success')"))
) + " FROM w" + _BY

_FUSED = ("nstep_chain", "second_assist", "pass_geometry", "time_blocks", "zone_density", "zone_thirds", "basic_stats", "goal_count", "type_pivot", "success_rates", "attack_defence", "pass_to_shot", "progressive_pass", "progressive_carry", "gca_spatial", "linebreak_packing", "chain_quality", "box_entry", "attack_tempo", "vision")

def _fused() -> str:
    parts = []
    for name in _FUSED:
        parts.append(_q[name].replace("FROM d)", "FROM a)"))  # here at the actions' own times
    names = [f"b{i}" for i in range(len(parts))]
    joined = " ".join(f"LEFT JOIN ({sql}) {n} ON {n}.match_id=t.match_id AND {n}.player_id=t.player_id" for n, sql in zip(names, parts, strict=True))
    return _ACTIONS + " SELECT t.*, " + ", ".join(f"coalesce(COLUMNS({n}.* EXCLUDE (match_id, player_id)), 0)" for n in names) + f" FROM targets t {joined}"


_q["feature_table"] = _fused()
_pairs = ("xag", "action_count", "pass_dist_mean", "progressive_pass_count", "box_entries")
_q["feature_correlations"] = f"WITH w AS ({_q['feature_table']}) " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}),6)+0.0 AS corr FROM w" for i, a in enumerate(_pairs) for b in _pairs[i + 1 :])
_q["stratified_splits"] = _ACTIONS + ", k AS (SELECT CAST(xag >= 0.1 AS INT) AS high, count(*) AS c FROM targets GROUP BY 1) SELECT CAST(f AS INT) AS fold, high, CAST(c // 5 + CASE WHEN f < c % 5 THEN 1 ELSE 0 END AS BIGINT) AS n FROM k, (SELECT unnest(range(0, 5)) AS f) r"
_VALUES = (("start_mean", "avg(vs)"), ("start_max", "max(vs)"), ("delta_sum", "sum(d)"), ("delta_mean", "avg(d)"), ("positive_delta_sum", "sum(greatest(d,0))"), ("positive_delta_mean", "avg(greatest(d,0))"), ("success_rate", "avg(CASE WHEN result_name='success' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)"), ("end_success_mean", "avg(ve) FILTER (WHERE result_name='success')"), ("delta_success_mean", "avg(d) FILTER (WHERE result_name='success')"))
_grid_player = _ACTIONS + _VALUED + ", w AS (SELECT *, xt_start AS vs, xt_end AS ve, xt AS d FROM v) SELECT match_id, player_id, count(*) AS xt_learned_action_count, " + ", ".join(_agg(x, f"xt_learned_{n}") for n, x in _VALUES) + " FROM w" + _BY
_MORE = ("extended_chain", "pass_latency", "setplay_share", "bodypart_pivot", "box_receiver_volume", "box_receiver_timing", "box_receiver_angles", "box_receiver_origin", "final_third_receive", "dynamic_position", "heuristic_xt", "pass_tempo", "sca1", "gca1", "sca2", "gca2", "possession_player", "pass_entropy", "passnet_attempts", "passnet_receive", "box_receiver_diversity")


def _wide() -> str:
    parts = [_q[n].replace("time_seconds/20.0::DOUBLE", "time_seconds") for n in (*_FUSED, *_MORE) if n != "pass_tempo"] + [f"SELECT * REPLACE (round(pass_tempo_variance, 6) AS pass_tempo_variance) FROM ({_q['pass_tempo']})", _grid_player, f"SELECT * EXCLUDE (team_id) FROM ({_q['pass_degree']})"]
    joined = " ".join(f"LEFT JOIN ({sql}) b{i} ON b{i}.match_id=t.match_id AND b{i}.player_id=t.player_id" for i, sql in enumerate(parts))
    return _ACTIONS + " SELECT t.*, " + ", ".join(f"coalesce(COLUMNS(b{i}.* EXCLUDE (match_id, player_id)), 0)" for i in range(len(parts))) + f" FROM targets t {joined}"


_q["player_features"] = _wide()
_gated = [(c, t) for t, cs in (("x", ("xt_learned_delta_sum", "xt_learned_positive_delta_sum")), ("p", ("possession_xt_positive_sum", "possession_xt_delta_sum", "possession_speed_ground_mean"))) for c in cs]
_q["league_gate_values"] = _ACTIONS + " SELECT t.match_id, t.player_id, " + ", ".join(f"CASE WHEN comp={v} THEN coalesce({t}.{c}, 0.0::DOUBLE) ELSE 0.0::DOUBLE END AS {c}__comp_gate_{v}" for c, t in _gated for v in (0, 1, 2)) + f" FROM targets t LEFT JOIN ({_q['xt_player']}) x ON x.match_id=t.match_id AND x.player_id=t.player_id LEFT JOIN ({_q['possession_player']}) p ON p.match_id=t.match_id AND p.player_id=t.player_id"

for _n in NINE_DIGITS:
    _q[_n] = _q[_n].replace(",6)+0.0", ",9)+0.0").replace(", 6) + 0.0", ", 9) + 0.0")
