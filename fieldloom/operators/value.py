"""Value of places on the pitch: a fixed grid, and one learned from transitions by value iteration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.columns import PITCH, grid_index, is_shot, yes

CELLS_X, CELLS_Y = 16, 12
#: The grid's first nine rows from the own goal on, each across the pitch.
GRID_ROWS = (
    (0.00078, 0.00089, 0.00095, 0.00095, 0.00095, 0.00095, 0.00095, 0.00095, 0.00095, 0.00095, 0.00089, 0.00078),
    (0.00116, 0.00144, 0.00161, 0.00161, 0.00161, 0.00161, 0.00161, 0.00161, 0.00161, 0.00161, 0.00144, 0.00116),
    (0.00191, 0.00264, 0.00321, 0.00321, 0.00321, 0.00321, 0.00321, 0.00321, 0.00321, 0.00321, 0.00264, 0.00191),
    (0.00462, 0.00657, 0.00814, 0.00814, 0.00814, 0.00814, 0.00814, 0.00814, 0.00814, 0.00814, 0.00657, 0.00462),
    (0.01051, 0.01486, 0.01794, 0.01794, 0.01794, 0.01794, 0.01794, 0.01794, 0.01794, 0.01794, 0.01486, 0.01051),
    (0.02132, 0.02842, 0.03251, 0.03251, 0.03251, 0.03251, 0.03251, 0.03251, 0.03251, 0.03251, 0.02842, 0.02132),
    (0.03627, 0.04759, 0.05372, 0.05372, 0.05372, 0.05372, 0.05372, 0.05372, 0.05372, 0.05372, 0.04759, 0.03627),
    (0.06031, 0.07749, 0.08666, 0.08666, 0.08666, 0.08666, 0.08666, 0.08666, 0.08666, 0.08666, 0.07749, 0.06031),
    (0.09821, 0.12363, 0.13704, 0.13704, 0.13704, 0.13704, 0.13704, 0.13704, 0.13704, 0.13704, 0.12363, 0.09821),
)
#: Kinds that move the ball, in the learned grid.
MOVES = ("pass", "cross", "carry", "dribble", "take_on", "freekick_crossed", "corner_crossed", "throw_in", "goal_kick", "clearance")


def heuristic_grid() -> list[float]:
    """Values by x cell * CELLS_Y + y cell; rows after the ninth are the ninth times 1.2, and 0.15 more for each further one."""
    known = len(GRID_ROWS)
    factors = [1.0 if x < known else 1.2 + (x - known) * 0.15 for x in range(CELLS_X)]
    return [v * f for x, f in enumerate(factors) for v in GRID_ROWS[min(x, known - 1)]]


def _floor_cell(c: str, size: float, cells: int) -> Column:
    return F.least(F.greatest(F.floor(F.col(c) / size * cells), F.lit(0)), F.lit(cells - 1)).cast("int")


def with_heuristic_value(actions: DataFrame) -> DataFrame:
    """xt_start and xt_end from the fixed grid, 0 where a coordinate is missing. The grid is a literal array: no join."""
    grid = F.array(*[F.lit(v) for v in heuristic_grid()])

    def value(x: str, y: str) -> Column:
        at = _floor_cell(x, PITCH[0], CELLS_X) * CELLS_Y + _floor_cell(y, PITCH[1], CELLS_Y)
        return F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), F.get(grid, at)).otherwise(0.0)

    return actions.withColumns({"xt_start": value("start_x", "start_y"), "xt_end": value("end_x", "end_y")})


def zone(x: str, y: str, null_as: float | None = None) -> Column:
    """Cell number, row by row along the pitch; null without a place unless null_as."""
    c = lambda n: F.coalesce(F.col(n), F.lit(null_as)) if null_as is not None else F.col(n)
    return (grid_index(c(y), PITCH[1], CELLS_Y) * CELLS_X + grid_index(c(x), PITCH[0], CELLS_X)).cast("int")


def transition_counts(actions: DataFrame, moves: tuple[str, ...] = MOVES) -> DataFrame:
    """start_zone, end_zone (null for shots and losses), moves, shots, goals, losses: at most a few ten thousand rows."""
    move = yes(F.col("type_name").isin(*moves))
    shot = is_shot("type_name")
    done = move & yes(F.col("result_name") == "success") & F.col("end_x").isNotNull() & F.col("end_y").isNotNull()
    rows = actions.where(move | shot).select(zone("start_x", "start_y", 0.0).alias("start_zone"), F.when(done, zone("end_x", "end_y")).alias("end_zone"), done.cast("int").alias("m"), shot.cast("int").alias("s"), (shot & yes(F.col("result_name") == "success")).cast("int").alias("g"), (move & ~yes(F.col("result_name") == "success")).cast("int").alias("l"))
    return rows.groupBy("start_zone", "end_zone").agg(F.sum("m").alias("moves"), F.sum("s").alias("shots"), F.sum("g").alias("goals"), F.sum("l").alias("losses"))


def solve_values(counts: DataFrame, discount: float = 0.95, rounds: int = 500, tolerance: float = 1e-6) -> np.ndarray:
    """Value of each zone: reward for shooting there plus the discounted value of where moves lead. The counts fit one page."""
    n = CELLS_X * CELLS_Y
    t, shots, goals, losses = np.zeros((n, n)), np.zeros(n), np.zeros(n), np.zeros(n)
    for r in counts.collect():  # bounded by zones times zones
        s = r["start_zone"]
        if r["end_zone"] is not None:
            t[s, r["end_zone"]] += r["moves"]
        shots[s] += r["shots"]
        goals[s] += r["goals"]
        losses[s] += r["losses"]
    total = t.sum(1) + shots + losses
    safe = np.maximum(total, 1)
    reward = np.where(shots > 0, shots / safe * goals / np.maximum(shots, 1), 0.0)
    step, v = discount * t / safe[:, None], np.zeros(n)
    for _ in range(rounds):
        new = reward + step @ v
        done = np.abs(new - v).max() < tolerance
        v = new
        if done:
            break
    return v


def with_learned_value(actions: DataFrame, values: np.ndarray) -> DataFrame:
    """xt_learned_start, _end, _delta_on_success, _delta and _positive_delta; the values travel as a literal array."""
    grid = F.array(*[F.lit(float(v)) for v in values])
    look = lambda z: F.coalesce(F.get(grid, z), F.lit(0.0))
    df = actions.withColumns({"xt_learned_start": look(zone("start_x", "start_y", 0.0)), "xt_learned_end": look(zone("end_x", "end_y"))})
    success = yes(F.col("result_name") == "success")
    df = df.withColumn("xt_learned_delta", F.when(success, F.col("xt_learned_end")).otherwise(0.0) - F.col("xt_learned_start"))
    return df.withColumns({"xt_learned_positive_delta": F.greatest("xt_learned_delta", F.lit(0.0)), "xt_learned_delta_on_success": F.when(success, F.col("xt_learned_delta"))})


def value_player(actions: DataFrame) -> DataFrame:
    """The learned value by player and match; 0 where a player has no success to average over."""
    d, up, s = F.col("xt_learned_delta"), F.col("xt_learned_positive_delta"), F.col("xt_learned_start")
    success = yes(F.col("result_name") == "success")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return actions.groupBy("match_id", "player_id").agg(
        F.avg(s).alias("xt_learned_start_mean"), F.max(s).alias("xt_learned_start_max"), F.sum(d).alias("xt_learned_delta_sum"), F.avg(d).alias("xt_learned_delta_mean"),
        F.sum(up).alias("xt_learned_positive_delta_sum"), F.avg(up).alias("xt_learned_positive_delta_mean"), F.avg(success.cast("double")).alias("xt_learned_success_rate"), F.count(F.lit(1)).alias("xt_learned_action_count"),
        zero(F.avg(F.when(success, F.col("xt_learned_end")))).alias("xt_learned_end_success_mean"), zero(F.avg("xt_learned_delta_on_success")).alias("xt_learned_delta_success_mean"),
    )
