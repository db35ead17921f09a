"""Operators by window: own previous place, gaps between passes, possessions, player form, shares of a team."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.functions.columns import clamp, ratio, yes
from fieldloom.operators.sequence import KEY, ORDER, by_match
from fieldloom.sources.staging import staged


def with_own_previous(actions: DataFrame) -> DataFrame:
    """x_own and y_own: where the player's previous action of the match began."""
    w = Window.partitionBy("match_id", "player_id").orderBy(*ORDER)
    return actions.withColumns({"x_own": F.lag("start_x").over(w), "y_own": F.lag("start_y").over(w)})


def with_pass_gaps(actions: DataFrame, most: float = 60.0) -> DataFrame:
    """Passes only, with the seconds to the team's next pass and the same of its two next passes."""
    w = Window.partitionBy("match_id", "team_id").orderBy(*ORDER)
    passes = actions.where(F.col("type_name") == "pass").withColumn("gap_1", clamp(F.lead("time_seconds").over(w) - F.col("time_seconds"), 0.0, most))
    return passes.withColumns({"gap_2": F.lead("gap_1", 1).over(w), "gap_3": F.lead("gap_1", 2).over(w)})


# ---- possessions ----


def with_possessions(actions: DataFrame, most_gap: float = 15.0) -> DataFrame:
    """possession_no and possession_step. A possession ends with the match, a change of team, a failure, or a gap over most_gap s;
    a new period alone doesn't end it."""
    w = by_match()
    t = F.coalesce("time_seconds", F.lit(0.0))
    team = F.coalesce(F.col("team_id").cast("string"), F.lit("unknown_team"))
    held = yes(F.lag(team).over(w) == team) & yes(F.lag("result_name").over(w) == "success") & yes(t - F.lag(t).over(w) <= most_gap)
    flagged = actions.withColumn("_new", (~held).cast("int"))
    numbered = flagged.withColumn("possession_no", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
    return numbered.withColumn("possession_step", F.row_number().over(Window.partitionBy("match_id", "possession_no").orderBy(*ORDER)))


def possession_table(steps: DataFrame, final_third: float = 70.0) -> DataFrame:
    """One row for each possession of with_possessions()."""
    order = F.struct(*ORDER)
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), order))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), order))
    value = lambda c: F.coalesce(F.sum(c), F.lit(0.0)) if c in steps.columns else F.lit(0.0)
    arrived = yes(F.col("end_x") >= final_third)
    p = steps.groupBy("match_id", "possession_no").agg(
        first("team_id").alias("team_id"), first("start_x").alias("x0"), first("start_y").alias("y0"), last("end_x").alias("x1"), last("end_y").alias("y1"), first("time_seconds").alias("t0"), last("time_seconds").alias("t1"),
        F.count("player_id").alias("action_count"), F.count_distinct("player_id").alias("unique_players"), value("xt_learned_positive_delta").alias("xt_positive_sum"), value("xt_learned_delta").alias("xt_delta_sum"),
        F.min(F.when(arrived, F.col("possession_step"))).alias("final_third_step"), F.min(F.when(arrived, F.col("time_seconds"))).alias("final_third_time"),
    )
    dx, dy, duration = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.col("duration")
    p = p.withColumns({"duration": F.greatest(F.col("t1") - F.col("t0"), F.lit(1.0)), "ground_distance": F.hypot(dx, dy)})
    return p.select(
        "match_id", "possession_no", "team_id", "action_count", "unique_players", "duration", "ground_distance", ratio(dx, F.col("ground_distance")).alias("directness"), (dx / duration).alias("speed_x"), (F.col("ground_distance") / duration).alias("speed_ground"),
        "xt_positive_sum", "xt_delta_sum", (F.col("xt_positive_sum") / duration).alias("xt_positive_per_second"), F.col("final_third_step").isNotNull().cast("double").alias("final_third_flag"), "final_third_step", (F.col("final_third_time") - F.col("t0")).alias("time_to_final_third"),
    )


def possession_player(steps: DataFrame) -> DataFrame:
    """Means over the possessions that a player took part in."""
    part = steps.select(*KEY, "possession_no").distinct().join(possession_table(steps), ["match_id", "possession_no"])
    mean = lambda c, name: F.coalesce(F.avg(c), F.lit(0.0)).alias(f"possession_{name}")
    return part.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("possession_count"), mean("duration", "duration_mean"), mean("ground_distance", "ground_distance_mean"), mean("directness", "directness_mean"), mean("speed_x", "speed_x_mean"), mean("speed_ground", "speed_ground_mean"),
        mean("xt_positive_per_second", "xt_positive_per_second_mean"), F.sum("xt_positive_sum").alias("possession_xt_positive_sum"), F.sum("xt_delta_sum").alias("possession_xt_delta_sum"), mean("action_count", "actions_per_pos_mean"),
        mean("final_third_flag", "final_third_rate"), mean("final_third_step", "final_third_step_mean"), mean("time_to_final_third", "time_to_final_third_mean"),
    )


# ---- form and context ----


def player_trend(rows: DataFrame, is_train: Column, value: str = "xag", date: str = "match_id") -> DataFrame:
    """Means of a player's strictly earlier training rows: all and the last three, and the change to the last. Rows that aren't
    training rows see the player's whole training history. 0 without history."""
    rows = rows.withColumn("_train", is_train)
    w = Window.partitionBy("player_id").orderBy(date, "match_id")
    past, three = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(-3, -1)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    train = rows.where("_train").withColumns({f"{value}_expanding_mean": zero(F.avg(value).over(past)), f"{value}_rolling3_mean": zero(F.avg(value).over(three)), f"{value}_diff_prev": zero(F.col(value) - F.lag(value).over(w))})
    ranked = rows.where("_train").withColumn("_rank", F.row_number().over(Window.partitionBy("player_id").orderBy(F.desc(date), F.desc("match_id"))))
    history = ranked.groupBy("player_id").agg(F.avg(value).alias("_all"), F.avg(F.when(F.col("_rank") <= 3, F.col(value))).alias("_three"), F.max(F.when(F.col("_rank") == 1, F.col(value))).alias("_last"))
    other = rows.where(~F.col("_train")).join(history, "player_id", "left")
    other = other.withColumns({f"{value}_expanding_mean": zero(F.col("_all")), f"{value}_rolling3_mean": zero(F.col("_three")), f"{value}_diff_prev": zero(F.col(value) - F.col("_last"))}).drop("_all", "_three", "_last")
    return train.unionByName(other).drop("_train")


def team_context(rows: DataFrame, columns: list[str], team: str = "squad") -> DataFrame:
    """Each column's sum over the team in the match, the own share of it, and the sum without the own part. The sums are a written table that is
    joined, so rows of many columns are not sorted by team and a team of many rows is no task's work."""
    names = [f"_t{i}" for i in range(len(columns))]
    totals = rows.groupBy(F.col("match_id").alias("_match"), F.col(team).alias("_team")).agg(*[F.sum(c).alias(n) for c, n in zip(columns, names, strict=True)])
    wide = rows.join(staged(totals, "teams"), F.col("match_id").eqNullSafe(F.col("_match")) & F.col(team).eqNullSafe(F.col("_team")))
    out = {}
    for c, n in zip(columns, names, strict=True):
        total = F.col(n)
        out |= {f"{c}_team_sum": total, f"{c}_team_share": F.when(total == 0, 0.0).otherwise(F.try_divide(F.col(c), total)), f"{c}_team_lopo": total - F.col(c)}
    return wide.withColumns(out).drop("_match", "_team", *names)
