"""Expected value of actions: components by success probability, out-of-fold centring, and the penalty per kind of action."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.functions.columns import ratio
from fieldloom.operators.encoding import empirical_position
from fieldloom.operators.quantiles import percentiles
from fieldloom.operators.sequence import KEY

#: Kinds of action by group, and the groups that start from a dead ball.
GROUPS = {"pass": ("pass",), "cross": ("cross",), "carry": ("carry",), "dribble": ("dribble", "take_on"), "free_kick": ("freekick_crossed",), "corner": ("corner_crossed",)}
DEAD_BALL = ("corner", "free_kick")
#: Bounds of the penalty by group.
PENALTY_BOUNDS = {"pass": (-0.3, 0.6), "cross": (-0.6, 2.0), "dribble": (-0.6, 2.0), "carry": (-0.6, 2.0), "corner": (-1.5, 3.0), "free_kick": (-1.5, 3.0)}


def action_group(kind: str = "type_name") -> Column:
    out = F.lit(None).cast("string")
    for group, kinds in GROUPS.items():
        out = F.when(F.col(kind).isin(*kinds), group).otherwise(out)
    return out


def with_components(actions: DataFrame) -> DataFrame:
    """group, success (probability times value), failure (its complement times the value at stake) and the complement. Needs
    xpass_prob, xt_learned_delta and xt_learned_start; other kinds of action go."""
    p = F.col("xpass_prob")
    return actions.withColumn("group", action_group()).where(F.col("group").isNotNull()).withColumns({"success": p * F.col("xt_learned_delta"), "fail_raw": (1 - p) * F.col("xt_learned_start"), "fail_weight": F.coalesce(1 - p, F.lit(0.0))})


def fold_moments(rows: DataFrame, value: str = "xt_learned_start") -> DataFrame:
    """group, fold, mean and population standard deviation over the other folds, from count, sum and sum of squares. Rows without a
    fold are new ones: they count for none, and theirs are the values over all folds, under the fold null."""
    parts = rows.where(F.col("fold").isNotNull()).groupBy("group", "fold").agg(F.count(value).alias("n"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("q"))
    w = Window.partitionBy("group")
    other = lambda c: F.sum(c).over(w) - F.col(c)
    whole = parts.groupBy("group").agg(*[F.sum(c).alias(c) for c in ("n", "s", "q")]).withColumn("fold", F.lit(None).cast(parts.schema["fold"].dataType))
    parts = parts.select("group", "fold", other("n").alias("n"), other("s").alias("s"), other("q").alias("q")).where("n > 0").unionByName(whole)
    mean = F.col("s") / F.col("n")
    return parts.select("group", "fold", mean.alias("mean"), F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0))).alias("std"))


def fold_medians(rows: DataFrame, folds: list[int], value: str = "xt_learned_start") -> DataFrame:
    """group, fold, median and median absolute deviation over the other folds. These can't be taken apart, so the counts of values
    (not the rows) are sent to each of the few other folds."""
    others = F.explode(F.array(*[F.lit(f) for f in folds]))
    counts = rows.where(F.col(value).isNotNull()).groupBy("group", F.col("fold").alias("own"), F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    copies = counts.withColumn("fold", others).where("own <> fold").groupBy("group", "fold", "v").agg(F.sum("n").alias("n"))
    median = percentiles(copies, "v", (0.5,), ("group", "fold"), "n").select("group", "fold", F.col("q")[0].alias("median"))
    away = copies.join(F.broadcast(median), ["group", "fold"]).withColumn("off", F.abs(F.col("v") - F.col("median")))  # groups times folds rows
    mad = percentiles(away, "off", (0.5,), ("group", "fold"), "n").select("group", "fold", F.col("q")[0].alias("mad"))
    return median.join(F.broadcast(mad), ["group", "fold"])


def with_scaled_failure(rows: DataFrame, moments: DataFrame, value: str = "xt_learned_start") -> DataFrame:
    """fail_scaled: the failure's weight times its centred value. A pass is centred by its empirical position among all passes with
    a fold; other actions are put in standard deviations of their group over the other folds, or, where the group has no others
    or no spread, of all actions with a fold. An action without a value is in the middle: 0."""
    known = F.col("fold").isNotNull()
    overall = rows.where(known).agg(F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_std"))
    passes = empirical_position(rows.where(F.col("group") == "pass"), value, known)
    passes = passes.withColumn("fail_scaled", F.col("fail_weight") * F.coalesce("centred", F.lit(0.0)))
    own = moments.select(F.col("group").alias("_g"), F.col("fold").alias("_f"), "mean", "std")
    others = rows.where(F.col("group") != "pass").join(F.broadcast(own), (F.col("group") == F.col("_g")) & F.col("fold").eqNullSafe(F.col("_f")), "left").crossJoin(F.broadcast(overall))  # groups times folds rows, one row
    spread = F.when(F.col("_std") >= 1e-6, F.col("_std")).otherwise(1.0)
    centred = (F.col(value) - F.coalesce("mean", "_mean")) / F.when(F.col("std") > 1e-6, F.col("std")).otherwise(spread)
    others = others.withColumn("fail_scaled", F.col("fail_weight") * F.coalesce(centred, F.lit(0.0)))
    return passes.select(*rows.columns, "fail_scaled").unionByName(others.select(*rows.columns, "fail_scaled"))


def component_sums(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEY, "group").agg(F.sum("success").alias("success_sum"), F.sum("fail_scaled").alias("fail_scaled_sum"), F.sum("fail_raw").alias("fail_raw_sum"), F.sum("fail_weight").alias("fail_weight_sum"), F.count("success").alias("action_count"))


def penalty_statistics(sums: DataFrame, targets: DataFrame, weight: Column, value: str = "xag") -> DataFrame:
    """group, fold, n and the three sums that the weighted squared error of y - (success - penalty * failure) depends on."""
    rows = sums.join(targets, list(KEY)).withColumns({"r": F.col(value) - F.col("success_sum"), "q": F.col("fail_scaled_sum"), "w": weight})
    return rows.groupBy("group", "fold").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("w") * F.col("r") * F.col("r")).alias("wrr"), F.sum(F.col("w") * F.col("r") * F.col("q")).alias("wrq"), F.sum(F.col("w") * F.col("q") * F.col("q")).alias("wqq"))


def best_penalty(statistics: list, low: float = -1.0, high: float = 2.0) -> float:
    """The penalty of least mean error over folds; each fold's error is convex in it. statistics: one group's few rows."""

    def error(x: float) -> float:
        return sum(math.sqrt(max(r["wrr"] + 2 * x * r["wrq"] + x * x * r["wqq"], 0.0) / r["n"] + 1e-9) for r in statistics)

    golden = (math.sqrt(5) - 1) / 2
    a, b = low, high
    for _ in range(60):
        c, d = b - golden * (b - a), a + golden * (b - a)
        a, b = (a, d) if error(c) < error(d) else (c, b)
    return (a + b) / 2


def expected_features(rows: DataFrame, penalties: dict[str, float]) -> DataFrame:
    """By player and group: sums, means and maxima of the expected value with raw and scaled failures, and the set-piece share. Rows move
    once, by player; a player's groups are summed one below the other, then put side by side."""
    lam = F.lit(0.0)
    for g, v in penalties.items():
        lam = F.when(F.col("group") == g, F.lit(v)).otherwise(lam)
    rows = rows.withColumns({"edxt": F.col("success") - lam * F.col("fail_raw"), "edxt_scaled": F.col("success") - lam * F.col("fail_scaled")})
    own = {}
    for name in ("edxt", "edxt_scaled"):
        v, up = F.col(name), F.greatest(F.col(name), F.lit(0.0))
        own |= {f"{name}_sum": F.sum(v), f"{name}_mean": F.avg(v), f"{name}_max": F.max(v), f"{name}_positive_sum": F.sum(up), f"{name}_positive_mean": F.avg(up)}
    own |= {"edxt_count": F.count("edxt")} | {n: F.sum(c) for n, c in (("edxt_success_sum", "success"), ("edxt_fail_sum", "fail_raw"), ("edxt_fail_scaled_sum", "fail_scaled"), ("fail_weight_sum", "fail_weight"))}
    rows = rows.select(*KEY, "group", "success", "fail_raw", "fail_scaled", "fail_weight", "edxt", "edxt_scaled")
    tall = rows.repartition(*KEY).groupBy(*KEY, "group").agg(*[c.alias(n) for n, c in own.items()])
    zero = {n: F.lit(0).cast("long") if n == "edxt_count" else F.lit(0.0) for n in own}
    wide = tall.groupBy(*KEY).agg(*[F.first(F.when(F.col("group") == g, F.struct(*own)), ignorenulls=True).alias(f"_{i}") for i, g in enumerate(penalties)])  # one row a group
    wide = wide.select(*KEY, *[F.coalesce(F.col(f"_{i}")[n], zero[n]).alias(f"{g}_{n}") for i, g in enumerate(penalties) for n in own])
    total = lambda groups, name: sum((F.col(f"{g}_{name}_positive_sum") for g in groups), F.lit(0.0))
    dead, live = [g for g in penalties if g in DEAD_BALL], [g for g in penalties if g not in DEAD_BALL]
    for name in ("edxt", "edxt_scaled"):
        wide = wide.withColumns({f"setpiece_{name}_positive_sum": total(dead, name), f"openplay_{name}_positive_sum": total(live, name)})
        wide = wide.withColumn(f"setpiece_{name}_ratio", ratio(F.col(f"setpiece_{name}_positive_sum"), F.col(f"setpiece_{name}_positive_sum") + F.col(f"openplay_{name}_positive_sum")))
    return wide
