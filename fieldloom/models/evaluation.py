"""Folds, sample weights and metrics. Rows and groups stay in Spark; the driver sees one row a size of groups, a fold or a candidate."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.operators.quantiles import percentiles
from fieldloom.operators.sequence import with_value_range

# ---- weights ----


def step_weight(y: Column, threshold: float = 0.1, heavy: float = 5.0) -> Column:
    return F.when(y >= threshold, heavy).otherwise(1.0)


def smooth_weight(y: Column, threshold: float = 0.1, heavy: float = 5.0, tau: float = 0.03) -> Column:
    return 1.0 + (heavy - 1.0) / (1.0 + F.exp(-(y - threshold) / tau))


def band_weight(y: Column, threshold: float = 0.1) -> Column:
    """5, 3, 2 within 0.01, 0.03, 0.05 of the threshold, else 1. Distances are rounded so that borders count as inside."""
    d = F.round(F.abs(y - threshold), 9)
    return F.when(d <= 0.01, 5.0).when(d <= 0.03, 3.0).when(d <= 0.05, 2.0).otherwise(1.0)


def sample_weight(y: Column, scheme: str = "step", **how: float) -> Column:
    schemes = {"step": step_weight, "smooth": smooth_weight, "band": band_weight}
    if scheme not in schemes:
        raise ValueError(f"unknown weight scheme: {scheme}")
    return schemes[scheme](y, **how)


def weight_statistics(rows: DataFrame, schemes: dict[str, Column], value: str = "xag", threshold: float = 0.1) -> DataFrame:
    """scheme, mean, std, min, max, rows and rate over the threshold, effective sample size: one pass for all schemes."""
    each = rows.select(F.col(value).alias("y"), F.inline(F.array(*[F.struct(F.lit(k).alias("scheme"), w.cast("double").alias("w")) for k, w in schemes.items()])))
    return each.groupBy("scheme").agg(
        F.avg("w").alias("mean"), F.stddev_pop("w").alias("std"), F.min("w").alias("min"), F.max("w").alias("max"), F.count_if(F.col("y") >= threshold).alias("n_pos"),
        F.avg((F.col("y") >= threshold).cast("double")).alias("pos_rate"), (F.sum("w") * F.sum("w") / F.sum(F.col("w") * F.col("w"))).alias("effective_n"),
    )


# ---- metrics ----


def weighted_rmse(y: Column, p: Column, w: Column) -> Column:
    """Aggregate: the root of the mean of w times squared error; the mean is over rows, not over weights."""
    return F.sqrt(F.avg(w * (y - p) * (y - p)) + 1e-9)


def log_loss(y: Column, p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-15)), F.lit(1 - 1e-15))
    return -F.avg(y * F.log(q) + (1 - y) * F.log(1 - q))


def prediction_summary(rows: DataFrame, p: str) -> DataFrame:
    one = rows.agg(F.avg(p).alias("mean"), F.stddev_pop(p).alias("std"), F.min(p).alias("min"), F.max(p).alias("max"))
    q = percentiles(rows, p, (0.25, 0.5, 0.75))
    return one.crossJoin(F.broadcast(q)).select("mean", "std", "min", "max", *[F.col("q")[i].alias(n) for i, n in enumerate(("p25", "p50", "p75"))])  # one row each


def correlations(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """a, b and Pearson's correlation of each pair of columns, over rows where both are there: one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = rows.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("corr")) for i, (a, b) in enumerate(pairs)])))


def calibration_table(rows: DataFrame, p: str, y: str, buckets: int = 10) -> DataFrame:
    """bucket, n, mean prediction and rate, in quantile buckets closed on the right; the edges are exact percentiles."""
    edges = percentiles(rows, p, [i / buckets for i in range(1, buckets)]).select(F.col("q").alias("_edges"))
    at = F.size(F.filter("_edges", lambda e: e < F.col(p)))
    placed = rows.crossJoin(F.broadcast(edges)).withColumn("bucket", at.cast("int"))  # one row of edges
    return placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_pred"), F.avg(y).alias("rate"))


def ranking_quality(rows: DataFrame, p: str, y: str) -> DataFrame:
    """auc and average precision with ties counted half and as one step: sums over distinct predictions, in ranges of them."""
    counts = rows.groupBy(F.col(p).alias("p")).agg(F.sum(F.col(y)).cast("double").alias("pos"), F.sum(1 - F.col(y)).cast("double").alias("neg"))
    spread = with_value_range(counts, "p").withColumn("part", -F.col("_part"))
    parts = spread.groupBy("part").agg(F.sum("pos").alias("a"), F.sum("neg").alias("b"))
    w = Window.orderBy("part")  # one row a range
    offsets = parts.select("part", (F.sum("a").over(w) - F.col("a")).alias("pos0"), (F.sum("b").over(w) - F.col("b")).alias("neg0"))
    inside = Window.partitionBy("part").orderBy(F.desc("p"))
    run = spread.join(F.broadcast(offsets), "part").withColumns({"tp": F.sum("pos").over(inside) + F.col("pos0"), "fp": F.sum("neg").over(inside) + F.col("neg0")})
    area = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2))
    return run.agg(F.try_divide(area, F.sum("pos") * F.sum("neg")).alias("auc"), F.try_divide(F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))), F.sum("pos")).alias("average_precision"))


def fold_balance(rows: DataFrame, value: str = "xag", fold: str = "fold", threshold: float = 0.1) -> DataFrame:
    pos = (F.col(value) >= threshold).cast("double")
    return rows.groupBy(fold).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(value) >= threshold).alias("n_pos"), F.avg(pos).alias("pos_rate"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def fold_warnings(rows: DataFrame, value: str = "xag", fold: str = "fold", least: int = 100, most_std: float = 0.05) -> list[str]:
    """What is odd about folds: too few rows, or means that differ too much."""
    found = rows.groupBy(fold).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("m")).collect()  # one row a fold
    out = [f"fold {r[fold]}: {r['n']} rows" for r in sorted(found, key=lambda r: r[fold]) if r["n"] < least]
    means = [r["m"] for r in found if r["m"] is not None]
    if means and math.sqrt(sum((m - sum(means) / len(means)) ** 2 for m in means) / len(means)) > most_std:
        out.append("the folds' means differ")
    return out


# ---- folds ----


def group_sizes(rows: DataFrame, group: str = "match_id") -> DataFrame:
    return rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"))


#: Classes of groups (by size) that are sent to all executors; a table of more is joined.
SENT_CLASSES = 100_000


def deal(loads: list[int], order: list[tuple], size: int, count: int) -> tuple[list[int], list[list[int]], list[int]]:
    """Deals `count` groups of one size, each to the lightest fold: (ranks at which a segment starts, the folds that take turns in it,
    loads afterwards). order: what tells folds of equal loads apart.

    The j-th of them that a fold would take finds it at load + j * size, so groups go in the order of these numbers: level by level of
    `size`, and within a level in the order of the remainders, among the folds that have been reached.
    """
    level = [x // size for x in loads]
    turn = sorted(range(len(loads)), key=lambda f: (loads[f] % size, order[f]))
    starts, turns, after, at = [], [], list(loads), 0
    levels = sorted(set(level))
    for i, low in enumerate(levels):
        active = [f for f in turn if level[f] <= low]
        room = (levels[i + 1] - low) * len(active) if i + 1 < len(levels) else count - at
        here = min(room, count - at)
        if here <= 0:
            break
        starts.append(at)
        turns.append(active)
        for k, f in enumerate(active):
            after[f] += size * (here // len(active) + (k < here % len(active)))
        at += here
    return starts, turns, after


def _ranked(groups: DataFrame, by: Sequence[str], group: str, seed: int) -> DataFrame:
    """_rank from 0 of each group among those of its class, in an order drawn by the seed: numbered by ranges of that order, so that a
    class of very many groups is many tasks' work."""
    h = groups.withColumn("_h", F.xxhash64(F.col(group), F.lit(seed))).withColumn("_part", F.pmod(F.shiftright("_h", 40), F.lit(256)))
    parts = h.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_n"))
    offsets = parts.withColumn("_offset", F.sum("_n").over(Window.partitionBy(*by).orderBy("_part")) - F.col("_n")).drop("_n")  # 256 rows a class
    inside = F.row_number().over(Window.partitionBy(*by, "_part").orderBy("_h", group)) - 1
    return h.withColumn("_at", inside).join(offsets, [*by, "_part"]).withColumn("_rank", F.col("_at") + F.col("_offset")).drop("_h", "_part", "_at", "_offset")


def _placed(groups: DataFrame, by: Sequence[str], table: list[tuple], group: str, seed: int) -> DataFrame:
    """group and fold. table: the class, and starts and turns as deal() gives them."""
    kinds = ", ".join(f"{c} {groups.schema[c].dataType.simpleString()}" for c in by)
    classes = groups.sparkSession.createDataFrame(table, f"{kinds}, _starts array<long>, _turns array<array<int>>")
    ranked = _ranked(groups, by, group, seed).join(F.broadcast(classes) if len(table) <= SENT_CLASSES else classes, list(by))
    segment = F.size(F.filter("_starts", lambda s: s <= F.col("_rank"))) - 1
    turn = F.col("_turns")[F.col("_segment")]
    fold = turn[F.pmod(F.col("_rank") - F.col("_starts")[F.col("_segment")], F.size(turn)).cast("int")] + 1
    return ranked.withColumn("_segment", segment).select(group, fold.alias("fold"))


def group_folds(rows: DataFrame, group: str = "match_id", splits: int = 5, seed: int = 42) -> DataFrame:
    """group and fold from 1: the largest group first, each to the fold with the fewest rows, those of a size in an order drawn by the
    seed. The driver sees one row a size of groups, of which there are fewer than the root of twice the number of rows."""
    sizes = group_sizes(rows, group)
    classes = sorted(((r["n"], r["count"]) for r in sizes.groupBy("n").count().collect()), reverse=True)  # one row a size
    load, table = [0] * splits, []
    for size, count in classes:
        starts, turns, load = deal(load, list(range(splits)), size, count)
        table.append((size, starts, turns))
    return _placed(sizes, ["n"], table, group, seed)


def hashed_folds(rows: DataFrame, group: str = "match_id", splits: int = 5, seed: int = 42) -> DataFrame:
    """fold from 1 by a hash of the group: no state, any number of groups."""
    return rows.withColumn("fold", (F.pmod(F.xxhash64(F.col(group), F.lit(seed)), F.lit(splits)) + 1).cast("int"))


def group_strata(rows: DataFrame, value: str = "xag", group: str = "match_id", threshold: float = 0.1, bins: int = 5) -> DataFrame:
    """group, rows, positives and bin: quantile bins, over rows, of the group's rate of positives."""
    rate = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(value) >= threshold).alias("n_pos"))
    rate = rate.withColumn("rate", F.col("n_pos") / F.col("n"))
    edges = percentiles(rate, "rate", [i / bins for i in range(1, bins)], weight="n").select(F.col("q").alias("_edges"))
    bin_ = F.size(F.filter("_edges", lambda e: e <= F.col("rate")))
    return rate.crossJoin(F.broadcast(edges)).select(group, "n", "n_pos", bin_.cast("int").alias("bin"))  # one row of edges


def stratified_folds(rows: DataFrame, y: str, key: Sequence[str], splits: int = 5, seed: int = 42) -> DataFrame:
    """rows with fold from 0: the rows of each value of y are dealt out in turn, in an order drawn by the seed. They are numbered by
    ranges of that order, so a frequent value is many tasks' work."""
    h = rows.withColumn("_h", F.xxhash64(*key, F.lit(seed))).withColumn("_part", F.pmod(F.shiftright("_h", 40), F.lit(256)))
    parts = h.groupBy(F.col(y).alias("_y"), "_part").agg(F.count(F.lit(1)).alias("_n"))
    offsets = parts.select("_y", "_part", (F.sum("_n").over(Window.partitionBy("_y").orderBy("_part")) - F.col("_n")).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy(y, "_part").orderBy("_h", *key)) - 1
    placed = h.withColumn("_at", inside).withColumnRenamed("_part", "_of").join(F.broadcast(offsets), F.col(y).eqNullSafe(F.col("_y")) & (F.col("_of") == F.col("_part")))  # 256 rows a value
    return placed.withColumn("fold", F.pmod(F.col("_at") + F.col("_offset"), F.lit(splits)).cast("int")).select(*rows.columns, "fold")


def stratified_group_folds(rows: DataFrame, value: str = "xag", group: str = "match_id", threshold: float = 0.1, splits: int = 5, bins: int = 5, seed: int = 42) -> DataFrame:
    """group and fold from 1: groups go, the largest first, where the bins' shares over folds stay most alike: as a group changes one
    bin's shares alone, that is the fold with the fewest rows of its bin, and of such ones that with the fewest rows so far. Groups of
    one size and bin go in an order drawn by the seed; the driver sees one row a size and bin."""
    strata = group_strata(rows, value, group, threshold, bins)
    classes = sorted(((r["n"], r["bin"], r["count"]) for r in strata.groupBy("n", "bin").count().collect()), key=lambda r: (-r[0], r[1]))  # one row a size and bin
    loads, table = [[0] * splits for _ in range(bins)], []
    for size, bin_, count in classes:
        total = [sum(x) for x in zip(*loads, strict=True)]
        starts, turns, loads[bin_] = deal(loads[bin_], [(t, f) for f, t in enumerate(total)], size, count)
        table.append((size, bin_, starts, turns))
    return _placed(strata.select(group, "n", "bin"), ["n", "bin"], table, group, seed)


def ordered_folds(rows: DataFrame, order: Sequence[str], splits: int = 5) -> DataFrame:
    """fold from 0: the first block is only trained on (-1), each later one is tested once. Blocks are cut at percentiles of the
    leading column (a number or a date), so rows of one value stay together."""
    lead = order[0]
    edges = rows.agg(F.percentile_approx(lead, [i / (splits + 1) for i in range(1, splits + 1)], 10000).alias("_edges"))
    at = F.size(F.filter("_edges", lambda e: e < F.col(lead)))
    return rows.crossJoin(F.broadcast(edges)).withColumn("fold", (at - 1).cast("int")).drop("_edges")  # one row of edges


def explode_folds(rows: DataFrame, splits: int, split: str) -> DataFrame:
    """All rows once for each fold: the row's fold where it is tested in it, -1 where it is trained on."""
    each = rows.withColumn("_at", F.explode(F.sequence(F.lit(1), F.lit(splits))))
    return each.withColumn("fold", F.when(F.col("fold") == F.col("_at"), F.col("fold")).otherwise(-1)).withColumn("split_id", F.lit(split)).withColumnRenamed("_at", "fold_no")
