"""Encodings that don't see their own fold: smoothed target means, league residuals, crosses with categories, empirical ranks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.operators.sequence import with_value_range
from fieldloom.sources.staging import side_by_side, staged


def crossed_key(a: str, b: str, by: str = "_vs_") -> Column:
    """Both values as text; a missing one reads `nan`."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("nan"))
    return F.concat(text(a), F.lit(by), text(b))


def target_encoding(rows: DataFrame, key: str, value: str = "xag", fold: str = "fold", alpha: float = 10.0) -> DataFrame:
    """key, fold, encoding: the key's mean over the other folds, drawn towards the mean of all by alpha rows. One aggregate;
    the other folds are the key's total less the own fold. A key with no other fold gets the mean of all."""
    parts = rows.groupBy(key, fold).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    overall = rows.agg(F.avg(value).alias("_mean"))
    w = Window.partitionBy(key)
    others = lambda c: F.sum(c).over(w) - F.col(c)
    both = parts.select(key, fold, others("s").alias("s"), others("n").alias("n")).crossJoin(F.broadcast(overall))  # one row
    return both.select(key, fold, ((F.col("s") + F.col("_mean") * alpha) / (F.col("n") + alpha)).alias(f"{key}_target_enc"))


def target_encoding_all(rows: DataFrame, key: str, value: str = "xag", alpha: float = 10.0) -> DataFrame:
    """key and encoding from all training rows, for rows outside them."""
    overall = rows.agg(F.avg(value).alias("_mean"))
    parts = rows.groupBy(key).agg(F.sum(value).alias("s"), F.count(value).alias("n")).crossJoin(F.broadcast(overall))  # one row
    return parts.select(key, ((F.col("s") + F.col("_mean") * alpha) / (F.col("n") + alpha)).alias(f"{key}_target_enc"))


def with_target_encoding(rows: DataFrame, key: str, value: str = "xag", fold: str = "fold", alpha: float = 10.0, of: DataFrame | None = None) -> DataFrame:
    """rows, all of them, with `<key>_target_enc`: of the other folds for a row with a fold, of all rows with one for a new row (fold
    null). A missing key, and one that those rows haven't got, gets the mean of all rows with a fold. of: the
    same rows before other encodings were joined to them, so that a chain of encodings reads them once more each, not all it joined so far."""
    name = f"{key}_target_enc"
    known = (rows if of is None else of).where(F.col(fold).isNotNull())
    keyed = known.where(F.col(key).isNotNull())
    overall = known.agg(F.avg(value).alias("_mean"))
    parts = keyed.groupBy(key, fold).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    w = Window.partitionBy(key)
    own = parts.select(key, fold, (F.sum("s").over(w) - F.coalesce("s", F.lit(0.0))).alias("s"), (F.sum("n").over(w) - F.col("n")).alias("n"))
    every = parts.groupBy(key).agg(F.sum("s").alias("s"), F.sum("n").alias("n")).withColumn(fold, F.lit(None).cast(rows.schema[fold].dataType)).select(*own.columns)
    table = own.unionByName(every).withColumnsRenamed({key: "_key", fold: "_fold", "s": "_s", "n": "_n"})
    wide = rows.join(table, (F.col(key) == F.col("_key")) & F.col(fold).eqNullSafe(F.col("_fold")), "left").crossJoin(F.broadcast(overall))  # one row
    encoded = F.when(F.col("_n") > 0, (F.coalesce("_s", F.lit(0.0)) + F.col("_mean") * alpha) / (F.col("_n") + alpha)).otherwise(F.col("_mean"))
    return wide.withColumn(name, encoded).drop("_key", "_fold", "_s", "_n", "_mean")


def permuted(rows: DataFrame, ids: Sequence[str], seed: int, name: str = "_order") -> DataFrame:
    """A place in an order drawn by the seed."""
    return rows.withColumn(name, F.xxhash64(*ids, F.lit(seed)))


def ordered_target_encoding(rows: DataFrame, key: str, order: Sequence[str], value: str = "xag", prior: float = 1.0, name: str | None = None) -> DataFrame:
    """rows, all of them, with `<key>_ordered_enc`: the mean of the key's values in the rows before in the order, drawn towards the mean of
    all by `prior` rows; no row sees its own value. Rows without a value see all that have one. A missing key is a key of its own.

    Sums run over ranges of the order's first column (a number), and over those of a range, so a frequent key is many tasks' work.
    """
    known = F.col(value).isNotNull()
    lead = order[0]
    spread = with_value_range(rows.withColumnRenamed("_part", "_given") if "_part" in rows.columns else rows, lead)
    parts = spread.groupBy(F.col(key).alias("_key"), F.col("_part").alias("_of")).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    before, every = Window.partitionBy("_key").orderBy("_of"), Window.partitionBy("_key")  # one row a range
    sums = parts.select(
        "_key", "_of", (F.coalesce(F.sum("_s").over(before), F.lit(0.0)) - F.coalesce("_s", F.lit(0.0))).alias("_s0"), (F.sum("_n").over(before) - F.col("_n")).alias("_n0"),
        F.coalesce(F.sum("_s").over(every), F.lit(0.0)).alias("_all_s"), F.sum("_n").over(every).alias("_all_n"),
    )
    w = Window.partitionBy(key, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = spread.withColumns({"_s1": F.coalesce(F.sum(value).over(w), F.lit(0.0)), "_n1": F.coalesce(F.count(value).over(w), F.lit(0))})
    overall = rows.agg(F.avg(value).alias("_mean"))
    both = inside.join(sums, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_of"))).crossJoin(F.broadcast(overall))  # one row
    s, n = F.when(known, F.col("_s0") + F.col("_s1")).otherwise(F.col("_all_s")), F.when(known, F.col("_n0") + F.col("_n1")).otherwise(F.col("_all_n"))
    return both.withColumn(name or f"{key}_ordered_enc", (s + F.col("_mean") * prior) / (n + prior)).select(*rows.columns, name or f"{key}_ordered_enc")


def ordered_encodings(rows: DataFrame, keys: Sequence[str], ids: Sequence[str], value: str = "xag", seeds: Sequence[int] = (1, 2, 3, 4), prior: float = 1.0) -> tuple[DataFrame, list[str]]:
    """rows with each key's ordered encoding in several permutations, and the names of these columns. ids: without nulls, one row each."""
    narrow = staged(rows.select(*ids, *keys, value), "ids")
    names = {seed: [f"{key}_ordered_enc_{seed}" for key in keys] for seed in seeds}

    def of_seed(seed: int) -> DataFrame:
        out = permuted(narrow, ids, seed)
        for key, name in zip(keys, names[seed], strict=True):
            out = ordered_target_encoding(out, key, ["_order", *ids], value, prior, name)
        return staged(out.select(*ids, *names[seed]), "encoded")

    for part in side_by_side(rows.sparkSession, [partial(of_seed, seed) for seed in seeds]):
        rows = rows.join(part, list(ids))
    return rows, [name for of in names.values() for name in of]


#: Columns that with_residuals adds, besides the encodings.
RESIDUALS = ("squad_comp_residual", "squad_global_residual", "squad_vs_opponent_gap")


def with_residuals(rows: DataFrame, value: str = "xag", fold: str = "fold", alpha: float = 5.0) -> DataFrame:
    """rows, all of them, with the encodings of comp, squad and opponent and how the squad's stands to the league's, to the mean of all and to the opponent's."""
    out = rows
    for key, a in (("comp", alpha), ("squad", 10.0), ("opponent", 10.0)):
        out = with_target_encoding(out, key, value, fold, a, rows)
    out = out.crossJoin(F.broadcast(rows.where(F.col(fold).isNotNull()).agg(F.avg(value).alias("_mean"))))  # one row
    gaps = zip(RESIDUALS, ("comp_target_enc", "_mean", "opponent_target_enc"), strict=True)
    return out.withColumns({name: F.col("squad_target_enc") - F.col(other) for name, other in gaps}).drop("_mean")


def league_residuals(rows: DataFrame, value: str = "xag", alpha: float = 5.0) -> DataFrame:
    return with_residuals(rows, value, alpha=alpha).select("match_id", "player_id", "comp_target_enc", *RESIDUALS)


def _labels(values: list) -> dict[str, object]:
    """What each value is called in column names: without dots and backticks, and with a number where another has its name."""
    out: dict[str, object] = {}
    taken: set[str] = set()
    for v in values:
        plain = str(v).replace(".", "_").replace("`", "_")
        name, i = plain, 1
        while name.lower() in taken:  # names of columns don't tell cases apart
            i += 1
            name = f"{plain}_{i}"
        taken.add(name.lower())
        out[name] = v
    return out


def category_crosses(rows: DataFrame, columns: list[str], category: str, values: list) -> DataFrame:
    """Each column times the one-hot of the category; the list of values is the caller's, so train and test have the same columns."""
    return rows.withColumns({f"{c}__comp_gate_{name}": F.when(F.col(category) == F.lit(v), F.col(c).cast("double")).otherwise(0.0) for c in columns for name, v in _labels(values).items()})


def one_hot(rows: DataFrame, column: str, values: list) -> DataFrame:
    return rows.withColumns({f"{column}_{name}": F.when(F.col(column) == F.lit(v), 1.0).otherwise(0.0) for name, v in _labels(values).items()})


def empirical_position(rows: DataFrame, value: str, reference: Column) -> DataFrame:
    """Adds `centred`: the share of reference values below, put at its half step, less a half; null for a missing value, which counts
    as no reference either. Values are counted first, so the running sum goes over distinct values, in ranges of them that are
    summed apart."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.count_if(reference).alias("_ref"))
    spread = with_value_range(counts, value)
    inside = F.sum("_ref").over(Window.partitionBy("_part").orderBy(value)) - F.col("_ref")
    ranked = spread.withColumn("_below", inside)
    parts = spread.groupBy("_part").agg(F.sum("_ref").alias("_n"))
    before = Window.orderBy("_part")  # one row a range
    offsets = parts.select("_part", (F.sum("_n").over(before) - F.col("_n")).alias("_offset"), F.sum("_n").over(Window.partitionBy()).alias("_total"))
    position = F.least(F.greatest((F.col("_below") + F.col("_offset") + 0.5) / F.col("_total"), F.lit(1e-6)), F.lit(1 - 1e-6)) - 0.5
    table = ranked.join(F.broadcast(offsets), "_part").select(value, F.when(F.col("_total") > 0, position).otherwise(0.0).alias("centred"))
    return rows.join(staged(table, "positions"), value, "left")  # of a written table Spark knows whether it is small enough to be broadcast
