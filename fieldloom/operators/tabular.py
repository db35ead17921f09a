"""Preparation of plain tables: titles out of names, bands, imputation over all rows, and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.operators.quantiles import percentiles
from fieldloom.operators.sequence import KEY, with_value_range

#: Titles by group (all others are rare), and the names of bands.
TITLES = {"Mr": "Mr", "Mrs": "Mrs", "Miss": "Miss", "Master": "Master", "Mlle": "Miss", "Ms": "Mrs", "Mme": "Mrs"}
FARE_NAMES = ("Low", "Medium", "High", "VeryHigh")
AGE_EDGES = (0.0, 12.0, 18.0, 35.0, 60.0, 100.0)
AGE_NAMES = ("Child", "Teen", "Adult", "Middle", "Senior")


def title(name: Column) -> Column:
    """The word before the first dot after a space, grouped; `Rare` where there is none."""
    found = F.nullif(F.regexp_extract(name, r" ([A-Za-z]+)\.", 1), F.lit(""))
    groups = F.create_map(*[F.lit(x) for kv in TITLES.items() for x in kv])
    return F.coalesce(F.element_at(groups, found), F.lit("Rare"))


def band(value: Column, edges: tuple[float, ...] = AGE_EDGES, names: tuple[str, ...] = AGE_NAMES) -> Column:
    """Name of the half-open range (low, high] that holds the value; null outside."""
    out = F.lit(None).cast("string")
    for low, high, name in zip(edges, edges[1:], names, strict=False):
        out = F.when((value > low) & (value <= high), name).otherwise(out)
    return out


def quartile_band(rows: DataFrame, column: str, out: str) -> DataFrame:
    """Name of the quarter by exact quartiles of the whole table, closed on the right; null stays null."""
    edges = percentiles(rows, column, (0.25, 0.5, 0.75)).select(F.col("q").alias("_edges"))
    at = F.size(F.filter("_edges", lambda e: e < F.col(column))) + 1
    name = F.when(F.col(column).isNotNull(), F.element_at(F.array(*[F.lit(n) for n in FARE_NAMES]), at))
    return rows.crossJoin(F.broadcast(edges)).withColumn(out, name).drop("_edges")  # one row of edges


def family(siblings: Column, parents: Column) -> dict[str, Column]:
    size = siblings + parents + 1
    return {"FamilySize": size, "IsAlone": (size == 1).cast("int")}


def impute(rows: DataFrame, how: dict[str, str | float]) -> DataFrame:
    """Missing values filled by `median`, `mean`, `mode` of the whole table (the smallest of equal modes) or by the given constant."""
    stats = [c for c, m in how.items() if m in ("median", "mean", "mode")]
    for c in stats:
        if how[c] == "median":
            one = percentiles(rows, c, (0.5,)).select(F.col("q")[0].alias(f"_fill_{c}"))
        elif how[c] == "mean":
            one = rows.agg(F.avg(c).alias(f"_fill_{c}"))
        else:
            counts = rows.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("_n"))
            one = counts.agg(F.min_by(c, F.struct(-F.col("_n"), F.col(c))).alias(f"_fill_{c}"))
        rows = rows.crossJoin(F.broadcast(one))  # one row
    fill = {c: F.coalesce(F.col(c), F.col(f"_fill_{c}") if c in stats else F.lit(how[c])) for c in how}
    return rows.withColumns(fill).drop(*[f"_fill_{c}" for c in stats])


def prepare_passengers(rows: DataFrame) -> DataFrame:
    """Title, family size, bands and imputed values of the passenger table (train and test together)."""
    rows = impute(rows, {"Age": "median", "Fare": "median", "Embarked": "mode"})
    rows = rows.withColumns({"Title": title(F.col("Name")), **family(F.col("SibSp"), F.col("Parch")), "AgeBand": band(F.col("Age"))})
    return quartile_band(rows, "Fare", "FareBand")


def age_years(date: Column, birth: Column) -> Column:
    return F.datediff(F.try_to_timestamp(date), F.try_to_timestamp(birth)) / F.lit(365.25)


def union_tables(train: DataFrame, test: DataFrame) -> DataFrame:
    """Both, marked is_train; columns that one lacks are null."""
    return train.withColumn("is_train", F.lit(True)).unionByName(test.withColumn("is_train", F.lit(False)), allowMissingColumns=True)


def overlap(a: DataFrame, b: DataFrame, key: str = "match_id") -> DataFrame:
    """in_both, only_a, only_b: distinct keys."""
    side = lambda df, l, r: df.select(key).distinct().withColumns({"_a": F.lit(l), "_b": F.lit(r)})  # noqa: E731, E741
    each = side(a, 1, 0).unionByName(side(b, 0, 1)).groupBy(key).agg(F.max("_a").alias("x"), F.max("_b").alias("y"))
    return each.agg(F.count_if((F.col("x") == 1) & (F.col("y") == 1)).alias("in_both"), F.count_if(F.col("y") == 0).alias("only_a"), F.count_if(F.col("x") == 0).alias("only_b"))


def distinct_pairs(actions: DataFrame) -> DataFrame:
    return actions.select(*KEY).distinct()


def categories(*tables: DataFrame, column: str, most: int = 1000) -> list:
    """The values of a column in any of the tables, in order: one-hot columns are then the same in all of them. More than `most`
    are an error, as each would be a column."""
    all_rows = tables[0].select(column)
    for t in tables[1:]:
        all_rows = all_rows.unionByName(t.select(column))
    found = [r[0] for r in all_rows.where(F.col(column).isNotNull()).distinct().limit(most + 1).collect()]  # at most `most` + 1 values
    if len(found) > most:
        raise ValueError(f"{column} has more than {most} values")
    return sorted(found)


def dictionary(rows: DataFrame, column: str) -> DataFrame:
    """value and code from 0: the most frequent value first, ties in the order of values. Codes are summed up by ranges of
    frequency, so that a column of very many values is many tasks' work."""
    counts = rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    spread = with_value_range(counts, "_n")
    sizes = spread.groupBy("_part").agg(F.count(F.lit(1)).alias("_k"))
    after = Window.orderBy(F.desc("_part"))  # one row a range
    offsets = sizes.select("_part", (F.sum("_k").over(after) - F.col("_k")).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(F.desc("_n"), column)) - 1
    return spread.withColumn("_at", inside).join(F.broadcast(offsets), "_part").select(F.col(column).alias("value"), (F.col("_at") + F.col("_offset")).cast("long").alias("code"))
