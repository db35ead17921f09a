"""Exact percentiles of large columns: values are counted first, and counts are summed up range by range."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.operators.sequence import with_value_range


def percentiles(rows: DataFrame, value: str, shares: Sequence[float], by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """The columns `by` (few groups, no nulls) and q: an array of the interpolated percentiles of value, each row counted weight
    times. No task holds more than one range of the distinct values; nulls are left out."""
    many = F.sum(weight) if weight else F.count(F.lit(1))
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(many.alias("_c"))
    spread = with_value_range(counts, "_v")
    parts = spread.groupBy(*by, "_part").agg(F.sum("_c").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_part")  # one row a range
    offsets = parts.select(*by, "_part", (F.sum("_n").over(before) - F.col("_n")).alias("_offset"), F.sum("_n").over(Window.partitionBy(*by)).alias("_total"))
    inside = F.sum("_c").over(Window.partitionBy(*by, "_part").orderBy("_v"))
    ends = spread.join(F.broadcast(offsets), [*by, "_part"]).withColumn("_end", inside + F.col("_offset"))

    def at(place) -> F.Column:
        return F.max(F.when((F.col("_end") - F.col("_c") <= place) & (place < F.col("_end")), F.col("_v")))

    out = []
    for s in shares:
        place = F.lit(float(s)) * (F.col("_total") - 1)
        low, part = at(F.floor(place)), F.max(place - F.floor(place))
        out.append(F.when(part > 0, low * (1 - part) + at(F.ceil(place)) * part).otherwise(low))
    return ends.groupBy(*by).agg(F.array(*out).alias("q"))
