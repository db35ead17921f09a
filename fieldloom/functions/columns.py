"""Column helpers: null-safe comparisons, guarded arithmetic, pitch geometry and bucketing. All stay in generated JVM code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pitch size, action kinds and the areas that features are named for.
PITCH = (105.0, 68.0)
GOAL = (105.0, 34.0)
SHOTS = ("shot", "shot_freekick", "shot_penalty")
BOX = (88.5, 13.84, 54.16)
ZONE14 = (65.0, 85.0, 20.0, 48.0)
HALFSPACE_LEFT, HALFSPACE_RIGHT = 22.67, 45.33


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def yes(c: Column) -> Column:
    """The condition, false where it is null."""
    return F.coalesce(c, F.lit(False))


def same(a: Column | str, b: Column | str) -> Column:
    return yes(col(a) == col(b))


def differs(a: Column | str, b: Column | str) -> Column:
    """True also where one side is null and the other isn't, or both are."""
    return ~same(a, b)


def is_shot(c: Column | str) -> Column:
    return yes(col(c).isin(*SHOTS))


def ratio(n: Column, d: Column) -> Column:
    """n / d, 0 where d is not above 0."""
    return F.coalesce(F.when(d > 0, F.try_divide(n.cast("double"), d.cast("double"))), F.lit(0.0))


def clamp(c: Column, low: float | None = None, high: float | None = None) -> Column:
    """Null stays null, unlike with greatest and least alone."""
    out = c
    if low is not None:
        out = F.greatest(out, F.lit(low))
    if high is not None:
        out = F.least(out, F.lit(high))
    return F.when(c.isNotNull(), out)


def count_where(cond: Column) -> Column:
    return F.count_if(yes(cond))


def sum_where(cond: Column, value: Column) -> Column:
    return F.coalesce(F.sum(F.when(cond, value)), F.lit(0.0))


def mean_where(cond: Column, value: Column) -> Column:
    return F.coalesce(F.avg(F.when(cond, value)), F.lit(0.0))


def share_where(cond: Column, flag: Column) -> Column:
    """Share of the rows where cond holds that have the flag; 0 without such rows."""
    return mean_where(cond, yes(flag).cast("double"))


def in_box(x: Column | str, y: Column | str) -> Column:
    return yes((col(x) >= BOX[0]) & col(y).between(BOX[1], BOX[2]))


def in_zone14(x: Column | str, y: Column | str) -> Column:
    return yes((col(x) >= ZONE14[0]) & (col(x) < ZONE14[1]) & col(y).between(ZONE14[2], ZONE14[3]))


def in_left(y: Column | str) -> Column:
    return yes(col(y) < HALFSPACE_LEFT)


def in_right(y: Column | str) -> Column:
    return yes(col(y) > HALFSPACE_RIGHT)


def in_centre(y: Column | str) -> Column:
    return yes(col(y).between(HALFSPACE_LEFT, HALFSPACE_RIGHT))


def third_code(x: Column | str) -> Column:
    """0, 1, 2 for [0, 35], (35, 70], (70, 105]; null outside."""
    c = col(x)
    return F.when((c >= 0) & (c <= 35), 0).when((c > 35) & (c <= 70), 1).when((c > 70) & (c <= 105), 2)


def grid_index(c: Column | str, size: float, cells: int) -> Column:
    """Cell from 0 of an even grid over [0, size]; values outside go to the border cells, null stays null."""
    cell = F.least(F.greatest(F.width_bucket(col(c), F.lit(0.0), F.lit(size), F.lit(cells)), F.lit(1)), F.lit(cells)) - 1
    return F.when(col(c).isNotNull(), cell)


def goal_distance(x: Column, y: Column) -> Column:
    return F.hypot(F.lit(GOAL[0]) - x, F.lit(GOAL[1]) - y)


def goal_angle(x: Column, y: Column) -> Column:
    return F.atan2(F.abs(F.lit(GOAL[1]) - y), F.greatest(F.lit(GOAL[0]) - x, F.lit(1e-6)))


def snap(c: Column, step: float = 0.1, tolerance: float = 0.02) -> Column:
    """The nearest multiple of step where it is within tolerance, else the value."""
    near = F.bround(c / step) * step
    near = F.bround(near, 6)
    return F.when(F.abs(c - near) <= tolerance, near).otherwise(c)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Spark takes NaN for a value; a missing one must be null."""
    kinds = dict(df.dtypes)
    return df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in df.columns])


def select_columns(df: DataFrame, prefixes: Sequence[str] = (), suffixes: Sequence[str] = (), keep: Sequence[str] = ()) -> DataFrame:
    """keep, then the columns by prefix or suffix in the table's order, each once."""
    hit = [c for c in df.columns if c.startswith(tuple(prefixes)) or c.endswith(tuple(suffixes))]
    return df.select(*dict.fromkeys([*keep, *hit]))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that sums taken in another order compare as equal; -0.0 becomes 0.0."""
    kinds = dict(df.dtypes)
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in df.columns])
