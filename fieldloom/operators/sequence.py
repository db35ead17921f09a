"""Actions in order: semi-join to the wanted players, one pitch direction, and neighbours by one window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

KEY = ("match_id", "player_id")
ORDER = ("period_id", "time_seconds", "action_id")
#: Columns of neighbouring actions that features ask for, with their short names.
NEIGHBOUR = {"type": "type_name", "team": "team_id", "player": "player_id", "time": "time_seconds", "x": "start_x", "y": "start_y", "xt": "xt_learned_delta"}


def relevant(actions: DataFrame, pairs: DataFrame) -> DataFrame:
    """Actions of the wanted (match, player) pairs; the sequence is taken after this, among those alone."""
    return actions.join(pairs.select(*KEY).distinct(), list(KEY), "left_semi")


def one_direction(actions: DataFrame) -> DataFrame:
    """Coordinates of the away side turned round; rows that don't say their side stay."""
    away = ~F.col("is_home")
    turn = lambda c, size: F.when(away, F.lit(size) - F.col(c)).otherwise(F.col(c))
    return actions.withColumns({c: turn(c, 105.0 if c.endswith("x") else 68.0) for c in ("start_x", "start_y", "end_x", "end_y")})


def by_match(order: tuple[str, ...] = ORDER) -> WindowSpec:
    return Window.partitionBy("match_id").orderBy(*order)


def with_neighbours(actions: DataFrame, after: int = 0, before: int = 0, order: tuple[str, ...] = ORDER, columns: tuple[str, ...] = ("type", "team", "player", "time", "xt")) -> DataFrame:
    """type_1, team_1, ... of the next `after` actions and type_p1, ... of the `before` previous ones. One exchange and one sort
    by match, whatever the number of columns; the later aggregate by (match, player) needs no further exchange."""
    w = by_match(order)
    have = {k: NEIGHBOUR[k] for k in columns if NEIGHBOUR[k] in actions.columns}
    ahead = {f"{k}_{i}": F.lead(c, i).over(w) for i in range(1, after + 1) for k, c in have.items()}
    behind = {f"{k}_p{i}": F.lag(c, i).over(w) for i in range(1, before + 1) for k, c in have.items()}
    return actions.withColumns(ahead | behind) if ahead or behind else actions


def with_value_range(df: DataFrame, value: str, parts: int = 64) -> DataFrame:
    """_part: which of so many ranges of about equal numbers of rows the value is in, from 0. The edges are fixed numbers, so that
    a task that runs again deals rows alike; running sums go over one range at a time and then over one row a range."""
    edges = df.agg(F.percentile_approx(value, [i / parts for i in range(1, parts)], 1000)).first()[0] or []  # `parts` numbers
    at = F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e < F.col(value))) if edges else F.lit(0)
    return df.withColumn("_part", at)
