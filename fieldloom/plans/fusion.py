"""Feature blocks as data: conditional aggregates that many blocks share one pass for.

A block is a set of aggregates over rows prepared once. fuse() puts the aggregates of all blocks into a single groupBy, so
twenty blocks cost one exchange; one block alone gives only the keys that have a row of it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.columns import yes
from fieldloom.operators.sequence import KEY, with_neighbours


@dataclass(frozen=True)
class Block:
    """columns: output name to aggregate. rows: which rows make a key appear (all, if None). after, before: neighbours needed."""

    name: str
    columns: dict[str, Column]
    rows: Column | None = None
    after: int = 0
    before: int = 0
    derived: dict[str, Column] = field(default_factory=dict)


def _prepared(actions: DataFrame, blocks: Sequence[Block]) -> DataFrame:
    df = with_neighbours(actions, max(b.after for b in blocks), max(b.before for b in blocks))
    derived = {k: c for b in blocks for k, c in b.derived.items()}
    return df.withColumns(derived) if derived else df


def run(actions: DataFrame, block: Block, key: Sequence[str] = KEY) -> DataFrame:
    """One block, for the keys that have a qualifying row."""
    df = _prepared(actions, [block])
    if block.rows is None:
        return df.groupBy(*key).agg(*[c.alias(n) for n, c in block.columns.items()])
    out = df.groupBy(*key).agg(F.count_if(yes(block.rows)).alias("_rows"), *[c.alias(n) for n, c in block.columns.items()])
    return out.where("_rows > 0").drop("_rows")


def fuse(actions: DataFrame, blocks: Sequence[Block], key: Sequence[str] = KEY) -> DataFrame:
    """All blocks side by side for every key; a block that a key has no rows of gives zeros."""
    df = _prepared(actions, blocks)
    columns = {n: c for b in blocks for n, c in b.columns.items()}
    return df.groupBy(*key).agg(*[c.alias(n) for n, c in columns.items()])


def enrich(targets: DataFrame, features: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Features beside targets; every target stays and numbers it lacks are 0."""
    names = [c for c, t in features.dtypes if c not in key and t != "string"]
    return targets.join(features, list(key), "left").fillna(0, subset=names)


def credit(actions: DataFrame, cond: Column, to: str, name: str) -> DataFrame:
    """How often cond holds, credited to the player in column `to`; rows without such a player are left out."""
    return actions.where(yes(cond) & F.col(to).isNotNull()).groupBy("match_id", F.col(to).alias("player_id")).agg(F.count(F.lit(1)).alias(name))
