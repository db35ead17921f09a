"""Connected components of an edge table by rounds of contraction, all in Spark. Tables between rounds are written, so plans stay short."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import staged

MAX_ROUNDS = 200
#: Up to so many edges (3 MB) are settled in one task; while there are more, rounds of contraction go on.
ONE_TASK_EDGES = 200_000


def _settle(edges: DataFrame) -> DataFrame:
    """node and p, the smallest node of its component, by union-find over a bounded table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def root(i: int) -> int:
            while (j := up.setdefault(i, i)) != i:
                up[i] = up[j]
                i = j
            return i

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = root(a), root(b)
                up[max(a, b)] = min(a, b)
        nodes = list(up)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(i) for i in nodes], pa.int64())], names=["node", "p"])

    return edges.select("a", "b").coalesce(1).mapInArrow(run, "node long, p long")


def connected(edges: DataFrame) -> DataFrame:
    """node and root (one node of its component) for each node of edges (a long, b long).

    In a round each node follows its neighbour of the smallest rank, if that is below its own; edges between what is left are the
    next round's. Ranks are the ids in the first round, which resolves stars around their smallest node, and are drawn anew in
    each later one, so the number of nodes falls by a constant factor and the number of rounds is logarithmic whatever the
    graph's form; the last bounded number of edges is settled at once. All steps are sums by key and plain inner or left joins, whose hot keys adaptive execution splits. Loops and
    repeated edges do no harm; a table without edges gives no rows.
    """
    current = staged(edges.select("a", "b").where("a <> b").distinct(), "edges")
    maps: list[DataFrame] = []
    for r in range(MAX_ROUNDS):
        left = current.count()
        if left <= ONE_TASK_EDGES:
            if left:
                maps.append(staged(_settle(current), "labels"))
            break
        rank = lambda c: F.struct((F.xxhash64(c, F.lit(r)) if r else F.lit(0).cast("long")).alias("h"), c.alias("id"))  # noqa: B023, E731
        both = current.select("a", "b").unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = both.groupBy("a").agg(F.min(rank(F.col("b"))).alias("best"))
        step = staged(best.select(F.col("a").alias("node"), F.least(F.col("best"), rank(F.col("a")))["id"].alias("p")), "labels")
        maps.append(step)
        both = current.join(step.toDF("a", "pa"), "a").join(step.toDF("b", "pb"), "b").where("pa <> pb")
        current = staged(both.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
    else:
        raise RuntimeError("the graph didn't contract")
    if not maps:
        return current.toDF("node", "root")
    out = maps[-1].toDF("node", "root")
    for step in reversed(maps[:-1]):  # what a node was contracted to, followed through the later rounds
        out = staged(step.join(out.toDF("p", "root"), "p", "left").select("node", F.coalesce("root", "p").alias("root")), "roots")
    return out
