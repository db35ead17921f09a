"""Exact top-k inner products by MaxScore.

Vectors become integers, floor(scale * x). A candidate shard keeps a posting list for each dimension: its rows' values, in the
order of ids (dense vectors have a value for each row, so ids are left out), with the largest and the smallest of them, and so the
most that a query's dimension can add to any of its rows. For a query, dimensions in the order of those bounds are split: the
essential ones, without which no row can still reach the query's threshold, are traversed list by list; the others are probed, in
bound order, only for rows whose partial score plus the bounds still to come is competitive. The k best of each shard are merged.

Candidates are dealt to shards once, whatever the number of queries; a task holds one shard and reads all queries block by block. A
shard has SHARD_ROWS rows, more where there would be more than SHARDS of them, up to SHARD_BYTES; so queries, of which there are
few against the candidates, are what is copied. Each query comes with a threshold to start from: its k-th best score in a bounded
sample of candidates that all tasks know.

Edge cases: rows without an id and vectors that are null or hold null or non-finite components take no part; of vectors of
different lengths the shorter one counts as ending in zeros, so an empty one scores 0; ties go to the smaller id; a query has
fewer than k rows only if there are fewer candidates; rows of the query's own id are no candidates; repeated rows count each, as
candidates and as queries; scores beyond 64 bits are ranked exactly within a shard and returned as the largest long; an empty
table gives no rows; columns of other names are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.llm.common import staged

SHARD_ROWS = 8192
#: Shards grow rather than be more than this, as long as their values stay within so many bytes.
SHARDS = 512
SHARD_BYTES = 64 << 20
#: Candidates that give the first thresholds (4 MB at most).
SAMPLE_ROWS = 4096
SAMPLE_BYTES = 4 << 20
QUERY_ROWS = 1024
BLOCK_ROWS = 1024
PROBE = 8


def usable(df: DataFrame, vector: str) -> F.Column:
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    return v.isNotNull() & ~F.coalesce(bad, F.lit(True))


def search_shard(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, k: int, least: list[int | None] | None = None, work: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query position, candidate id, score) of the k best candidates for each query; x_ids ascend. least: scores below which a
    query's candidates aren't wanted. To work, if given, the number of values that were read is appended.

    Works on float64, whose products and sums of these integers are exact below 2^53; beyond that on Python's integers.
    """
    most = np.abs(q.astype(float)).max(initial=0) * np.abs(x.astype(float)).max(initial=0) * max(1, q.shape[1])
    kind = np.float64 if most < 2.0**53 else object
    q, lists = q.astype(kind), np.ascontiguousarray(x.T.astype(kind))
    dims, n = lists.shape
    top_score, top_id = [np.zeros(0, kind)] * len(q), [np.zeros(0, np.int64)] * len(q)
    high, low = (lists.max(1), lists.min(1)) if n else (np.zeros(dims, kind), np.zeros(dims, kind))
    bound = np.maximum(q * high, q * low)  # queries x dimensions
    spread = bound - np.minimum(q * high, q * low)
    order = np.argsort(-spread.astype(float), axis=1, kind="stable")
    rest = np.zeros((len(q), dims + 1), kind)  # the most that dimensions from place j on can add
    rest[:, :dims] = np.cumsum(np.take_along_axis(bound, order, 1)[:, ::-1], axis=1)[:, ::-1]
    read = 0
    for a in range(0, n, BLOCK_ROWS):
        block, ids = lists[:, a : a + BLOCK_ROWS], x_ids[a : a + BLOCK_ROWS]
        for i in range(len(q)):
            theta = None if least is None else least[i]
            if len(top_score[i]) == k and (theta is None or top_score[i][-1] > theta):
                theta = top_score[i][-1]
            place, split = order[i], dims
            if theta is not None:
                # essential: the leading dimensions up to the last one from which the bounds alone still reach the threshold
                reach = np.flatnonzero(rest[i] >= theta)
                if not len(reach):
                    continue
                split = min(dims, int(reach[-1]) + 1)
            lead = place[:split]
            score = q[i][lead] @ block[lead]
            rows = np.arange(len(ids))
            read += split * len(ids)
            if theta is not None:
                rows = np.flatnonzero(score + rest[i][split] >= theta)
                score = score[rows]
            while split < dims and len(rows):
                lead = place[split : split + PROBE]
                score = score + q[i][lead] @ block[np.ix_(lead, rows)]
                read += len(lead) * len(rows)
                split += len(lead)
                keep = score + rest[i][split] >= theta
                rows, score = rows[keep], score[keep]
            if len(rows):
                keep = ids[rows] != q_ids[i]
                s, c = np.concatenate([top_score[i], score[keep]]), np.concatenate([top_id[i], ids[rows][keep]])
                best = np.lexsort((c, -s))[:k] if kind is np.float64 else np.array(sorted(range(len(s)), key=lambda j: (-s[j], c[j]))[:k], int)
                top_score[i], top_id[i] = s[best], c[best]
    if work is not None:
        work.append(read)
    if not len(q):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    scores = np.concatenate(top_score)
    if kind is object:
        scores = np.clip(scores, -(2**63) + 1, 2**63 - 1)
    return np.repeat(np.arange(len(q)), [len(t) for t in top_id]), np.concatenate(top_id), scores.astype(np.int64)


def _matrix(lists: list[np.ndarray], dims: int) -> np.ndarray:
    out = np.zeros((len(lists), dims), np.int64)
    for i, v in enumerate(lists):
        out[i, : len(v)] = v
    return out


def _lists(column: pa.Array) -> list[np.ndarray]:
    flat, ends = column.flatten().to_numpy(), np.cumsum(column.value_lengths().to_numpy())
    return [flat[ends[j - 1] if j else 0 : ends[j]] for j in range(len(ends))]


def _thresholds(asked: DataFrame, sample: list[tuple[int, np.ndarray]], k: int) -> DataFrame:
    """asked (q, id, v) with least: the k-th best score among the sample's rows, null if there are fewer."""
    ids = np.array([i for i, _ in sample], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, QUERY_ROWS):
                part = batch.slice(a, QUERY_ROWS)
                v = _lists(part.column(2))
                dims = max(1, *(len(x) for x in v), *(len(x) for _, x in sample))
                at, _, score = search_shard(_matrix(v, dims), part.column(1).to_numpy(), _matrix([x for _, x in sample], dims), ids, k)
                n = np.bincount(at, minlength=len(v))
                last = np.cumsum(n) - 1
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.where(n == k, score[last], 0), mask=n < k)], names=["q", "id", "v", "least"])

    return asked.select("q", "id", "v").mapInArrow(run, "q long, id long, v array<long>, least long")


def _search(asked: DataFrame, candidates: DataFrame, shards: int, k: int) -> DataFrame:
    """q, query_id, found and score of the k best of each shard. asked: q, id, v, least; candidates: id, v, shard."""
    none, every = F.lit(None).cast("long"), F.sequence(F.lit(0), F.lit(shards - 1)).cast("array<long>")
    sides = candidates.select("shard", F.lit(0).alias("side"), "id", none.alias("q"), none.alias("least"), "v").unionByName(
        asked.select(F.explode(every).alias("shard"), F.lit(1).alias("side"), "id", "q", "least", "v")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, rows, ids = None, [], []
        matrix: np.ndarray | None = None

        def search(q: list, q_ids: list, least: list, v: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            nonlocal matrix
            if matrix is None or matrix.shape[1] < max(len(x) for x in v):
                matrix = _matrix(rows, max(1, *(len(x) for x in v), *(len(x) for x in rows)))
            own = np.array(q_ids, np.int64)
            i, c, s = search_shard(_matrix(v, matrix.shape[1]), own, matrix, np.array(ids, np.int64), k, least)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.array(q, np.int64)[i], own[i], c, s)], names=["q", "query_id", "found", "score"])

        for batch in batches:
            at, side = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero((at[1:] != at[:-1]) | (side[1:] != side[:-1])) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                part, v = batch.slice(a, b - a), _lists(batch.column(5).slice(a, b - a))
                if at[a] != shard:
                    shard, rows, ids, matrix = at[a], [], [], None
                if side[a] == 0:
                    rows += v
                    ids += part.column(2).to_pylist()
                elif rows:
                    q_ids, q, least = (part.column(c).to_pylist() for c in (2, 3, 4))
                    for i in range(0, len(v), QUERY_ROWS):
                        end = i + QUERY_ROWS
                        yield from search(q[i:end], q_ids[i:end], least[i:end], v[i:end])

    dealt = sides.repartition(2 * shards, "shard").sortWithinPartitions("shard", "side", "id")
    return dealt.mapInArrow(run, "q long, query_id long, found long, score long")


def top_k(vectors: DataFrame, queries: F.Column, k: int = 10, scale: float = 1024.0, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank from 1, key and score of the k best other rows for each row where `queries` holds."""
    rows = vectors.where(usable(vectors, vector) & F.col(key).cast("long").isNotNull()).select(F.col(key).cast("long").alias("id"), queries.alias("is_query"), F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(scale)).cast("long")).alias("v"))
    rows = staged(rows.withColumn("q", F.monotonically_increasing_id()), "vectors")  # numbers are fixed once written
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dims")).first()
    n, dims = facts["n"], max(1, facts["dims"] or 1)
    held = max(SHARD_ROWS, min(-(-n // SHARDS), SHARD_BYTES // (8 * dims)))
    shards = max(1, -(-n // held))
    asked = rows.where("is_query").select("q", "id", "v")
    most = min(SAMPLE_ROWS, max(k, SAMPLE_BYTES // (8 * dims)))
    drawn = F.xxhash64("q", F.lit(3))
    sample = rows.where(F.pmod(drawn, F.lit(1 << 30)) < F.lit(min(1.0, 2 * most / max(1, n)) * (1 << 30))).select("id", "v").limit(most).toArrow()
    first = sorted(zip(sample["id"].to_pylist(), _lists(sample["v"].combine_chunks()) if sample.num_rows else [], strict=True), key=lambda r: r[0])
    least = _thresholds(asked, first, k) if first and shards > 1 else asked.withColumn("least", F.lit(None).cast("long"))
    # by row, not by id, so that rows that repeat an id are spread
    found = _search(least, rows.select("id", "v", F.pmod(F.xxhash64("q"), F.lit(shards)).alias("shard")), shards, k)
    best = Window.partitionBy("q").orderBy(F.desc("score"), "found")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("found").alias(key), "score")
