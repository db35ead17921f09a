"""Benchmark decontamination by winnowing.

A text's fingerprints are the smallest hashes of K words in each window of W such hashes, so every run of at least
K + W - 1 words that two texts share leaves the same fingerprint in both. Fingerprints of documents are joined with those of
the benchmark, and each hit is extended word by word to both sides; a run of that length or more is a hit, and each such run
holds its own fingerprint. Items shorter than that are one window, found by hashes of just their length.

Words are compared by 64-bit hashes. Edge cases: null and empty texts have no words, match nothing and are reported clean; rows
have numbers of their own, so repeated and null ids are each judged by their own text; texts may be of any length; of repeated
items each id counts once, and items without an id count for words but not for items; an empty table gives no rows, with an empty
benchmark all documents are clean; columns of other names are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import ALNUM, U64, Words, grams, mix, signed, staged, text_blocks

K, W = 5, 6
SPAN = K + W - 1
SIDE = W - 1
#: Up to so many benchmark fingerprints (32 MB of hashes) are sent to all executors; more go through a shuffle.
BROADCAST_FINGERPRINTS = 4_000_000
#: Up to so many (25 MB with their words) are joined by broadcast.
BROADCAST_ROWS = 200_000
_WORDS = Words(ALNUM)


def winnow(h: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Places of the chosen K-grams: in each window of W K-grams of one row the smallest hash, the last one among equals."""
    g = grams(h, K)
    n = len(g) - W + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    least, place = g[:n].copy(), np.zeros(n, np.int64)
    for k in range(1, W):
        take = g[k : k + n] <= least
        least[take] = g[k : k + n][take]
        place[take] = k
    whole = row[:n] == row[SPAN - 1 : SPAN - 1 + n]
    return np.unique((place + np.arange(n))[whole])


def _fingerprints(h: np.ndarray, row: np.ndarray, lengths: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length of short items or 0, places, hashes)."""
    at = winnow(h, row)
    if len(at):
        yield 0, at, grams(h, K)[at]
    for m in lengths:
        g = grams(h, m)
        at = np.flatnonzero(row[: len(g)] == row[m - 1 :])
        if len(at):
            yield m, at, mix(g[at] + U64(m))


def _context(h: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Hashes of the SIDE words before each place, the K at it and SIDE after; 0 beyond the text [low, high)."""
    i = at[:, None] + np.arange(-SIDE, K + SIDE)
    return np.where((i >= low[:, None]) & (i < high[:, None]), h[np.clip(i, 0, len(h) - 1)], U64(0))


_ROW = "row long, key {k}, n_words long, fp long, short int, pos long, context array<long>"


def _scan(texts: DataFrame, lengths: list[int], known, own: bool) -> DataFrame:
    """Fingerprints of texts (key, text); `own`: of benchmark items, whose short ones are whole. A document has a row without
    fingerprint as well, so that it stays when nothing matches. Rows are numbered; the numbers are fixed once the result is written."""
    shape = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
    names = ["row", "key", "n_words", "fp", "short", "pos", "context"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fps = None if known is None else known.value
        at_row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for a, b, d, o in text_blocks(batch.column(1)):
                h, row, count = _WORDS.split(d, o)
                keys, number = batch.column(0).slice(a, b - a), np.arange(at_row, at_row + b - a)
                at_row += b - a
                end = np.cumsum(count)
                if not own:
                    none = pa.nulls(b - a, pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(number), keys, pa.array(count), none, pa.nulls(b - a, pa.int32()), none, pa.nulls(b - a, shape[4])], names=names)
                for m, at, fp in _fingerprints(h, row, list(range(1, SPAN)) if own else lengths):
                    if own and m:
                        keep = count[row[at]] == m
                    elif fps is not None:
                        keep = fps[np.minimum(np.searchsorted(fps, fp), max(len(fps) - 1, 0))] == fp if len(fps) else np.zeros(len(fp), bool)
                    else:
                        keep = np.ones(len(fp), bool)
                    at, fp = at[keep], fp[keep]
                    if not len(at):
                        continue
                    r = row[at]
                    context = _context(h, at, (end - count)[r], end[r])
                    width = context.shape[1]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(number[r]), keys.take(pa.array(r)), pa.array(count[r]), pa.array(signed(fp)), pa.array(np.full(len(at), m, np.int32)), pa.array(at - (end - count)[r]), pa.ListArray.from_arrays(pa.array(np.arange(0, len(at) * width + 1, width, dtype=np.int32)), pa.array(signed(context.ravel())))],
                        names=names,
                    )

    return texts.mapInArrow(run, _ROW.format(k=texts.schema["key"].dataType.simpleString()))


def _run_length(mine: str, theirs: str, places: list[int]) -> F.Column:
    """How many of the places, one after the other, hold equal words."""
    out = F.lit(0)
    for p in reversed(places):
        same = (F.element_at(mine, p) == F.element_at(theirs, p)) & (F.element_at(mine, p) != 0)
        out = F.when(same, out + 1).otherwise(0)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each document: key, n_words, n_hit (words inside shared windows), items (sorted ids, as strings) and spans
    (start and end word of each shared stretch)."""
    spark = docs.sparkSession
    items = staged(_scan(benchmark.select(F.col(item).alias("key"), F.col(item_text).cast("string").alias("text")), [], None, True), "benchmark")
    facts = items.agg(F.count("fp").alias("n"), F.collect_set(F.when(F.col("short") > 0, F.col("short"))).alias("lengths")).first()
    lengths = sorted(facts["lengths"])
    small = facts["n"] <= BROADCAST_FINGERPRINTS
    known = None
    if small:
        column = items.select("fp").distinct().toArrow()["fp"].to_numpy()
        known = spark.sparkContext.broadcast(np.sort(column.view(np.uint64)))
    found = staged(_scan(docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")), lengths, known, False), "fingerprints")
    right = items.select("fp", F.col("short").alias("t_short"), F.col("context").alias("t_context"), F.col("key").cast("string").alias("item"))
    right = F.broadcast(right) if facts["n"] <= BROADCAST_ROWS else right
    hits = found.where(F.col("fp").isNotNull()).join(right, "fp").where(F.col("short") == F.col("t_short"))
    left_run = _run_length("context", "t_context", list(range(SIDE, 0, -1)))
    right_run = _run_length("context", "t_context", list(range(SIDE + K + 1, SIDE + K + SIDE + 1)))
    core = _run_length("context", "t_context", list(range(SIDE + 1, SIDE + K + 1)))
    short_run = _run_length("context", "t_context", list(range(SIDE + 1, SIDE + SPAN)))
    long_span = F.when((F.col("short") == 0) & (core == K) & (left_run + right_run >= W - 1), F.struct((F.col("pos") - left_run).alias("a"), (F.col("pos") + K + right_run).alias("b")))
    short_span = F.when((F.col("short") > 0) & (short_run >= F.col("short")), F.struct(F.col("pos").alias("a"), (F.col("pos") + F.col("short")).alias("b")))
    hits = hits.select("row", "key", F.lit(None).cast("long").alias("n_words"), F.coalesce(long_span, short_span).alias("span"), "item").where(F.col("span").isNotNull()).distinct()
    base = found.where(F.col("fp").isNull()).select("row", "key", "n_words", F.lit(None).cast(hits.schema["span"].dataType).alias("span"), F.lit(None).cast("string").alias("item"))
    grouped = base.unionByName(hits).groupBy("row").agg(F.first("key", ignorenulls=True).alias("key"), F.max("n_words").alias("n_words"), F.array_sort(F.collect_set("span")).alias("spans"), F.array_sort(F.collect_set("item")).alias("items"))
    merged = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
        lambda acc, s: F.struct((acc["n"] + F.greatest(F.lit(0).cast("long"), s["b"] - F.greatest(s["a"], acc["end"]))).alias("n"), F.greatest(acc["end"], s["b"]).alias("end")),
        lambda acc: acc["n"],
    )
    return grouped.select(F.col("key").alias(key), "n_words", merged.alias("n_hit"), "items", "spans")
