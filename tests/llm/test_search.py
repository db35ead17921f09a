from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from fieldloom.llm import topk


def brute(rows, queries, k, scale=1024.0):
    """Each query row against each row of another id; shorter vectors end in zeros."""
    vs = [(i, [int(x) for x in np.floor(scale * np.array(v, np.float64))]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in vs:
        if q in set(queries):
            best = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in vs if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def result(df):
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect())


def test_against_brute_force(spark, small, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 100)
    vectors = spark.read.parquet(f"{small}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in vectors.collect()]
    got = result(topk.top_k(vectors, F.col("vec_id") % 20 == 0))
    assert got == brute(rows, [i for i, _ in rows if i % 20 == 0], 10)


def test_ties_nulls_and_few_rows(spark):
    rows = [(0, [1.0, 0.5]), (1, [1.0, 0.5]), (2, [1.0, 0.5]), (3, None), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, []), (8, [-1.0, 2.0]), (9, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"shard": F.lit(1), "id": F.lit(2), "v": F.lit(3)})
    assert result(topk.top_k(df, F.col("vec_id") % 2 == 0, k=3)) == brute(rows, [0, 2, 4, 6, 8], 3)
    assert topk.top_k(df.where("vec_id > 100"), F.col("vec_id") % 2 == 0).count() == 0
    assert topk.top_k(df.where("vec_id = 0"), F.col("vec_id") % 2 == 0).count() == 0


def test_rows_without_an_id_take_no_part(spark):
    rows = [(i, [float(i), 1.0]) for i in range(6)]
    df = spark.createDataFrame([*rows, (None, [9.0, 9.0]), (None, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert result(topk.top_k(df, F.col("vec_id").isNull() | (F.col("vec_id") % 2 == 0), k=3)) == brute(rows, [0, 2, 4], 3)


def test_repeated_rows_and_other_lengths(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(int(i), [round(float(x), 3) for x in rng.normal(0, 1, rng.choice([0, 1, 3, 8]))]) for i in rng.integers(0, 60, 150)]
    rows += rows[:40]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for shard, block in ((8192, 1024), (30, 7)):
        monkeypatch.setattr(topk, "SHARD_ROWS", shard)
        monkeypatch.setattr(topk, "QUERY_ROWS", block)
        assert result(topk.top_k(df, F.col("vec_id") % 5 == 0, k=4)) == brute(rows, range(0, 60, 5), 4)


def test_thresholds_save_work():
    rng = np.random.default_rng(2)
    scale = np.array([400.0] * 4 + [20.0] * 60)
    x, q = (np.floor(rng.normal(0, 1, (n, 64)) * scale).astype(np.int64) for n in (4000, 30))
    ids, q_ids = np.arange(4000), np.arange(10_000, 10_030)
    alone, work = [], []
    i, c, s = topk.search_shard(q, q_ids, x, ids, 10, None, alone)
    want = [sorted((-int(v @ y), j) for j, y in enumerate(x))[:10] for v in q]
    assert [(-int(b), int(a)) for a, b in zip(c, s, strict=True)] == [p for w in want for p in w] and len(i) == 300
    again = topk.search_shard(q, q_ids, x, ids, 10, [-w[-1][0] for w in want], work)
    assert all((a == b).all() for a, b in zip((i, c, s), again, strict=True))
    assert work[0] < alone[0] < 0.8 * 64 * 4000 * 30 and work[0] < 0.25 * 64 * 4000 * 30


def test_candidates_are_dealt_once(spark, monkeypatch):
    """However many blocks of queries there are, a candidate is in one shard; only queries are copied."""
    seen = []
    real = topk._search
    monkeypatch.setattr(topk, "_search", lambda *a: seen.append(a) or real(*a))
    monkeypatch.setattr(topk, "SHARD_ROWS", 100)
    monkeypatch.setattr(topk, "QUERY_ROWS", 5)
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(0, 1, 6).tolist()) for i in range(1000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = result(topk.top_k(df, F.col("vec_id") % 10 == 0, k=3))
    assert got == brute(rows, range(0, 1000, 10), 3)
    asked, candidates, shards, _ = seen[0]
    assert shards == 10 and candidates.count() == 1000 and asked.where("least is not null").count() == 100
    assert [r for r in result(topk.top_k(df.where("vec_id < 400"), F.col("vec_id") % 10 == 0, k=3))] == brute(rows[:400], range(0, 400, 10), 3)
    monkeypatch.setattr(topk, "SHARDS", 2)
    assert result(topk.top_k(df, F.col("vec_id") % 10 == 0, k=3)) == got and seen[-1][2] == 2


def test_one_id_on_a_third_of_the_rows_is_spread(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 50)
    seen = []
    real = topk._search
    monkeypatch.setattr(topk, "_search", lambda *a: seen.append(a[1]) or real(*a))
    rows = [(5 if i % 3 == 0 else i, [float(i % 11), 1.0]) for i in range(600)]
    topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0).count()
    assert max(r["count"] for r in seen[0].groupBy("shard").count().collect()) < 150
