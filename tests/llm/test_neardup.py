from __future__ import annotations

import numpy as np
import pytest

from fieldloom.llm import neardup


def brute(rows, cosine=0.95):
    """Every pair; components by spreading the smallest id."""
    good = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    dims = max([len(v) for (_, v), g in zip(rows, good, strict=True) if g], default=1)
    x = np.zeros((len(rows), dims))
    for k, (_, v) in enumerate(rows):
        if good[k]:
            x[k, : len(v)] = v
            x[k] /= np.abs(x[k]).max()
            x[k] /= np.linalg.norm(x[k])
    link = (x @ x.T >= cosine - 1e-13) & np.array(good)[:, None] & np.array(good)[None, :]
    np.fill_diagonal(link, False)
    least = np.array([np.inf if i is None else i for i, _ in rows], float)
    while True:
        new = np.minimum(least, np.where(link, least[None, :], np.inf).min(1)) if len(rows) else least
        if np.array_equal(new, least):
            break
        least = new
    ids = [None if np.isinf(v) else int(v) for v in least]
    return sorted(((i, int(n), c, i == c) for (i, _), n, c in zip(rows, link.sum(1), ids, strict=True)), key=repr)


def result(df):
    assert df.columns == ["vec_id", "n_links", "component_id", "kept"]
    return sorted((tuple(r) for r in df.collect()), key=repr)


def table(spark, rows, kind="float"):
    """With columns by names that the operator uses within."""
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").withColumns({c: F.lit(1) for c in ("id", "v", "hash", "cell", "rid", "weight", "n_links")})


def cloud(seed, dims=12):
    """Even background, chains, tight and loose groups, copies."""
    rng = np.random.default_rng(seed)
    parts = [rng.normal(0, 1, (150, dims))]
    for size, spread in ((120, 0.02), (60, 0.25), (40, 0.1), (3, 0.2)):
        parts.append(rng.normal(0, 1, dims) * 2 + rng.normal(0, spread, (size, dims)))
    t = np.linspace(0, 3, 40)
    chain = np.zeros((40, dims))
    chain[:, 0], chain[:, 1] = np.cos(t), np.sin(t)
    parts += [chain, np.repeat(rng.normal(0, 1, (1, dims)), 30, 0), 3 * parts[0][:10]]
    x = np.concatenate(parts).astype(np.float32)
    return [(int(i), [float(c) for c in v]) for i, v in zip(rng.permutation(len(x)) * 3, x, strict=True)]


@pytest.mark.parametrize(("home", "guest", "pairs"), [(8192, 32768, 1 << 22), (40, 25, 100)])
def test_against_all_pairs(spark, monkeypatch, home, guest, pairs):
    """Small bounds cut cells into chunks and parts, and make balls of the tight groups."""
    for name, value in (("HOME_ROWS", home), ("GUEST_ROWS", guest), ("BLOCK_PAIRS", pairs)):
        monkeypatch.setattr(neardup, name, value)
    rows = cloud(1)
    assert result(neardup.near_duplicates(table(spark, rows))) == brute(rows)


def test_points_come_in_many_batches(spark, monkeypatch):
    monkeypatch.setattr(neardup, "HOME_ROWS", 100)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        rows = cloud(3)
        assert result(neardup.near_duplicates(table(spark, rows))) == brute(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")


def test_balls_are_found_and_not_compared(spark, monkeypatch):
    monkeypatch.setattr(neardup, "HOME_ROWS", 50)
    seen, dealt = [], []
    real, join = neardup.choose_centres, neardup._join
    monkeypatch.setattr(neardup, "choose_centres", lambda *a: seen.append(real(*a)) or seen[-1])
    monkeypatch.setattr(neardup, "_join", lambda df, *a: dealt.append(df) or join(df, *a))
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(0, 1, 16) * 2 + rng.normal(0, 0.05, (600, 16)), rng.normal(0, 1, (300, 16))])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    assert result(neardup.near_duplicates(table(spark, rows, "double"))) == brute(rows)
    assert len(seen[0]) >= 1
    cells = dealt[0].where("side = 1").groupBy("cell").count().collect()
    assert sum(r["count"] for r in cells) < 900 * 12  # not 600 guests for each of twelve chunks of the group's own


def test_odd_rows(spark):
    rows = [
        (1, [1.0, 0.0]), (2, [1.0, 0.001]), (3, None), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, []), (8, [0.0, 0.0]), (9, [-0.0, 0.0]), (None, [1.0, 0.0]), (None, [0.0, 1.0]), (None, [0.0, 2.0]),
        (10, [1e300, 1e297]), (11, [1e-300, 0.0]), (12, [1.0]), (13, [-1.0, 0.0]), (13, [-1.0, 0.0]), (13, [0.5, -0.5]), (14, [-1.0, -0.0]),
    ]
    got = result(neardup.near_duplicates(table(spark, rows, "double")))
    want = brute(rows)
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert all(r[3] == (r[0] == r[2]) for r in got)


def test_threshold_is_exact(spark):
    """Cosines of exactly 0.6 link at 0.6, however they are computed."""
    rows = [(1, [3.0, 4.0]), (2, [1.0, 0.0]), (3, [300.0, -400.0]), (4, [0.0, -7.0])]
    assert [r[1] for r in result(neardup.near_duplicates(table(spark, rows, "double"), cosine=0.6))] == [1, 2, 2, 1]


def test_empty_and_all_equal(spark):
    assert neardup.near_duplicates(table(spark, [])).count() == 0
    assert result(neardup.near_duplicates(table(spark, [(5, None)]))) == [(5, 0, 5, True)]
    rows = [(i, [1.0, 2.0]) for i in range(3000)]
    assert result(neardup.near_duplicates(table(spark, rows))) == brute(rows)
