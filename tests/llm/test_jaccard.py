from __future__ import annotations

import numpy as np
import pytest

from fieldloom.llm import components, jaccard
from tests.llm.conftest import LONG, SPACED, TRICKY, clash, words


def brute(rows, n=3, percent=90):
    """{doc: (size, component)} by comparing all pairs of distinct sets that share a shingle."""
    sets = {}
    for i, t in rows:
        w = words(t, SPACED)
        sets[i] = frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(i for i in sets if sets[i])
    by_member = {}
    for i in ids:
        for g in sets[i]:
            by_member.setdefault(g, []).append(i)
    for i in ids:
        near = {}
        for g in sets[i]:
            for j in by_member[g]:
                near[j] = near.get(j, 0) + 1
        for j, o in near.items():
            if 100 * o >= percent * (len(sets[i]) + len(sets[j]) - o):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def result(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def test_all_documents(spark, documents):
    assert result(jaccard.join(documents)) == brute([(r["doc_id"], r["text"]) for r in documents.collect()])


def test_tricky(spark, tricky):
    out = jaccard.join(clash(tricky))
    assert out.count() == len(TRICKY)  # a repeated row stays twice
    assert result(out) == brute(TRICKY)


def test_empty_table(spark, tricky):
    assert jaccard.join(tricky.where("false")).count() == 0


def family(rng, copies, size=120):
    base = [f"v{rng.integers(1000)}" for _ in range(size)]
    out = [base]
    for _ in range(copies):
        c = list(base if rng.random() < 0.7 else out[rng.integers(len(out))])
        for k in rng.integers(0, size, rng.integers(0, 5)):
            c[k] = f"v{rng.integers(1000)}"
        out.append(c)
    return [" ".join(c) for c in out]


@pytest.mark.parametrize(("block", "rounds"), [(2048, 4), (4, 0), (4, 2)])
def test_families_in_blocks_of_any_size(spark, monkeypatch, block, rounds):
    monkeypatch.setattr(jaccard, "BLOCK_SETS", block)
    monkeypatch.setattr(jaccard, "CENTRE_ROUNDS", rounds)
    rng = np.random.default_rng(7)
    texts = [t for f in range(6) for t in family(rng, 12, (30, 60, 120)[f % 3])]
    rows = list(enumerate(texts))
    assert result(jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_tree_finds_all_partners():
    rng = np.random.default_rng(3)
    sets = []
    for _ in range(120):
        base = rng.integers(0, 400, rng.integers(1, 40)) if not sets or rng.random() < 0.3 else np.append(sets[rng.integers(len(sets))], rng.integers(0, 400, 2))
        sets.append(np.unique(base.astype(np.uint64)))
    sets = [np.array(x, np.uint64) for x in sorted({tuple(s.tolist()) for s in sets})]
    tree = jaccard.PrefixTree(sets, list(range(len(sets))))
    for i, s in enumerate(sets):
        want = {j for j, t in enumerate(sets) if 100 * len(np.intersect1d(s, t)) >= 90 * len(np.union1d(s, t))}
        assert set(tree.partners(s, 90)) == want
        assert i in want


@pytest.mark.parametrize(("n", "percent", "burning"), [(3, 90, 0.0), (5, 80, 0.0), (5, 80, 0.4), (3, 90, 1.0)])
def test_linked_sets_share_a_key(spark, n, percent, burning):
    rng = np.random.default_rng(5)
    texts = [t for size in (5, 12, 40, 150) for _ in range(3) for t in family(rng, 8, size)] + [LONG, LONG + " tail"]
    hot = rng.random(1 << jaccard.SKETCH_BITS) < burning
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    keys = {}
    for r in jaccard.candidate_keys(docs, hot, percent, n).collect():
        keys.setdefault(r["set"], set()).add(r["k"])
    data = [np.frombuffer(t.encode(), np.uint8) for t in texts]
    sets = [jaccard.sets_of(d, np.array([0, len(d)]), n)[0] for d in data]
    ids = [int(jaccard.digests(x, np.array([len(x)])).view(np.int64)[0]) for x in sets]
    pairs = 0
    for i, a in enumerate(sets):
        for j in range(i):
            o = len(np.intersect1d(a, sets[j]))
            if ids[i] != ids[j] and jaccard.linked(o, len(a), len(sets[j]), percent):
                pairs += 1
                assert keys[ids[i]] & keys[ids[j]]
    assert pairs > 20


def test_sets_of_their_own_have_no_keys(spark):
    rows = [(" ".join(f"w{i}x{k}" for k in range(200)),) for i in range(20)]
    assert jaccard.candidate_keys(spark.createDataFrame(rows, "text string"), np.zeros(1 << jaccard.SKETCH_BITS, bool), 80, 5).count() == 0


def test_null_and_repeated_ids(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    rows = [(None, a), (None, a + " z"), (4, a + " y"), (5, b), (5, c), (3, c), (None, b), (None, "q r s t"), (None, "q r s t")]
    got = sorted(((r["doc_id"], r["component_id"]) for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(None, 4), (None, 4), (4, 4), (5, 5), (5, 3), (3, 3), (None, 5), (None, None), (None, None)], key=str)


def test_components(spark):
    rng = np.random.default_rng(9)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 200, (150, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5001 + i) for i in range(300)]
    up = {}

    def root(i):
        up.setdefault(i, i)
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        up[root(a)] = root(b)
    got = {r["node"]: r["root"] for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert set(got) == nodes
    for a in nodes:
        assert root(got[a]) == root(a)
    assert len({got[a] for a in nodes}) == len({root(a) for a in nodes})
    assert components.connected(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


@pytest.mark.parametrize(("block", "rounds"), [(2048, 1), (4, 2)])
def test_other_lengths_of_runs(spark, monkeypatch, block, rounds):
    monkeypatch.setattr(jaccard, "BLOCK_SETS", block)
    monkeypatch.setattr(jaccard, "CENTRE_ROUNDS", rounds)
    rng = np.random.default_rng(11)
    rows = list(enumerate(t for size in (6, 9, 30, 100) for _ in range(3) for t in family(rng, 8, size)))
    rows += [(i + len(rows), t) for i, (_, t) in enumerate(TRICKY)]
    assert result(jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"), percent=80, n=5)) == brute(rows, 5, 80)
