from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from fieldloom.llm import collocation as co

LOWER = {i: i + 32 for i in range(65, 91)}


def plainly(docs, longest=3, least=10, most=2000, covered=50):
    f, n = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for k in range(1, longest + 1):
                f[lang].update(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))
    out = []
    for lang, of in f.items():
        often = {p: a for p, a in of.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in often.items():
            longer = [b for q, b in often.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if any(100 * b >= covered * a for b in longer):
                continue
            score, k = min((1_000_000 * a * a // (of[p[:k]] * of[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), a, of[p[:k]], of[p[k:]], score))
        out += [(lang, i + 1, t.decode(), a, lf, r, n[lang], s) for i, (_, _, t, a, lf, r, s) in enumerate(sorted(found)[:most])]
    return sorted(out)


def run(spark, docs, **how):
    df = co.collocations(spark.createDataFrame([(lang, t, 1, 2, 3) for lang, t in docs], "lang string, text string, key int, words int, f int").repartition(3), **how)
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in df.collect())


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["Ünder", "straße", "a-b", "\x00z", "x'", "日本"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    line = "The Common line of ALL documents, again and again"
    docs = []
    for _ in range(250):
        words = rng.choices(vocabulary, weights, k=rng.choice([0, 1, 2, 3, 30, 60]))
        text = "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "!? "]) for w in words)
        docs.append((rng.choice(["en", "en", "en", "de", None, "und", ""]), text + (line if rng.random() < 0.4 else "")))
    return docs + [("en", None), (None, ""), ("de", " .,;\n"), ("fr", "aa aa aa aa aa aa aa aa aa aa aa aa aa"), ("fr", "bb bb aa bb bb aa " * 20), *[("es", "uno dos tres")] * 40]


@pytest.mark.parametrize(("bucket", "flush", "listed"), [(1_000_000, 2_000_000, 1_000_000), (200, 300, 1_000_000), (200, 300, 12), (1000, 300, 0)])
def test_against_counting_all_phrases(spark, monkeypatch, bucket, flush, listed):
    """Small bounds make shared pivots, several rounds in a task, and words beyond the list."""
    for name, value in (("BUCKET_WORDS", bucket), ("FLUSH_WORDS", flush), ("LIST_WORDS", listed), ("FLUSH_TYPES", 20 if flush == 300 else 500_000)):
        monkeypatch.setattr(co, name, value)
    docs = corpus(1)
    assert run(spark, docs) == plainly(docs)


def test_other_lengths_and_few_phrases(spark):
    docs = corpus(2)
    for how in ({"longest": 2}, {"longest": 5, "least": 4, "covered": 80}, {"most": 3}):
        assert run(spark, docs, **how) == plainly(docs, **how)


def test_odd_tables(spark):
    assert run(spark, []) == []
    assert run(spark, [(None, None), ("en", ""), ("en", "one two")]) == []
    long = "alpha beta gamma " * 30_000
    assert run(spark, [("en", long)]) == plainly([("en", long)])


def test_an_occurrence_owns_a_phrase_once():
    """Each run of words is in exactly one fragment, that of its rarest word's first occurrence."""
    rng = np.random.default_rng(3)
    h = rng.integers(1, 8, 500).astype(np.uint64)
    piece = np.cumsum(rng.random(500) < 0.1)
    ranks = np.where(h == 7, -1, h.astype(np.int64))
    for longest in (2, 3, 4):
        at, found = co.fragments(h, piece, ranks, longest)
        got = Counter()
        for n in range(2, longest + 1):
            words, counts = co.phrases_of(found, np.ones(len(found), np.int64), n)
            got.update(tuple(int(x) for x in w) for w, c in zip(words, counts, strict=True))
        want = Counter(tuple(h[i : i + n].tolist()) for n in range(2, longest + 1) for i in range(len(h) - n + 1) if piece[i] == piece[i + n - 1] and (ranks[i : i + n] >= 0).all())
        assert got == want


def test_exact_beyond_64_bits(spark):
    big = 3_000_000_000_001
    rows = [(1, [1, 2], big, [big + 1, big + 2]), (2, [3, 4], 10, [2 * big, 11])]
    out = {r["key"]: (r["l"], r["r"], r["score"]) for r in co.score_cuts(spark.createDataFrame(rows, "key long, words array<long>, a long, f array<long>"), 3, 1_000_000).collect()}
    assert out == {1: (big + 1, big + 2, 1_000_000 * big * big // ((big + 1) * (big + 2))), 2: (2 * big, 11, 1_000_000 * 100 // (2 * big * 11))}
