"""Held-out accuracy and edge cases of the three classifiers."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.llm import language_id, quality, queries, toxicity
from tests.llm.conftest import TRICKY, clash

SF = "/root/testdata/sf0.1"


def scored(spark, query, label):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", label)
    return query(spark, SF).where("held_out").join(labels, "doc_id").where(F.col(label).isNotNull()).toPandas()


def area(pdf, label):
    rank, pos = pdf["score"].rank(), pdf[label] == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def test_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    pdf = queries.op10_language(spark, SF).join(docs, "doc_id").toPandas()
    held = pdf[pdf["held_out"] & pdf["lang"].notna()]
    assert len(pdf) == docs.count() and (held["lang"] == held["lang_pred"]).mean() >= 0.97
    assert pdf["score"].between(0, 1).all()


def test_quality(spark):
    pdf = scored(spark, queries.op8_quality, "quality")
    assert area(pdf, "quality") >= 0.9 and (pdf["predicted"] == pdf["quality"]).mean() >= 0.9


def test_toxicity(spark):
    pdf = scored(spark, queries.op9_toxicity, "toxic")
    picked = pdf["predicted"] == 1
    assert area(pdf, "toxic") >= 0.92 and pdf["toxic"][picked].mean() >= 0.9 and picked[pdf["toxic"] == 1].mean() >= 0.85


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i, _ in TRICKY] + [(4, None, None)], "doc_id long, quality int, toxic int")


def test_tricky_language(spark, tricky):
    model = language_id.fit(tricky)
    out = {r["doc_id"]: r["lang_pred"] for r in language_id.predict(clash(tricky), model).collect()}
    assert {i for i, p in out.items() if p == "und"} == {1, 2, 3, 12} and set(out.values()) == {"und", "en"}
    assert language_id.fit(tricky.where("false")) is None
    assert {r["lang_pred"] for r in language_id.predict(tricky, None).collect()} == {"und"}
    assert language_id.predict(tricky.where("false"), model).count() == 0


def test_rows_without_an_id_are_not_held_out_and_not_learned_from(spark):
    from fieldloom.llm.common import held_out, learnable

    rows = spark.createDataFrame([(i,) for i in [None, *range(40)]], "doc_id long").select("doc_id", held_out("doc_id", 5, 0).alias("out"), learnable("doc_id", 5, 0).alias("known")).collect()
    assert all(r["out"] is not None and r["known"] == (r["doc_id"] is not None and not r["out"]) for r in rows)
    assert not next(r["out"] for r in rows if r["doc_id"] is None) and any(r["out"] for r in rows)


def test_chunks_are_drawn_over_whole_texts(spark):
    """What a network learns from is anywhere in a long text, and of few bytes."""
    import zlib

    long = "".join(f"{zlib.crc32(str(i).encode()):08x}" for i in range(60_000))
    docs = spark.createDataFrame([(1, long), (2, "short"), (3, None), (4, "é" * 5000)], "doc_id long, text string")
    found = {r["k"]: np.frombuffer(r["chunks"], np.int16).reshape(-1, quality.CHUNK) for r in quality.drawn_chunks(docs, "doc_id", "text", 48).collect()}
    assert [len(found[i]) for i in (1, 2, 3, 4)] == [48, 1, 1, len(quality.chunk_starts(10_000))]
    places = sorted(long.find(bytes(c.astype(np.uint8)).decode()) for c in found[1])
    assert len(set(places)) == 48 and places[0] < len(long) / 4 and places[-1] > 3 * len(long) / 4
    assert (found[3] == quality.PAD).all()


@pytest.mark.parametrize("how", [quality, toxicity])
def test_tricky_scores(spark, tricky, labels, how):
    model = how.fit(tricky, labels)
    out = how.predict(clash(tricky), model).collect()
    assert len(out) == len(TRICKY) and all(0 <= r["score"] <= 1 for r in out)
    same = {r["doc_id"]: r["score"] for r in out}
    assert same[6] == same[8]
    assert how.fit(tricky, labels.where("false")) is None
    assert len({r["score"] for r in how.predict(tricky, None).collect()}) == 1
    assert how.predict(tricky.where("false"), model).count() == 0


def test_maximal_segments_against_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(200):
        s = rng.integers(-4, 5, rng.integers(1, 14)).astype(float)
        got = [(a, b) for a, b, _ in toxicity.maximal_segments(s)]

        def find(lo, hi, s=s):  # the largest sum, shortest first; then the same on both sides
            best = None
            for a in range(lo, hi):
                for b in range(a + 1, hi + 1):
                    v = s[a:b].sum()
                    if v > 0 and (best is None or v > best[0] or (v == best[0] and b - a < best[2] - best[1])):
                        best = (v, a, b)
            return [] if best is None else find(lo, best[1]) + [best[1:]] + find(best[2], hi)

        want = find(0, len(s))
        assert sum(s[a:b].sum() for a, b in got) == pytest.approx(sum(s[a:b].sum() for a, b in want))
        assert max((s[a:b].sum() for a, b in got), default=0) == max((s[a:b].sum() for a, b in want), default=0)


def test_passages_point_at_the_text(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    found = toxicity.predict(docs, toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))).where(F.size("passages") > 0)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = found.collect()
    assert rows
    for r in rows:
        for p in r["passages"]:
            part = texts[r["doc_id"]][p["start"] : p["end"]]
            assert part and part == part.strip() and p["score"] > 0


def arrow(texts):
    data = [t.encode() for t in texts]
    return np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(d) for d in data])])


def plain_grams(text):
    """Distinct byte n-grams of the text's classes of bytes, for n of 1 to 3."""
    out = bytes(b | 32 if 65 <= b <= 90 or 97 <= b <= 122 else b if b >= 128 else 32 for b in text.encode())
    return [{out[i : i + n] for i in range(len(out) - n + 1)} for n in (1, 2, 3)]


def test_language_scores_against_plain_kernel_ridge(spark, documents):
    rows = [r for r in documents.where("text is not null and lang is not null and length(text) < 3000").select("doc_id", "text", "lang").limit(60).collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs, landmarks=60)
    texts, labels = [r["text"] for r in rows], np.array([r["lang"] for r in rows])
    grams = [plain_grams(t) for t in texts]

    def kernel(a, b):
        return sum(len(x & y) / np.sqrt(len(x) * len(y)) for x, y in zip(a, b, strict=True) if x and y) / 3

    taken, marks = {}, []
    each = 60 // len(set(labels))
    drawn = {r[0]: r[1] for r in docs.select("doc_id", F.xxhash64("doc_id", F.lit(31))).collect()}
    for i in np.argsort([drawn[r["doc_id"]] for r in rows], kind="stable"):  # the first drawn of each language
        if taken.get(labels[i], 0) < each:
            taken[labels[i]] = taken.get(labels[i], 0) + 1
            marks.append(i)
    k = np.array([[kernel(a, grams[j]) for j in marks] for a in grams])
    weight = np.array([len(labels) / len(set(labels)) / (labels == x).sum() for x in labels])
    y = np.where(labels[:, None] == np.array(sorted(set(labels)))[None], 1.0, -1.0)
    # ridge regression on the landmarks' kernel, solved in the coefficients of the landmarks
    alpha = np.linalg.lstsq(k.T @ (weight[:, None] * k) + 1e-3 * len(labels) * k[marks], k.T @ (weight[:, None] * y), rcond=1e-10)[0]
    got = model.score(*arrow(texts))
    assert model.languages == sorted(set(labels)) and np.abs(got - k @ alpha).max() < 0.02  # trigrams are hashed to 16 bits
    assert (got.argmax(1) == (k @ alpha).argmax(1)).all()


def test_quality_scores_against_a_plain_convolution():
    net = quality.ByteNetwork.fresh(np.random.default_rng(3))
    texts = ["", "a", "ab" * 127, "x" * 256, "é" * 200, "The quick brown fox. " * 60, "z" * 241, "0123456789" * 97]
    got = net.score(*arrow(texts))
    for text, score in zip(texts, got, strict=True):
        b = list(text.encode())
        hidden, covered = [], set()
        for start in quality.chunk_starts(len(b)):
            chunk = (b[start : start + quality.CHUNK] + [quality.PAD] * quality.CHUNK)[: quality.CHUNK]
            covered |= set(range(start, min(len(b), start + quality.CHUNK)))
            peak = []
            for f in range(len(net.bias)):
                peak.append(max(net.bias[f] + sum(float(net.embedding[chunk[p + w]] @ net.filters[w, :, f]) for w in range(quality.WIDTH)) for p in range(0, quality.CHUNK - quality.WIDTH + 1, quality.STEP)))
            hidden.append(np.maximum(np.array(peak) @ net.dense + net.dense_bias, 0))
        both = np.concatenate([np.mean(hidden, 0), np.max(hidden, 0)])
        assert covered == set(range(len(b)))
        assert score == pytest.approx(1 / (1 + np.exp(-(both @ net.out + net.out_bias[0]))), abs=1e-5)


def test_quality_of_a_very_long_text_takes_bounded_memory():
    import tracemalloc

    net = quality.ByteNetwork.fresh(np.random.default_rng(3))
    data = np.frombuffer(b"some words of a text " * 1_000_000, np.uint8)
    tracemalloc.start()
    whole = net.score(data, np.array([0, len(data)]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert 0 <= whole[0] <= 1 and peak < 100e6


def test_toxicity_scores_against_a_plain_search(spark):
    """Scores by words as strings, their longest known beginnings, and segments found by trying all sums."""
    from tests.llm.conftest import ALNUM, words

    known = {"badword": 3.0, "awful": 2.5, "grimmig": 4.0, "zzz": 1.0, "schlim": 2.0}
    hashes = {}
    for w in known:
        data = np.frombuffer(w.encode() + b"e" * 20, np.uint8)  # longer, so that w is a beginning of it
        whole = toxicity._WORDS.parts(data[: len(w)], np.array([0, len(w)]), ())[0][0]
        hashes[int(whole)] = known[w]
        if len(w) in toxicity.PREFIXES:
            hashes[int(toxicity._WORDS.parts(data, np.array([0, len(data)]), (len(w),))[5][0][0])] = known[w]
    tokens = np.array(sorted(hashes), np.uint64)
    model = toxicity.ToxicModel(tokens, np.array([hashes[int(t)] for t in tokens]), -0.5, 0.7, 0.2, np.array([-2.0, 1.5, 0.8, 0.6]))
    rng = np.random.default_rng(9)
    pool = ["badword", "Badwords", "AWFULLY", "awful", "grimmige", "grimmig", "zzz", "zzzz", "schlimm", "fine", "ok", "ünd", "12", "peace"]
    rows = [(i, " ".join(rng.choice(pool, rng.integers(0, 16)))) for i in range(120)] + [(500, None), (501, ""), (502, "!!")]

    def segments(s):
        best = max(((sum(s[a:b]), a - b, a, b) for a in range(len(s)) for b in range(a + 1, len(s) + 1)), default=(0,))
        if best[0] <= 0:
            return []
        _, _, a, b = best
        return segments(s[:a]) + [best[0]] + segments(s[b:])

    for r in toxicity.predict(spark.createDataFrame(rows, "doc_id long, text string"), model).collect():
        scores = []
        for w in words(dict(rows)[r["doc_id"]], ALNUM):
            b = w.encode()
            parts = [w, *(b[:n].decode("utf-8", "ignore") for n in toxicity.PREFIXES if len(b) > n)]
            scores.append(next((known[x] for i, x in enumerate(parts) if x in known and (i == 0 or len(x) in toxicity.PREFIXES)), -0.5))
        found = [0.7 * v - np.log(0.2 * max(len(scores), 1)) for v in segments(scores)]
        f = (1.0, 0.0, 0.0, 0.0)
        if found:
            f = (1.0, 1 + max(0.0, 4 + max(found)) / 4, (max(found) + np.log(len(scores))) / 4, np.log1p(sum(x > 0 for x in found)))
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-np.dot(f, model.link))), abs=1e-9), r["doc_id"]
