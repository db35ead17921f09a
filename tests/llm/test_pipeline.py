"""The pipeline against the same stages done by brute force."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldloom.llm import packing
from fieldloom.llm.common import staged
from tests.llm.conftest import ALNUM, words
from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_jaccard import brute as groups
from tests.llm.test_packing import check


def test_stages(spark, small):
    import corpus_pipeline

    docs = spark.read.parquet(f"{small}/documents.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    kept = [(i, t) for i, t in rows if any(c.isalpha() for c in t or "")]
    found = groups(kept, 5, 80)
    kept = [(i, t) for i, t in kept if found[i][1] == i]
    hit = contaminated(kept, items)
    kept = [(i, t) for i, t in kept if not hit[i][1]]
    cur = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        cur = staged(stage(spark, cur, small), name)
        assert cur.columns == docs.columns
    final = {r["doc_id"]: r["text"] for r in cur.collect()}
    assert set(final) == {i for i, _ in kept}
    for i, t in kept:
        if final[i] != t:
            assert "[SECRET]" in final[i] and len(words(final[i], ALNUM)) <= len(words(t, ALNUM)) + 5
    check(sorted(final.items()), packing.pack(cur).collect(), 2048)
    assert corpus_pipeline.run(spark, small).count() == packing.pack(cur).count()


def test_rows_that_no_stage_keeps(spark, small):
    import corpus_pipeline

    docs = spark.createDataFrame([(1, None, "en", "s", 0), (2, "12 34", "en", "s", 5), (3, "a b c", "en", "s", 5), (4, "a b c", None, "s", 5)], "doc_id long, text string, lang string, source string, n_chars long")
    one = staged(corpus_pipeline.language_stage(spark, docs, small), "one")
    assert sorted(r["doc_id"] for r in one.collect()) == [3, 4]
    assert [r["doc_id"] for r in corpus_pipeline.near_duplicate_stage(spark, one, small).collect()] == [3]


def test_near_duplicates_by_runs_of_five_words(spark, small):
    import corpus_pipeline

    rows = []
    for i, (n, changes) in enumerate(((100, 2), (150, 3), (200, 4))):
        base = [f"w{i}x{k}" for k in range(n)]
        copy = [f"c{k}" if k % (n // changes) == 20 else w for k, w in enumerate(base)]
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(copy))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicate_stage(spark, docs, small).collect()) == [0, 2, 4]
    documents = spark.read.parquet(f"{small}/documents.parquet")
    found = groups([(r["doc_id"], r["text"]) for r in documents.collect()], 5, 80)
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicate_stage(spark, documents, small).collect()} == {i for i, (_, c) in found.items() if c == i}


def test_rows_without_or_with_repeated_ids(spark, small):
    import corpus_pipeline

    passage = max((r["text"] for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()), key=len)
    text = lambda name: " ".join(f"{name}{i}" for i in range(60))
    secret = 'set token = "0b96a8c8d79c4a5085c919698889f59b72ab7bb6" here'
    rows = [(None, text("a")), (5, text("a")), (None, text("b")), (None, text("b")), (None, text("c")), (7, text("d")), (7, text("a")), (7, text("e")), (None, passage), (None, secret), (None, "12 34"), (8, passage), (8, text("f"))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.language_stage(spark, docs, small)
    assert not any(r["text"] == "12 34" for r in kept.collect()) and kept.columns == docs.columns
    cur = docs.where("text <> '12 34'")
    for name, stage in corpus_pipeline.STAGES[1:4]:
        cur = staged(stage(spark, cur, small), name)
    got = sorted(((r["doc_id"], r["text"]) for r in cur.collect()), key=str)
    want = [(5, text("a")), (None, text("b")), (None, text("c")), (7, text("d")), (7, text("e")), (None, 'set token = "[SECRET]" here'), (8, text("f"))]
    assert got == sorted(want, key=str)


def test_tables_of_odd_forms(spark, small, tricky):
    import corpus_pipeline

    odd = tricky.withColumns({c: F.lit("mine") for c in ("_text", "_row", "_doc", "key", "set", "row", "lang_pred", "count", "spans", "flags")})
    for docs in (odd, odd.where("false"), tricky.where("text is null")):
        cur = docs
        for name, stage in corpus_pipeline.STAGES[:-1]:
            cur = staged(stage(spark, cur, small), name)
            assert cur.columns == docs.columns
            if "_text" in cur.columns:
                assert cur.where("_text <> 'mine' or _row <> 'mine' or _doc <> 'mine'").count() == 0
        ids = sorted(r["doc_id"] for r in cur.collect())
        # 7 and 8 (twice) repeat 6, 10 is near 9, 14 near 13; 1, 2, 3 and 12 have no letter
        assert ids == ([4, 5, 6, 9, 11, 13, 15] if docs is odd else [])
        assert (corpus_pipeline.STAGES[-1][1](spark, cur, small).count() > 0) == bool(ids)
