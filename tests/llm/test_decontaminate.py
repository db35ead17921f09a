from __future__ import annotations

from fieldloom.llm import decontaminate
from tests.llm.conftest import ALNUM, TRICKY, clash, words


def brute(rows, items):
    out = {}
    for i, t in rows:
        w, hit, found = words(t, ALNUM), set(), set()
        for name, it in items:
            v = words(it, ALNUM)
            n = min(10, len(v))
            wanted = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if v else set()
            for k in range(len(w) - n + 1) if n else ():
                if tuple(w[k : k + n]) in wanted:
                    hit |= set(range(k, k + n))
                    found.add(str(name))
        out[i] = (len(w), len(hit), sorted(found))
    return out


def result(df):
    return {r["doc_id"]: (r["n_words"], r["n_hit"], list(r["items"])) for r in df.collect()}


def test_all_documents(spark, small, documents):
    items = spark.read.parquet(f"{small}/benchmark.parquet")
    got = result(decontaminate.decontaminate(documents, items))
    want = brute([(r["doc_id"], r["text"]) for r in documents.collect()], [(r["item_id"], r["text"]) for r in items.collect()])
    assert got == want and any(h for _, h, _ in want.values())


def test_tricky(spark, tricky):
    items = [(1, "one"), (2, None), (3, ""), (4, "a b c"), (5, "A, b. C"), (10, " ".join(f"t{i}" for i in range(5, 20))), (11, "same same same"), (12, " ".join(f"t{i}" for i in range(20, 29)) + " other"), (13, "ßtraße ünïcode"), (14, " ".join(["same"] * 12))]
    got = result(decontaminate.decontaminate(clash(tricky), spark.createDataFrame(items, "item_id long, text string")))
    assert got == brute(TRICKY, items)


def test_empty(spark, tricky):
    items = spark.createDataFrame([(1, "one")], "item_id long, text string")
    assert decontaminate.decontaminate(tricky.where("false"), items).count() == 0
    assert all(h == 0 for _, h, _ in result(decontaminate.decontaminate(tricky, items.where("false"))).values())


def test_rows_of_one_id_or_none(spark):
    passage = " ".join(f"b{i}" for i in range(14))
    rows = [(1, passage), (1, "quite other words"), (1, passage + " more"), (None, passage), (None, "nothing here"), (None, None), (1, passage)]
    out = decontaminate.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(7, passage), (7, passage), (None, passage)], "item_id long, text string"))
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in out.collect()), key=str)
    assert got == sorted([(1, 14, 14, ["7"]), (1, 3, 0, []), (1, 15, 14, ["7"]), (None, 14, 14, ["7"]), (None, 2, 0, []), (None, 0, 0, []), (1, 14, 14, ["7"])], key=str)
