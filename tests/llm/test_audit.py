from __future__ import annotations

import random
import re
from fractions import Fraction
from itertools import permutations

from fieldloom.llm import audit

COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def failing(doc_id, text, docs):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    out = ""
    out += "A" if len(words) < 100 else ""
    out += "B" if 100 * len(set(words)) < 80 * len(words) else ""
    out += "C" if 100 * len(re.findall("[A-Z]", t)) > 10 * len(t) else ""
    out += "D" if re.search(r"[#$%&*|]", t) else ""
    out += "E" if doc_id is not None and any(i is not None and i < doc_id and (u or "") == t for i, u, _ in docs) else ""
    return out


def plainly(docs, labels):
    """Runs each order over each document."""
    good, toxic = {i for i, q, _ in labels if q == 1} - {None}, {i for i, _, t in labels if t == 1} - {None}
    rows = [(lang or "", i, failing(i, t, docs)) for i, t, lang in docs]
    out, removed_in_all = [], {}
    for part in {p for p, _, _ in rows}:
        mine = [(i, f) for p, i, f in rows if p == part]
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, c in enumerate(order, 1):
                gone = [(i, f) for i, f in left if c in f]
                fails = sum(c in f for _, f in mine)
                left = [(i, f) for i, f in left if c not in f]
                removed_in_all[part, c] = removed_in_all.get((part, c), 0) + len(gone)
                out.append([part, order, step, len(left), len(gone), fails - len(gone), sum(f == c for _, f in mine), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone), c])
    return sorted((*r[:-1], removed_in_all[r[0], r[-1]]) for r in out)


def run(spark, docs, labels):
    d = spark.createDataFrame([(i, t, lang, 1, 2) for i, t, lang in docs], "doc_id long, text string, lang string, mask int, n int")
    found = audit.audit(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert found.columns == COLUMNS
    return sorted(tuple(r) for r in found.collect())


def test_against_running_each_order(spark):
    rng = random.Random(3)
    pieces = ["word", "Ünder", "ABC", "x|y", "a\tb", "50%", "same same", "", "\n", "ok."]
    texts = [" ".join(rng.choice(pieces) if rng.random() < 0.3 else f"w{rng.randrange(400)}" for _ in range(rng.choice([0, 1, 90, 99, 100, 101, 150]))) for _ in range(40)]
    docs = [(i, rng.choice(texts), rng.choice(["en", "de", None, ""])) for i in range(150)]
    docs += [(i, None, "en") for i in (200, 201)] + [(202, "", "fr"), (None, texts[0], "en"), (None, texts[0], "en"), (7, texts[1], "en"), (7, texts[1], "en"), (7, texts[1], None)]
    docs += [(300, " ".join(f"long{i}" for i in range(30_000)), "es")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 140, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (999, 1, 1)]
    assert run(spark, docs, labels) == plainly(docs, labels)


def test_limits_are_exact(spark):
    hundred = [f"w{i}" for i in range(100)]
    docs = [
        (1, " ".join(hundred), "a"), (2, " ".join(hundred[:99]), "a"), (3, " ".join(hundred[:80] + ["w0"] * 20), "a"), (4, " ".join(hundred[:79] + ["w0"] * 21), "a"),
        (5, "A" + "b" * 9, "a"), (6, "AA" + "b" * 17, "a"), (7, "ÄÖ" + "c" * 8, "a"), (8, "Case case CASE", "a"), (9, "𝒳" * 9 + "A", "a"),
    ]
    assert run(spark, docs, []) == plainly(docs, [])


def test_empty_tables(spark):
    assert run(spark, [], [(1, 1, 1)]) == []
    assert run(spark, [(1, None, None)], []) == plainly([(1, None, None)], [])


def test_polynomials_are_sums_over_orders():
    rng = random.Random(5)
    for k in (1, 2, 3, 4, 6):
        counts = {m: rng.randrange(50) for m in range(1 << k)}
        p = audit.removal_polynomial(counts, k)
        total = [0] * k
        orders = list(permutations(range(k)))
        for order in orders:
            on = 0
            for i in order:
                total[i] += sum(n for m, n in counts.items() if m >> i & 1 and not m & on)
                on |= 1 << i
                assert audit.at_corner(p, on) == sum(n for m, n in counts.items() if m & on)
        assert [audit.shapley(p, i) for i in range(k)] == [Fraction(t, len(orders)) for t in total]
