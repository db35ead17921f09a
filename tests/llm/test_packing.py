from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fieldloom.llm import packing
from tests.llm.conftest import TRICKY, clash


def check(rows, out, capacity):
    """Exact round trip: every id of every document once, in order, and every sequence gapless."""
    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces, places = defaultdict(list), defaultdict(list)
    for r in out:
        pieces[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == {i for i, _ in rows}
    for i, text in rows:
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        at = 0
        copies = sum(j == i for j, _ in rows)
        mine = sorted(pieces[i])
        assert len(mine) % copies == 0
        for p, start, n, crc in mine[::copies]:
            assert start == at and n <= capacity and crc == zlib.crc32(ids[start : start + n].tobytes())
            assert p == 0 or n == capacity
            at += n
        assert at == len(ids) and (len(ids) > capacity or len(mine) == copies)
    for spots in places.values():
        end = 0
        for offset, n in sorted(spots):
            assert offset == end
            end += n
        assert end <= capacity
    return len(places), sum(n for spots in places.values() for _, n in spots)


@pytest.mark.parametrize("capacity", [2048, 64])
def test_round_trip(spark, documents, capacity):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    used, ids = check(rows, packing.pack(documents, capacity=capacity).collect(), capacity)
    assert used <= -(-ids // capacity) * 1.03 + 1


def test_tricky(spark, tricky):
    rows = [(i, t) for i, t in TRICKY]
    check(rows, packing.pack(clash(tricky)).collect(), 2048)
    assert packing.pack(tricky.where("false")).count() == 0


def test_special_string_is_one_id(spark):
    rows = [(1, "a <|endoftext|> b")]
    check(rows, packing.pack(spark.createDataFrame(rows, "doc_id long, text string")).collect(), 2048)


def plain_best_fit(lengths, capacity):
    """Sequences that best fit opens, the longest piece first, each in the fullest sequence that holds it."""
    room = []
    for n in sorted(lengths, reverse=True):
        fitting = [i for i, r in enumerate(room) if r >= n]
        if fitting:
            i = min(fitting, key=lambda i: room[i])
            room[i] -= n
        else:
            room.append(capacity - n)
    return len(room)


def successors(slots, pieces):
    """The sizes of the smallest free slots that hold the pieces, the longest piece first; None where there is none."""
    free, out = sorted(slots), []
    for n in sorted(pieces, reverse=True):
        fitting = [s for s in free if s >= n]
        if fitting:
            free.remove(fitting[0])
        out.append((n, fitting[0] if fitting else None))
    return sorted(out, key=str)


def test_a_sweep_finds_each_piece_its_successor(spark):
    rng = np.random.default_rng(3)
    for trial in range(6):
        slots, pieces = rng.integers(1, 30, rng.integers(0, 60)).tolist(), rng.integers(1, 30, rng.integers(1, 60)).tolist()
        if trial == 5:  # one length holds most rows
            pieces += [17] * 100
        left = spark.createDataFrame([(s, i, 1, s) for i, s in enumerate(slots)], "size long, seq long, slot int, room long")
        right = spark.createDataFrame([(n, i) for i, n in enumerate(pieces)], "size long, id long")
        out = packing.swept(left, right, 4, 30, F.lit(1000), 3).collect()
        assert successors(slots, pieces) == sorted(((r["size"], r["room"]) for r in out), key=str)
        taken = [(r["seq"], r["slot"]) for r in out]
        assert len(set(taken)) == len(taken) == len(pieces)
        late = sorted(s for s, _ in taken if s >= 1000)
        assert late == [1000 + i // 3 for i in range(len(late))]
        out = packing.swept(left, right, 4, 30, F.lit(1000), 3, 100 - 29 + 1).collect()
        begin = np.cumsum([0] + sorted((r["size"] for r in out if r["seq"] >= 1000), reverse=True))[:-1]
        assert sorted(r["seq"] for r in out if r["seq"] >= 1000) == (1000 + begin // 72).tolist()


def test_nearly_as_many_sequences_as_plain_best_fit(spark, documents):
    out = packing.pack(documents.unionByName(documents.where("doc_id % 2 = 0")), capacity=512).collect()
    best = plain_best_fit([r["length"] for r in out], 512)
    assert len({r["sequence_id"] for r in out}) <= 1.01 * best + 1


def test_one_length_may_be_frequent_and_offsets_shuffled(spark, monkeypatch):
    monkeypatch.setattr(packing, "FEW_OFFSETS", 0)
    rows = [(i, "a b c d e") for i in range(300)] + [(i, "a " * 40) for i in range(300, 340)]
    used, ids = check(rows, packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), capacity=64).collect(), 64)
    assert used <= ids / 64 * 1.1 + 1


def test_ids_are_those_of_the_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for text in ("", " ", " " * 1_000_000, "a" * 300_000, " \n\t" * 100_000 + "x", "Ünïcode 李雷 😀 12,5 <|endoftext|> can't", "1" * 50_000, "\r\n" * 2000 + "end"):
        assert packing.encode(text, packing.vocabulary_path()) == whole.encode(text, add_special_tokens=False).ids
