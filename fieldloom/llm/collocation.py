"""Phrases whose words occur together more often than their parts would let expect, mined by pivots as in MG-FSM.

A phrase belongs to its rarest word, its pivot: rarity is one order of all words (of a language), by count and then by hash. Each
occurrence of a word becomes a fragment: the words around it that are more frequent, as far as they reach without a gap (left of it
more frequent in earnest, so that a phrase with its pivot twice belongs to the first of both), all others being blanked. A fragment
holds exactly the phrases that this occurrence owns. Equal fragments are counted where they arise and sent to the bucket of their
pivot; there phrases are counted, and those that are frequent leave. So a phrase is counted in one place, and what is rare never
travels as a phrase.

Buckets come from the word counts: each holds words with at most BUCKET_WORDS occurrences in all, or a share of one word that has
more. Such a word's fragments are dealt by their hash, and only its phrases need a second sum. A line that is repeated in very many
documents is a few fragments with large counts.

Words are known by 64-bit hashes of language and word; a task's fragments name words by places in a short list of these. The counts
of the LIST_WORDS most frequent words are sent to all tasks. A corpus may have more words of the least count; those beyond the list
rank as rarer than it, among themselves by hash, and get their counts by a join, so results are the same.

Scores: of a phrase with count a, cut after k words into parts of counts l and r, the integer part of scale * a * a / (l * r) in decimals of 38
digits; the least over its cuts counts. A phrase is dropped where a longer one that holds it has `covered` per cent of its count.
As the count never grows with length, phrases of one word more decide that.

Edge cases: null texts are empty; null languages are `und`, together with those of that name; documents of any length; words of any
length; repeated rows count each time; ids don't matter; an empty table gives no rows; columns of other names are ignored. Languages
with fewer phrases than `most` give all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.llm.common import _PLACE, U64, Words, mix, signed, staged, text_blocks

#: Words whose counts all tasks know (24 MB).
LIST_WORDS = 1_000_000
#: Occurrences of a bucket's words: 20 MB of fragments at most.
BUCKET_WORDS = 1_000_000
#: Words of text whose fragments a task counts before it sends them.
FLUSH_WORDS = 2_000_000
#: Distinct words that a task holds before it sends their counts.
FLUSH_TYPES = 500_000
#: Tasks that take a language's first phrases, before one task merges what they leave.
TOP_TASKS = 64

_PIECE = np.zeros(256, bool)
_PIECE[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = True
_INSIDE = ~_PIECE
_INSIDE[[0x20, 0x09]] = False
_WORDS = Words(_INSIDE)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
RAREST = np.int64(1) << 62


# ---- words of texts ----


def _languages(column: pa.Array) -> tuple[list[str], np.ndarray]:
    """The languages of a batch and each row's place among them."""
    names = column.fill_null("und").dictionary_encode() if len(column) else pa.array([], pa.string()).dictionary_encode()
    return names.dictionary.to_pylist(), names.indices.to_numpy()


def _seed(name: str) -> np.uint64:
    """A hash of the language, the same in every task."""
    data = np.frombuffer(name.encode(), np.uint8).astype(U64)
    with np.errstate(over="ignore"):
        h = U64(len(data) + 1)
        for x in data:
            h = (h ^ (x + U64(1))) * U64(0x9E3779B97F4A7C15)
    return mix(np.array([h]))[0]


def _of_language(h: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Hash of language and word; never 0, which is a blank."""
    with np.errstate(over="ignore"):
        out = mix(h ^ seeds)
    out[out == 0] = 1
    return out


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]]:
    """For blocks of texts: hash and language (a place in names) and piece of each word, names, bytes, first and last byte of each word."""
    for batch in batches:
        names, of = _languages(batch.column(0))
        seeds = np.array([_seed(x) for x in names], U64)
        for a, b, data, offsets in text_blocks(batch.column(1)):
            h, row, _, s, e = _WORDS.spans(data, offsets)
            if not len(h):
                continue
            marks = np.cumsum(_PIECE[data], dtype=np.int64)[s]
            lang = of[a:b][row]
            piece = np.cumsum(np.concatenate([[0], (marks[1:] != marks[:-1]) | (row[1:] != row[:-1])]))
            yield _of_language(h, seeds[lang]), lang, piece, names, data, s, e


def _slices(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> pa.Array:
    """The lower-cased stretches of data as strings."""
    n = e - s
    ends = np.cumsum(n)
    at = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - n, n) + np.repeat(s, n)
    return pa.LargeStringArray.from_buffers(len(n), pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64)), pa.py_buffer(_LOWER[data[at]].tobytes())).cast(pa.string())


_COUNTED = "word long, lang string, text string, f long"


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, list] = {}  # hash: language, text, count

    def out() -> pa.RecordBatch:
        values = list(held.values())
        return pa.RecordBatch.from_arrays([pa.array(signed(np.fromiter(held, U64, len(held)))), pa.array([v[0] for v in values], pa.string()), pa.array([v[1] for v in values], pa.string()), pa.array([v[2] for v in values], pa.int64())], names=["word", "lang", "text", "f"])

    for h, lang, _, names, data, s, e in _scan(batches):
        types, first, count = np.unique(h, return_index=True, return_counts=True)
        texts = None
        keys = types.tolist()
        new = np.array([k not in held for k in keys])
        if new.any():
            at = first[new]
            texts = iter(zip([names[i] for i in lang[at]], _slices(data, s[at], e[at]).to_pylist(), strict=True))
        for k, n, fresh in zip(keys, count.tolist(), new.tolist(), strict=True):
            if fresh:
                held[k] = [*next(texts), n]
            else:
                held[k][2] += n
        if len(held) >= FLUSH_TYPES:
            yield out()
            held.clear()
    if held:
        yield out()


def count_words(docs: DataFrame) -> DataFrame:
    """word (hash of language and word), lang, text and f. docs: lang, text."""
    return docs.select("lang", "text").mapInArrow(_count_words, _COUNTED).groupBy("word").agg(F.first("lang").alias("lang"), F.first("text").alias("text"), F.sum("f").alias("f"))


# ---- the list of frequent words and the buckets ----


class WordList:
    """The most frequent words by hash: rank (0: the most frequent), count, first bucket and number of buckets.

    complete: there is no other word of the least count, so what isn't in the list can be blanked."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, complete: bool, bucket_words: int, rest_buckets: int):
        words = words.view(U64)
        order = np.lexsort((words, -counts))
        rank = np.empty(len(words), np.int64)
        rank[order] = np.arange(len(words))
        buckets = np.maximum(1, -(-counts // bucket_words))
        # hot words have buckets of their own; the others are dealt in the order of their hashes, which is by chance
        by_hash = np.argsort(words)
        words, counts, rank, buckets = words[by_hash], counts[by_hash], rank[by_hash], buckets[by_hash]
        hot = buckets > 1
        cold = np.cumsum(np.where(hot, 0, counts)) // bucket_words
        n_cold = int(cold[-1]) + 1 if len(cold) else 0
        first = np.where(hot, n_cold + np.cumsum(np.where(hot, buckets, 0)) - buckets, cold)
        self.words, self.counts, self.rank, self.first, self.buckets, self.complete = words, counts, rank, first, buckets, complete
        self.listed = n_cold + int(buckets[hot].sum())
        self.rest = 0 if complete else max(1, rest_buckets)

    def places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the list, whether it is there)."""
        if not len(self.words):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        return at, self.words[at] == h

    def ranks(self, h: np.ndarray) -> np.ndarray:
        """Each word's rank: higher is rarer; below 0: blank. Words beyond an incomplete list follow it, by hash."""
        at, there = self.places(h)
        beyond = np.full(len(h), -1, np.int64) if self.complete else (RAREST + (h >> U64(2)).astype(np.int64))
        return np.where(there, self.rank[at] if len(self.words) else 0, beyond)

    def bucket(self, h: np.ndarray, spread: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bucket of each pivot, whether it shares the pivot with other buckets); spread deals a hot pivot's fragments."""
        at, there = self.places(h)
        if not len(self.words):
            return self.listed + (mix(h) % U64(self.rest)).astype(np.int64), there
        n = self.buckets[at]
        own = self.first[at] + (spread % n.astype(U64)).astype(np.int64)
        return (np.where(there, own, self.listed + (mix(h) % U64(max(1, self.rest))).astype(np.int64)), there & (n > 1))

    def count_of(self, h: np.ndarray) -> pa.Array:
        at, there = self.places(h)
        return pa.array(self.counts[at] if len(self.words) else np.zeros(len(h), np.int64), mask=~there)


def word_list(words: DataFrame, least: int) -> WordList:
    """The list and the buckets, from all word counts (written)."""
    often = words.where(F.col("f") >= least)
    n = often.count()
    total = words.agg(F.coalesce(F.sum("f"), F.lit(0))).first()[0]
    size = max(BUCKET_WORDS, total // 100_000)  # at most some hundred thousand buckets
    top = often.orderBy(F.desc("f"), "word").limit(LIST_WORDS).select("word", "f").toArrow()
    counts = top["f"].to_numpy()
    return WordList(top["word"].to_numpy(), counts, n <= LIST_WORDS, size, int((total - counts.sum()) // size) + 1)


# ---- fragments ----


def fragments(h: np.ndarray, piece: np.ndarray, ranks: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of pivots that own a phrase, for each the hashes of the 2 * longest - 1 words around it, 0 where blank)."""
    n, side = len(h), longest - 1
    reach = []
    for sign in (-1, 1):
        going = ranks >= 0
        steps = []
        for k in range(1, side + 1):
            going = going.copy()
            a, b = (slice(k, n), slice(0, n - k)) if sign < 0 else (slice(0, n - k), slice(k, n))  # a: pivots, b: their k-th neighbours
            going[: k if sign < 0 else 0] = False
            if sign > 0:
                going[max(0, n - k) :] = False
            going[a] &= (piece[a] == piece[b]) & (ranks[b] >= 0) & ((ranks[b] < ranks[a]) if sign < 0 else (ranks[b] <= ranks[a]))
            steps.append(going)
        reach.append(steps)
    at = np.flatnonzero(reach[0][0] | reach[1][0])
    out = np.zeros((len(at), 2 * side + 1), U64)
    out[:, side] = h[at]
    for k in range(1, side + 1):
        for sign, steps in zip((-1, 1), reach, strict=True):
            there = steps[k - 1][at]
            out[there, side + sign * k] = h[at[there] + sign * k]
    return at, out


def _fold(words: np.ndarray) -> np.ndarray:
    """Hash of each row of word hashes."""
    with np.errstate(over="ignore"):
        total = np.full(len(words), U64(words.shape[1]), U64)
        for k in range(words.shape[1]):
            total += words[:, k] * _PLACE[k]
    return mix(total)


def key_of(words: np.ndarray) -> np.ndarray:
    """The key of phrases of one length: of one word its hash."""
    return words[:, 0] if words.shape[1] == 1 else _fold(words)


_SENT = "bucket long, shared boolean, list binary, places binary, counts binary"


def _send(known, longest: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = at_piece = 0

    def out() -> Iterator[pa.RecordBatch]:
        h, piece = (np.concatenate(x) for x in zip(*held, strict=True))
        types, code = np.unique(h, return_inverse=True)
        ranks = known.value.ranks(types)[code]
        _, found = fragments(h, piece, ranks, longest)
        if not len(found):
            return
        spread, first, count = np.unique(_fold(found), return_index=True, return_counts=True)
        found = found[first]
        bucket, shared = known.value.bucket(found[:, longest - 1], spread)
        order = np.argsort(bucket, kind="stable")
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket[order])) + 1, [len(order)]])
        rows: list[tuple] = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            mine = order[a:b]
            local, places = np.unique(found[mine], return_inverse=True)
            places = places.astype(np.uint16 if len(local) < 1 << 16 else np.uint32)
            counts = count[mine]
            rows.append((int(bucket[mine[0]]), bool(shared[mine[0]]), local.tobytes(), places.tobytes(), counts.astype(np.uint8 if counts.max() < 256 else np.int64).tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "shared", "list", "places", "counts"])

    for h, _, piece, *_ in _scan(batches):
        held.append((h, piece + at_piece))
        at_piece += int(piece[-1]) + 1
        size += len(h)
        if size >= FLUSH_WORDS:
            yield from out()
            held, size = [], 0
    if held:
        yield from out()


def _unpack(local: bytes, places: bytes, counts: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows of word hashes, their counts)."""
    local = np.frombuffer(local, U64)
    places = np.frombuffer(places, np.uint16 if len(local) < 1 << 16 else np.uint32).reshape(-1, width)
    return local[places], np.frombuffer(counts, np.uint8 if len(counts) == len(places) else np.int64).astype(np.int64)


def phrases_of(found: np.ndarray, count: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Phrases of n words that the pivots (middle column) own, one row an occurrence in a fragment, and the fragments' counts."""
    side = found.shape[1] // 2
    words, counts = [], []
    for a in range(side - n + 1, side + 1):
        there = (found[:, a] != 0) & (found[:, a + n - 1] != 0)
        words.append(found[there, a : a + n])
        counts.append(count[there])
    return np.concatenate(words), np.concatenate(counts)


def summed(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, words, count) of each phrase."""
    key, first, place = np.unique(key_of(words), return_index=True, return_inverse=True)
    total = np.zeros(len(key), np.int64)
    np.add.at(total, place, counts)
    return key, words[first], total


_MINED = "key long, words array<long>, a long, f array<long>, shared boolean"


def _mine(known, longest: int, least: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Phrases of each bucket; rows come bucket by bucket."""
    width = 2 * longest - 1
    held: list[tuple[np.ndarray, np.ndarray]] = []
    at: tuple | None = None

    def out() -> Iterator[pa.RecordBatch]:
        found, count = (np.concatenate(x) for x in zip(*held, strict=True))
        for n in range(2, longest + 1):
            key, words, a = summed(*phrases_of(found, count, n))
            if not at[1]:
                keep = a >= least
                key, words, a = key[keep], words[keep], a[keep]
            if len(key):
                ends = pa.array(np.arange(0, len(key) * n + 1, n, dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(key)), pa.ListArray.from_arrays(ends, pa.array(signed(words.ravel()))), pa.array(a), pa.ListArray.from_arrays(ends, known.value.count_of(words.ravel())), pa.array(np.full(len(key), at[1]))],
                    names=["key", "words", "a", "f", "shared"],
                )

    for batch in batches:
        for bucket, shared, *packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if at is not None and at[0] != bucket:
                yield from out()
                held = []
            at = (bucket, shared)
            held.append(_unpack(*packed, width))
    if held:
        yield from out()


def frequent_phrases(docs: DataFrame, words: DataFrame, longest: int, least: int) -> DataFrame:
    """key, words (hashes), a, f (counts of the words) of all phrases of 2 to longest words that occur so often. docs: lang, text;
    words: as count_words gives them, written."""
    found = word_list(words, least)
    known = docs.sparkSession.sparkContext.broadcast(found)
    sent = docs.select("lang", "text").mapInArrow(lambda b: _send(known, longest, b), _SENT)
    dealt = sent.repartition(max(1, found.listed + found.rest), "bucket").sortWithinPartitions("bucket")
    mined = staged(dealt.mapInArrow(lambda b: _mine(known, longest, least, b), _MINED), "phrases")
    parts = mined.where("shared").groupBy("key").agg(F.first("words").alias("words"), F.sum("a").alias("a"), F.first("f").alias("f")).where(F.col("a") >= least)
    out = mined.where("not shared").select("key", "words", "a", "f").unionByName(parts)
    if found.complete:
        return out
    # words beyond the list are rare, so no key of this join is hot
    lost = out.select("key", F.posexplode(F.arrays_zip("words", "f")).alias("i", "w")).where("w.f is null").select("key", "i", F.col("w.words").alias("word"))
    own = lost.join(words.select("word", F.col("f").alias("own")), "word").groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("i", "own"))).alias("own"))
    return out.join(own, "key", "left").withColumn("f", F.transform("f", lambda x, i: F.coalesce(x, F.element_at("own", i)))).drop("own")


# ---- scores ----


def score_cuts(phrases: DataFrame, longest: int, scale: int) -> DataFrame:
    """Adds l, r and score of the cut that counts."""
    words = F.col("words")
    # parts of one word have their counts beside them; those of more words are phrases as well, at least as frequent
    cuts = phrases.select("key", "a", "words", "f", F.explode(F.sequence(F.lit(1), F.size(words) - 1)).alias("k"))
    n = F.size(words)
    part = lambda a, m: F.when(m > 1, F.slice(words, a, m))
    cuts = cuts.select("key", "a", "k", part(F.lit(1), F.col("k")).alias("lw"), part(F.col("k") + 1, n - F.col("k")).alias("rw"), F.col("f")[0].alias("l1"), F.element_at("f", -1).alias("r1"))
    known = phrases.where(F.size("words") < longest).select("words", F.col("a").alias("of"))
    cuts = cuts.join(known.withColumnsRenamed({"words": "lw", "of": "lp"}), "lw", "left").join(known.withColumnsRenamed({"words": "rw", "of": "rp"}), "rw", "left")
    cuts = cuts.select("key", "a", "k", F.coalesce("lp", "l1").alias("l"), F.coalesce("rp", "r1").alias("r"))
    big = lambda c: F.col(c).cast("decimal(18,0)")
    score = F.expr(f"(cast({scale} as decimal(7,0)) * (cast(a as decimal(15,0)) * cast(a as decimal(15,0)))) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))")
    best = cuts.withColumn("score", score).groupBy("key").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return phrases.join(best.select("key", "cut.l", "cut.r", "cut.score"), "key")


def without_covered(phrases: DataFrame, covered: int) -> DataFrame:
    """Drops phrases of which a longer one that holds them has at least so many per cent of the count."""
    n = F.size("words")
    parts = phrases.where(n > 2).select(F.col("a").alias("longer"), F.explode(F.array(F.slice("words", 1, n - 1), F.slice("words", 2, n - 1))).alias("words"))
    most = parts.groupBy("words").agg(F.max("longer").alias("longer"))
    return phrases.join(most, "words", "left").where(F.coalesce(F.col("longer") * 100 < F.col("a") * covered, F.lit(True))).drop("longer")


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, most: int = 2000, covered: int = 50, scale: int = 1_000_000, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's first phrases, by score, count and text."""
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("string").alias("text"))
    words = staged(count_words(texts), "words")
    phrases = staged(frequent_phrases(texts, words, longest, least), "frequent")
    scored = staged(without_covered(score_cuts(phrases, longest, scale), covered).select("key", "words", "a", "l", "r", "score"), "scored")
    of = words.select("word", "lang", F.col("text").alias("of"))
    # the language of a phrase is that of its first word
    first = scored.withColumn("word", F.col("words")[0]).join(of.select("word", "lang"), "word").drop("word")
    salt = F.pmod("key", F.lit(TOP_TASKS))
    ahead = F.rank().over(Window.partitionBy("lang", salt).orderBy(F.desc("score"), F.desc("a")))
    over = F.rank().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a")))  # of TOP_TASKS * most rows and ties
    few = staged(first.withColumn("place", ahead).where(F.col("place") <= most).withColumn("place", over).where(F.col("place") <= most).drop("place"), "first")
    spelled = few.select("key", F.posexplode("words").alias("i", "word")).join(of.select("word", "of"), "word").groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "of"))), lambda x: x["of"]), " ").alias("phrase"))
    sizes = words.groupBy("lang").agg(F.sum("f").alias("n"))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    ranked = few.join(spelled, "key").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= most)
    return ranked.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
