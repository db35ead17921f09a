"""N-gram Jaccard join with prefix trees.

A text's set is its distinct runs of N words as 64-bit hashes, ordered by hash: the global order. Equal sets are one class.

Candidates. If |A & B| / |A | B| >= t, then in any order that all sets share, the first n - ceil(t * n) + 1 members of A and those
of B (n being the set's own size) have one in common. The order here puts members that few sets hold first: ahead go the
members of the lowest hashes (twice as many as a prefix needs), by the number of sets that hold them, then the others, and last
those of buckets of a count sketch that are used far more than most. So a prefix holds members that no other set has, wherever
the set has enough of them, and only those of it that other sets hold are keys. Sets with one key are candidates if no gap in
size parts them; their connected components are blocks, and every link lies inside a block.

Join. A block's sets go into a prefix tree in the global order. Each set is run down the tree; what it shares with a branch's
common prefix is counted once for all sets below, and a branch is left as soon as what remains of the set and of the longest
set below can't reach the needed overlap, or when all below is linked with the set already.

Blocks of more than BLOCK_SETS sets or BLOCK_MEMBERS members are not given to one task. A set near the block's centre is compared
with all others, wherever they are; by the triangle inequality of Jaccard distance its neighbours need not be compared with sets
that are more than twice the threshold's distance away, so only the rest goes on to the next round. A block that stays large
(sets that are alike, but mostly not linked) is taken apart by keys: the sets of one key are a block of their own, whose trees
are small; a key of too many sets is cut into ranges of size and joined range by range, each pair of ranges with its own tree.

Edge cases: a text of fewer than N words is one run of all its words; null and empty texts and such without words have the
empty set and link with nothing, not even each other; equal and repeated texts are one class, all its rows linked; a text may be
of any length; rows are judged by their texts, so rows of one id with other texts have components of their own, and a component_id is null only where
none of the rows has an id; an empty table gives no rows; columns of other names are ignored. Hashes of 64 bits stand for
the runs throughout.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.llm.common import SPACED, U64, Words, grams, join_by_key, mix, signed, staged, text_blocks
from fieldloom.llm.components import connected

N = 3
PERCENT = 90
#: Sets, and members of sets in all, that one task joins in a tree; larger blocks are split.
BLOCK_SETS = 2048
BLOCK_MEMBERS = 4_000_000
#: Rounds of comparing with centres before what is left is joined key by key.
CENTRE_ROUNDS = 1
#: Buckets of the count sketch that finds members of very many sets.
SKETCH_BITS = 16
_WORDS = Words(SPACED)


# ---- sets and their ranges ----


def sets_of(data: np.ndarray, offsets: np.ndarray, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """(members of all sets, one after the other and each in order; size of each set)."""
    h, _, count = _WORDS.split(data, offsets)
    rows = len(offsets) - 1
    ends = np.cumsum(count)
    runs = np.maximum(count - n + 1, 0)
    first = np.repeat(ends - count, runs) + np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
    members, row = grams(h, n)[first], np.repeat(np.arange(rows), runs)
    for m in range(1, n):
        short = np.flatnonzero(count == m)
        if len(short):
            members, row = np.concatenate([members, mix(grams(h, m)[(ends - count)[short]] + U64(m))]), np.concatenate([row, short])
    order = np.lexsort((members, row))
    members, row = members[order], row[order]
    keep = np.ones(len(members), bool)
    keep[1:] = (members[1:] != members[:-1]) | (row[1:] != row[:-1])
    return members[keep], np.bincount(row[keep], minlength=rows).astype(np.int64)


def digests(members: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One hash for each set, whatever its rows' order."""
    with np.errstate(over="ignore"):
        total = np.concatenate([[U64(0)], np.cumsum(mix(members ^ U64(0x5BD1E9955BD1E995)), dtype=U64)])
        ends = np.cumsum(sizes)
        return mix(total[ends] - total[ends - sizes] + sizes.astype(U64) * U64(0x9E3779B97F4A7C15))


def prefix_size(sizes: np.ndarray, percent: int) -> np.ndarray:
    return sizes - -(-percent * sizes // 100) + 1


def zone_end(percent: int) -> int:
    """Hashes below it are those of the members that are counted: about twice as many of a set as its prefix has."""
    return int(min(0.98, 2 * (100 - percent) / 100) * 2.0**64)


def ordered(members: np.ndarray, sizes: np.ndarray, hot: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of the members that can be in a prefix, slack of each set): all counted ones, and of the others, in order, those
    within the prefix. Slack is how many more counted members a set has than its prefix needs, 0 if too few."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    kind = np.where(hot[(members >> U64(64 - SKETCH_BITS)).astype(np.int64)], 2, np.where(members < U64(zone_end(percent)), 0, 1))
    order = np.argsort(3 * row + kind, kind="stable")
    place = np.arange(len(members)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    prefix = prefix_size(sizes, percent)
    counted = np.bincount(row[kind == 0], minlength=len(sizes))
    return np.sort(order[(kind[order] == 0) | (place < prefix[row])]), np.maximum(counted - prefix, 0)


# ---- the tree ----


def linked(overlap: int, a: int, b: int, percent: int) -> bool:
    return 100 * overlap >= percent * (a + b - overlap)


class PrefixTree:
    """Sets in the global order; branches hold runs of members that all sets below share, at most RUN of them each.

    Branches are kept level by level in arrays, so that a set is run down all open branches of a level at once. `label` of a
    branch is the group of all sets below if that was one when the tree was built, else -1.
    """

    RUN = 16

    def __init__(self, sets: list[np.ndarray], groups: list[int]):
        self.order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u8").tobytes())
        ordered = [sets[i] for i in self.order]
        own = [groups[i] for i in self.order]
        shared = [0] * (len(ordered) + 1)  # members at the start in common with the set before
        for i in range(1, len(ordered)):
            m = min(len(ordered[i - 1]), len(ordered[i]))
            differ = np.flatnonzero(ordered[i - 1][:m] != ordered[i][:m])
            shared[i] = int(differ[0]) if len(differ) else m
        sizes = [len(x) for x in ordered]
        rows, runs = [], []
        queue = deque([(0, len(ordered), 0)] if ordered else [])
        made = len(queue)
        while queue:
            low, high, depth = queue.popleft()
            full = sizes[low] if high - low == 1 else min(shared[low + 1 : high])
            end = min(full, depth + self.RUN)
            first = made
            if end < full:
                queue.append((low, high, end))
                made += 1
            elif high - low > 1:
                cuts = [low, *(i for i in range(low + 1, high) if shared[i] == end), high]
                queue.extend((x, y, end) for x, y in zip(cuts, cuts[1:], strict=False))
                made += len(cuts) - 1
            one = set(own[low:high])
            runs.append(ordered[low][depth:end])
            rows.append((end - depth, end, min(sizes[low:high]), max(sizes[low:high]), low, first, made - first, one.pop() if len(one) == 1 else -1))
        x = np.array(rows, np.int64).reshape(-1, 8)
        self.length, self.depth, self.least, self.most, self.low, self.child, self.children, self.label = x.T
        self.flat = np.concatenate(runs) if runs else np.zeros(0, U64)
        self.start = np.cumsum(self.length) - self.length
        self.last = np.array([ordered[r[4]][r[1] - 1] if r[1] else 0 for r in rows], U64)

    def partners(self, probe: np.ndarray, percent: int, roots: np.ndarray | None = None, mine: int = -1) -> Iterator[int]:
        """Places in the given list of the sets linked with probe. Branches whose label's root is `mine` are of no use."""
        n = len(probe)
        at, overlap = np.zeros(min(1, len(self.length)), np.int64), np.zeros(min(1, len(self.length)), np.int64)
        while len(at):
            keep = (self.most[at] * 100 >= percent * n) & (self.least[at] * percent <= 100 * n)
            if roots is not None:
                label = self.label[at]
                keep &= (label < 0) | (roots[label] != mine)
            at, overlap = at[keep], overlap[keep]
            length = self.length[at]
            ends = np.cumsum(length)
            run = self.flat[np.repeat(self.start[at] - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)]
            hit = np.concatenate([[0], np.cumsum(probe[np.minimum(np.searchsorted(probe, run), n - 1)] == run)])
            overlap = overlap + hit[ends] - hit[ends - length]
            depth = self.depth[at]
            rest = np.where(depth > 0, n - np.searchsorted(probe, self.last[at], "right"), n)
            small = np.maximum(self.least[at], -(-percent * n // 100))
            keep = (overlap + np.minimum(rest, self.most[at] - depth)) * (100 + percent) >= percent * (n + small)
            at, overlap = at[keep], overlap[keep]
            count = self.children[at]
            for i in np.flatnonzero(count == 0).tolist():
                if linked(int(overlap[i]), n, int(self.most[at[i]]), percent):
                    yield self.order[self.low[at[i]]]
            ends = np.cumsum(count)
            overlap = np.repeat(overlap, count)
            at = np.repeat(self.child[at] - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)


class Groups:
    """Groups of places, named by their smallest place."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, i: int, j: int) -> None:
        a, b = self.root[i], self.root[j]
        if a != b:
            self.root[self.root == max(a, b)] = min(a, b)


def overlaps(one: np.ndarray, members: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Overlap of a set with each of many."""
    where = np.minimum(np.searchsorted(one, members), max(len(one) - 1, 0))
    hit = np.concatenate([[0], np.cumsum(one[where] == members)]) if len(one) else np.zeros(len(members) + 1, int)
    ends = np.cumsum(sizes)
    return hit[ends] - hit[ends - sizes]


def join_block(sets: list[np.ndarray], percent: int, other: int | None = None) -> list[int]:
    """The group (its first place) of each set of a block, after all links inside it. other: only sets before this place are
    run down a tree of the sets from it on."""
    n, groups = len(sets), Groups(len(sets))
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    if n > 2:  # sets linked with one near the centre need no search among themselves
        values, uses = np.unique(flat, return_counts=True)
        usual = values[2 * uses > n]
        near = overlaps(usual, flat, sizes)
        centre = int(np.argmax(near / np.maximum(sizes + len(usual) - near, 1)))
        same = overlaps(sets[centre], flat, sizes)
        for i in np.flatnonzero(100 * same >= percent * (sizes + sizes[centre] - same)).tolist():
            groups.join(i, centre)
    at = 0 if other is None else other
    tree = PrefixTree(sets[at:], groups.root[at:].tolist())
    for i in range(n if other is None else other):
        for j in tree.partners(sets[i], percent, groups.root, groups.root[i]):
            groups.join(i, at + j)
    return groups.root.tolist()


# ---- the join in Spark ----


def _load(n: F.Column) -> F.Column:
    """A set's share of what one task may join."""
    return F.greatest(F.lit(1.0 / BLOCK_SETS), n / F.lit(float(BLOCK_MEMBERS)))


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def scan(docs: DataFrame, words: int = N) -> DataFrame:
    """doc, n and set (hash, null if empty) of each row; and rows of a sketch: bucket and number of members in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        kind = None
        for batch in batches:
            kind = batch.column(0).type
            for a, b, d, o in text_blocks(batch.column(1)):
                members, sizes = sets_of(d, o, words)
                total += np.bincount((members >> U64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(total))
                none = pa.nulls(b - a, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(sizes), pa.array(signed(digests(members, sizes)), mask=sizes == 0), none, none], names=names)
        used = np.flatnonzero(total)
        if kind is not None and len(used):
            yield pa.RecordBatch.from_arrays([pa.nulls(len(used), kind), *(pa.nulls(len(used), pa.int64()),) * 2, pa.array(used), pa.array(total[used])], names=names)

    names = ["doc", "n", "set", "bucket", "uses"]
    return docs.mapInArrow(run, f"doc {_kind(docs, 'doc')}, n long, set long, bucket long, uses long")


def _hot_buckets(scanned: DataFrame) -> np.ndarray:
    """Which buckets hold far more members than most: at most 2 ** SKETCH_BITS flags, whatever the input."""
    sketch = staged(scanned.where(F.col("bucket").isNotNull()).groupBy("bucket").agg(F.sum("uses").alias("n")), "sketch")
    facts = sketch.agg(F.sum("n"), F.percentile_approx("n", 0.5)).first()
    members, usual = int(facts[0] or 0), int(facts[1] or 0)
    hot = np.zeros(1 << SKETCH_BITS, bool)
    hot[[r[0] for r in sketch.where(F.col("n") > 2 * usual + max(100, members // 100_000)).select("bucket").collect()]] = True
    return hot


#: Layout of a member on its way: 48 bits of its hash, then whether its bucket is hot, then its set's slack (as far as it fits).
_TOKEN_BITS, _HOT, _SLACK = 48, 1 << 15, (1 << 15) - 1


def candidate_keys(docs: DataFrame, hot: np.ndarray, percent: int, words: int) -> DataFrame:
    """k, set: the members of prefixes that more than one set may hold; each pair of sets that are linked has one in common."""
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shared, end = spark.sparkContext.broadcast(hot), zone_end(percent) >> (64 - _TOKEN_BITS)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, d, o in text_blocks(batch.column(0)):
                members, sizes = sets_of(d, o, words)
                which = digests(members, sizes)
                first = np.zeros(len(sizes), bool)
                first[np.unique(which, return_index=True)[1]] = True  # equal sets of a block count once
                members, sizes, which = members[np.repeat(first, sizes)], sizes[first], which[first]
                at, slack = ordered(members, sizes, shared.value, percent)
                row, m = np.repeat(np.arange(len(sizes)), sizes)[at], members[at]
                rest = np.minimum(slack, _SLACK).astype(U64)[row] | np.where(shared.value[(m >> U64(64 - SKETCH_BITS)).astype(np.int64)], U64(_HOT), U64(0))
                k = (m >> U64(64 - _TOKEN_BITS) << U64(64 - _TOKEN_BITS)) | rest
                yield pa.RecordBatch.from_arrays([pa.array(signed(k)), pa.array(signed(which[row]))], names=["k", "set"])

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows in the order of token and set: tokens of more than one set, with their number of sets; all hot ones."""

        def emit(k: np.ndarray, s: np.ndarray) -> Iterator[pa.RecordBatch]:
            token = k >> U64(64 - _TOKEN_BITS)
            new = np.concatenate([[True], (token[1:] != token[:-1]) | (s[1:] != s[:-1])])
            k, s, token = k[new], s[new], token[new]
            start = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            count = np.diff(np.append(start, len(token)))
            df = np.repeat(count, count)
            burning = (k & U64(_HOT)) > 0
            keep = (df > 1) | burning
            sure = burning | (token >= U64(end))
            out = (signed(token)[keep], s[keep], df[keep], sure[keep], (k & U64(_SLACK)).astype(np.int64)[keep])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["k", "set", "df", "sure", "slack"])

        held: list[tuple[np.ndarray, np.ndarray]] = []  # of the last token, which may go on
        for batch in batches:
            k, s = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
            if not len(k):
                continue
            token = k >> U64(64 - _TOKEN_BITS)
            last = int(np.searchsorted(token, token[-1]))
            if held and token[0] != held[-1][0][-1] >> U64(64 - _TOKEN_BITS):
                yield from emit(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held = []
            if last:
                yield from emit(*(np.concatenate(x) for x in zip(*held, (k[:last], s[:last]), strict=True)))
                held = []
            held.append((k[last:].copy(), s[last:].copy()))
        if held:
            yield from emit(*(np.concatenate(x) for x in zip(*held, strict=True)))

    token = F.shiftrightunsigned("k", 64 - _TOKEN_BITS)
    dealt = docs.select("text").mapInArrow(spread, "k long, set long").repartition(partitions, F.when(F.col("k").bitwiseAND(F.lit(_HOT)) > 0, F.col("set")).otherwise(token))
    found = staged(dealt.sortWithinPartitions(token, "set").mapInArrow(repeated, "k long, set long, df long, sure boolean, slack long"), "repeated")
    counted = found.where("not sure").groupBy("set").agg(F.first("slack").alias("slack"), F.array_sort(F.collect_list(F.struct("df", "k"))).alias("l"))
    least = F.slice("l", F.lit(1), F.greatest(F.size("l") - F.col("slack"), F.lit(0)).cast("int"))
    chosen = counted.select("set", F.explode(least).alias("x")).select(F.col("x")["k"].alias("k"), "set")
    return chosen.unionByName(found.where("sure").select("k", "set").distinct())


def _candidate_edges(keyed: DataFrame, percent: int) -> DataFrame:
    """a, b: chains through the sets of each key in the order of size, broken where the next set is too large to be linked with any
    before it. keyed: k, set, n. Sets of one size are joined with their first, so hot keys shrink before they are dealt out."""
    groups = staged(keyed.groupBy("k", "n").agg(F.min("set").alias("a"), F.count("*").alias("sets")), "groups")
    before = Window.partitionBy("k").orderBy("n")
    near = 100 * F.lag("n").over(before) >= percent * F.col("n")
    chain = groups.select("a", F.when(near, F.lag("a").over(before)).alias("b")).where(F.col("b").isNotNull())
    equal = join_by_key(keyed, groups.where("sets > 1"), ["k", "n"], "sets", keyed.count()).select("a", F.col("set").alias("b"))
    return chain.unionByName(equal).where("a <> b")


def _members(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """Sets of the wanted rows (set, doc, block, size of the block, whether it is large) with their members, made again from the texts."""
    known = wanted.count()
    small = wanted.select("doc", "set", "block", "block_sets", "large")
    texts = docs.join(F.broadcast(small) if known <= 500_000 else small, "doc").select("text", "set", "block", "block_sets", "large")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            want = batch.column(1).to_numpy()
            for a, b, d, o in text_blocks(batch.column(0)):
                members, sizes = sets_of(d, o, words)
                same = signed(digests(members, sizes)) == want[a:b]  # rows of one id can hold several texts
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                out = pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in (1, 2, 3, 4)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(signed(members)))], names=["set", "block", "block_sets", "large", "members"])
                yield out.filter(pa.array(same))

    return texts.mapInArrow(run, "set long, block long, block_sets long, large boolean, members array<long>").withColumn("mark", F.lit(0).cast("long"))


def _unpack(column: pa.ListArray) -> list[np.ndarray]:
    flat, o = column.flatten().to_numpy().view(np.uint64), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())])
    return [flat[o[i] : o[i + 1]] for i in range(len(o) - 1)]


def _tree_links(rows: DataFrame, percent: int, partitions: int) -> DataFrame:
    """a, b: links that join the sets of each block. rows: block, set, mark, members. Sets with mark 0 are run down a tree of
    those with mark 1 if a block has both; else all down a tree of all."""

    def links(ids: list[int], marks: list[int], sets: list[np.ndarray]) -> tuple[list[int], list[int]]:
        seen: dict[tuple[int, int], int] = {}
        for i, key in enumerate(zip(marks, ids, strict=True)):
            seen.setdefault(key, i)
        keep = sorted(seen.values(), key=lambda i: marks[i])
        split = sum(marks[i] == 0 for i in keep)
        group = join_block([sets[i] for i in keep], percent, split if 0 < split < len(keep) else None)
        pairs = [(ids[keep[g]], ids[keep[i]]) for i, g in enumerate(group) if ids[keep[g]] != ids[keep[i]]]
        return [a for a, _ in pairs], [b for _, b in pairs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, marks, sets = None, [], [], []
        for batch in batches:
            for b, s, m, one in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), _unpack(batch.column(3)), strict=True):
                if b != block:
                    if len(ids) > 1:
                        x, y = links(ids, marks, sets)
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["a", "b"])
                    block, ids, marks, sets = b, [], [], []
                ids.append(s)
                marks.append(m)
                sets.append(one.copy())
        if len(ids) > 1:
            x, y = links(ids, marks, sets)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["a", "b"])

    dealt = rows.select("block", "set", "mark", "members").repartition(partitions, "block").sortWithinPartitions("block", "mark", "set")
    return dealt.mapInArrow(run, "a long, b long")


def _overlap_with(rows: DataFrame, pivots: DataFrame) -> DataFrame:
    """set, block, its size, and overlap and size of its block's pivot (block, pivot, pivot_members)."""
    joined = rows.join(pivots, "block").select("set", "block", "pivot", "members", "pivot_members")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            o, n, m = [], [], []
            for mine, pivot in zip(_unpack(batch.column(3)), _unpack(batch.column(4)), strict=True):
                n.append(len(mine))
                m.append(len(pivot))
                o.append(int(overlaps(pivot, mine, np.array([len(mine)]))[0]))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), *(pa.array(x, pa.int64()) for x in (o, n, m))], names=["set", "block", "pivot", "overlap", "n", "m"])

    return joined.mapInArrow(run, "set long, block long, pivot long, overlap long, n long, m long")


def _usual_members(rows: DataFrame) -> DataFrame:
    """block and the members that over half of a bounded sample of its sets hold (up to some 250 sets by hash)."""
    sample = rows.where(F.pmod(F.xxhash64("set"), F.col("block_sets")) < 250)
    counts = sample.groupBy("block").agg(F.count("*").alias("sampled"))
    uses = sample.select("block", F.explode("members").alias("member")).groupBy("block", "member").agg(F.count("*").alias("uses"))
    return uses.join(counts, "block").where(2 * F.col("uses") > F.col("sampled")).groupBy("block").agg(F.array_sort(F.collect_list("member")).alias("pivot_members")).select("block", F.lit(-1).cast("long").alias("pivot"), _unsigned_order("pivot_members").alias("pivot_members"))


def _unsigned_order(column: str) -> F.Column:
    """Ascending signed numbers put in the order of the same bits read unsigned."""
    return F.concat(F.filter(column, lambda x: x >= 0), F.filter(column, lambda x: x < 0))


def _centre_links(rows: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(links of each block's set nearest the usual members, sets that must still be compared)."""
    near = _overlap_with(rows, staged(_usual_members(rows), "usual"))
    best = near.groupBy("block").agg(F.max(F.struct((F.col("overlap") / F.greatest(F.col("n") + F.col("m") - F.col("overlap"), F.lit(1))).alias("j"), F.col("set").alias("s")))["s"].alias("pivot"))
    none = rows.groupBy("block").agg(F.min("set").alias("least"))  # where the sample has no usual members
    best = none.join(best, "block", "left").select("block", F.coalesce("pivot", "least").alias("pivot"))
    pivots = staged(rows.select(F.col("set").alias("pivot"), F.col("members").alias("pivot_members")).join(best, "pivot").dropDuplicates(["block"]).select("block", "pivot", "pivot_members"), "pivots")
    seen = staged(_overlap_with(rows, pivots), "compared")
    union = F.col("n") + F.col("m") - F.col("overlap")
    links = seen.where((100 * F.col("overlap") >= percent * union) & (F.col("set") != F.col("pivot"))).select(F.col("pivot").alias("a"), F.col("set").alias("b"))
    distance = 1 - F.col("overlap") / union
    reach = 1 - percent / 100 + 1e-9
    # a neighbour of the pivot can be linked with a set outside only if that is less than `reach` further away
    outside = seen.where(100 * F.col("overlap") < percent * union).groupBy("block").agg(F.min(distance).alias("nearest"))
    rest = seen.join(outside, "block").where((F.col("set") != F.col("pivot")) & ((100 * F.col("overlap") < percent * union) | (distance + reach >= F.col("nearest"))))
    return links, rest.select("set", "block").distinct()


def _range_links(rows: DataFrame, percent: int, partitions: int) -> DataFrame:
    """Links of blocks of any size: ranges of sets by size, each of one task's load, joined pair by pair of ranges whose sizes can
    be linked."""
    sized = rows.withColumn("n", F.size("members"))
    by_size = sized.groupBy("block", "n").agg(F.count("*").alias("sets"))
    before = Window.partitionBy("block").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_size.withColumn("start", F.coalesce(F.sum(F.col("sets") * _load(F.col("n"))).over(before), F.lit(0.0)))
    # a set's range: by its size's start and, within the size, by hash, so no range holds much more than a task's load
    placed = sized.join(starts, ["block", "n"])
    place = F.col("start") + F.pmod(F.xxhash64("set", F.lit(64)), F.col("sets")) * _load(F.col("n"))
    placed = placed.withColumn("part", F.floor(place).cast("long"))
    spans = staged(placed.groupBy("block", "part").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.count("*").alias("sets")), "spans")
    other = spans.select("block", F.col("part").alias("part2"), F.col("least").alias("least2"), F.col("most").alias("most2"))
    pairs = spans.join(other, "block").where((F.col("part") <= F.col("part2")) & (100 * F.col("most") >= percent * F.col("least2")))
    pairs = pairs.select("block", "part", "part2", F.xxhash64("block", "part", "part2").alias("pair"))
    sides = pairs.select("block", "part", "pair", F.lit(0).cast("long").alias("mark")).unionByName(pairs.where("part <> part2").select("block", F.col("part2").alias("part"), "pair", F.lit(1).cast("long").alias("mark")))
    rows = placed.select("block", "part", "set", "members").join(sides, ["block", "part"]).select(F.col("pair").alias("block"), "set", "mark", "members")
    return _tree_links(rows, percent, partitions)


def _key_links(members: DataFrame, keyed: DataFrame, percent: int, partitions: int) -> DataFrame:
    """Links of large blocks by keys: linked sets share one. Keys of the same sets count once."""
    keyed = staged(keyed.join(members.select("set"), "set", "left_semi"), "keyed")
    groups = keyed.groupBy("k").agg(F.count("*").alias("sets"), *[F.sum(F.pmod(F.xxhash64("set", F.lit(i)), F.lit(1 << 40))).alias(f"which{i}") for i in (1, 2)], (F.sum(_load(F.col("n"))) > 1).alias("large")).where("sets > 1")
    blocks = staged(groups.groupBy("sets", "which1", "which2").agg(F.min("k").alias("k"), F.max("large").alias("large")), "keys")
    placed = keyed.join(blocks.select("k", "large"), "k").select(F.col("k").alias("block"), "set", "large")
    each = placed.join(members.select("set", "members", F.lit(0).cast("long").alias("mark")), "set")
    found = _tree_links(each.where("not large"), percent, partitions)
    if blocks.where("large").isEmpty():
        return found
    return found.unionByName(_range_links(each.where("large").select("block", "set", "members"), percent, partitions))


def links_between(docs: DataFrame, keyed: DataFrame, classes: DataFrame, percent: int, words: int = N) -> DataFrame:
    """a, b: links enough to join all linked sets. docs: doc, text; keyed: k, set and n; classes: set, doc and n of each distinct set."""
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = spark.createDataFrame([], "a long, b long")
    left = keyed
    for turn in range(CENTRE_ROUNDS + 1):
        nodes = connected(_candidate_edges(left, percent))
        wanted = nodes.toDF("set", "block").join(classes, "set")
        blocks = wanted.groupBy("block").agg(F.count("*").alias("block_sets"), (F.sum(_load(F.col("n"))) > 1).alias("large"))
        wanted = staged(wanted.join(blocks, "block"), "wanted")
        members = _members(docs, wanted, words)
        if wanted.where("large").isEmpty():
            return found.unionByName(_tree_links(members, percent, partitions))
        members = staged(members, "members")
        found = found.unionByName(staged(_tree_links(members.where("not large"), percent, partitions), "links"))
        members = members.where("large")
        if turn == CENTRE_ROUNDS:
            return found.unionByName(_key_links(members, left, percent, partitions))
        links, rest = _centre_links(members, percent)
        rest = staged(rest, "rest")
        found = found.unionByName(staged(links, "links"))
        left = staged(left.join(rest.select("set"), "set", "left_semi"), "left")
    raise AssertionError


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT, n: int = N) -> DataFrame:
    """key, n_shingles and component_id (the smallest key that links lead to) for each row; sets of runs of n words."""
    text = F.col(text).cast("string")
    docs = docs.select(F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("id"), F.xxhash64(text).alias("text")).alias("doc"), text.alias("text"))
    scanned = staged(scan(docs, n), "sets")
    texts = scanned.where(F.col("bucket").isNull())
    sets = texts.where(F.col("set").isNotNull())
    classes = staged(sets.groupBy("set").agg(F.min("doc").alias("doc"), F.max("n").alias("n")), "classes")
    keyed = staged(candidate_keys(docs, _hot_buckets(scanned), percent, n).join(classes.select("set", "n"), "set"), "keys")
    roots = connected(links_between(docs, keyed, classes, percent, n))
    labelled = staged(classes.join(roots.withColumnRenamed("node", "set"), "set", "left").withColumn("root", F.coalesce("root", "set")), "labelled")
    groups = labelled.groupBy("root").agg(F.min("doc").alias("component"))
    out = sets.select("doc", "n", "set").join(labelled.join(groups, "root").select("set", "component"), "set")
    empty = texts.where(F.col("set").isNull()).select("doc", "n", F.col("doc").alias("component"))
    return out.select("doc", "n", "component").unionByName(empty).select(F.col("doc")["id"].alias(key), F.col("n").alias("n_shingles"), F.col("component")["id"].alias("component_id"))
