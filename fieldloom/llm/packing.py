"""Best-fit packing of tokenized documents into sequences of a fixed capacity.

Tokenizing: ids of the byte-level BPE vocabulary and one end id. Longer documents are cut into pieces of the capacity, of which
the first may be shorter.

Packing is bulk-synchronous best fit. Pieces are written once in order of length, and rounds take ranges of lengths, the longest first.
A round is one Spark job:

1. Gaps offer slots: as many as the range's longest piece surely fits into, or one. Slots and pieces get their ranks by size (counts by
   size and salt, then offsets), the largest first, slots before pieces of their size.
2. Read in that order, a slot opens a bracket and a piece closes one: the piece gets the last slot still open, its successor, which is the
   smallest free slot that holds it. Depths of brackets follow from the counts by size alone; of pieces that want the same slot the
   rank decides, as each has a depth of its own. A depth has at most one slot and one piece a size, so the sweeps along each
   depth are small windows, spread over all tasks, whatever length is frequent.
3. Pieces of a gap are laid end to end, and the gap shrinks. The next round reads what this one wrote.

Pieces that find no slot in a range's last round open sequences: each takes a fixed number that surely fits or, of short pieces, those
that begin within a window that leaves room for the longest. Ranges of which a gap can hold several pieces have a round before, in
which such pieces wait. The driver sees one row a range of lengths, and there are at most 13 rounds whatever the corpus.

Edge cases: null and empty texts are one end id; equal texts, repeated and null ids are packed each, ties of length in any order; a text may
be of any length; an empty table gives no rows; columns of other
names are ignored.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.llm.common import staged

CAPACITY = 2048
END_ID = 0
SPECIAL = "<|endoftext|>"
_ENCODERS: dict[str, object] = {}


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encoder(path: str):
    """The vocabulary as ranks: the same ids as byte_bpe_50k.json gives, several times as fast. The special token's string, where a
    text holds it, is the special token, as in that file."""
    if path not in _ENCODERS:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f)}
        _ENCODERS[path] = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: len(ranks)})
    return _ENCODERS[path]


def encode(text: str, path: str) -> list[int]:
    """The ids of byte_bpe_50k.json. Runs of white space that the fast encoder's pattern can't hold go through the tokenizer itself."""
    try:
        return encoder(path).encode(text, allowed_special="all")
    except ValueError:
        import public_tokenizers
        from tokenizers import Tokenizer

        if "whole" not in _ENCODERS:
            _ENCODERS["whole"] = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        return _ENCODERS["whole"].encode(text, add_special_tokens=False).ids


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: whole ones but for the first."""
    first = n % capacity if n > capacity and n % capacity else min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, key: str, text: str, capacity: int, path: str) -> DataFrame:
    """key, piece, start, length and ids_crc32 (of the ids as little-endian unsigned 32-bit numbers)."""
    fields = ["piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, out = [], []
            for r, t in enumerate(batch.column(1)):
                ids = np.array(encode(t.as_py() or "", path) + [END_ID], "<u4")
                for p, (s, n) in enumerate(cut(len(ids), capacity)):
                    row.append(r)
                    out.append((p, s, n, zlib.crc32(ids[s : s + n].tobytes())))
            x = np.array(out, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(x[:, 0].astype(np.int32)), *(pa.array(x[:, i]) for i in (1, 2, 3))], names=["key", *fields])

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


#: Rows of offsets by size and salt that are sent to all executors; more go through a shuffle.
FEW_OFFSETS = 200_000


#: Ranges of lengths, each by how many of its longest pieces a sequence holds at least.
RANGES = (1, 2, 3, 4, 6, 8, 16, 64)
#: In ranges before this one a gap holds one piece at most, as all gaps come from longer pieces.
SEVERAL = 4
#: From this range on, new sequences are filled by length and not by number.
BY_LENGTH = 8


def swept(slots: DataFrame, pieces: DataFrame, salts: int, sizes: int, opens: F.Column, each: int, window: int | None = None) -> DataFrame:
    """Pieces beside the sequence, slot and room they get: that of their successor slot, or where there is none a new sequence
    opens + i for `each` of them in turn, or for those that begin in a window of that many ids (opens null: none).

    slots: size, seq, slot, room; pieces: size, id and more. sizes: how many sizes there can be.
    """
    both = slots.withColumn("kind", F.lit(0)).unionByName(pieces.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    both = both.withColumn("salt", F.pmod(F.xxhash64("kind", "seq", "slot", "id"), F.lit(salts)))
    counts = both.groupBy("size", "kind", "salt").count()
    order = [F.desc("size"), "kind"]
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    line = Window.partitionBy(F.lit(0)).orderBy(*order)  # one row a size and kind
    runs = counts.groupBy("size", "kind").agg(F.sum(F.when(F.col("kind") == 0, F.col("count")).otherwise(-F.col("count"))).alias("step"))
    runs = runs.withColumn("opened", F.coalesce(F.sum("step").over(before(line)), F.lit(0))).withColumn("after", F.col("opened") + F.col("step"))
    runs = runs.withColumn("lost", -F.least(F.coalesce(F.min("after").over(before(line)), F.lit(0)), F.lit(0)))  # pieces without a slot so far
    runs = runs.withColumn("late", F.when(F.col("kind") == 1, F.greatest(-F.col("step") - F.col("opened") - F.col("lost"), F.lit(0))).otherwise(0))
    runs = runs.withColumn("late_ids", F.coalesce(F.sum(F.col("late") * F.col("size")).over(before(line)), F.lit(0)))
    own = before(Window.partitionBy("size", "kind").orderBy("salt"))
    offsets = counts.withColumn("base", F.coalesce(F.sum("count").over(own), F.lit(0))).join(F.broadcast(runs), ["size", "kind"])
    offsets = offsets.select("size", "kind", "salt", "base", (F.col("opened") + F.col("lost")).alias("depth"), "lost", "late_ids")
    within = Window.partitionBy("size", "kind", "salt").orderBy("seq", "slot", "id")
    ranked = both.withColumn("rank", F.row_number().over(within)).join(F.broadcast(offsets) if 2 * sizes * salts <= FEW_OFFSETS else offsets, ["size", "kind", "salt"])
    ranked = ranked.withColumn("rank", F.col("base") + F.col("rank") - 1)
    level = F.when(F.col("kind") == 0, F.col("depth") + F.col("rank") + 1).otherwise(F.col("depth") - F.col("rank"))
    ranked = ranked.withColumn("level", level).withColumn("late", F.col("lost") - F.col("level"))  # level below 1: no slot
    sweep = Window.partitionBy(F.when(F.col("level") > 0, F.col("level")).otherwise(-1 - F.col("id"))).orderBy(*order)
    met = ranked.withColumn("slot_met", F.lag(F.struct("seq", "slot", "room")).over(sweep)).where(F.col("kind") == 1)
    late = F.col("level") < 1
    new = F.floor(F.col("late") / each) if window is None else F.floor((F.col("late_ids") + (F.col("late") - F.col("lost")) * F.col("size")) / window)
    return met.withColumns({
        "seq": F.when(late, opens + new).otherwise(F.col("slot_met.seq")),
        "slot": F.when(late, F.col("late")).otherwise(F.col("slot_met.slot").cast("long")),
        "room": F.col("slot_met.room"),
    })


def one_round(gaps: DataFrame, waiting: DataFrame, number: int, longest: int, shortest: int, capacity: int, salts: int, opening: bool, by_length: bool) -> DataFrame:
    """waiting with seq and offset (null: still waiting), and gaps after the round: one row of each sequence has its room.

    gaps: seq, room; waiting: id, length and more, all lengths between shortest and longest.
    """
    fit = F.greatest(F.floor(F.col("room") / longest), F.lit(1)).cast("int")
    slots = gaps.where(F.col("room") >= shortest).select("seq", "room", F.explode(F.sequence(F.lit(1), fit)).alias("slot"))
    slots = slots.withColumn("size", F.when(F.col("slot") == 1, F.col("room") - longest * (fit - 1)).otherwise(F.lit(longest)))
    opens = F.lit(number << 40) if opening else F.lit(None).cast("long")
    met = swept(slots, waiting.withColumn("size", F.col("length")), salts, capacity, opens, capacity // longest, capacity - longest + 1 if by_length else None)
    met = met.select(*waiting.columns, "seq", "slot", F.coalesce("room", F.lit(capacity)).alias("room"))
    rows = met.unionByName(gaps.select("seq", "room", F.lit(-1).cast("long").alias("slot"), F.lit(0).cast("long").alias("length")), allowMissingColumns=True)
    group = Window.partitionBy(F.coalesce("seq", -1 - F.col("id"))).orderBy("slot")
    total = F.sum("length").over(group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    earlier = F.coalesce(F.sum("length").over(group.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumns({"offset": capacity - F.col("room") + earlier, "left": F.col("room") - total, "first": F.row_number().over(group) == 1})
    rows = rows.withColumn("room", F.when(F.col("first") & F.col("seq").isNotNull(), F.col("left")))
    return rows.select(*waiting.columns, "seq", F.when(F.col("seq").isNotNull(), F.col("offset")).alias("offset"), "room")


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """pieces() with sequence_id and offset."""
    spark = docs.sparkSession
    cuts = staged(pieces(docs, key, text, capacity, path or vocabulary_path()), "pieces")
    holds = F.floor(F.lit(capacity) / F.col("length"))
    which = F.lit(0)
    for m in RANGES:
        which = F.when(holds >= m, m).otherwise(which)
    sized = cuts.withColumn("range", which)
    found = {r["range"]: r for r in sized.groupBy("range").agg(F.min("length").alias("shortest"), F.max("length").alias("longest")).collect()}  # a row a range
    order = sized.withColumn("id", F.monotonically_increasing_id())
    order = staged(order.repartitionByRange(F.desc("length"), F.xxhash64("id")).sortWithinPartitions(F.desc("length")), "by_length")
    salts = max(32, int(spark.conf.get("spark.sql.shuffle.partitions")))
    least = min((r["shortest"] for r in found.values()), default=1)
    gaps = spark.createDataFrame([], "seq long, room long")
    columns = ["key", "piece", "start", "length", "ids_crc32"]
    placed = order.where("false").select(*columns, F.lit(None).cast("long").alias("seq"), F.lit(None).cast("long").alias("offset"))
    number = 0
    for m in sorted(found):
        shortest, longest = found[m]["shortest"], found[m]["longest"]
        waiting = order.where(F.col("length").between(shortest, longest)).drop("range")
        for opening in (False, True) if number and m >= SEVERAL else (True,):
            number += 1
            done = staged(one_round(gaps, waiting, number, longest, shortest, capacity, salts, opening, m >= BY_LENGTH), "round")
            placed = placed.unionByName(done.where("seq is not null and length > 0").select(*columns, "seq", "offset"))
            waiting = done.where("seq is null").select(*waiting.columns)
            gaps = done.where(F.col("room") >= least).select("seq", "room")
    return placed.withColumnsRenamed({"key": key, "seq": "sequence_id"})
