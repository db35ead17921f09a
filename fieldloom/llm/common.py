"""What the text operators share: byte blocks out of Arrow batches, word hashes, staged tables and joins that survive hot keys."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.sources import staging

BLOCK_BYTES = 1 << 20
U64 = np.uint64


#: Rows in an Arrow batch where the session has not set another number than Spark's own, which is too many for long texts.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bound_batches(spark: SparkSession) -> None:
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """staging.staged with bounded Arrow batches."""
    bound_batches(df.sparkSession)
    return staging.staged(df, name)


def held_out(key: str, modulus: int, remainder: int) -> F.Column:
    """crc32 of the id as text, by remainder; false for a row without an id."""
    return F.coalesce((F.crc32(F.col(key).cast("string").cast("binary")) % F.lit(modulus)) == F.lit(remainder), F.lit(False))


def learnable(key: str, modulus: int, remainder: int) -> F.Column:
    """Rows that a model may learn from: with an id, and not held out."""
    return F.col(key).isNotNull() & ~held_out(key, modulus, remainder)


def labelled_sample(df: DataFrame, key: str, label: str, per_label: int) -> DataFrame:
    """At most about per_label rows of each value of label, by a hash of the key: the bounded sample that a model is fitted on.

    The values of label must be few. Where a label has fewer rows, all are taken.
    """
    counts = df.where(F.col(label).isNotNull()).groupBy(label).count()
    share = counts.select(label, F.least(F.lit(1.0), F.lit(float(per_label)) / F.col("count")).alias("_share"))
    unit = (F.pmod(F.xxhash64(F.col(key), F.lit(17)), F.lit(1 << 30)) / F.lit(float(1 << 30)))
    return df.join(F.broadcast(share), label).where(unit < F.col("_share")).drop("_share")


#: Rows of a written table (some tens of bytes each) that are sent to all executors; longer tables go through a shuffle.
FEW_ROWS = 500_000


def sent_if_few(written: DataFrame, load: F.Column | None = None) -> DataFrame:
    """The written table, marked for broadcast where it has at most FEW_ROWS rows, or where the sum of load over its rows is so low."""
    n = written.agg(F.count(F.lit(1)) if load is None else F.coalesce(F.sum(load), F.lit(0))).first()[0]
    return F.broadcast(written) if n <= FEW_ROWS else written


def join_by_key(left: DataFrame, right: DataFrame, key: str | list[str], count: str, rows: int) -> DataFrame:
    """Inner join of left with right, which has one row a key (of one or more columns) and in `count` the number of left rows with that key.

    Keys with over a thousandth of the rows are fewer than a thousand, so that part of right is broadcast whatever the
    input's size; the other keys are shuffled and none of them can fill a task.
    """
    limit = max(100, rows // 1000)
    hot = right.where(F.col(count) > limit)
    cold = right.where(F.col(count) <= limit)
    marked = left.join(F.broadcast(hot.select(*([key] if isinstance(key, str) else key), F.lit(True).alias("_hot"))), key, "left")
    part = left.columns
    return (
        marked.where(F.col("_hot")).select(*part).join(F.broadcast(hot), key)
        .unionByName(marked.where(F.col("_hot").isNull()).select(*part).join(cold, key))
    )


# ---- bytes of Arrow string columns ----


def text_blocks(column: pa.Array | pa.ChunkedArray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, UTF-8 bytes, offsets from 0) in blocks of at most `most` bytes, or of one row.

    Null counts as empty. The bytes are a view of Arrow's buffer.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.fill_null("") if column.null_count else column
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        end = min(end, n)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def _splitmix(n: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
        return h ^ (h >> U64(31))


BASE = 0x5851F42D4C957F2D
BASE_INVERSE = pow(BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, BLOCK_BYTES + 1)
        steps = np.full(size, base, U64)
        steps[0] = 1
        with np.errstate(over="ignore"):
            have = np.multiply.accumulate(steps)
        if size <= 4 * BLOCK_BYTES:
            _POWERS[base] = have
    return have[:n]


class Words:
    """Words of whole texts as 64-bit hashes, found on bytes: a byte is part of a word or not, and A-Z count as a-z.

    Both word patterns in use treat every non-ASCII character as part of a word, so UTF-8 bytes decide as characters do.
    """

    def __init__(self, in_word: np.ndarray):
        self.in_word = in_word
        values = _splitmix(256, 7)
        values[65:91] = values[97:123]
        values[~in_word] = 0
        self.values = values

    def split(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash of each word, row of each word, number of words by row)."""
        return self.spans(data, offsets)[:3]

    def spans(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """As split, and the first byte of each word and the byte after its last."""
        return self.parts(data, offsets, ())[:5]

    def parts(self, data: np.ndarray, offsets: np.ndarray, prefixes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        """As spans, and for each length of prefixes the hash of each word's first bytes, 0 for words that aren't longer."""
        rows = len(offsets) - 1
        n = len(data)
        if not n:
            none = np.zeros(0, np.int64)
            return np.zeros(0, U64), none, np.zeros(rows, np.int64), none, none, [np.zeros(0, U64) for _ in prefixes]
        inside = self.in_word[data]
        start = inside.copy()
        start[1:] &= ~inside[:-1]
        firsts = offsets[:-1][offsets[:-1] < n]
        start[firsts] = inside[firsts]
        end = inside
        end[:-1] &= ~inside[1:]
        lasts = offsets[1:][offsets[1:] > 0] - 1
        end[lasts] = self.in_word[data[lasts]]
        s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
        with np.errstate(over="ignore"):
            total = np.cumsum(self.values[data] * powers(BASE, n), dtype=U64)
            before = np.where(s > 0, total[s - 1], U64(0))
            back = powers(BASE_INVERSE, n)[s]
            h = mix((total[e - 1] - before) * back + (e - s).astype(U64))
            starts = [np.where(e - s > p, mix((total[np.minimum(s + p, n) - 1] - before) * back + U64(p) + U64(1 << 32)), U64(0)) for p in prefixes]
        row = np.searchsorted(offsets, s, "right") - 1
        return h, row, np.bincount(row, minlength=rows).astype(np.int64), s, e, starts


def _class(separators: list[tuple[int, int]]) -> np.ndarray:
    inside = np.ones(256, bool)
    for lo, hi in separators:
        inside[lo : hi + 1] = False
    return inside


#: [^\x20\x09-\x0D]+
SPACED = _class([(0x20, 0x20), (0x09, 0x0D)])
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of lower-cased text
ALNUM = _class([(0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])
_PLACE = [U64(x | 1) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x2127599BF4325C37, 0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F)]


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words, by its first word; runs over the end of h are left out. Rows are the caller's business."""
    m = max(0, len(h) - n + 1)
    with np.errstate(over="ignore"):
        total = np.full(m, U64(n), U64)
        for k in range(n):
            total += h[k : k + m] * _PLACE[k]
    return mix(total)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
