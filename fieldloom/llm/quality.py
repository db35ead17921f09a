"""Quality classifier: a convolutional network over bytes, in numpy.

A text is cut into overlapping chunks that cover all of it. In each chunk learned filters slide over learned byte embeddings
and are max-pooled; a dense layer turns the chunk's values into hidden units, and the mean and the maximum of these over all
chunks give one probability.

Edge cases: null and empty texts count as one chunk of padding and get the score learned for it. Equal texts get equal scores,
also of repeated and null ids. Texts may be of any length: a few thousand chunks are held at a time. A table without labelled rows yields score 0.5 for all rows. Columns of other names are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import labelled_sample, mix, text_blocks

CHUNK = 256
WIDTH = 8
STEP = 2
OVERLAP = 16
POSITIONS = (CHUNK - WIDTH) // STEP + 1
PAD = 256
#: Chunks that are cut out at a time.
SLAB = 2048


def chunk_starts(n: int) -> np.ndarray:
    """Starts of chunks of CHUNK bytes, each OVERLAP bytes into the one before; the last one ends with the text."""
    if n <= CHUNK:
        return np.zeros(1, np.int64)
    starts = np.arange(0, n - CHUNK + (CHUNK - OVERLAP), CHUNK - OVERLAP)
    starts[-1] = n - CHUNK
    return starts


def chunk_plan(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start of each chunk in its text, row of each chunk)."""
    starts = [chunk_starts(int(n)) for n in sizes]
    return np.concatenate(starts), np.repeat(np.arange(len(sizes)), [len(s) for s in starts])


def cut(data: np.ndarray, offsets: np.ndarray, first: np.ndarray, row: np.ndarray) -> np.ndarray:
    """chunks x CHUNK bytes as numbers to 256, for chunks of a plan."""
    inside = first[:, None] + np.arange(CHUNK)
    good = inside < np.diff(offsets)[row][:, None]
    if not len(data):
        return np.full(inside.shape, PAD, np.int16)
    out = data[np.where(good, inside + offsets[row][:, None], 0)].astype(np.int16)
    out[~good] = PAD
    return out


def chunks_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(all chunks, row of each chunk)."""
    first, row = chunk_plan(np.diff(offsets))
    return cut(data, offsets, first, row), row


@dataclass
class ByteNetwork:
    embedding: np.ndarray  # 257 x E
    filters: np.ndarray  # WIDTH x E x F
    bias: np.ndarray  # F
    dense: np.ndarray  # F x H
    dense_bias: np.ndarray  # H
    out: np.ndarray  # 2H
    out_bias: np.ndarray  # 1

    @classmethod
    def fresh(cls, rng: np.random.Generator, e: int = 6, f: int = 20, h: int = 12) -> ByteNetwork:
        n = lambda *s, scale: rng.normal(0, scale, s).astype(np.float32)
        return cls(n(257, e, scale=0.5), n(WIDTH, e, f, scale=(WIDTH * e) ** -0.5), np.zeros(f, np.float32), n(f, h, scale=f**-0.5), np.zeros(h, np.float32), n(2 * h, scale=0.3), np.zeros(1, np.float32))

    def tables(self) -> np.ndarray:
        """Response of each filter to each byte at each place of its window: WIDTH x 257 x F."""
        return np.einsum("be,wef->wbf", self.embedding, self.filters)

    def pooled(self, chunks: np.ndarray, tables: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(largest response of each filter in each chunk, the place of it)."""
        total = np.broadcast_to(self.bias, (len(chunks), POSITIONS, len(self.bias))).copy()
        for w in range(WIDTH):
            total += tables[w][chunks[:, w : w + STEP * POSITIONS : STEP]]
        return total.max(1), total.argmax(1)

    def largest(self, chunks: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """The responses of pooled, byte pairs looked up at once and a few chunks at a time so that they stay in cache."""
        out = np.empty((len(chunks), len(self.bias)), np.float32)
        for a in range(0, len(chunks), 16):
            c = chunks[a : a + 16]
            total = tables[0].take(c[:, 0 : STEP * POSITIONS : STEP], axis=0)
            for w in range(1, WIDTH):
                total += tables[w].take(c[:, w : w + STEP * POSITIONS : STEP], axis=0)
            out[a : a + 16] = total.max(1)
        return out + self.bias

    def head(self, peak: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, ...]:
        """(probability by row, and what training needs). row: sorted, every row has a chunk."""
        hidden = np.maximum(np.einsum("cf,fh->ch", peak, self.dense) + self.dense_bias, 0)  # unlike BLAS, alike for any number of rows
        first = np.searchsorted(row, np.arange(rows))
        count = np.diff(np.append(first, len(row)))[:, None]
        mean, most = np.add.reduceat(hidden, first) / count, np.maximum.reduceat(hidden, first)
        both = np.concatenate([mean, most], 1)
        return 1 / (1 + np.exp(-np.clip((both * self.out).sum(1) + self.out_bias, -30, 30))), both, hidden, count, most

    def score(self, data: np.ndarray, offsets: np.ndarray, tables: np.ndarray | None = None) -> np.ndarray:
        tables = self.tables() if tables is None else tables
        first, row = chunk_plan(np.diff(offsets))
        peak = [self.largest(cut(data, offsets, first[a : a + SLAB], row[a : a + SLAB]), tables) for a in range(0, len(row), SLAB)]
        return self.head(np.concatenate(peak), row, len(offsets) - 1)[0]


def train(chunks: np.ndarray, row: np.ndarray, labels: np.ndarray, epochs: int = 14, batch: int = 32, per_text: int = 6, rate: float = 0.01, seed: int = 5) -> ByteNetwork:
    """Adam on log loss, classes weighted alike. chunks: some of each text (row, in order). Each pass takes per_text of these anew."""
    rng = np.random.default_rng(seed)
    net = ByteNetwork.fresh(rng)
    first = np.searchsorted(row, np.arange(len(labels) + 1))
    share = labels.mean()
    weight = np.where(labels == 1, 0.5 / max(share, 1e-6), 0.5 / max(1 - share, 1e-6)).astype(np.float32)
    names = list(net.__dict__)
    m, v, step = {k: 0.0 for k in names}, {k: 0.0 for k in names}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(labels))
        for a in range(0, len(order), batch):
            ids = order[a : a + batch]
            picks = [first[i] + (np.arange(first[i + 1] - first[i]) if first[i + 1] - first[i] <= per_text else np.sort(rng.choice(first[i + 1] - first[i], per_text, False))) for i in ids]
            r = np.repeat(np.arange(len(ids)), [len(p) for p in picks])
            c = chunks[np.concatenate(picks)]
            peak, place = net.pooled(c, net.tables())
            p, both, hidden, count, most = net.head(peak, r, len(ids))
            g = ((p - labels[ids]) * weight[ids] / len(ids)).astype(np.float32)
            h = hidden.shape[1]
            grad = {"out": both.T @ g, "out_bias": np.array([g.sum()], np.float32)}
            d_both = g[:, None] * net.out
            tie = hidden == most[r]
            d_hidden = d_both[r, :h] / count[r] + d_both[r, h:] * tie / np.maximum(np.add.reduceat(tie, np.searchsorted(r, np.arange(len(ids)))), 1)[r]
            d_hidden *= hidden > 0
            grad |= {"dense": peak.T @ d_hidden, "dense_bias": d_hidden.sum(0)}
            d_peak = d_hidden @ net.dense.T
            grad["bias"] = d_peak.sum(0)
            grad["filters"], grad["embedding"] = np.zeros_like(net.filters), np.zeros_like(net.embedding)
            at = np.arange(len(c))[:, None]
            for w in range(WIDTH):
                byte = c[at, place * STEP + w]  # chunks x F
                grad["filters"][w] = np.einsum("cfe,cf->ef", net.embedding[byte], d_peak)
                d_byte = d_peak[:, :, None] * net.filters[w].T[None]
                for e in range(net.embedding.shape[1]):
                    grad["embedding"][:, e] += np.bincount(byte.ravel(), d_byte[:, :, e].ravel(), 257)
            step += 1
            lr = rate * (0.5 + 0.5 * np.cos(np.pi * epoch / epochs))
            for k in names:
                m[k] = 0.9 * m[k] + 0.1 * grad[k]
                v[k] = 0.999 * v[k] + 0.001 * grad[k] ** 2
                setattr(net, k, (getattr(net, k) * (1 - 1e-4) - lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32))
    return net


def drawn_chunks(docs: DataFrame, key: str, text: str, drawn: int) -> DataFrame:
    """k and chunks: at most so many chunks of each whole text, drawn by a hash of the key and the chunk's place, all of a shorter one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seeds, out = batch.column(1).to_numpy(zero_copy_only=False), []
            for a, b, d, o in text_blocks(batch.column(2)):
                for r in range(b - a):
                    data = d[o[r] : o[r + 1]]
                    first = chunk_starts(len(data))
                    if len(first) > drawn:
                        order = mix(first.astype(np.uint64) ^ seeds[a + r : a + r + 1].view(np.uint64))
                        first = np.sort(first[np.argpartition(order, drawn)[:drawn]])
                    out.append(cut(data, np.array([0, len(data)]), first, np.zeros(len(first), np.int64)).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["k", "chunks"])

    rows = docs.select(F.col(key).alias("k"), F.xxhash64(F.col(key), F.lit(29)).alias("seed"), F.col(text).cast("string").alias("t"))
    return rows.mapInArrow(run, f"k {rows.schema['k'].dataType.simpleString()}, chunks binary")


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", per_label: int = 1000, drawn: int = 48) -> ByteNetwork | None:
    """Fits on at most about per_label texts of each label, by `drawn` chunks of each that are drawn over the whole of it (24 KB a text, whatever its
    script). A key that is labelled more than once counts once, with its largest label."""
    known = labels.where(F.col(label).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.max(label).cast("int").alias("y"))
    picked = F.broadcast(labelled_sample(known, "k", "y", per_label))
    chosen = docs.withColumn("_k", F.col(key)).join(picked.withColumnRenamed("k", "_k").select("_k"), "_k", "left_semi")
    rows = drawn_chunks(chosen, key, text, drawn).join(picked, "k").orderBy("k").toArrow()
    y = np.array(rows["y"].to_pylist(), np.float32)
    if not len(y) or y.min() == y.max():
        return None
    parts = [np.frombuffer(c, np.int16).reshape(-1, CHUNK) for c in rows["chunks"].to_pylist()]
    return train(np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(c) for c in parts]), y)


def predict(docs: DataFrame, model: ByteNetwork | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and score: how likely label 1 is."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        tables = None if net is None else net.tables().astype(np.float32)
        for batch in batches:
            parts = [np.full(b - a, 0.5) if net is None else net.score(d, o, tables) for a, b, d, o in text_blocks(batch.column(1), 1 << 18)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(parts).astype(np.float64) if parts else [], pa.float64())], names=["key", "score"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, score double").withColumnRenamed("key", key)
