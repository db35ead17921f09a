"""Toxic passages by maximal scoring segments.

Token scores are log-odds of toxic against other labelled texts under an informative Dirichlet prior (the background's token
rates), kept where they differ by enough standard errors. Words and their beginnings are tokens; a word scores as its longest
known token, so inflected and compound forms score as their stems do. A word without one costs a little, so that random text
drifts downwards. One linear scan finds every maximal scoring segment of a text. A segment's score is turned into an extreme-value
(Karlin-Altschul) bit score with the text's length taken off, and a text's score combines the best passage and the number of
significant ones through a logistic link fitted on the same labelled rows.

Edge cases: null and empty texts have no passage and get the link's score for none. Equal texts get equal scores, also of repeated and
null ids. Texts may be of any length: the scan is linear in the text. A table without labelled rows of both kinds yields score 0 for
all rows, an empty one no rows. Columns of other names are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import ALNUM, Words, grams, labelled_sample, signed, staged, text_blocks

_WORDS = Words(ALNUM)
#: Lengths in bytes of the beginnings that count as tokens, the longest first.
PREFIXES = (10, 9, 8, 7, 6, 5)


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments [start, end) of a sequence, left to right, in linear time.

    Candidates are kept with the sums before and after them. A new positive item is merged leftwards with the nearest
    candidate whose left sum is lower, as long as that candidate's right sum is lower than the new one's.
    """
    before = np.concatenate([[0.0], np.cumsum(scores)])
    found: list[list] = []  # start, end, left sum, right sum, index of the nearest candidate to the left with a lower left sum
    for i in np.flatnonzero(scores > 0).tolist():
        new = [i, i + 1, before[i], before[i + 1], -1]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j = found[j][4]
            if j < 0 or found[j][3] >= new[3]:
                new[4] = j
                found.append(new)
                break
            new = [found[j][0], new[1], found[j][2], new[3], -1]
            del found[j:]
    return [(s, e, float(r - left)) for s, e, left, r, _ in found]


def karlin_altschul(values: np.ndarray, rates: np.ndarray) -> tuple[float, float]:
    """(lambda, K): sum of rates * exp(lambda * values) = 1; K by the first-order approximation from the score's drift."""
    drift = float((values * rates).sum())
    if not (values > 0).any() or drift >= 0:
        return 1.0, 0.1
    lo, hi = 1e-6, 1.0
    f = lambda x: float((rates * np.exp(np.minimum(x * values, 700))).sum()) - 1
    while f(hi) < 0 and hi < 1e3:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    slope = float((rates * values * np.exp(np.minimum(lo * values, 700))).sum())
    return lo, max(1e-6, min(1.0, drift * drift / max(slope, 1e-9)))


@dataclass
class ToxicModel:
    tokens: np.ndarray  # sorted hashes
    scores: np.ndarray
    cost: float  # of any other token, below 0
    scale: float  # lambda
    k: float
    link: np.ndarray  # weights of features()

    def token_scores(self, h: np.ndarray, starts: list[np.ndarray]) -> np.ndarray:
        """Score of each word: of the word itself if known, else of its longest known beginning."""
        out = np.full(len(h), self.cost)
        if not len(self.tokens):
            return out
        for part in [*reversed(starts), h]:
            at = np.minimum(np.searchsorted(self.tokens, part), len(self.tokens) - 1)
            known = self.tokens[at] == part
            out[known] = self.scores[at[known]]
        return out

    def passages(self, scores: np.ndarray) -> list[tuple[int, int, float]]:
        """(first word, word after the last, calibrated score) of each segment; the score is minus the log of the expected
        number of such segments in random text of this length, so over 0 means rarer than once."""
        if not (scores > 0).any():
            return []
        size = np.log(self.k * max(len(scores), 1))
        return [(s, e, self.scale * v - size) for s, e, v in maximal_segments(scores)]

    def features(self, scores: np.ndarray) -> tuple[float, float, float, float]:
        """1, the best passage's calibrated score, that of a text of its own length alone, and the significant passages."""
        found = [b for _, _, b in self.passages(scores)]
        if not found:
            return 1.0, 0.0, 0.0, 0.0
        best = max(found)
        return 1.0, 1.0 + max(0.0, 4.0 + best) / 4, (best + float(np.log(len(scores)))) / 4, float(np.log1p(sum(b > 0 for b in found)))


def _by_row(h: np.ndarray, count: np.ndarray) -> Iterator[tuple[int, int]]:
    ends = np.cumsum(count)
    return zip((ends - count).tolist(), ends.tolist(), strict=True)


def _token_counts(rows: DataFrame) -> DataFrame:
    """token hash, uses in texts of label 1, in texts of label 0, texts of label 1 that hold it, and words of both labels among
    the uses (the others are beginnings); summed in Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch.column(1).to_numpy(zero_copy_only=False)
            for a, b, d, o in text_blocks(batch.column(0)):
                h, row, _, _, _, starts = _WORDS.parts(d, o, PREFIXES)
                if not len(h):
                    continue
                toxic = y[a:b][row] == 1
                for whole, part in ((1, h), *((0, p) for p in starts)):
                    use = part != 0
                    u, inv = np.unique(part[use], return_inverse=True)
                    if not len(u):
                        continue
                    t, r = toxic[use], row[use]
                    pair = np.unique(r[t] * len(u) + inv[t]) % len(u)
                    n1, n0 = (np.bincount(inv, x, len(u)).astype(np.int64) for x in (t, ~t))
                    yield pa.RecordBatch.from_arrays([pa.array(signed(u)), pa.array(n1), pa.array(n0), pa.array(np.bincount(pair, minlength=len(u)).astype(np.int64)), pa.array(n1 * whole), pa.array(n0 * whole)], names=["token", "n1", "n0", "d1", "w1", "w0"])

    names = ("n1", "n0", "d1", "w1", "w0")
    return rows.select("t", "y").mapInArrow(run, "token long, " + ", ".join(f"{c} long" for c in names)).groupBy("token").agg(*[F.sum(c).alias(c) for c in names])


def _without_copies(rows: DataFrame) -> DataFrame:
    """One text of each label and smallest 5-word hash, so that a token is not learned from copies of one text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least = []
            for _, _, d, o in text_blocks(batch.column(1)):
                h, _, count = _WORDS.split(d, o)
                least += [int(grams(h[i:j], min(5, j - i)).min()) if j > i else 0 for i, j in _by_row(h, count)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(signed(np.array(least, np.uint64)))], names=["k", "sketch"])

    kind = rows.schema["k"].dataType.simpleString()
    sketches = rows.select("k", "t").mapInArrow(run, f"k {kind}, sketch long").join(rows.select("k", "y"), "k")
    return rows.join(sketches.groupBy("y", "sketch").agg(F.min("k").alias("k")).select("k"), "k", "left_semi")


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", per_label: int = 4000, prior: float = 2000.0, least_z: float = 4.0, least_texts: int = 4, least_odds: float = 1.5) -> ToxicModel | None:
    """Fits on at most about per_label texts of each label, of which copies (by label and smallest hash of five words) count once; only tokens in at least least_texts toxic ones, and with log-odds of
    least_odds, can score above 0."""
    known = labels.where(F.col(label).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.max(label).cast("int").alias("y"))
    picked = labelled_sample(known, "k", "y", per_label)
    rows = staged(docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")).join(F.broadcast(picked), "k"), "labelled")
    counts = staged(_token_counts(_without_copies(rows)), "tokens")
    total = counts.agg(F.sum("w1"), F.sum("w0")).first()
    t1, t0 = float(total[0] or 0), float(total[1] or 0)
    if not t1 or not t0:
        return None
    rate = (F.col("n1") + F.col("n0")) / F.lit(t1 + t0)
    a = F.lit(prior) * rate
    odds = lambda n, t: F.log((F.col(n) + a) / (F.lit(t + prior) - F.col(n) - a))
    z = (odds("n1", t1) - odds("n0", t0)) / F.sqrt(1 / (F.col("n1") + a) + 1 / (F.col("n0") + a))
    kept = counts.withColumn("odds", odds("n1", t1) - odds("n0", t0)).where((z >= least_z) & (F.col("d1") >= least_texts) & (F.col("odds") >= least_odds)).select("token", "odds", "n0").toPandas()
    h = kept["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(h)
    h, values, n0 = h[order], kept["odds"].to_numpy(float)[order], kept["n0"].to_numpy(float)[order]
    cost = -0.5
    # the rates of words by score: those of tokens, scaled down where words and their beginnings are both known
    share = n0.sum() / t0
    rates = np.append(n0 / t0 * min(1.0, 0.5 / max(share, 1e-9)), 1 - min(share, 0.5))
    scale, k = karlin_altschul(np.append(values, cost), rates)
    model = ToxicModel(h, values, cost, scale, k, np.zeros(4))
    model.link = _fit_link(rows, model)
    return model


def _feature_rows(batches: Iterator[pa.RecordBatch], m: ToxicModel) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for _, _, d, o in text_blocks(batch.column(0)):
            h, _, count, _, _, starts = _WORDS.parts(d, o, PREFIXES)
            s = m.token_scores(h, starts)
            out += [m.features(s[i:j]) for i, j in _by_row(h, count)]
        x = np.array(out, float).reshape(-1, 4)
        yield pa.RecordBatch.from_arrays([*(pa.array(x[:, i]) for i in (1, 2, 3)), batch.column(1)], names=["best", "alone", "many", "y"])


def _fit_link(rows: DataFrame, model: ToxicModel) -> np.ndarray:
    """Logistic regression by Newton steps on the distinct feature rows of the sample."""
    names = ("best", "alone", "many")
    pdf = rows.select("t", "y").mapInArrow(lambda b: _feature_rows(b, model), "best double, alone double, many double, y int").groupBy(*[F.round(c, 3).alias(c) for c in names], "y").count().toPandas()
    x = np.column_stack([np.ones(len(pdf)), *(pdf[c] for c in names)])
    y, n = pdf["y"].to_numpy(float), pdf["count"].to_numpy(float)
    n = n / n.sum()
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (n * (p - y)) + 1e-4 * w
        hess = (x * (n * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(x.shape[1])
        w = w - np.linalg.solve(hess, g)
    return w


def predict(docs: DataFrame, model: ToxicModel | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score (how likely label 1 is) and passages: the significant ones, as characters of the text from 0, with their scores."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            scores, spans = [], []
            for _, _, d, o in text_blocks(batch.column(1)):
                if m is None:
                    scores += [0.0] * (len(o) - 1)
                    spans += [[]] * (len(o) - 1)
                    continue
                h, _, count, first, last, starts = _WORDS.parts(d, o, PREFIXES)
                s = m.token_scores(h, starts)
                for r, (i, j) in enumerate(_by_row(h, count)):
                    f = m.features(s[i:j])
                    scores.append(1 / (1 + np.exp(-float(np.clip(np.dot(f, m.link), -30, 30)))))
                    if f[1] == 0:
                        spans.append([])
                        continue
                    chars = np.cumsum((d[o[r] : o[r + 1]] & 0xC0) != 0x80)  # characters up to each byte
                    spans.append([{"start": int(chars[first[i + a] - o[r]]) - 1, "end": int(chars[last[i + b - 1] - o[r] - 1]), "score": v} for a, b, v in m.passages(s[i:j]) if v > 0])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(spans, kind)], names=["key", "score", "passages"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, score double, passages array<struct<start:bigint,end:bigint,score:double>>").withColumnRenamed("key", key)
