"""Language identification with a blended-spectrum string kernel.

Two texts are as similar as the share of byte n-grams (n = 1, 2, 3) that both hold, counted as present or absent and
normalised for each n by the numbers of distinct n-grams. Landmark texts span the feature space (Nystroem), one-versus-rest
kernel ridge regression is solved on it, and texts are scored by products of batches with the solved matrix.

Edge cases: a null text, an empty one or one without a letter is `und` with score 0. Rows with equal texts get equal results, also
of repeated and null ids. Texts may be of any length: a text's n-grams are marked in a table of fixed size. An empty table, or one without labelled rows, yields `und` for all rows. Columns of other names are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.llm.common import U64, labelled_sample, staged, text_blocks

UND = "und"
TRIGRAM_BITS = 16
_STARTS = (0, 256, 256 + 65536)
_SPACE = 256 + 65536 + (1 << TRIGRAM_BITS)


def _byte_classes() -> np.ndarray:
    """Letters in lower case and non-ASCII bytes stay; all else is a space."""
    lut = np.full(256, 32, np.uint8)
    lut[97:123] = np.arange(97, 123)
    lut[65:91] = np.arange(97, 123)
    lut[128:] = np.arange(128, 256)
    return lut


_LUT = _byte_classes()


def has_letter(data: np.ndarray) -> bool:
    """A letter of any alphabet; only texts without ASCII letters are decoded."""
    if ((data | 32) - 97 < 26).any():
        return True
    if not (data >= 128).any():
        return False
    return any(c.isalpha() for c in data.tobytes().decode("utf-8", "ignore"))


def spectrum(data: np.ndarray, seen: np.ndarray) -> tuple[int, int, int]:
    """Marks the n-grams of a text in `seen`, which must be all False; returns the numbers of distinct ones by n."""
    x = _LUT[data]
    if len(x) > 1:  # runs of spaces count as one
        keep = np.ones(len(x), bool)
        keep[1:] = (x[1:] != 32) | (x[:-1] != 32)
        x = x[keep]
    seen[x] = True
    if len(x) > 1:
        two = (x[:-1].astype(np.uint32) << 8) | x[1:]
        seen[_STARTS[1] + two] = True
        if len(x) > 2:
            three = ((two[:-1] << 8) | x[2:]) * np.uint32(2654435761)
            seen[_STARTS[2] + (three >> np.uint32(32 - TRIGRAM_BITS))] = True
    return int(np.count_nonzero(seen[:256])), int(np.count_nonzero(seen[256 : _STARTS[2]])), int(np.count_nonzero(seen[_STARTS[2] :]))


def kernel_rows(data: np.ndarray, offsets: np.ndarray, columns: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A row for each text: presence of the given n-grams over the root of the number of the text's own, by n."""
    out = np.zeros((len(offsets) - 1, len(columns)), np.float32)
    seen = np.zeros(_SPACE, bool)
    for r in range(len(offsets) - 1):
        sizes = spectrum(data[offsets[r] : offsets[r + 1]], seen)
        row = out[r]
        row[:] = seen[columns]
        for k, size in enumerate(sizes):
            if size:
                row[bounds[k] : bounds[k + 1]] *= 1 / np.sqrt(3.0 * size)
        seen[:] = False
    return out


@dataclass
class LanguageModel:
    languages: list[str]
    columns: np.ndarray
    bounds: np.ndarray
    weights: np.ndarray  # n-grams of the landmarks x languages: landmark matrix times the solved ridge coefficients

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return kernel_rows(data, offsets, self.columns, self.bounds) @ self.weights


def _spectra(texts: DataFrame) -> DataFrame:
    """row, lang and the places of a text's n-grams, and their numbers by n. texts: row, lang, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(_SPACE, bool)
        for batch in batches:
            found, sizes = [], []
            for _, _, d, o in text_blocks(batch.column(2)):
                for r in range(len(o) - 1):
                    sizes.append(list(spectrum(d[o[r] : o[r + 1]], seen)))
                    found.append(np.flatnonzero(seen).astype(np.int32).tobytes())
                    seen[:] = False
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary()), pa.array(sizes, pa.list_(pa.int32()))], names=["row", "lang", "places", "sizes"])

    return texts.mapInArrow(run, "row long, lang string, places binary, sizes array<int>")


def _compared(texts: DataFrame, columns: np.ndarray, bounds: np.ndarray, z: np.ndarray) -> DataFrame:
    """row, lang and the kernel of each whole text with each landmark."""
    shared = texts.sparkSession.sparkContext.broadcast((columns, bounds, z))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns, bounds, z = shared.value
        for batch in batches:
            rows = [kernel_rows(d[o[a] : o[min(a + 32, len(o) - 1)]], o[a : a + 33] - o[a], columns, bounds) @ z.T for _, _, d, o in text_blocks(batch.column(2)) for a in range(0, len(o) - 1, 32)]
            k = np.concatenate(rows) if rows else np.zeros((0, len(z)), np.float32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.astype(np.float64).tobytes() for r in k], pa.binary())], names=["row", "lang", "kernel"])

    return texts.mapInArrow(run, "row long, lang string, kernel binary")


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = 400, landmarks: int = 240, ridge: float = 1e-3) -> LanguageModel | None:
    """Fits on at most about per_language labelled whole texts of each language, of which at most `landmarks` in all, drawn by a hash,
    are landmarks. Texts are read in tasks; the driver gets the landmarks' n-grams and each text's kernel with the landmarks."""
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    sample = staged(labelled_sample(rows, "k", "lang", per_language).select(F.monotonically_increasing_id().alias("row"), "lang", "text", F.xxhash64("k", F.lit(31)).alias("draw")), "sample")
    languages = sorted(r["lang"] for r in sample.select("lang").distinct().collect())  # one row a language
    if not languages:
        return None
    each = max(1, landmarks // len(languages))
    first = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "row"))  # about per_language rows
    chosen = _spectra(sample.withColumn("_n", first).where(F.col("_n") <= each).select("row", "lang", "text")).collect()
    chosen = sorted(chosen, key=lambda r: (r["lang"], r["row"]))
    places = [np.frombuffer(r["places"], np.int32) for r in chosen]
    columns = np.unique(np.concatenate(places))
    bounds = np.searchsorted(columns, [0, *_STARTS[1:], _SPACE])
    z = np.zeros((len(chosen), len(columns)), np.float32)
    for row, at, r in zip(z, places, chosen, strict=True):
        row[np.searchsorted(columns, at)] = 1
        for k, size in enumerate(r["sizes"]):
            if size:
                row[bounds[k] : bounds[k + 1]] *= 1 / np.sqrt(3.0 * size)
    compared = sorted(_compared(sample.select("row", "lang", "text"), columns, bounds, z).collect(), key=lambda r: r["row"])
    labels = np.array([r["lang"] for r in compared], dtype=object)
    k_mm, k_nm = (z @ z.T).astype(np.float64), np.stack([np.frombuffer(r["kernel"]) for r in compared])
    values, vectors = np.linalg.eigh(k_mm)
    good = values > 1e-6 * max(values.max(), 1e-12)
    root = vectors[:, good] / np.sqrt(values[good])
    phi = k_nm @ root
    y = np.where(labels[:, None] == np.array(languages, dtype=object)[None, :], 1.0, -1.0)
    balance = np.array([1.0 / (labels == v).sum() for v in languages])
    w = np.sqrt(np.array([balance[languages.index(v)] for v in labels]) * len(labels) / len(languages))[:, None]
    a = (phi * w).T @ (phi * w) + ridge * len(labels) * np.eye(phi.shape[1])
    beta = root @ np.linalg.solve(a, (phi * w).T @ (y * w))
    return LanguageModel(languages, columns, bounds, (z.T.astype(np.float64) @ beta).astype(np.float32))


def _judge(column: pa.Array, model: LanguageModel | None) -> tuple[np.ndarray, np.ndarray]:
    """(language or UND, score) of each text."""
    names, scores = [np.zeros(0, object)], [np.zeros(0)]
    for _, _, data, offsets in text_blocks(column):
        lettered = np.array([has_letter(data[offsets[r] : offsets[r + 1]]) for r in range(len(offsets) - 1)], bool)
        if model is None:
            names.append(np.full(len(lettered), UND, object))
            scores.append(np.zeros(len(lettered)))
            continue
        margins = np.concatenate([model.score(data[offsets[a] : offsets[min(a + 64, len(lettered))]], offsets[a : a + 65] - offsets[a]) for a in range(0, len(lettered), 64)])
        p = np.exp(4 * (margins - margins.max(1, keepdims=True)))
        names.append(np.where(lettered, np.array(model.languages, object)[margins.argmax(1)], UND))
        scores.append(np.where(lettered, p.max(1) / p.sum(1), 0.0))
    return np.concatenate(names), np.concatenate(scores)


def predict(docs: DataFrame, model: LanguageModel | None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, lang_pred and score (0 to 1) for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = _judge(batch.column(1), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores)], names=["key", "lang_pred", "score"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, lang_pred string, score double").withColumnRenamed("key", key)
