"""Exact percentiles of many columns of numbers at once, without shuffling their values.

Tasks sort what they read in chunks and send a thousand evenly placed values of each. From these, every wanted place gets two values that
it surely lies between; a second pass counts what is below and sends only what is between, about one value in five hundred a place.
A place whose two values are equal needs no second pass.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

#: Values of a group that a task sorts at a time, and how many of them it sends.
CHUNK, POINTS = 1 << 16, 1024
#: Groups and their values in a batch.
Values = Callable[[pa.RecordBatch], Iterator[tuple[int, np.ndarray]]]


def summary(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Evenly placed values of the sorted ones, and their places."""
    v = np.sort(values)
    at = np.unique(np.linspace(0, len(v) - 1, min(POINTS, len(v))).astype(np.int64))
    return v[at], at


def brackets(chunks: Sequence[tuple[int, np.ndarray, np.ndarray]], places: Sequence[float]) -> list[tuple[float, float]]:
    """For each place, two values between which those at its floor and ceiling lie. chunks: (rows, values, places) as summary() gives them."""
    at = np.concatenate([v for _, v, _ in chunks])
    over = np.concatenate([np.diff(np.append(p, n)) for n, _, p in chunks])  # by how many rows at most more are below what exceeds the value
    under = np.concatenate([np.diff(p, prepend=-1) for _, _, p in chunks])  # by how many rows at least more are up to the value
    order = np.argsort(at, kind="stable")
    at, over, under = at[order], np.cumsum(over[order]), np.cumsum(under[order])
    first, last = np.searchsorted(at, at, "left"), np.searchsorted(at, at, "right") - 1
    below, upto = np.where(first > 0, over[np.maximum(first - 1, 0)], 0), under[last]  # neither falls
    low = at[np.searchsorted(below, [math.floor(x) for x in places], "right") - 1]
    high = at[np.searchsorted(upto, [math.ceil(x) + 1 for x in places], "left")]
    return list(zip(low.tolist(), high.tolist(), strict=True))


def between_places(low: float, high: float, place: float) -> float:
    part = place - math.floor(place)
    return low * (1 - part) + high * part if part > 0 else low


def _packed(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


def exact_percentiles(rows: DataFrame, values: Values, shares: Sequence[float]) -> dict[int, list[float]]:
    """By group, the interpolated percentiles. rows are read twice, so they should be a written table; values: the groups of a batch
    and their numbers, none of them missing. Groups are few: one row each and share reaches the driver."""

    def points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, list[np.ndarray]] = {}
        size: dict[int, int] = {}

        def out(groups: Sequence[int]) -> pa.RecordBatch:
            done = []
            for g in groups:
                v, p = summary(np.concatenate(kept.pop(g)))
                done.append((g, size.pop(g), _packed(v), _packed(p)))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["g", "n", "v", "p"])

        for batch in batches:
            for g, v in values(batch):
                if len(v):
                    kept.setdefault(g, []).append(v + 0.0)
                    size[g] = size.get(g, 0) + len(v)
            if full := [g for g, n in size.items() if n >= CHUNK]:
                yield out(full)
        if size:
            yield out(list(size))

    def found(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        chunks = [(int(n), np.frombuffer(v), np.frombuffer(p, np.int64)) for n, v, p in zip(pdf["n"], pdf["v"], pdf["p"], strict=True)]
        total = sum(n for n, _, _ in chunks)
        places = [s * (total - 1) for s in shares]
        ends = brackets(chunks, places)
        return pd.DataFrame({"g": np.int32(key[0]), "s": np.arange(len(shares), dtype=np.int32), "total": total, "low": [a for a, _ in ends], "high": [b for _, b in ends]})

    wanted = rows.mapInArrow(points, "g int, n long, v binary, p binary").groupBy("g").applyInPandas(found, "g int, s int, total long, low double, high double").collect()  # one row a group and share
    result: dict[int, list[float]] = {}
    todo: dict[int, list[tuple[int, float, float]]] = {}
    total: dict[int, int] = {}
    for r in wanted:
        result.setdefault(r["g"], [math.nan] * len(shares))[r["s"]] = between_places(r["low"], r["low"], shares[r["s"]] * (r["total"] - 1))
        total[r["g"]] = r["total"]
        if r["low"] < r["high"]:
            todo.setdefault(r["g"], []).append((r["s"], r["low"], r["high"]))
    if not todo:
        return result

    def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        below: dict[tuple[int, int], int] = {}
        kept: dict[tuple[int, int], list[np.ndarray]] = {}

        def out() -> pa.RecordBatch:
            done = []
            for k, n in below.items():
                v, c = np.unique(np.concatenate(kept[k]), return_counts=True)
                done.append((*k, n, _packed(v), _packed(c)))
            below.clear()
            kept.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["g", "s", "b", "v", "c"])

        held = 0
        for batch in batches:
            for g, raw in values(batch):
                if g not in todo or not len(raw):
                    continue
                v = np.sort(raw + 0.0)
                for s, low, high in todo[g]:
                    a, b = np.searchsorted(v, low, "left"), np.searchsorted(v, high, "right")
                    below[g, s] = below.get((g, s), 0) + int(a)
                    kept.setdefault((g, s), []).append(v[a:b].copy())
                    held += int(b - a)
            if held >= 1 << 20:
                yield out()
                held = 0
        if below:
            yield out()

    def select(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for s, part in pdf.groupby("s"):
            v, c = np.concatenate([np.frombuffer(x) for x in part["v"]]), np.concatenate([np.frombuffer(x, np.int64) for x in part["c"]])
            order = np.argsort(v, kind="stable")
            v, ends = v[order], np.cumsum(c[order]) + int(part["b"].sum())
            place = shares[s] * (total[key[0]] - 1)
            low, high = (float(v[np.searchsorted(ends, x, "right")]) for x in (math.floor(place), math.ceil(place)))
            out.append((key[0], s, between_places(low, high, place)))
        return pd.DataFrame(out, columns=["g", "s", "q"])

    for r in rows.mapInArrow(between, "g int, s int, b long, v binary, c binary").groupBy("g").applyInPandas(select, "g int, s int, q double").collect():  # one row a group and share
        result[r["g"]][r["s"]] = r["q"]
    return result
