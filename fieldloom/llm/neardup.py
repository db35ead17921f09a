"""Exact near-duplicates of vectors: a metric range join over cells of pivots.

Two vectors link when their cosine, in double precision, is at least `cosine`. Of unit length, they lie then within
r = sqrt(2 - 2 cosine) of each other. Equal vectors are one point with a weight. Pivots are points of a bounded sample, none within
2 r of another; each point's home is the cell of its nearest pivot. A point y can link with a point of cell j only if

* d(y, p_j) <= R_j + r, R_j being the largest distance of p_j to a point at home there (the triangle inequality), and
* y lies no further than r behind the plane between its own pivot and p_j (the same inequality along the line of both pivots),

so it is sent there as a guest. Each cell finds on its own all links of its home points, with one another and with guests: a home
point's neighbours are all there, so its number of links is complete within the cell, and each cell gives as many edges as it has
points at most (what joins them), never all its pairs. A cell's points at home are cut into chunks and its guests into parts; a task
holds one chunk and reads one part, block by block.

Groups of points that would fill cells (near copies of one vector by the million) are balls: all points within r / 2 of a centre
link with each other by the triangle inequality, so they are counted and joined by one edge each and never compared. Points of
a ball are compared with the points outside of it alone. Centres are taken where the sample says that more than a chunk lies
within r / 2.

Pivots prune what is clustered. Points that are spread evenly over many dimensions are nearer to a plane between pivots than r almost
everywhere; there nearly every cell gets every point, and the join compares all pairs, in bounded tasks.

Edge cases: vectors that are null, zero, empty or hold null or non-finite components link with nothing; shorter vectors end in zeros; rows
that repeat an id or a vector are vectors of their own and count as links of each other; rows without an id link like any others,
but give no component its id; where a whole component has none, component_id is null and all its rows are kept; an empty table gives no
rows; columns of other names are ignored. Pairs within 1e-9 of the threshold are decided by exactly rounded sums, the same whichever
task sees them.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import fsum, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import join_by_key, staged
from fieldloom.llm.components import connected
from fieldloom.llm.topk import usable

#: Points at home in one task, and guests that it reads.
HOME_ROWS = 8192
GUEST_ROWS = 32768
#: Points compared at once with those at home: 4 million products, 32 MB.
BLOCK_PAIRS = 1 << 22
#: Bytes of the sample that pivots and centres are taken from, and of them at most so many.
SAMPLE_BYTES = 16 << 20
SAMPLE_ROWS = 8192
PIVOTS = 1024
#: Slack of bounds, far above the rounding of a distance.
SLACK = 1e-7
NEAR = 1e-9


# ---- distances ----


def unit(v: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first, so that no square leaves the range of doubles."""
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def _exactly(a: np.ndarray, b: np.ndarray) -> float:
    a, b = a / np.abs(a).max(), b / np.abs(b).max()
    return fsum((a * b).tolist()) / (sqrt(fsum((a * a).tolist())) * sqrt(fsum((b * b).tolist())))


def links(home: np.ndarray, guests: np.ndarray, raw_home: np.ndarray, raw_guests: np.ndarray, cosine: float) -> np.ndarray:
    """Which guests (rows) link with which points at home (columns)."""
    c = guests @ home.T
    out = c >= cosine - NEAR
    if out.any():
        i, j = np.nonzero(out)
        close = c[i, j] < cosine + NEAR
        for a, b in zip(i[close].tolist(), j[close].tolist(), strict=True):
            out[a, b] = _exactly(raw_home[b], raw_guests[a]) >= cosine
    return out


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2.0 - 2.0 * (x @ y.T), 0.0))


def choose_pivots(sample: np.ndarray, most: int, apart: float) -> np.ndarray:
    """Points of the sample in its order, none within `apart` of one taken before."""
    taken: list[int] = []
    free = np.ones(len(sample), bool)
    for i in range(len(sample)):
        if len(taken) >= most:
            break
        if free[i]:
            taken.append(i)
            free &= distances(sample, sample[i : i + 1])[:, 0] > apart
    return sample[taken] if taken else sample[:1]


def choose_centres(sample: np.ndarray, share: float, radius: float, most: int) -> np.ndarray:
    """Centres of at most so many balls of this radius that hold more than `share` of the sample, the fullest ones first."""
    near = np.concatenate([distances(sample[a : a + 512], sample) <= radius for a in range(0, len(sample), 512)])
    free, size, taken = np.ones(len(sample), bool), near.sum(1), []
    while len(taken) < most:
        i = int(size.argmax())
        if size[i] < max(2, share * len(sample)):
            break
        taken.append(i)
        now = near[i] & free
        size = size - near[:, now].sum(1)
        free &= ~now
    return sample[taken]


def unite(up: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins a[i] with b[i] for all i in the forest `up`, whose trees are flat before and after, with their smallest member on top."""
    while True:
        x, y = up[a], up[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up, top := up[up]):
            up[:] = top


# ---- steps ----


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of a list column as doubles, zeros at the end of shorter ones."""
    n, size = column.value_lengths().to_numpy(zero_copy_only=False), column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(n) and (n == dims).all():
        return size.reshape(len(n), dims)
    out = np.zeros((len(n), dims))
    out[np.repeat(np.arange(len(n)), n), np.arange(len(size)) - np.repeat(np.cumsum(n) - n, n)] = size
    return out


def _deal(points: DataFrame, dims: int, pivots: np.ndarray, centres: np.ndarray, r: float) -> DataFrame:
    """rid, weight, v, and the cell at home: a pivot's number, or after those a centre's; d: the distance from it."""
    rows = max(1, min(1024, BLOCK_PAIRS // max(1, len(pivots) + len(centres))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, rows):
                part = batch.slice(a, rows)
                x = unit(_matrix(part.column(2), dims))
                d = distances(x, pivots)
                cell = d.argmin(1)
                own = d[np.arange(len(x)), cell]
                if len(centres):
                    near = distances(x, centres)
                    inside = near <= r / 2 - SLACK
                    ball = inside.argmax(1)
                    held = inside.any(1)
                    cell, own = np.where(held, len(pivots) + ball, cell), np.where(held, near[np.arange(len(x)), ball], own)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(cell.astype(np.int32)), pa.array(own)], names=["rid", "weight", "v", "cell", "d"])

    return points.select("rid", "weight", "v").mapInArrow(run, f"rid long, weight long, v {points.schema['v'].dataType.simpleString()}, cell int, d double")


def _guests(homes: DataFrame, dims: int, pivots: np.ndarray, centres: np.ndarray, reach: np.ndarray, r: float) -> DataFrame:
    """rid, weight, v and the cells (to) that a point is sent to besides its own. reach: the largest distance at home, by cell; below 0 if none."""
    k = len(pivots)
    apart = np.maximum(distances(pivots, pivots), SLACK)
    rows = max(1, min(1024, BLOCK_PAIRS // max(1, k + len(centres))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, rows):
                part = batch.slice(a, rows)
                x, cell = unit(_matrix(part.column(2), dims)), part.column(3).to_numpy()
                d = distances(x, pivots)
                nearest = d.argmin(1)
                behind = (d * d - d.min(1)[:, None] ** 2) / (2 * apart[nearest])
                there = (reach[:k] >= 0) & (d <= reach[:k] + r + SLACK) & (behind <= r + SLACK)
                if len(centres):
                    there = np.concatenate([there, (reach[k:] >= 0) & (distances(x, centres) <= reach[k:] + r + SLACK)], axis=1)
                there[np.arange(len(x)), cell] = False
                i, to = np.nonzero(there)
                n = np.bincount(i, minlength=len(x))
                cells = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(to.astype(np.int32)))
                keep = pa.array(n > 0)
                yield pa.RecordBatch.from_arrays([c.filter(keep) for c in (part.column(0), part.column(1), part.column(2), cells)], names=["rid", "weight", "v", "to"])

    return homes.mapInArrow(run, f"rid long, weight long, v {homes.schema['v'].dataType.simpleString()}, to array<int>")


_FOUND = "a long, b long, n long"


def _join(dealt: DataFrame, dims: int, cosine: float) -> DataFrame:
    """dealt: unit, side (0: at home), rid, weight, v, sorted by unit and side. Rows (a, null, n): so many links of a point at home; (a, b, null): an edge."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {"unit": None}

        def begin(at: tuple) -> None:
            state.clear()
            state.update(unit=at, raw=[], rid=[], home=None)

        def settle() -> None:
            """The points at home are all there."""
            raw, rid = np.concatenate(state["raw"]), np.concatenate(state["rid"])
            state.update(home=unit(raw), raw=raw, rid=rid, n=np.zeros(len(rid), np.int64), up=np.arange(len(rid)))

        def edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int64())], names=["a", "b", "n"])

        def compare(rid: np.ndarray, weight: np.ndarray, raw: np.ndarray) -> Iterator[pa.RecordBatch]:
            if state["home"] is None:
                settle()
            step = max(1, BLOCK_PAIRS // len(state["rid"]))
            for i in range(0, len(rid), step):
                w, ids = weight[i : i + step], rid[i : i + step]
                hit = links(state["home"], unit(raw[i : i + step]), state["raw"], raw[i : i + step], cosine)
                if not hit.any():
                    continue
                hit &= ids[:, None] != state["rid"][None, :]  # a point at home is compared with all others there
                some = np.flatnonzero(hit.any(1))
                state["n"] += w[some] @ hit[some]
                first = hit[some].argmax(1)
                guest, own = np.nonzero(hit[some])
                unite(state["up"], first[guest], own)
                yield edges(state["rid"][first], ids[some])

        def end() -> Iterator[pa.RecordBatch]:
            if state["unit"] is None or state["home"] is None:
                return
            low = np.flatnonzero(state["up"] != np.arange(len(state["rid"])))
            if len(low):
                yield edges(state["rid"][low], state["rid"][state["up"][low]])
            some = np.flatnonzero(state["n"])
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array(state["rid"][some]), pa.nulls(len(some), pa.int64()), pa.array(state["n"][some])], names=["a", "b", "n"])

        for batch in batches:
            where = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in range(4)])  # cell, chunk, part, side
            cuts = np.concatenate([[0], np.flatnonzero((where[:, 1:] != where[:, :-1]).any(0)) + 1, [batch.num_rows]])
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if i == j:
                    continue
                part = batch.slice(i, j - i)
                *at, side = where[:, i].tolist()
                if state["unit"] != tuple(at):
                    yield from end()
                    begin(tuple(at))
                rid, weight, raw = part.column(4).to_numpy(), part.column(5).to_numpy(), _matrix(part.column(6), dims)
                if side == 0:
                    state["raw"].append(raw)
                    state["rid"].append(rid)
                elif len(state["raw"]):
                    yield from compare(rid, weight, raw)
        yield from end()

    return dealt.mapInArrow(run, _FOUND)


def _points(vectors: DataFrame, key: str, vector: str) -> tuple[DataFrame, DataFrame]:
    """All rows (id, hash) and the distinct vectors (rid, hash, v, weight, least id). Hash: 128 bits of the usable vector, else null."""
    v = F.col(vector)
    good = usable(vectors, vector) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))
    kind = "float" if vectors.schema[vector].dataType.simpleString() == "array<float>" else "double"
    plain = F.transform(v, lambda x: x.cast(kind) + F.lit(0).cast(kind))  # -0 becomes 0
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.when(good, plain).alias("v"))
    rows = rows.withColumn("hash", F.when(F.col("v").isNotNull(), F.struct(F.xxhash64("v").alias("x"), F.xxhash64(F.lit(71), "v").alias("y"))))
    distinct = rows.where("hash is not null").groupBy("hash").agg(F.first("v").alias("v"), F.count(F.lit(1)).alias("weight"), F.min("id").alias("least"))
    points = staged(distinct.select(F.monotonically_increasing_id().alias("rid"), "hash", "v", "weight", "least"), "points")  # numbers are fixed once written
    return staged(rows.select("id", "hash"), "rows"), points


def near_duplicates(vectors: DataFrame, cosine: float = 0.95, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key, n_links, component_id (the smallest id that links reach) and kept, for each row."""
    spark = vectors.sparkSession
    rows, points = _points(vectors, key, vector)
    facts = points.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dims")).first()
    n, dims = facts["n"], max(1, facts["dims"] or 1)
    r = sqrt(2 - 2 * cosine)
    if n:
        most = max(2, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * dims)))
        order = F.xxhash64(F.lit(5), "hash")  # the same points each time
        drawn = points.where(F.pmod(order, F.lit(1 << 40)) < F.lit(min(1.0, 2.0 * most / n) * (1 << 40))).orderBy(order).limit(most)
        sample = unit(_matrix(drawn.select("v").toArrow()["v"].combine_chunks(), dims)) if n else np.zeros((0, dims))
        if not len(sample):
            sample = unit(_matrix(points.limit(most).select("v").toArrow()["v"].combine_chunks(), dims))
        centres = choose_centres(sample, HOME_ROWS / n, r / 2 - SLACK, PIVOTS) if n > HOME_ROWS else sample[:0]
        outside = sample[(distances(sample, centres) > r / 2).all(1)] if len(centres) else sample
        pivots = choose_pivots(outside if len(outside) else sample, min(PIVOTS, -(-n // HOME_ROWS)), 2 * r)
        k = len(pivots)
        homes = staged(_deal(points, dims, pivots, centres, r), "homes")
        cells = {c["cell"]: c for c in homes.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight"), F.max("d").alias("d"), F.min("rid").alias("first")).collect()}  # one row a pivot or centre
        reach = np.array([cells[c]["d"] if c in cells else -1.0 for c in range(k + len(centres))])
        sent = staged(_guests(homes, dims, pivots, centres, reach, r), "guests").select("rid", "weight", "v", F.explode("to").alias("cell"))
        size = {c: x["n"] for c, x in cells.items()}
        guests = {x["cell"]: x["count"] for x in sent.groupBy("cell").count().collect()}
        of = lambda numbers: F.get(F.array(*[F.lit(numbers.get(c, 1)) for c in range(k + len(centres))]), F.col("cell"))
        chunks = {c: -(-m // HOME_ROWS) for c, m in size.items()}
        # a cell of a pivot reads its own points as guests as well, a ball only those from outside
        parts = {c: max(1, -(-(guests.get(c, 0) + (m if c < k else 0)) // GUEST_ROWS)) for c, m in size.items()}
        chunk, part = F.pmod(F.xxhash64(F.lit(7), "rid"), of(chunks)).cast("int"), F.pmod(F.xxhash64(F.lit(11), "rid"), of(parts)).cast("int")
        every = lambda numbers: F.explode(F.sequence(F.lit(0), of(numbers).cast("int") - 1))
        read = sent.unionByName(homes.where(F.col("cell") < k).select("rid", "weight", "v", "cell"))
        dealt = homes.select("cell", chunk.alias("chunk"), every(parts).alias("part"), F.lit(0).alias("side"), "rid", "weight", "v").unionByName(
            read.withColumn("part", part).select("cell", every(chunks).alias("chunk"), "part", F.lit(1).alias("side"), "rid", "weight", "v")
        )
        units = sum(chunks[c] * parts[c] for c in size)
        dealt = dealt.repartition(max(1, 2 * units), "cell", "chunk", "part").sortWithinPartitions("cell", "chunk", "part", "side")
        found = staged(_join(dealt, dims, cosine), "found")
        balls = [(c, x["weight"], x["first"]) for c, x in cells.items() if c >= k]
        inside = homes.join(F.broadcast(spark.createDataFrame(balls, "cell int, all long, first long")), "cell") if balls else None  # one row a ball
        counts = found.where("n is not null").select("a", "n")
        edges = found.where("n is null").select("a", "b")
        if inside is not None:
            counts = counts.unionByName(inside.select(F.col("rid").alias("a"), (F.col("all") - F.col("weight")).alias("n")))
            edges = edges.unionByName(inside.where("rid <> first").select(F.col("rid").alias("a"), F.col("first").alias("b")))
        counts = counts.groupBy(F.col("a").alias("rid")).agg(F.sum("n").alias("n"))
        roots = connected(edges).toDF("rid", "root")
        known = points.select("rid", "hash", "weight", "least").join(counts, "rid", "left").join(roots, "rid", "left").withColumn("root", F.coalesce("root", "rid"))
        known = staged(known, "known")
        component = known.groupBy("root").agg(F.min("least").alias("component_id"))
        table = known.join(component, "root").select("hash", "weight", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    else:
        table = points.select("hash", "weight", F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component_id"))
    linked = join_by_key(rows.where("hash is not null"), table, "hash", "weight", max(1, n)).select(F.col("id").alias(key), "n_links", "component_id")
    alone = rows.where("hash is null").select(F.col("id").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))

