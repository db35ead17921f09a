"""How filters of documents interact: survivors of every order of them, and each filter's Shapley share of what all remove.

Each document becomes a mask of the filters that it fails; a part (here a language) is then its counts by mask, however many
documents it has. The game of a part gives to a set of filters the documents that they remove together. Its multilinear
extension is a polynomial in one variable a filter, the chance that the filter is on:

    removed(x) = sum over sets T of filters of c(T) * product of x_i, i in T,   c(T) = (-1)^(|T|+1) * (documents that fail all of T)

Its values at the corners (each x_i 0 or 1) are what stays and what goes after each step of each order. Filter i's Shapley value
is the integral, along the diagonal from 0 to 1, of the partial derivative by x_i: exact rationals, which are whole numbers once
multiplied by the number of orders.

Edge cases: null texts are empty, with no words; null parts are the empty string; a text is a copy if an equal one, in any part,
has a smaller id, so rows that repeat an id are no copies of each other and rows without an id neither are nor make copies; a
document of several labels counts as good, or toxic, if one of them says so; rows are counted as often as they occur; texts may be
of any length; an empty table has no parts and gives no rows; columns of other names are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import permutations
from math import factorial

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FILTERS = "ABCDE"
#: The filter that needs other rows: it is the last bit of a mask.
COPY = 4


def own_mask(text: F.Column) -> F.Column:
    """Bits of the filters that look at the text alone: few words, repeated words, capitals, marks."""
    t = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(t, F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0))
    n = F.size(words)
    capitals = F.length(F.regexp_replace(t, "[^A-Z]+", ""))
    fails = [n < 100, F.size(F.array_distinct(words)) * F.lit(100).cast("long") < n * F.lit(80).cast("long"), capitals * F.lit(100).cast("long") > F.length(t) * F.lit(10).cast("long"), t.rlike("[#$%&*|]")]
    return sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(fails)), F.lit(0))


def mask_counts(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """part, mask, and the counts n, good and toxic of documents that fail just the filters of the mask.

    Only digests travel. Rows are summed before each exchange, so neither many copies of a text nor a repeated id fill a task;
    rows without an id, which have no labels, are spread over salts.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(t.cast("binary"), 256)).alias("digest"), own_mask(F.col(text)).alias("mask"))
    rows = rows.groupBy("id", "part", "digest", "mask").agg(F.count(F.lit(1)).alias("n")).withColumn("salt", F.when(F.col("id").isNull(), F.pmod(F.hash("digest"), F.lit(1 << 16))).otherwise(0))
    one = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0))
    known = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("id")).agg(one("quality").alias("good"), one("toxic").alias("toxic")).withColumn("salt", F.lit(0))
    rows = rows.join(known, ["id", "salt"], "left").fillna(0, ["good", "toxic"])
    # copies: of equal texts all rows but those of the smallest id; texts are equal, so their masks are
    texts = rows.groupBy("digest", "part", "mask", "good", "toxic").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("nameless"), F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("first"))
    least = F.min(F.col("first.id")).over(Window.partitionBy("digest"))  # one row for each part and label of a text
    kept = F.col("nameless") + F.when(F.col("first.id") == F.col("least"), F.col("first.n")).otherwise(0)
    texts = texts.withColumn("least", least).withColumn("kept", kept)
    split = texts.select("part", "good", "toxic", F.explode(F.array(F.struct("mask", F.col("kept").alias("n")), F.struct((F.col("mask") + (1 << COPY)).alias("mask"), (F.col("n") - F.col("kept")).alias("n")))).alias("m"))
    split = split.select("part", "good", "toxic", "m.mask", "m.n").where("n > 0")
    return split.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


# ---- polynomials of one part ----


def removal_polynomial(counts: dict[int, int], filters: int) -> list[int]:
    """Coefficients by set of filters (as a mask): at x, so many documents are removed. counts: documents by mask."""
    out = [0] * (1 << filters)
    for t in range(1, 1 << filters):
        fail_all = sum(n for m, n in counts.items() if m & t == t)
        out[t] = fail_all if t.bit_count() % 2 else -fail_all
    return out


def at_corner(polynomial: list[int], on: int) -> int:
    """The polynomial where the filters of `on` are 1 and the others 0."""
    return sum(c for t, c in enumerate(polynomial) if t & on == t)


def shapley(polynomial: list[int], i: int) -> Fraction:
    """The integral from 0 to 1 of the partial derivative by x_i along the diagonal: t^(k-1) of each set of k filters with i."""
    return sum((Fraction(c, t.bit_count()) for t, c in enumerate(polynomial) if t >> i & 1), Fraction(0))


def orders_of(counts: dict[str, dict[int, int]], filters: str) -> Iterator[tuple[str, int, int, int, int, int, int, int, int]]:
    """(order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of one part. counts: n, good, toxic by mask."""
    k = len(filters)
    every = sum(counts["n"].values())
    values = {}
    for name in ("n", "good", "toxic"):
        polynomial = removal_polynomial(counts[name], k)
        values[name] = [at_corner(polynomial, on) for on in range(1 << k)]
        if name == "n":
            share = [shapley(polynomial, i) * factorial(k) for i in range(k)]
    gone, full = values["n"], (1 << k) - 1
    for order in permutations(range(k)):
        on = 0
        for step, i in enumerate(order, 1):
            now = on | 1 << i
            removed = gone[now] - gone[on]
            if share[i].denominator != 1:
                raise ArithmeticError("a sum over all orders isn't whole")
            yield (
                "".join(filters[j] for j in order), step, every - gone[now], removed, gone[1 << i] - removed, gone[full] - gone[full ^ 1 << i],
                values["good"][now] - values["good"][on], values["toxic"][now] - values["toxic"][on], int(share[i]),
            )
            on = now


_OUT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def interactions(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Every order of the filters and every step of it, by part. counts: as mask_counts gives them; a part has at most a row a mask."""

    def of_part(rows: pd.DataFrame) -> pd.DataFrame:
        masks = {c: dict(zip(rows["mask"].tolist(), rows[c].tolist(), strict=True)) for c in ("n", "good", "toxic")}
        names = _OUT.replace(" string", "").replace(" int", "").replace(" long", "").split(", ")
        return pd.DataFrame([(rows["part"].iloc[0], *r) for r in orders_of(masks, filters)], columns=names)

    return counts.groupBy("part").applyInPandas(of_part, _OUT)


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    return interactions(mask_counts(docs, labels, key, text, part))
