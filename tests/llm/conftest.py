from __future__ import annotations

import re

import pytest

LOWER = {i: i + 32 for i in range(65, 91)}
SPACED, ALNUM = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text, pattern):
    return pattern.findall((text or "").translate(LOWER))


DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
TRICKY = [
    (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "one two"), (6, "a b c"), (7, "A B C"), (8, "a b c"), (9, LONG), (10, LONG + " tail"), (11, "Ünïcode ßtraße Ünïcode ßtraße"), (12, "12 34 !!"),
    (13, " ".join(f"t{i}" for i in range(40))), (14, " ".join(f"t{i}" for i in range(41))), (15, " ".join(["same"] * 500)), (8, "a b c"),
]


@pytest.fixture(scope="session")
def tricky(spark):
    """Null, empty, tiny, huge, repeated and non-ASCII texts, with a repeated row."""
    return spark.createDataFrame([(i, t, "en" if i % 2 else None, "s", len(t or "")) for i, t in TRICKY], DOCS)


@pytest.fixture(scope="session")
def documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


def clash(df):
    """Columns by names that an operator may use within."""
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit(1) for c in ("key", "set", "block", "n", "salt", "rank", "length", "parts", "candidate", "score", "_key", "hot")})
